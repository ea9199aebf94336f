"""Labelled values: each pattern of a rule is sought once a text, by tasks that share the rows out."""

from pyspark.sql import functions as F

from sievework.operators import metrics
from sievework.plans import readings
from tests.conftest import DATA

D = f"{DATA}/sf0.001"


def plan(spark, df):
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)


def test_predictions_seek_each_pattern_once(spark):
    got = readings.prediction_metrics(spark, D)
    text = plan(spark, got)
    assert {p: text.count(f", {p}, 1)") for ps in metrics.PREDICTION.values() for _, p in ps} == {p: 1 for ps in metrics.PREDICTION.values() for _, p in ps}
    # the table is one small part; its rows go to as many tasks as a shuffle has
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = spark.createDataFrame([("내 점수 61.5점  환산점수 70 모집인원 1,200 모집인원 , 수능최저 기준\n충족",), ("모집인원 , 15명 내 점수 수능최저 기준 미충족",), (None,)], "t string")
    a, b, c = metrics.predictions(texts, "t").collect()
    assert (tuple(a.metrics.my_calculated_score), tuple(a.metrics.capacity), a.minimum) == ((61.5, "card"), (1200.0, "label"), None)
    assert (tuple(b.metrics.capacity), b.minimum, b.prediction_label) == ((15.0, "card"), "충족", None) and not any(c.metrics) and c.minimum is None
    both = metrics.predictions(texts, "t").select("metrics", metrics.first_found(F.col("t"), metrics.PREDICTION).alias("m")).collect()
    assert all(r.metrics == r.m for r in both)


def test_summaries_seek_each_pattern_once(spark):
    """Also where pages without any value are left out."""
    text = plan(spark, readings.summary_metrics(spark, D))
    assert {p: text.count(f", {p}, 1)") for ps in metrics.SUMMARY.values() for _, p in ps} == {p: 1 for ps in metrics.SUMMARY.values() for _, p in ps}
    none = [F.lit(None).cast("string").alias(c) for c in ("scope", "mission_key", "mission_confidence", "university", "department", "admission")]
    texts = spark.createDataFrame([("모의지원자 수 12",), ("없음",), (None,), ("소신지원",)], "t string").select("t", *none)
    assert sorted((r.t, r.prediction_label, r.metrics.mock_applicants and r.metrics.mock_applicants.value) for r in metrics.summaries(texts, "t").collect()) == [("모의지원자 수 12", None, 12.0), ("소신지원", "소신지원", None)]


def test_contexts_are_read_once_from_each_text(spark):
    """Each pattern occurs twice in the plan: for what is near, and for the page's whole text, which is only made where that leaves something open."""
    got = readings.page_contexts(spark, D)
    text = plan(spark, got)
    patterns = (*metrics._UNIVERSITY, metrics._UNIT_LABEL, metrics._UNIT, metrics._TRACK_LABEL, metrics._TRACK, metrics._YEAR)
    assert [text.count(f", {p}, 1)") for p in patterns] == [2] * len(patterns)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    spec = "selection array<string>, title string, context array<string>, blocks array<string>, tables array<struct<caption:string,rows:array<array<string>>>>"
    pages = spark.createDataFrame([(["가나대학교"], "수학과 2026년", None, None, [("다라대학교 물리학과 2025년", [])]), ([" "], "2026년", None, ["가나대학교"], [(None, [["화학전공", "전형명: 일반 전형"]])])], spec)
    a, b = metrics.inferred_contexts(pages).collect()
    assert (tuple(a.inferred), tuple(a.sources)) == (("가나대학교", "물리학과", None, 2026), ("selection", "page", None, "selection"))
    assert (tuple(b.inferred), tuple(b.sources)) == (("가나대학교", "화학전공", "일반 전형", 2026), ("selection", "page", "page", "selection"))
