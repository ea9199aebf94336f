"""The operators on small made-up fixtures."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions import url as U
from sievework.functions import values as V
from sievework.operators import binding, decide, extract, resume, tables
from sievework.sources import captures, export

UTC = dt.UTC


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x):
    return F.lit(x)


def test_html_table_rows_and_entities(spark):
    html = "<table><tr><th>가&amp;나</th><th> </th></tr><tr><td>1&#44;2</td><td><b>x</b><br>&#x41;&bogus;</td></tr><tr></tr></table>"
    assert one(spark, T.table_rows(lit(html))) == [["가&나"], ["1,2", "x A&bogus;"]]
    assert one(spark, T.html_text(lit("a<script>b</script>&lt;c&gt;&amp;lt;"))) == "a <c>&lt;"


@pytest.mark.parametrize(("a", "b", "said"), [("컴퓨터공학", "컴퓨터공학과", "none"), ("물리", "물리학과", "suffix-equivalent"), ("AI융합학부", "AI융합", "suffix-equivalent"), ("물리학과", "물리학과", "exact"), ("물리학", "화학", "none"), (None, "화학", "missing")])
def test_unit_match(spark, a, b, said):
    assert one(spark, T.unit_match(F.lit(a).cast("string"), lit(b))) == said


def test_track_match_and_variants(spark):
    assert one(spark, T.track_match(lit("학생부종합Ⅰ"), lit("학생부종합Ⅱ"))) == "exact"  # numbers are lost with compat
    assert one(spark, T.track_match(lit("학생부종합Ⅰ"), lit("학생부종합Ⅱ"), compat=False)) == "none"
    cell = lambda c, t: one(spark, T.cell_track_match(lit(c), lit(t), lit("종합")))
    assert cell("학생부종합Ⅱ전형", "학생부종합Ⅱ") == "exact"
    assert cell("학생부종합Ⅰ+Ⅱ", "학생부종합Ⅱ") != "exact"
    assert cell("종합 지역인재", "지역인재 종합") == "exact"
    assert cell("-", "지역인재") == "related"
    assert one(spark, T.cell_track_match(lit("-"), lit("지역인재"), lit("종합"), compat=False)) == "none"


def test_segments_bind_only_under_their_header(spark):
    rows = [
        ["모집단위", "학생부종합Ⅱ"], ["컴퓨터공학과", "10"], ["모집단위", "학생부교과"], ["컴퓨터공학과", "12"], ["비고", "학생부종합Ⅱ"],
    ]
    t = spark.createDataFrame([Row(table_id="t", row=i, cells=c, unit="컴퓨터공", track="학생부종합Ⅱ", kind="종합") for i, c in enumerate(rows)])
    got = binding.segment_bindings(t).collect()
    assert [(r.scope_row, r.unit_row, r.track_match, r.unit_match) for r in got] == [(0, 1, "exact", "suffix-equivalent")]


def test_competition_rows(spark):
    page = [
        ["학생부교과"], ["모집단위", "모집인원", "지원인원", "경쟁률"], ["국어국문학과", "10", "1,005", "100.50:1"], ["10", "20", "2대1"], ["영문학과", "10", "20", "3.0:1"], ["국어국문학과", "10", "1,005", "100.50:1"],
        ["일반전형"], ["수학과", "0", "0", "0:1"],
    ]
    df = spark.createDataFrame([Row(page=1, row=i, cells=c) for i, c in enumerate(page)])
    got = {(r.track, r.unit, r.quota, r.applicants, r.ratio) for r in extract.competition_rows(df, "page").collect()}
    assert got == {("학생부교과", "국어국문학과", 10, 1005, 100.5), ("학생부교과", None, 10, 20, 2.0), ("일반전형", "수학과", 0, 0, 0.0)}


def test_card_grammar(spark):
    cards = spark.createDataFrame([Row(page="p", at=0, text="닫기7칸가나대학교[교과]일반[교과][대전]안경광학3명내 점수 85.5점 (전교과 2.1등급)"), Row(page="p", at=1, text="안내 문구")])
    got = extract.parse_cards(cards, "text", 2027).orderBy("at").collect()
    c = got[0]
    assert (c.university, c.category, c.admission, c.campus, c.department, c.capacity, c.year, c.confidence) == ("가나대학교", "교과", "일반", "대전", "안경광학", 3, 2027, "high")
    assert (c.metrics.my_calculated_score, c.metrics.my_reflected_grade, c.metrics.stability_bars) == (85.5, 2.1, 7.0)
    assert got[1].confidence == "raw" and got[1].identity_key is None
    assert extract.richest_cards(extract.parse_cards(cards, "text", 2027), "page", "at").count() == 1


def test_predictions_need_the_literal_label(spark):
    cand = spark.createDataFrame([Row(identity_key="k", university="가나대", department="안경광학", admission="일반", campus=None, year=2027)], "identity_key string, university string, department string, admission string, campus string, year int")
    spec = "identity_key string, university string, department string, admission string, year int, page string, evidence string, observed_at timestamp, fingerprint string, stability_bars double, capacity double, score double"
    at = dt.datetime(2026, 1, 1)
    good = ("k", "가나대", "안경광학", "일반", 2027, "https://www.example.com/a?x=1", "닫기7칸가나대[교과]일반안경광학3명내 점수85.5점", at, "f", None, None, None)
    rows = [good, (*good[:11], 99.0), (*good[:5], "http://www.example.com/a", *good[6:]), (*good[:6], "다른대[교과]일반안경광학3명내 점수85.5점", *good[7:])]
    got = extract.reverified_predictions(cand, spark.createDataFrame(rows, spec), "example.com").collect()
    assert [(r.stability_bars, r.capacity, r.score, r.source) for r in got] == [(7.0, 3.0, 85.5, "https://www.example.com/a")]


def test_table_evidence_and_unpivot(spark):
    t = spark.createDataFrame([Row(doc=1, title="2025학년도 입시결과", rows=[["모집단위", "경쟁률", "경쟁률"], ["물리학과", "3.1", "4.2"], ["", "", ""]])])
    got = extract.table_evidence(t, ["doc"]).collect()
    assert len(got) == 1 and got[0].columns == {"모집단위": "물리학과", "경쟁률": "3.1", "경쟁률#2": "4.2"} and got[0].year == 2025 and got[0].scope == "historical-reference"
    w = spark.createDataFrame([Row(k=1, header=["전형", "2024학년도", "비고", "2025학년도"], cells=["일반", "3.1", "x", ""])])
    assert [(r.label, r.year, r.value) for r in extract.unpivot_years(w, ["k"]).collect()] == [("일반", 2024, "3.1")]


def test_metrics_and_strategy(spark):
    t = spark.createDataFrame([Row(k=1, text="가나대학교 물리학과 경쟁률: 3.5 모집인원 1,200"), Row(k=2, text="아무것도 없음"), Row(k=3, text=None)], "k int, text string")
    got = extract.metric_records(t, ["k"], "text").collect()
    assert [(r.k, r.metrics.competition, r.metrics.capacity, r.confidence) for r in got] == [(1, 3.5, 1200.0, "high")]
    p = spark.createDataFrame([Row(k=1, title="논술 안내", blocks=["가나대학교의 논술전형 경쟁률은 지난해보다 올랐습니다. 참고하세요."])])
    s = extract.strategy_insights(p, ["k"]).first()
    assert (s.university, s.admission, s.confidence, s.topics) == ("가나대학교", "논술", "medium", ["competition"])


def test_urls(spark):
    u = lit("https://User@www.Example.com/a/b.do?menuId=7&token=x&page=2#f")
    assert one(spark, U.safe_path(u)) == "www.example.com/a/b.do"
    assert one(spark, U.canonical(u)) == "https://www.example.com/a/b.do?menuId=7&page=2"
    assert one(spark, U.family_key(u)) == "/a/b.do?menuId=7"
    assert one(spark, U.parameter(u, "page")) == "2"
    assert one(spark, U.with_parameter(u, "page", lit(3))) == "https://User@www.Example.com/a/b.do?menuId=7&token=x&page=3"
    r = lambda link: one(spark, U.resolve(u, lit(link)))
    assert (r("c"), r("/c"), r("../c"), r("?q"), r("//h/c")) == ("https://www.example.com/a/c", "https://www.example.com/c", "https://www.example.com/c", "https://www.example.com/a/b.do?q", "https://h/c")
    assert one(spark, U.frontier_url(lit("http://www.example.com/"), ("example.com",))) is None
    b = lit("https://h.example.com:8080/x/y/z.html?k=1#f")
    r = lambda link: one(spark, U.resolve(b, lit(link)))
    assert (r("/a/../b"), r("../../../c"), r("./d/./e/"), r(".."), r("f/.."), r("g/../h?u=/../v#w"), r("")) == tuple(
        f"https://h.example.com:8080{x}" for x in ("/b", "/c", "/x/y/d/e/", "/x/", "/x/y/", "/x/y/h?u=/../v#w", "/x/y/z.html?k=1")
    )
    assert (r("http://o.com/a/./b/../c?d"), r("mailto:x@y.z")) == ("http://o.com/a/c?d", "mailto:x@y.z")
    assert one(spark, U.canonical(b)) == "https://h.example.com:8080/x/y/z.html?k=1" and one(spark, U.canonical(lit("https://h.example.com:443/x"))) == "https://h.example.com/x"
    assert one(spark, U.frontier_url(b, ("example.com",))) == "https://h.example.com:8080/x/y/z.html?k=1"
    assert one(spark, U.official(lit("https://ipsi.school.ac.kr/x"))) and not one(spark, U.official(lit("https://ipsi.school.ac.kr/x?token=1")))
    assert not one(spark, U.official(F.lit(None).cast("string")))


def test_values(spark):
    assert one(spark, V.fnv1a(lit("abc"))) == "1a47e90b"
    assert one(spark, V.source_time(lit("2026. 9. 8 기준 17:05"))).isoformat()[:16] == "2026-09-08T08:05"
    assert one(spark, V.refresh_minutes(lit("10분 단위로 업데이트"))) == 10
    assert one(spark, V.past_academic_year(lit("2024학년도 2025학년도"), 2027)) is None
    assert one(spark, V.past_academic_year(lit("2024학년도, 2027학년도"), 2027)) == 2024
    assert one(spark, V.row_year(lit(2024), lit("2024 학년도 결과"), 2027)) == 2024
    assert one(spark, V.finite(lit("NaN").try_cast("double"))) is None
    assert one(spark, V.ratio_fits(lit(0), lit(1), lit(0.0))) is False


def test_resume_defers_after_server_errors(spark):
    now = dt.datetime(2026, 1, 1, 12)
    fam = spark.createDataFrame([Row(f="a", total_pages=4), Row(f="b", total_pages=0)])
    pages = spark.createDataFrame([
        Row(f="a", page=1, state="completed", retry_count=0, error_type=None, updated_at=now), Row(f="a", page=2, state="error", retry_count=2, error_type="server-error", updated_at=now - dt.timedelta(hours=1)),
        Row(f="a", page=3, state="error", retry_count=2, error_type="server-error", updated_at=now - dt.timedelta(hours=7)),
    ], "f string, page int, state string, retry_count int, error_type string, updated_at timestamp")
    got = {r.page: r.status for r in resume.resume_plan(fam, pages, ["f"], F.lit(now)).collect()}
    assert got == {1: "completed", 2: "deferred", 3: "retry", 4: "missing"}


def test_conflict_policies(spark):
    old = spark.createDataFrame([Row(k=1, v="a", t=1), Row(k=2, v="b", t=1)])
    new = spark.createDataFrame([Row(k=2, v="c", t=2), Row(k=3, v="d", t=2), Row(k=3, v="e", t=3), Row(k=None, v="n", t=1), Row(k=None, v="n", t=1)], "k long, v string, t long")
    assert sorted((r.k or 0, r.v) for r in tables.append_new(old, new, ["k"], ["t"]).collect()) == [(0, "n"), (0, "n"), (3, "d")]
    assert sorted((r.k, r.v) for r in tables.keep_last(old.unionByName(new.filter("k is not null")), ["k"], ["t"]).collect()) == [(1, "a"), (2, "c"), (3, "e")]
    merged = tables.upsert(old, spark.createDataFrame([Row(k=1, v=" ", t=9)]), ["k"], ["t"], {"v": "text", "t": "max"})
    assert sorted((r.k, r.v, r.t) for r in merged.collect()) == [(1, "a", 9), (2, "b", 1)]


OUTCOME = "array<struct<verified:boolean,value:double,scale:string,max_score:double,is_primary:boolean>>"
CONV = "struct<verified:boolean,status:string,score:double,max_score:double,scale:string,direction:string,identity_verified:boolean>"
C = (True, "verified", 95.0, 100.0, "s", "higher-is-better", True)
O = (True, 90.0, "s", 100.0, False)


@pytest.mark.parametrize(("conv", "outs", "code"), [
    (C, [O], "ABOVE_REFERENCE"), (None, [O], "UNVERIFIED_CONVERSION"), ((*C[:2], None, *C[3:]), [O], "MISSING_CONVERSION_SCORE"), ((*C[:4], " ", *C[5:]), [O], "MISSING_SCORE_SCALE"),
    ((*C[:5], "up", True), [O], "UNKNOWN_COMPARISON_DIRECTION"), ((*C[:6], False), [O], "UNVERIFIED_APPLICATION_BINDING"), ((*C[:2], float("nan"), *C[3:]), [O], "INVALID_CONVERSION_SCORE"),
    (C, [], "NO_COMPARABLE_OFFICIAL_OUTCOME"), (C, None, "NO_COMPARABLE_OFFICIAL_OUTCOME"), (C, [(True, float("nan"), "s", 100.0, False)], "NO_COMPARABLE_OFFICIAL_OUTCOME"), (C, [(True, 90.0, "s", 900.0, False)], "NO_COMPARABLE_OFFICIAL_OUTCOME"),
    (C, [O, O], "AMBIGUOUS_OFFICIAL_REFERENCE"), (C, [O, (*O[:4], True)], "ABOVE_REFERENCE"), (C, [(*O[:4], True)] * 2, "AMBIGUOUS_PRIMARY_REFERENCE"), ((*C[:5], "lower-is-better", True), [O], "BELOW_REFERENCE"),
])
def test_score_decision(spark, conv, outs, code):
    rows = spark.createDataFrame([("provisional", conv, outs)], f"quality string, conversion {CONV}, outcomes {OUTCOME}")
    r = decide.score_decision(rows).first()
    assert r.decision_code == code and (r.advantage_margin is None) == (r.status == "HOLD")


def _review(**change):
    ok = dict(
        identity_key="k", year=2027, profile_fingerprint="f", source_reviewed=True, rules_reviewed=True, formula_source="https://a.ac.kr/f", formula_excerpt="x", outcome_source="https://a.ac.kr/o", outcome_excerpt="x",
        rules_source="https://a.ac.kr/r", rules_excerpt="x", scale="점", method="m", metric="70%", direction="higher-is-better", own_score=95.0, reference_score=90.0, max_score=100.0, outcome_year=2026,
        eligibility=1, csat=1, documents=3, multiple_applications=1, deadline=dt.datetime(2026, 9, 8),
    ) | change
    return ok


REVIEW = (
    "struct<identity_key:string,year:int,profile_fingerprint:string,source_reviewed:boolean,rules_reviewed:boolean,formula_source:string,formula_excerpt:string,outcome_source:string,outcome_excerpt:string,rules_source:string,rules_excerpt:string,"
    "scale:string,method:string,metric:string,direction:string,own_score:double,reference_score:double,max_score:double,outcome_year:int,eligibility:int,csat:int,documents:int,multiple_applications:int,deadline:timestamp>"
)


@pytest.mark.parametrize(("change", "code"), [
    ({}, "REVIEWABLE"), ({"own_score": 80.0}, "SCORE_RISK"), ({"csat": 2}, "CONDITIONS_RECHECK"), ({"csat": 0}, "HOLD"), ({"deadline": dt.datetime(2026, 9, 6)}, "CONDITIONS_RECHECK"), ({"deadline": None}, "HOLD"),
    ({"formula_source": "http://a.ac.kr"}, "HOLD"), ({"outcome_year": 2027}, "HOLD"), ({"own_score": 101.0}, "HOLD"), ({"own_score": float("nan")}, "HOLD"), ({"scale": "등급", "own_score": 2.0, "reference_score": 3.0, "max_score": 9.0, "direction": "lower-is-better"}, "REVIEWABLE"),
    ({"scale": "등급"}, "HOLD"), ({"identity_key": "other"}, "HOLD"), ({"profile_fingerprint": "old"}, "HOLD"),
])
def test_application_review(spark, change, code):
    spec = f"candidate struct<identity_key:string,year:int,category:string,admission:string>, profile struct<status:string,year:int,fingerprint:string,complete:boolean>, review {REVIEW}"
    rows = spark.createDataFrame([(("k", 2027, "교과", "일반"), ("IMPORTED", 2027, "f", True), tuple(_review(**change).values()))], spec)
    r = decide.application_review(rows, F.lit(dt.datetime(2026, 9, 7))).first()
    assert r.code == code, (r.missing, r.risks)


def test_audit_and_rebind(spark):
    cand = spark.createDataFrame([Row(identity_key=f"a{i}", quality_state="accepted", complete=True) for i in range(6)])
    slots = spark.createDataFrame([Row(slot=i + 1, identity_key=f"a{i}", occupied=True) for i in range(6)])
    a = binding.audit(binding.slots_view(slots, cand), cand).first()
    assert (a.publish_state, a.hub_ready, a.blockers) == ("READY", True, "")
    a = binding.audit(binding.slots_view(slots.filter("slot < 6"), cand.filter("identity_key <> 'a0'")), cand).first()
    assert a.publish_state == "WAITING_FOR_USER_SELECTION" and a.blockers.split(",") == ["six-application-selection-incomplete", "stale-slot-binding", "selected-application-core-coverage-incomplete"]


def test_single_seed(spark):
    seeds = spark.createDataFrame([Row(identity_key="1", university="가나대학교", department="물리학과", admission="일반"), Row(identity_key="2", university="가나대학교", department="물리학과", admission="지역인재")])
    c = spark.createDataFrame([Row(c=1, text="가나대 물리학과 일반"), Row(c=2, text="가나대 물리학과 일반 지역인재"), Row(c=3, text="다라대 물리학과 일반")])
    assert [(r.c, r.identity_key) for r in binding.single_seed(c, seeds, "c", "text").collect()] == [(1, "1")]


def test_transcript(spark, tmp_path):
    (tmp_path / "t.csv").write_text('학년,학기,교과,과목,등급,학점,성취도\n1,1,국어,"국어, 문학",2,4,A\n1,2,수학,수학,4,2,\n2,1,예체능,체육,,2,P\n', encoding="utf-8")
    rows = captures.transcript(spark, str(tmp_path / "t.csv")).withColumn("student", F.lit(1))
    checked = captures.transcript_checked(rows, ["student"])
    assert checked.filter(F.size("errors") > 0).count() == 0
    s = captures.transcript_summary(checked, ["student"]).first()
    assert (s.rows, s.graded, s.ungraded, s.missing_credits) == (3, 2, 1, 0) and abs(s.own_weighted_grade - 16 / 6) < 1e-9
    (tmp_path / "u.csv").write_text("학년,학기,과목,등급,학점\n4,1,a,2,1\n1,1,b,2.5,1\n1,1,c,2,\n1,1,c,x,0\n", encoding="utf-8")
    bad = captures.transcript_checked(captures.transcript(spark, str(tmp_path / "u.csv")).withColumn("student", F.lit(1)), ["student"])
    assert sorted(",".join(r.errors) for r in bad.collect()) == ["duplicate", "grade", "number,credits,duplicate", "place"]


def test_stored_pages_and_export(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.html").write_bytes('<meta charset="euc-kr">가'.encode("euc-kr"))
    (tmp_path / "p" / "b.html").write_bytes(b"x" * 50)
    (tmp_path / "p" / "c.html").write_bytes(b"plain words")
    (tmp_path / "p" / "d.html").write_bytes(b"<html>Just a moment...</html>")
    got = {r.path[-6:]: (r.html, r.rejected) for r in captures.stored_pages(spark, str(tmp_path / "p"), most=40).collect()}
    assert got.pop("a.html")[0].endswith("가")
    assert got == {"b.html": (None, "too-large"), "c.html": (None, "not-html"), "d.html": ("<html>Just a moment...</html>", "challenge")}
    assert captures.stored_pages(spark, str(tmp_path / "p")).filter("rejected = 'too-large'").count() == 0
    export.write_sections(spark, str(tmp_path / "out"), {"records": spark.range(3)}, {"version": 1})
    assert spark.read.json(str(tmp_path / "out/records")).count() == 3
    assert '"sections": ["records"]' in spark.read.text(str(tmp_path / "out/manifest")).first().value


def test_bridge_has_a_time_limit(spark):
    t = dt.datetime(2026, 1, 1)
    e = spark.createDataFrame([Row(k=1, at=t, c="x"), Row(k=1, at=t + dt.timedelta(minutes=4), c=None), Row(k=1, at=t + dt.timedelta(minutes=6), c=None)], "k int, at timestamp, c string")
    assert [r.bridged for r in decide.attach_recent(e, "k", "at", F.col("c").isNotNull(), "c").orderBy("at").collect()] == ["x", "x", None]


def test_all_public_links_of_a_page(spark):
    """A page of more links than a crawl fetches at once keeps them all; a caller may ask for fewer."""
    html = "".join(f'<a href="/p/{i}">x</a>' for i in range(250))
    pages = spark.createDataFrame([(1, "https://example.com/", html)], "page_id long, url string, html string")
    got = extract.public_links(pages, "page_id", ("example.com",)).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 251)) and got[-1].url.endswith("/p/249")
    assert extract.public_links(pages, "page_id", ("example.com",), most=7).count() == 7


def test_bind_records_meets_units_by_one_suffix(spark):
    """Units that differ by one suffix meet once, also where the shorter one ends in a suffix itself."""
    records = spark.createDataFrame([(f"r{i}", "t", 0, "가나대학교", d, "일반") for i, d in enumerate(["물리", "물리학과", "물리학과전공", "화학", None])], "fingerprint string, record_type string, year int, university string, department string, admission string")
    apps = records.select(F.col("fingerprint").alias("identity_key"), "year", "university", "department", "admission")
    got = sorted((r.identity_key, r.fingerprint, r.unit_match) for r in binding.bind_records(records, apps).collect())
    want = [("r0", "r0", "exact"), ("r0", "r1", "suffix-equivalent"), ("r1", "r0", "suffix-equivalent"), ("r1", "r1", "exact"), ("r1", "r2", "suffix-equivalent"), ("r2", "r1", "suffix-equivalent"), ("r2", "r2", "exact"), ("r3", "r3", "exact")]
    assert got == want
