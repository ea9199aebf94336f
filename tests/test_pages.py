"""Page kinds, list and detail parsers, navigation, on small made-up snapshots."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sievework.operators import navigate, pages
from sievework.sources import captures

BASE = "https://example.com"


def snapshots(spark, *rows):
    text = [json.dumps(r, ensure_ascii=False) for r in rows]
    return spark.createDataFrame([(t,) for t in text], "j string").select(F.from_json("j", captures.SNAPSHOT).alias("s")).select("s.*")


def shot(path, rows=None, key="k", **more):
    return {"navigationKey": key, "url": BASE + path, "tables": [] if rows is None else [{"caption": "", "rows": rows}], **more}


def records(spark, f, *rows):
    return sorted(f(snapshots(spark, *rows), ["navigationKey"]).collect(), key=lambda r: (r.navigationKey, r.recordType, r.rawEvidence))


def test_university_list(spark):
    head = ["대학명", "지역", "2026 경쟁률", "정원", "학과", "전형"]
    good = ["가나대학교 [제2캠퍼스]", "서울", "수시 7.5 정시 4", "1,200", "30", "x"]
    page = shot("/ucp/uvt/uni/univView.do?searchSyr=2027", [head, good, good, ["짧은대학교", "서울"], ["일반대학", "", "", "", "", ""], ["다라고등학교", "a", "b", "1", "2", "3"]], collectionPage=3, collectionPagination={"pageSize": 10})
    got = records(spark, pages.list_records, page)
    assert len(got) == 1  # repeated, short and foreign rows go
    r = got[0]
    assert (r.recordType, r.university, r.campus, r.department, r.year, r.sourcePageNumber, r.sourceRowOrdinal, r.confidence) == ("university-summary", "가나대학교[제2캠퍼스]", "제2캠퍼스", None, 2027, 3, 21, "high")
    assert r.metrics == {"region": "서울", "earlyCompetition": "7.5", "regularCompetition": "4.0", "competitionYear": "2026", "enrollmentCapacity": "1200", "departmentCount": "30", "admissionCount": None}
    assert r.sourceRowFingerprint == "yr:2027:" + hashlib.sha256(("university-summary|" + " | ".join(good)).encode()).hexdigest()


def test_department_and_admission_lists(spark):
    d = shot("/ucp/cls/uni/classUnivView.do", [["h"] * 6, ["물리학과", "가나대학교", "부산", "정시 2.5", "40", "입시결과 보기"], ["검색결과가 없습니다.", "가나대학교", "", "", ""], ["화학과", "가나대학교", "", "", "x"]], key="d", listMeta={"visibleDataRows": 5})
    a = shot("/ucp/prc/uni/admssUnivView.do?searchSyr=2027", [["h"] * 6, ["가나대학교", "물리학과", "", "경쟁 12.5:1", "7", "평균 3.2등급"]], key="a")
    got = records(spark, pages.list_records, d, a)
    assert [(r.recordType, r.department, r.year, r.sourceRowOrdinal) for r in got] == [("admission-search-summary", "물리학과", 2027, None), ("department-summary", "물리학과", None, 1), ("department-summary", "화학과", None, 3)]
    assert got[0].metrics == {"region": None, "previousCompetition": "12.5", "competitionYear": "2026", "capacity": "7", "previousAdmissionGrade": "3.2", "historicalResultYear": "2026"}
    assert got[1].metrics["hasAdmissionResult"] == "true" and got[2].metrics["hasAdmissionResult"] == "false"
    assert got[1].metrics["earlyCompetition"] is None and got[1].metrics["regularCompetition"] == "2.5"


def test_index_pages(spark):
    labels = ["종합위주", "교과위주", "수능위주"]
    rows = (
        shot("/uct/acd/adc/characteristicsView.do?searchSyr=2027", [["h"], ["가나대학교", "1,000", "2026.1.1"]], key="a"),
        shot("/uct/acd/ueg/univEtenGuideView.do", [["h"], ["가나대학교", " "]], key="b"),
        shot("/uct/acd/ade/criteriaAndResultView.do?searchSyr=2027", [["h"], labels, ["가나대학교", "1", "2", "-", "d"]], key="c"),
        shot("/uct/acd/ade/criteriaAndResultView.do", [["h"], ["가나대학교", "1", "2", "3", "d"]], key="d"),
        shot("/uct/acd/dia/disabledAdmssView.do", [["대학", "2025 입학"], ["가나대학교 상세정보", "12"]], key="e"),
        shot("/uct/acd/dia/disabledAdmssView.do", key="f"),
    )
    got = {r.navigationKey: r for r in records(spark, pages.list_records, *rows)}
    assert {k: (r.recordType, r.year) for k, r in got.items()} == {
        "a": ("university-characteristics-index", None), "b": ("university-guide-index", None), "c": ("criteria-result-index", 2027), "d": ("criteria-result-index", None), "e": ("disabled-admissions-index", 2025),
    }
    assert got["a"].metrics == {"recruitmentTotal": "1000", "registeredAt": "2026.1.1"} and got["b"].metrics == {"registeredAt": None}
    assert json.loads(got["c"].metrics["columnLabels"]) == labels and got["c"].metrics["csatRecruitment"] is None and got["c"].metrics["historicalResultYear"] == "2026"
    assert json.loads(got["d"].metrics["columnLabels"]) == list(pages.CRITERIA_LABELS)
    assert got["e"].admission == "대학별 장애인 전형" and got["e"].university == "가나대학교"


def test_detail_pages(spark):
    past, now = [["2026학년도", "모집"], ["물리", "3"]], [["전형", "모집"], ["물리", "3"]]
    a = {"navigationKey": "a", "url": BASE + "/ucp/uvt/uni/univDetailSelection.do?searchSyr=2027&unvCd=0001", "context": ["안내", "가나대학교[본교] 소개"], "tables": [{"rows": []}, {"caption": "표", "rows": past}, {"rows": now}, {"rows": now}]}
    b = {"navigationKey": "b", "url": BASE + "/uct/acd/ade/criteriaAndResultPopup.do", "context": ["아무것"], "blocks": ["글"]}
    c = {"navigationKey": "c", "url": BASE + "/uct/acd/ade/criteriaAndResultPopup.do"}
    got = records(spark, pages.detail_records, a, b, c)
    assert [(r.navigationKey, r.recordType, r.year, r.university, r.campus, r.confidence) for r in got] == [
        ("a", "current-admission-criteria-table", 2027, "가나대학교[본교]", "본교", "high"), ("a", "historical-admission-result-table", 2026, "가나대학교[본교]", "본교", "high"), ("b", "university-detail-text", None, None, None, "medium"),
    ]
    assert got[1].metrics["tableIndex"] == "1" and got[1].metrics["caption"] == "표" and json.loads(got[1].metrics["rows"]) == past and got[1].metrics["universityCode"] == "0001"
    assert got[2].rawEvidence == "아무것 글" and got[2].sourceRowFingerprint == hashlib.sha256("na|아무것 글".encode()).hexdigest()
    assert pages.page_records(snapshots(spark, a, b, c), ["navigationKey"]).count() == 3


@pytest.mark.parametrize(("path", "title", "context", "said"), [
    ("/Login", "", [], "login"), ("/x", "404 not found", [], "navigation-error"), ("/x", "가나대학교에 대한 모든 입시정보 | 대학정보 | 사이트", [], "university-admission-info"), ("/my-tv/1", "", [], "media-content"),
    ("/index.html", "모의지원 리포트", [], "home"), ("/x", "", ["모의지원  리포트"], "mock-support-report"), ("/score/x", "", [], "score-calc-report"), ("/x", "", ["7 칸"], "prediction-report"), ("/x", None, None, "other"),
    ("/x", "", ["-"] * 16 + ["7 칸"], "other"),
])
def test_report_page_type(spark, path, title, context, said):
    df = spark.createDataFrame([(BASE + path, title, context)], "u string, t string, c array<string>")
    assert df.select(pages.report_page_type(F.col("u"), F.col("t"), F.col("c")).alias("x")).first().x == said


def test_official_page_type(spark):
    df = spark.createDataFrame([(BASE + "/sco/a",), (BASE + "/",), (None,)], "u string")
    assert [r.x for r in df.select(pages.official_page_type(F.col("u")).alias("x")).collect()] == ["score-analysis", "other", "other"]


def test_candidates(spark):
    card = "가나대학교[교과]일반[대전]안경광학3명내 점수 85.5점"
    act = lambda i, label, kind="read-navigation", context="", **more: {"scanIndex": i, "label": label, "kind": kind, "contextText": context, **more}
    one = [act(5, "리포트 보기", "mission-link-navigation", card), act(6, "결제하기 보기")]
    two = [act(1, "상세"), act(1, "상세"), act(2, "상세", "mission-bound-control", card), act(-1, "상세"), act(3, "아무"), act(4, "입시전략 보기")]
    j = json.dumps({"k": 1, "url": BASE + "/a", "missionAgentActions": one, "agentActions": two}, ensure_ascii=False)
    df = spark.createDataFrame([(j,), ('{"k": 2, "url": null}',)], "j string").select(F.from_json("j", f"k int, url string, missionAgentActions {navigate.CANDIDATE}, agentActions {navigate.CANDIDATE}").alias("s")).select("s.*")
    got = navigate.candidates(df, ["k"], 2027).orderBy("place").collect()
    assert [(r.place, r.scan_index, r.priority, r.promoted, r.identity_key is not None) for r in got] == [(1, 5, 5 + 14 + 8 + 35 + 45, True, True), (2, 2, 5 + 14 + 35, False, True), (3, 4, 68, False, False), (4, 1, 5, False, False)]


@pytest.mark.parametrize(("path", "label", "said"), [
    ("/four-year-university/library", "", ("saved-applications", 100)), ("/x", "실제합격자", ("actual-admit", 106)), ("/my-tv", "", ("media", 6)), ("/early/a", "수시", ("reference", 39)), ("/x", None, ("unknown", 5)),
])
def test_lanes(spark, path, label, said):
    df = spark.createDataFrame([(BASE + path, label)], "u string, l string")
    r = df.select(navigate.lane(F.col("u"), F.col("l")).alias("x"), navigate.priority(F.col("u"), F.col("l")).alias("p")).first()
    assert (r.x.lane, r.p) == said


def test_capabilities(spark):
    spec = "k int, controls array<struct<kind:string,label:string,evidenceClass:string>>"
    df = spark.createDataFrame([(1, [("download", " 받기  표 ", None), ("download", "받기 표", "x"), ("", "a", None), ("other", None, None)]), (2, None)], spec)
    a, b = navigate.capabilities(df, ["k"]).orderBy("k").collect()
    assert [tuple(c) for c in a.capabilities] == [("download", "받기 표", "visible-official-ui-control")]
    assert (a.structured_export, a.report_output) == (False, True) and (b.capabilities, b.structured_export, b.report_output) == ([], False, False)


def test_nothing_is_lost_behind_a_cut(spark):
    """Tables that differ after thousands of characters are records of their own, with their whole evidence; the older limits are parameters."""
    long = ["칸" * 50] * 100
    rows = lambda end: [["모집단위", *long, end]]
    page = {"url": "https://x.kr/ucp/uvt/uni/univDetailSelection.do?searchSyr=2026&unvCd=7", "navigationKey": "n", "tables": [{"caption": "", "rows": rows("a")}, {"caption": "", "rows": rows("b")}, {"caption": "", "rows": rows("a")}]}
    df = snapshots(spark, page)
    got = pages.detail_records(df, ["navigationKey"]).collect()
    assert len(got) == 2 and len({r.sourceRowFingerprint for r in got}) == 2 and all(len(r.rawEvidence) > 5000 for r in got)
    assert [len(r.rawEvidence) for r in pages.detail_records(df, ["navigationKey"], evidence=100).collect()] == [100, 100]
