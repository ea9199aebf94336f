"""Where a captured page may lead: lanes and priorities of routes, safe labels, candidates, capability controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..functions import values as V
from .extract import parse_cards

# Lane, base priority, pattern of the path, pattern of URL and label; the first that fits.
LANES = (
    ("saved-applications", 100, "/four-year-university/library", "저장소"),
    ("current-prediction", 96, "/four-year-university/report/pass-predict", None),
    ("actual-admit", 98, "/four-year-university/report/actual-admission", None),
    ("university-result", 92, "/four-year-university/report/admission-result", None),
    ("actual-admit", 98, None, "actual|admitreport|resultreport|passcase|실제합격자"),
    ("mock-support", 94, None, r"sapplysample|모의지원\s*리포트|지원자\s*분포"),
    ("current-prediction", 96, "university-major-predict", r"합격예측\s*리포트|대학.?학과별\s*합격예측|합격안정성"),
    ("university-result", 92, "/univ-major/univ-info/univ-search/detail", r"입시결과|최근\s*3개년\s*경쟁률|모집요강"),
    ("score-analysis", 88, None, "score|calc|성적분석|교과분석|수능최저"),
    ("recommendation", 48, "recommend-university", "추천대학"),
    ("strategy", 68, "/ipsi-analysis/ipsi-strategy", "입시전략"),
    ("admission-knowledge", 64, "/ipsi-knowledge", "입시지식|입시 상식"),
    ("media", 12, "/[a-z0-9]+-tv", None),
    ("reference", 35, "/early/|/univ-major/|/univ-entrance-info/", None),
)
UNKNOWN_LANE = ("unknown", 5)
# The lane of a page type, of a control's label and kind, and the lane that a label hints at; of patterns the first that fits.
REFERENCE = "reference"
PAGE_LANES = {
    "early-storage": "saved-application", "prediction-report": "current-prediction", "mock-support-report": "mock-support", "actual-admit-report": "actual-admit", "university-admission-info": "university-result",
    "score-calc-report": "score-analysis", "sat-minimum": "score-analysis", "admission-strategy": "strategy", "admission-knowledge": "strategy",
}
LABEL_LANES = (
    ("actual-admit", r"실제\s*합격자|과거\s*입시결과"), ("mock-support", r"모의\s*지원|지원자\s*분포"), ("current-prediction", r"합격\s*예측|합격\s*안정성"), ("score-analysis", r"성적\s*분석|성적\s*산출|환산\s*점수"),
    ("university-result", r"대학\s*정보|전형\s*정보|학과\s*정보|입시\s*결과|경쟁률"), ("strategy", r"입시\s*전략|입시\s*지식"),
)
HINT_LANES = (("actual-admit", r"실제\s*합격자|과거\s*입시결과"), ("mock-support", r"모의\s*지원|지원자\s*분포"), ("score-analysis", r"성적\s*(?:분석|산출)|환산\s*점수"), ("current-prediction", r"합격\s*예측|합격\s*안정성"))
SAVED_ORIGIN, SAVED_LABEL = "/four-year-university/library", r"^리포트(?:\s*보기)?$"
# Labels that change something are never followed, of the others only those that read.
UNSAFE_LABEL = r"(?i)원서\s*접수|결제|구매|저장|삭제|탈퇴|로그아웃|회원정보|수정|등록|전송|제출|확정|취소|신청|지원하기|장바구니|쿠폰|동의"
READ_LABEL = (
    r"(?i)실제\s*합격자|입시\s*결과|합격\s*예측|모의\s*지원|지원자\s*분포|합격\s*안정성|상세|보기|조회|검색|리포트|"
    r"(?:대학|전형|학과)\s*정보|수시\s*저장소|정시\s*저장소|추천\s*대학|성적\s*(?:분석|산출)|입시\s*(?:전략|지식)|경쟁률|모집\s*요강|다음|더보기|결과|탭"
)
REPORT_LABEL = r"리포트|실제\s*합격자|모의\s*지원|합격\s*예측"
CANDIDATE = "array<struct<scanIndex:int,label:string,tag:string,kind:string,contextText:string,applicationUniversity:string,applicationDepartment:string,applicationBindingSource:string>>"


def lane(url: Column, label: Column) -> Column:
    """struct(lane, base): the lane of a route and its base priority."""
    path, text = F.lower(F.coalesce(U.path(url), T.text_of(url))), F.lower(F.concat_ws(" ", T.text_of(url), T.text_of(label)))
    fits = lambda p, t: (path.rlike(p) if p else F.lit(False)) | (text.rlike(t) if t else F.lit(False))
    of = lambda name, base: F.struct(F.lit(name).alias("lane"), F.lit(base).alias("base"))
    return F.coalesce(*(F.when(fits(p, t), of(name, base)) for name, base, p, t in LANES), of(*UNKNOWN_LANE))


def _ladder(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    return F.coalesce(*(F.when(text.rlike(p), name) for name, p in rules), F.lit(REFERENCE))


def page_lane(page_type: Column) -> Column:
    """The lane that a page of a type belongs to."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in PAGE_LANES.items() for x in kv))[page_type], F.lit(REFERENCE))


def label_lane(label: Column, kind: Column) -> Column:
    """The lane that a control's label and kind speak of."""
    return _ladder(F.concat(T.text_of(label), F.lit(" "), T.text_of(kind)), LABEL_LANES)


def lane_hint(label: Column) -> Column:
    return _ladder(T.text_of(label), HINT_LANES)


def lane_at_origin(label: Column, kind: Column, origin: Column, page_type: Column) -> Column:
    """As the label says; a bare report label on a page of saved applications leads to the prediction."""
    saved = F.coalesce(page_type == "early-storage", F.lit(False)) | F.contains(T.text_of(origin), F.lit(SAVED_ORIGIN))
    said = label_lane(label, kind)
    return F.when(said != REFERENCE, said).when(saved & T.squeeze(T.text_of(label)).rlike(SAVED_LABEL), "current-prediction").otherwise(REFERENCE)


def priority(url: Column, label: Column) -> Column:
    at, text = lane(url, label), F.concat_ws(" ", T.text_of(url), T.text_of(label))
    more = F.when(text.rlike("2027|수시|학생부교과|학생부종합|지역인재|면접"), 4).otherwise(0) + F.when(text.rlike(r"실제합격자|과거\s*3개년|입시결과|합격예측\s*리포트|모의지원\s*리포트"), 8).otherwise(0)
    return V.clamp(at["base"] + more - F.when(at["lane"] == "media", 6).otherwise(0), 0, 120).cast("int")


def safe_label(label: Column) -> Column:
    return F.coalesce(~label.rlike(UNSAFE_LABEL) & label.rlike(READ_LABEL), F.lit(False))


def candidates(snapshots: DataFrame, key: list[str], target_year: int, promoted: int = 120, others: int = 160) -> DataFrame:
    """The controls of a page that may be followed, best first (place from 1).

    snapshots: key, url, missionAgentActions and agentActions (arrays of
    ``CANDIDATE``; of each the first ``promoted`` and ``others`` count). A null
    array holds none. Equal controls count once. A control that is bound to an
    application ranks before those that aren't.
    """
    empty = F.array().cast(CANDIDATE)
    tagged = lambda c, n, first: F.transform(F.slice(F.coalesce(c, empty), 1, n), lambda x: F.struct(x.alias("c"), F.lit(first).alias("promoted")))
    s = snapshots.select(*key, "url", F.posexplode(F.concat(tagged("missionAgentActions", promoted, True), tagged("agentActions", others, False))).alias("_at", "_c"))
    part = lambda name, most: T.squeeze(T.text_of(F.col(f"_c.c.{name}")), most)
    kind = F.coalesce(F.col("_c.c.kind"), F.lit("read-navigation"))
    s = s.select(
        *key, "url", "_at", F.col("_c.c.scanIndex").alias("scan_index"), part("label", 120).alias("label"), F.substring(T.text_of(F.col("_c.c.tag")), 1, 24).alias("tag"), F.substring(kind, 1, 40).alias("kind"), part("contextText", 2400).alias("context"),
        F.nullif(part("applicationUniversity", 80), F.lit("")).alias("_university"), F.nullif(part("applicationDepartment", 120), F.lit("")).alias("_department"), part("applicationBindingSource", 40).alias("binding_source"), F.col("_c.promoted").alias("promoted"),
    ).filter((F.col("scan_index") >= 0) & (F.col("label") != "") & safe_label(F.col("label")))
    s = parse_cards(s, "context", target_year)
    s = s.withColumns({"university": F.coalesce("_university", "university"), "department": F.coalesce("_department", "department")})
    s = s.withColumn("identity_key", V.identity_key(F.col("year"), F.col("university"), F.col("admission"), F.col("campus"), F.col("department")))
    same = W.partitionBy(*key, "scan_index", "label", "kind", F.coalesce("identity_key", F.substring("context", 1, 1000))).orderBy("_at")
    s = s.withColumn("_n", F.row_number().over(same)).filter("_n = 1")
    bound, link = F.col("identity_key").isNotNull(), F.col("kind") == "mission-link-navigation"
    app = bound | F.coalesce("university", "department", "admission").isNotNull()
    extra = lambda on, n: F.when(on, n).otherwise(0)
    score = priority(F.col("url"), F.col("label")) + extra(bound, 14) + extra(app & F.col("label").rlike(REPORT_LABEL), 8) + extra(bound & (link | (F.col("kind") == "mission-bound-control")), 35) + extra(bound & F.col("promoted"), 45)
    s = s.withColumn("priority", V.clamp(score, 0, 220).cast("int"))
    best = W.partitionBy(*key).orderBy((F.col("promoted") & bound).desc(), (link & bound).desc(), bound.desc(), F.desc("priority"), "scan_index", "_at")
    return s.select(*key, F.row_number().over(best).alias("place"), "scan_index", "label", "tag", "kind", "priority", "identity_key", "university", "department", "admission", "campus", "promoted", "binding_source", "context")


def capabilities(pages: DataFrame, key: list[str], controls: str = "controls") -> DataFrame:
    """A page's controls (array of kind, label, evidenceClass), each once in order, and whether it exports or prints reports."""
    cut = lambda c, n: F.substring(c, 1, n)
    read = F.transform(
        F.coalesce(F.col(controls), F.array().cast("array<struct<kind:string,label:string,evidenceClass:string>>")),
        lambda x: F.struct(cut(T.text_of(x["kind"]), 40).alias("kind"), T.squeeze(T.text_of(x["label"]), 120).alias("label"), cut(F.coalesce(x["evidenceClass"], F.lit("visible-official-ui-control")), 80).alias("evidence_class")),
    )
    p = pages.select(*key, F.filter(read, lambda x: (F.trim(x["kind"]) != "") & (x["label"] != "")).alias("_c"))
    earlier = lambda x, i: F.exists(F.slice(F.col("_c"), F.lit(1), i), lambda y: (y["kind"] == x["kind"]) & (y["label"] == x["label"]))
    has = lambda *kinds: F.exists("_c", lambda x: x["kind"].isin(*kinds))
    return p.select(*key, F.filter("_c", lambda x, i: ~earlier(x, i)).alias("capabilities"), has("structured-export").alias("structured_export"), has("report-output", "download").alias("report_output"))
