"""What kind of page a snapshot shows, and the records of list, index and detail pages.

Snapshots have the columns of ``captures.SNAPSHOT``; records have those of
``captures.RECORD`` behind the given key columns. Null or missing cells are
empty texts, values that can't be read are null in ``metrics``, snapshots
without tables give no list records, and equal rows of a snapshot count once
(the first stays).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..functions import values as V

# Page type, what its URL contains; the first that fits.
OFFICIAL_PAGES = (
    ("university-list", "/ucp/uvt/uni/univView.do"),
    ("department-list", "/ucp/cls/uni/classUnivView.do"),
    ("admission-list", "/ucp/prc/uni/admssUnivView.do"),
    ("university-detail", "/ucp/uvt/uni/univDetailSelection.do"),
    ("criteria-result-detail", "/uct/acd/ade/criteriaAndResultPopup.do"),
    ("university-characteristics", "/uct/acd/adc/characteristicsView.do"),
    ("university-guide", "/uct/acd/ueg/univEtenGuideView.do"),
    ("criteria-result", "/uct/acd/ade/criteriaAndResultView.do"),
    ("disabled-admission", "/uct/acd/dia/disabledAdmssView.do"),
    ("score-analysis", "/sco/"),
)
# Page type, patterns of the URL, its path, the title or the headings; the first that fits.
REPORT_PAGES = (
    ("login", {"url": "login|signin", "headings": "로그인.*비밀번호"}),
    ("navigation-error", {"title": r"(?i)^(?:302\s+Found|404\s+Not\s+Found|500(?:\s+Internal\s+Server\s+Error)?)$"}),
    ("university-admission-info", {"title": r"^.{2,100}에 대한 모든 입시정보\s*\|\s*대학정보\s*\|[^|]+$"}),
    ("admission-strategy", {"path": "/univ-entrance-info/ipsi-analysis/ipsi-strategy"}),
    ("admission-knowledge", {"path": "/ipsi-knowledge"}),
    ("admission-feature", {"path": "/univ-entrance-info/susi-special"}),
    ("media-content", {"path": "/[a-z0-9]+-tv"}),
    ("editorial-content", {"path": "/univ-major/major-info/major-deep-analysis|/univ-entrance-info/ipsi-analysis/ipsi-deep-analysis", "title": r"학과\s*심층분석|대학\s*심층분석|대학학과\s*심층분석|지도로\s*보는\s*대학|대학교\s*지도|캠퍼스맵"}),
    ("home", {"path": r"^/?$|/index(?:\.html)?$"}),
    ("mock-support-report", {"url": "sapplysample", "headings": r"모의지원\s*리포트"}),
    ("actual-admit-report", {"url": "actual|admitreport|resultreport|passcase", "headings": r"실제합격자\s*(?:리포트|사례)|합격자\s*리포트|전년도\s*입시결과\s*(?:리포트|상세)"}),
    ("sat-minimum", {"url": "esatminuniv", "path": "/sat-minimum|/minimum-requirement"}),
    ("student-basic", {"url": r"infoview\.aspx"}),
    ("score-calc-report", {"url": "score|calc", "headings": r"성적산출\s*리포트"}),
    ("early-storage", {"url": "storage|save", "headings": "저장소|저장대학"}),
    ("university-search", {"url": "four-year-university/search", "headings": "대학검색"}),
    ("curation", {"url": "/curation", "headings": "큐레이션"}),
    ("recommended-university", {"headings": "추천대학"}),
    ("prediction-report", {"url": "predict|possibility|admission-report|support-report", "headings": r"합격예측\s*(?:리포트|결과)|[0-9]{1,2}\s*칸"}),
)
HEADINGS = 16
_CAMPUS = r"(본교|분교|제\d+캠퍼스)"
_UNIVERSITY = rf"(?:대학교|대학)(?:\([^()]{{1,60}}\))?(?:\[{_CAMPUS}\])?$"
_NO_RESULT = "검색결과가 없습니다"
CRITERIA_LABELS = ("학생부위주(종합)", "학생부위주(교과)", "수능위주")


def official_page_type(url: Column) -> Column:
    return F.coalesce(*(F.when(F.contains(url, F.lit(part)), kind) for kind, part in OFFICIAL_PAGES), F.lit("other"))


def report_page_type(url: Column, title: Column, context: Column) -> Column:
    """By URL, title and the first headings, never by a page's whole text, whose menus name every kind."""
    low = F.lower(T.text_of(url))
    of = {
        "url": low, "path": F.coalesce(F.lower(U.path(url)), F.lit("/")), "title": T.squeeze(T.text_of(title)),
        "headings": T.squeeze(F.concat_ws(" ", T.text_of(title), F.array_join(F.slice(F.coalesce(context, F.array().cast("array<string>")), 1, HEADINGS), " "))),
    }

    def fits(patterns: dict[str, str]) -> Column:
        out = F.lit(False)
        for name, p in patterns.items():
            out = out | of[name].rlike(p)
        return out

    return F.coalesce(*(F.when(fits(p), kind) for kind, p in REPORT_PAGES), F.lit("other"))


def university_cell(c: Column) -> Column:
    """A university's name with its brackets closed up."""
    return T.squeeze(F.regexp_replace(T.text_of(c), r"\s+(?=[(\[])", ""))


def looks_like_university(c: Column) -> Column:
    return F.coalesce((c != "") & ~F.contains(c, F.lit("대학명을 클릭")) & ~c.isin("일반대학", "전문대학") & c.rlike(_UNIVERSITY), F.lit(False))


def campus_of(university: Column) -> Column:
    return F.nullif(F.regexp_extract(university, rf"\[{_CAMPUS}\]$", 1), F.lit(""))


def _first(c: Column, pattern: str, kind: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).try_cast(kind)


def _said(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


Cell = Callable[[int], Column]


class ListPage(NamedTuple):
    """Where a kind of list keeps what: metrics take the readers of row and header cells and the page's year."""

    record: str
    width: int
    metrics: Callable[[Cell, Cell, Column], dict[str, Column]]
    university: int = 0
    department: int | None = None
    year: str | None = "url"
    ordinal: bool = False
    admission: str | None = None


def _competition(c: Column, head: Column) -> dict[str, Column]:
    both = V.pair_of_competition(c)
    return {"earlyCompetition": both["early"], "regularCompetition": both["regular"], "competitionYear": _first(head, r"(20\d{2})\s*경쟁률", "int")}


_NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
LIST_PAGES = {
    "university-list": ListPage("university-summary", 6, lambda c, h, y: {"region": _said(c(1)), **_competition(c(2), h(2)), "enrollmentCapacity": V.integer(c(3)), "departmentCount": V.integer(c(4)), "admissionCount": V.integer(c(5))}, ordinal=True),
    "department-list": ListPage("department-summary", 5, lambda c, h, y: {"region": _said(c(2)), **_competition(c(3), h(3)), "enrollmentCapacity": V.integer(c(4)), "hasAdmissionResult": F.contains(c(5), F.lit("입시결과"))}, university=1, department=0, ordinal=True),
    "admission-list": ListPage(
        "admission-search-summary", 6,
        lambda c, h, y: {"region": _said(c(2)), "previousCompetition": _first(c(3), _NUMBER, "double"), "competitionYear": y - 1, "capacity": V.integer(c(4)), "previousAdmissionGrade": _first(c(5), _NUMBER, "double"), "historicalResultYear": y - 1},
        department=1, ordinal=True,
    ),
    "university-characteristics": ListPage("university-characteristics-index", 3, lambda c, h, y: {"recruitmentTotal": V.integer(c(1)), "registeredAt": _said(c(2))}, year=None),
    "university-guide": ListPage("university-guide-index", 2, lambda c, h, y: {"registeredAt": _said(c(1))}, year=None),
    "criteria-result": ListPage(
        "criteria-result-index", 5,
        lambda c, h, y: {
            "holisticRecruitment": V.integer(c(1)), "curriculumRecruitment": V.integer(c(2)), "csatRecruitment": V.integer(c(3)), "registeredAt": _said(c(4)),
            "columnLabels": F.to_json(F.col("_labels")), "admissionYear": y, "historicalResultYear": y - 1,
        },
    ),
    "disabled-admission": ListPage("disabled-admissions-index", 2, lambda c, h, y: {"admittedStudents": V.integer(c(1))}, year="header", admission="대학별 장애인 전형"),
}


def _fingerprint(kind: Column, year: Column, evidence: Column) -> Column:
    return F.concat(F.lit("yr:"), F.coalesce(year.cast("string"), F.lit("na")), F.lit(":"), F.sha2(F.concat(kind, F.lit("|"), evidence), 256))


def _once(records: DataFrame, key: list[str], order: str) -> DataFrame:
    rest = [c for c in records.columns if c not in (*key, "sourceRowFingerprint", order)]
    first = records.groupBy(*key, "sourceRowFingerprint").agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return first.select(*key, "sourceRowFingerprint", "_r.*").select(*(c for c in records.columns if c != order))


def list_records(snapshots: DataFrame, key: list[str], evidence: int | None = None) -> DataFrame:
    """Records of the first table of list and index pages: rows below the header that are wide enough and name a university.

    ``evidence`` cuts the evidence kept (the older collector: 3000), never what the fingerprint is made of.
    """
    url = F.col("url")
    page = F.greatest(F.coalesce("collectionPage", F.lit(1)), F.lit(1))
    size = F.coalesce(F.when(F.col("collectionPagination.pageSize") > 0, F.col("collectionPagination.pageSize")), F.col("listMeta.visibleDataRows"))
    rows = F.get("tables", F.lit(0))["rows"]
    second = F.transform(F.slice(F.get(rows, F.lit(1)), 1, 3), T.text_of)
    labelled = (F.size(second) == 3) & F.forall(second, lambda x: F.contains(x, F.lit("위주")))
    s = snapshots.select(
        *key, url.alias("sourcePage"), official_page_type(url).alias("_kind"), U.parameter(url, "searchSyr").try_cast("int").alias("_year"), page.alias("sourcePageNumber"), size.alias("_size"), F.get(rows, F.lit(0)).alias("_head"),
        F.when(labelled, second).otherwise(F.array(*(F.lit(x) for x in CRITERIA_LABELS))).alias("_labels"), rows.alias("_rows"),
    ).filter(F.col("_kind").isin(*LIST_PAGES))
    s = s.select("*", F.posexplode("_rows").alias("_row", "_cells")).drop("_rows").filter("_row > 0")
    s = s.withColumn("_cells", F.transform("_cells", T.text_of))
    cell = lambda i: T.text_of(F.get("_cells", F.lit(i)))
    head = lambda i: T.text_of(F.get("_head", F.lit(i)))
    chosen = lambda f: F.coalesce(*(F.when(F.col("_kind") == kind, f(p)) for kind, p in LIST_PAGES.items()))
    none = F.lit(None).cast("string")
    years = {"url": F.col("_year"), "header": _first(head(1), r"(20\d{2})", "int"), None: F.lit(None).cast("int")}
    named = lambda p: F.replace(cell(p.university), F.lit("상세정보"), F.lit("")) if p.year == "header" else cell(p.university)
    as_map = lambda m: F.create_map(*(x for n, c in m.items() for x in (F.lit(n), c.cast("string"))))
    s = s.withColumns({
        "recordType": chosen(lambda p: F.lit(p.record)), "university": university_cell(chosen(named)), "department": chosen(lambda p: none if p.department is None else F.trim(cell(p.department))),
        "year": chosen(lambda p: years[p.year]), "admission": chosen(lambda p: F.lit(p.admission).cast("string")), "_wide": F.size("_cells") >= chosen(lambda p: F.lit(p.width)),
        "rawEvidence": F.array_join("_cells", " | "),
        "sourceRowOrdinal": F.when(chosen(lambda p: F.lit(p.ordinal)) & (F.col("_size") > 0), (F.col("sourcePageNumber") - 1) * F.col("_size") + F.col("_row")),
    })
    with_unit = [k for k, p in LIST_PAGES.items() if p.department is not None]
    unit = ~F.col("_kind").isin(*with_unit) | ((F.col("department") != "") & ~F.contains("department", F.lit(_NO_RESULT)))
    s = s.filter(F.col("_wide") & unit & looks_like_university(F.col("university")))
    s = s.withColumns({"metrics": chosen(lambda p: as_map(p.metrics(cell, head, F.col("_year")))), "campus": campus_of(F.col("university")), "confidence": F.lit("high"), "sourceRowFingerprint": _fingerprint(F.col("recordType"), F.col("year"), F.col("rawEvidence"))})
    columns = ("sourceRowFingerprint", "recordType", "university", "campus", "department", "admission", "sourcePage", "confidence", "rawEvidence", "year", "sourcePageNumber", "sourceRowOrdinal", "metrics")
    s = s if evidence is None else s.withColumn("rawEvidence", F.substring("rawEvidence", 1, evidence))
    return _once(s.select(*key, *columns, "_row"), key, "_row")


_RESULTS = r"경쟁률|충원|최종등록|등록자|50%|70%|입시결과|전형 결과"
_NAMED = r"([가-힣A-Za-z0-9·()\- ]+(?:대학교|대학)(?:\[[^\]]+\])?)"


def detail_records(snapshots: DataFrame, key: list[str], name_blocks: int | None = None, text_blocks: int | None = None, evidence: int | None = None) -> DataFrame:
    """A record for each table of a detail page, past results apart from present criteria; a page without tables gives its text.

    The university is the first that the headings or the blocks name. All blocks
    count and all evidence is kept; the older collector took 60, 80 and 12,000.
    Fingerprints are made of whole tables and texts.
    """
    url, empty = F.col("url"), F.array().cast("array<string>")
    context, blocks = F.coalesce("context", empty), F.coalesce("blocks", empty)
    names = F.transform(F.concat(context, blocks if name_blocks is None else F.slice(blocks, 1, name_blocks)), lambda t: university_cell(F.regexp_extract(T.text_of(t), _NAMED, 1)))
    numbered = F.transform("tables", lambda t, i: F.struct(i.alias("at"), t["caption"].alias("caption"), t["rows"].alias("rows")))
    s = snapshots.filter(official_page_type(url).isin("university-detail", "criteria-result-detail")).select(
        *key, url.alias("sourcePage"), F.coalesce("collectionPage", F.lit(1)).alias("sourcePageNumber"), U.parameter(url, "searchSyr").try_cast("int").alias("_year"), U.parameter(url, "unvCd").alias("_code"),
        F.get(F.filter(names, looks_like_university), F.lit(0)).alias("university"), F.trim(F.array_join(F.concat(context, blocks if text_blocks is None else F.slice(blocks, 1, text_blocks)), " ")).alias("_text"),
        F.explode_outer(F.filter(numbered, lambda t: F.size(t["rows"]) > 0)).alias("_t"),
    )
    tabled = F.col("_t").isNotNull()
    s = s.withColumns({"_told": F.when(tabled, F.to_json("_t.rows")).otherwise(F.col("_text")), "_past": F.col("_year") - 1})
    past = tabled & F.coalesce(F.contains("_told", F.concat(F.col("_past").cast("string"), F.lit("학년도"))) | (F.col("_past").isNotNull() & F.col("_told").rlike(_RESULTS)), F.lit(False))
    s = s.filter("_told <> ''").withColumns({
        "recordType": F.when(~tabled, "university-detail-text").when(past, "historical-admission-result-table").otherwise("current-admission-criteria-table"), "year": F.when(past, F.col("_past")).otherwise(F.col("_year")),
    })
    lines = F.array_join(F.transform("_t.rows", lambda r: F.to_json(r)), " | ")
    of_text = F.sha2(F.concat(F.coalesce(F.col("_year").cast("string"), F.lit("na")), F.lit("|"), F.col("_text")), 256)
    always = [F.lit("admissionYear"), F.col("_year").cast("string"), F.lit("historicalResultYear"), F.col("_past").cast("string"), F.lit("universityCode"), F.col("_code")]
    of_table = F.create_map(*always, F.lit("tableIndex"), F.col("_t.at").cast("string"), F.lit("caption"), _said(F.col("_t.caption")), F.lit("rows"), F.col("_told"))
    none = F.lit(None)
    s = s.select(
        *key, F.when(tabled, _fingerprint(F.col("recordType"), F.col("year"), lines)).otherwise(of_text).alias("sourceRowFingerprint"), "recordType", "university", campus_of(F.col("university")).alias("campus"), none.cast("string").alias("department"),
        none.cast("string").alias("admission"), "sourcePage", F.when(tabled & F.col("university").isNotNull() & F.col("year").isNotNull(), "high").otherwise("medium").alias("confidence"), (F.col("_told") if evidence is None else F.substring("_told", 1, evidence)).alias("rawEvidence"),
        "year", "sourcePageNumber", none.cast("int").alias("sourceRowOrdinal"), F.when(tabled, of_table).otherwise(F.create_map(*always)).alias("metrics"), F.coalesce("_t.at", F.lit(0)).alias("_at"),
    )
    return _once(s, key, "_at")


def page_records(snapshots: DataFrame, key: list[str]) -> DataFrame:
    return list_records(snapshots, key).unionByName(detail_records(snapshots, key))
