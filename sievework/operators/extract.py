"""From captured documents to rows: tables, links, cards, labelled metrics, topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..functions import values as V
from .tables import carried

# What a header cell of a competition table speaks of.
HEADER_ROLES = {
    "track": "전형명|전형",
    "unit": "모집단위|학과|전공",
    "quota": "모집인원|모집정원|정원",
    "applicants": "지원인원|지원자수|지원자",
    "ratio": "경쟁률",
}
TOTALS = "합계|총계|모집인원|지원인원|경쟁률"
#: topic, pattern; fixed values.
TOPICS = (
    ("admission-result-interpretation", r"입시결과|입결|70%\s*컷|50%\s*컷|합격선"),
    ("competition", r"경쟁률|실질\s*경쟁률|충원|추가합격"),
    ("student-record", "학생부|내신|교과성적|석차등급"),
    ("holistic", "학생부종합|학종|서류|정성평가|학업역량|진로역량"),
    ("curricular", "학생부교과|교과전형|교과우수|지역인재"),
    ("minimum", "수능최저|최저학력기준"),
    ("interview", "면접|서류면접|면접평가"),
    ("school-type", "일반고|자사고|특목고|고교유형"),
    ("support-strategy", r"상향|적정|안정|소신|지원전략|6장|지원\s*조합"),
    ("mock-support", r"모의지원|지원자\s*분포|지원경향"),
)
TYPE_SIGNALS = (("학생부교과", "학생부교과|교과전형"), ("학생부종합", "학생부종합|학종"), ("지역인재", "지역인재"), ("면접", "면접"), ("논술", "논술"), ("실기", "실기"))
RELEVANT = r"입결|입시결과|70%\s*컷|50%\s*컷|경쟁률|충원|수능최저|학생부교과|학생부종합|학종|면접|모의지원|지원전략|합격선|일반고|자사고"
ENTITY = r"([가-힣A-Za-z0-9·.&()\-]{2,45}(?:대학교|교육대학교|과학기술원)(?:\([^)]+\))?)"
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
#: Labelled numbers of a card: name, pattern; fixed values.
CARD_METRICS = {
    "my_calculated_score": rf"내\s*점수\s*[:：]?\s*{NUMBER}\s*점",
    "my_reflected_grade": rf"내\s*점수.{{0,100}}?(?:전교과|반영(?:평균)?등급)\s*[:：]?\s*{NUMBER}\s*등급",
    "mock_average_score": rf"모의지원자\s*평균(?:점|점수)?\s*[:：]?\s*{NUMBER}\s*점?",
    "mock_average_grade": rf"모의지원자\s*평균.{{0,120}}?(?:전교과\s*)?{NUMBER}\s*등급",
    "previous_competition": rf"전년도(?:\s*수시)?\s*경쟁률\s*[:：]?\s*{NUMBER}",
    "mock_competition": rf"(?:실시간\s*수시\s*)?모의지원\s*경쟁률\s*[:：]?\s*{NUMBER}",
    "mock_applicants": r"모의지원자\s*(?:수|인원)\s*[:：]?\s*([0-9,]+)",
    "my_rank": r"(?:내\s*순위|나의\s*순위|현재\s*순위)\s*[:：]?\s*([0-9,]+)",
    "predicted_cut": rf"(?:예상\s*합격선|예상\s*컷|합격예상점수|적정지원컷)\s*[:：]?\s*{NUMBER}",
    "stability_bars": r"(?<![0-9.])(?:합격안정성|칸수|칸\s*수)?\s*[:：]?\s*([0-9]{1,2})\s*칸",
}
PREDICTION_LABEL = r"(?:합격예측|합격가능성|지원판정|지원전략)?\s*[:：]?\s*(안정지원|안정|적정지원|적정|소신지원|소신|위험|상향|하향|불안)"
#: Labelled numbers of any evidence text; fixed values.
ROW_METRICS = {
    "my_score": rf"(?:내\s*(?:환산)?점수|나의\s*(?:환산)?점수|산출점수|환산점수)\s*[:：]?\s*{NUMBER}",
    "grade": rf"(?:등급|반영\s*평균등급|내\s*등급)\s*[:：]?\s*{NUMBER}",
    "cut50": rf"(?:50%\s*(?:컷|cut|등급|점수)|산출점수\s*50%)\s*[:：]?\s*{NUMBER}",
    "cut70": rf"(?:70%\s*(?:컷|cut|등급|점수)|산출점수\s*70%)\s*[:：]?\s*{NUMBER}",
    "average_grade": rf"(?:(?:최종등록자|등록자|합격자)\s*)?(?:평균등급|평균 등급)\s*[:：]?\s*{NUMBER}",
    "lowest_grade": rf"(?:최저등급|최저 등급)\s*[:：]?\s*{NUMBER}",
    "competition": rf"경쟁률\s*[:：]?\s*{NUMBER}",
    "capacity": r"(?:모집인원|모집 인원)\s*[:：]?\s*([0-9,]+)",
    "applicants": r"(?:지원자수|지원자 수|실지원자수|실지원자 수)\s*[:：]?\s*([0-9,]+)",
    "additional_admits": r"(?:충원합격자수|충원합격자 수|충원인원|충원 인원|추가합격자수)\s*[:：]?\s*([0-9,]+)",
    "bars": r"(?:칸수|칸\s*수)\s*[:：]?\s*([0-9]+)",
}


def _roles(cells: Column) -> Column:
    """struct of 0-based places of the first header cell of each role, -1 if none."""
    keys = F.transform(cells, lambda c: F.regexp_replace(F.lower(c), r"[\s·._()\-]", ""))
    place = lambda p: F.array_position(F.transform(keys, lambda c: c.rlike(p)), F.lit(True)).cast("int") - 1
    return F.struct(*(place(p).alias(r) for r, p in HEADER_ROLES.items()))


def exploded_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, row, cells of all table rows of the pages."""
    return pages.select(key, F.posexplode(T.table_rows(F.col(html))).alias("row", "cells"))


def competition_rows(rows: DataFrame, key: str) -> DataFrame:
    """Structured rows of competition tables from (key, row, cells).

    Header and section rows carry on to the rows below them. The ratio is read
    at the header's place or else from the right; quota and applicants are the
    two whole numbers nearest before it, as merged cells shift columns. Rows
    whose counts contradict their ratio go; equal rows of a page count once.
    """
    at = [key], ["row"]
    r = rows.withColumns({"ratios": F.transform("cells", V.ratio), "roles": _roles(F.col("cells"))})
    r = r.withColumn("is_header", (F.col("roles.ratio") >= 0) & ((F.col("roles.unit") >= 0) | (F.col("roles.quota") >= 0)))
    joined = F.trim(F.array_join("cells", " "))
    names = ~F.col("is_header") & (F.size("cells") <= 3) & ~F.exists("ratios", lambda x: x.isNotNull()) & (joined != "") & (F.length(joined) < 180) & ~joined.rlike(TOTALS)
    r = r.withColumns({"header": carried(r, *at, F.when(F.col("is_header"), F.col("roles"))), "section": carried(r, *at, F.when(names, joined))}).filter("not is_header")
    seen = F.filter(F.sequence(F.lit(0), F.size("cells") - 1), lambda i: F.get(F.col("ratios"), i).isNotNull())
    own = F.coalesce(F.col("header.ratio"), F.lit(-1))
    r = r.withColumn("at", F.when((own >= 0) & F.get("ratios", own).isNotNull(), own).otherwise(F.array_max(seen))).filter("at is not null")
    r = r.withColumn("before", F.slice("cells", F.lit(1), F.col("at"))).withColumn("ints", F.transform("before", V.integer))
    r = r.withColumn("places", F.filter(F.when(F.col("at") > 0, F.sequence(F.lit(0), F.col("at") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get(F.col("ints"), i).isNotNull()))
    two = F.size("places") >= 2
    nth = lambda back: F.try_element_at("places", F.lit(-back))
    under = lambda role: F.get("cells", F.nullif(F.col(f"header.{role}"), F.lit(-1)))
    r = r.withColumns({
        "quota": F.when(two, F.get("ints", nth(2))).otherwise(V.integer(under("quota"))),
        "applicants": F.when(two, F.get("ints", nth(1))).otherwise(V.integer(under("applicants"))),
        "labels": F.filter(F.slice("before", F.lit(1), F.when(two, nth(2)).otherwise(F.col("at"))), lambda c: ~V.numeric_like(c)),
        "ratio": F.get("ratios", F.col("at")),
    })
    unit = F.coalesce(F.try_element_at("labels", F.lit(-1)), under("unit"))
    told = under("track")
    track = F.when(~V.numeric_like(told) & ~told.eqNullSafe(unit) & told.isNotNull(), told).otherwise(F.coalesce("section", F.when(F.size("labels") > 1, F.try_element_at("labels", F.lit(-2)))))
    clean = lambda c: F.when((T.squeeze(c) != "") & ~V.numeric_like(T.squeeze(c)), T.squeeze(c, 300))
    r = r.withColumns({"track": clean(track), "unit": clean(unit)})
    r = r.filter(V.ratio_fits(F.col("quota"), F.col("applicants"), F.col("ratio")) & (F.col("unit").isNotNull() | F.col("quota").isNotNull() | F.col("applicants").isNotNull()))
    same = [key, "track", "unit", "quota", "applicants", "ratio"]
    return r.groupBy(*same).agg(F.min_by("cells", "row").alias("cells"), F.min("row").cast("int").alias("row"))


def public_links(pages: DataFrame, key: str, domains: tuple[str, ...], most: int | None = None) -> DataFrame:
    """key, place, url: links of a page that may enter the frontier, each once, in order, all or at most ``most``."""
    found = pages.select(key, "url", F.posexplode(U.links(F.col("html"))).alias("at", "link")).withColumn("url", U.frontier_url(U.resolve(F.col("url"), F.trim("link")), domains))
    first = found.filter("url is not null").groupBy(key, "url").agg(F.min("at").alias("at"))
    placed = first.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("at"))).select(key, "place", "url")
    return placed if most is None else placed.filter(F.col("place") <= most)


def unpivot_years(tables: DataFrame, key: list[str], header: str = "header", cells: str = "cells") -> DataFrame:
    """key, label, year, value: a row for each year column of a table row that has a value."""
    pairs = F.slice(F.arrays_zip(F.col(header).alias("head"), F.col(cells).alias("cell")), F.lit(2), F.greatest(F.size(header) - 1, F.lit(0)))
    out = tables.select(*key, T.squeeze(F.get(cells, F.lit(0))).alias("label"), F.explode(pairs).alias("p"))
    year = F.nullif(F.regexp_extract("p.head", r"(20[0-9]{2})\s*학년도", 1), F.lit("")).cast("int")
    return out.select(*key, "label", year.alias("year"), F.trim("p.cell").alias("value")).filter("year is not null and label <> '' and value <> ''")


def unique_headers(header: Column) -> Column:
    """Header cells made distinct: the second of a name gets #2, the third #3; blank ones are named by place."""
    base = F.transform(header, lambda c, i: F.when(T.squeeze(c) == "", F.concat(F.lit("column"), (i + 1).cast("string"))).otherwise(T.squeeze(c)))
    return F.transform(base, lambda c, i: F.when(F.size(F.filter(F.slice(base, F.lit(1), i), lambda x: x == c)) > 0, F.concat(c, F.lit("#"), (F.size(F.filter(F.slice(base, F.lit(1), i), lambda x: x == c)) + 1).cast("string"))).otherwise(c))


def table_evidence(tables: DataFrame, key: list[str]) -> DataFrame:
    """Rows of (key, title, rows) tables as maps from header to cell, where the header names both an identity and a metric."""
    t = tables.filter(F.size("rows") >= 2).withColumn("header", unique_headers(F.get("rows", F.lit(0))))
    head = F.array_join("header", " | ")
    t = t.filter(head.rlike("경쟁률|모의지원|합격예측|적정지원컷|평균점|모집인원|지원자|충원|충원율|50%|70%|등급|환산점수|합격선|순위") & head.rlike("전형|학과명|모집단위|대학명|학부|전공"))
    year = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit("")).cast("int")
    labelled = r"(20[0-9]{2})\s*학년도"
    year = F.coalesce(year(head, labelled), year(F.col("title"), labelled), year(F.col("title"), r"(?<![0-9])(20[0-9]{2})(?![0-9])"))
    predicted = head.rlike(r"모의지원|합격예측|적정지원컷|내\s*점수|칸")
    past = year.isNotNull() | F.concat_ws(" ", "title", head).rlike("입시결과|충원|50%|70%|등급")
    t = t.select(*key, "header", year.alias("year"), F.when(predicted, "current-prediction-reference").when(past, "historical-reference").otherwise("admission-reference").alias("scope"), F.posexplode("rows").alias("row", "cells")).filter("row > 0")
    filled = F.filter(F.arrays_zip(F.col("header").alias("k"), F.transform("cells", lambda c: T.squeeze(c)).alias("v")), lambda x: x["k"].isNotNull() & (F.coalesce(x["v"], F.lit("")) != ""))
    return t.withColumn("columns", F.map_from_entries(filled)).filter(F.size("columns") >= 2).select(*key, "row", "year", "scope", "columns")


def labelled_metrics(c: Column, patterns: dict[str, str]) -> Column:
    """struct of labelled numbers in a text; null where a label does not occur."""
    s = T.squeeze(T.text_of(c))
    read = lambda p: F.nullif(F.replace(F.regexp_extract(s, p, 1), F.lit(","), F.lit("")), F.lit("")).try_cast("double")
    return F.struct(*(read(p).alias(n) for n, p in patterns.items()))


def metric_records(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """Texts that hold at least one labelled metric, with their inferred context and confidence."""
    m = texts.select(*key, T.squeeze(F.col(text)).alias("evidence")).withColumn("metrics", labelled_metrics(F.col("evidence"), ROW_METRICS))
    some = F.coalesce(*(F.col(f"metrics.{n}") for n in ROW_METRICS)).isNotNull()
    found = lambda p: F.nullif(F.trim(F.regexp_extract("evidence", p, 1)), F.lit(""))
    m = m.filter(some).withColumns({"university": found(ENTITY), "department": found(r"([가-힣A-Za-z0-9·]{2,40}(?:학과|학부|전공))"), "year": V.academic_year(F.col("evidence"))})
    both = F.col("university").isNotNull() & F.col("department").isNotNull()
    any_ = F.col("university").isNotNull() | F.col("department").isNotNull()
    return m.withColumn("confidence", F.when(both, "high").when(any_, "medium").otherwise("raw"))


# The grammar of a card's label; fixed values.
_PREFIX = r"^(?:(?:닫기|열기)\s*)*(?:[0-9]{1,2}\s*칸\s*)*(?:(?:닫기|열기)\s*)*"
_ENTITY_AT_START = r"^([가-힣A-Za-z0-9·.&+()\-]{2,45}?(?:대학교|교육대학교|과학기술원|대(?:\([^)]+\))?))(?=\s*\[)"
_META_BRACKET = "교과|종합|논술|실기|실적|학생부교과|학생부종합|수시|정시"
_TRACKS = (
    r"학생부종합Ⅱ|학생부종합Ⅰ|학생부종합II|학생부종합I|지역인재기회균형대상자|창의인재\(면접형\)|학교장추천인재|지역인재교과|지역인재종합|학생부교과|학생부종합|교과성적우수자|"
    r"교과우수|교과일반|교과중심|교과면접|자기추천|학교장추천|고른기회|기회균형|사회통합|지역인재|일반전형|일반"
)
_CAPACITY = r"([0-9,]+)\s*명\s*(?:\||\s)*내\s*점수"
_NO_ENTITY = "경쟁률|합격|예측|지원|전형|모집|학과|학부|전공|점수|등급"
_NO_UNIT = r"경쟁률|합격|예측|내\s*점수|모의지원|전년도|지원자|평균점"


def parse_cards(cards: DataFrame, text: str, target_year: int) -> DataFrame:
    """Adds what a card's label says, read from left to right: university, category, admission, campus, department, capacity."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    c = cards.withColumn("_t", F.regexp_replace(T.squeeze(T.text_of(F.col(text))), _PREFIX, ""))
    c = c.withColumn("_u", F.regexp_extract("_t", _ENTITY_AT_START, 1)).withColumn("_w", F.trim(F.expr("substring(_t, length(_u) + 1)")))
    c = c.withColumn("category", some(F.regexp_extract("_w", r"^\[([^\]]{1,24})\]", 1))).withColumn("_w", F.regexp_replace("_w", r"^\[[^\]]{1,24}\]\s*", ""))
    c = c.withColumn("admission", some(F.regexp_extract("_w", f"^({_TRACKS})", 1))).withColumn("_w", F.trim(F.expr("substring(_w, length(coalesce(admission, '')) + 1)")))
    # brackets that repeat the category are no campus
    c = c.withColumn("_w", F.regexp_replace("_w", rf"^(?:\s*\[\s*(?:{_META_BRACKET})\s*\]\s*)+", ""))
    same = F.concat(F.lit("["), F.col("category"), F.lit("]"))
    c = c.withColumn("_w", F.when(F.col("category").isNotNull() & F.startswith(F.col("_w"), same), F.trim(F.expr("substring(_w, length(category) + 3)"))).otherwise(F.col("_w")))
    c = c.withColumn("campus", some(F.regexp_extract("_w", r"^\s*\[([^\]]{1,30})\]", 1))).withColumn("_w", F.trim(F.regexp_replace("_w", r"^\s*\[[^\]]{1,30}\]\s*", "")))
    unit = F.regexp_replace(F.regexp_extract("_w", rf"^(.*?){_CAPACITY}", 1), r"^[|·:\-\s]+|[|·:\-\s]+$", "")
    ok = F.length(unit).between(2, 120) & ~unit.rlike(_NO_UNIT) & ~unit.rlike(r"^[0-9.,:%\s]+$")
    c = c.withColumns({
        "university": F.when(F.length("_u").between(2, 60) & ~F.col("_u").rlike(_NO_ENTITY), F.col("_u")),
        "department": F.when(ok, unit),
        "capacity": V.integer(F.regexp_extract("_t", _CAPACITY, 1)).cast("int"),
        "year": F.coalesce(V.academic_year(F.col("_t")), F.lit(target_year)),
    })
    u, d, a = (F.col(x).isNotNull() for x in ("university", "department", "admission"))
    c = c.withColumns({
        "identity_key": V.identity_key(F.col("year"), F.col("university"), F.col("admission"), F.col("campus"), F.col("department")),
        "confidence": F.when(u & d & a, "high").when(u & d, "medium").when(u, "low").otherwise("raw"),
        "metrics": labelled_metrics(F.col(text), CARD_METRICS),
        "prediction_label": some(F.regexp_extract(T.squeeze(T.text_of(F.col(text))), PREDICTION_LABEL, 1)),
    })
    return c.drop("_t", "_u", "_w")


def richest_cards(cards: DataFrame, page: str, order: str) -> DataFrame:
    """Where a page has a bound card, unbound ones go; of equal cards the first stays. Unbound cards stay on pages without better."""
    bound = F.col("identity_key").isNotNull()
    kept = cards.withColumn("_rich", F.max(bound).over(W.partitionBy(page))).filter(bound | ~F.col("_rich")).drop("_rich")
    logical = V.digest(F.col("identity_key"), F.col("university"), F.col("admission"), F.col("department"), F.to_json("metrics"))
    by = W.partitionBy(page, logical).orderBy(order)
    return kept.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def topics(c: Column, patterns: tuple[tuple[str, str], ...] = TOPICS) -> Column:
    return F.array_compact(F.array(*(F.when(c.rlike(p), F.lit(name)) for name, p in patterns)))


def strategy_insights(pages: DataFrame, key: list[str], blocks: int | None = None, names: int | None = None, evidence: int | None = None, characters: int | None = None) -> DataFrame:
    """Topics, universities and admission types that (key, title, blocks) speaks of; a single one is the record's own.

    All blocks, names and evidence count; the older collector took 160 blocks, 24 names, 18 pieces of evidence of 1800 characters.
    """
    some = lambda c, n: c if n is None else F.slice(c, 1, n)
    whole = T.squeeze(F.concat_ws(" ", "title", F.array_join("blocks", " ")))
    p = pages.withColumn("_s", whole).filter("_s <> ''")
    told = some(F.filter(F.transform(some(F.col("blocks"), blocks), lambda b: T.squeeze(b)), lambda b: (F.length(b) >= 20) & b.rlike(RELEVANT)), evidence)
    p = p.withColumns({
        "topics": topics(F.col("_s")),
        "universities": some(F.array_distinct(F.regexp_extract_all("_s", F.lit(ENTITY), F.lit(1))), names),
        "admission_types": topics(F.col("_s"), TYPE_SIGNALS),
        "evidence": told if characters is None else F.transform(told, lambda b: F.substring(b, 1, characters)),
    })
    one = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0)))
    sure = F.when((F.size("topics") > 0) & (F.size("evidence") > 0), "medium").otherwise("raw")
    return p.select(*key, "topics", "universities", "admission_types", "evidence", one("universities").alias("university"), one("admission_types").alias("admission"), V.academic_year(F.col("_s")).alias("year"), sure.alias("confidence"))


def reverified_predictions(candidates: DataFrame, records: DataFrame, domain: str) -> DataFrame:
    """Predictions of saved cards whose literal label spells out the candidate they are bound to.

    candidates: identity_key, university, department, admission, campus, year.
    records: identity_key and the same columns, page, evidence, observed_at,
    fingerprint, stability_bars, capacity, score (as parsed, nullable).
    """
    r = records.join(candidates.select("identity_key", *(F.col(c).alias(f"c_{c}") for c in ("university", "department", "admission", "campus", "year"))), "identity_key")
    equal = F.lit(True)
    for c in ("university", "department", "admission", "year"):
        equal = equal & (F.col(c) == F.col(f"c_{c}"))
    q = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    campus = F.when(T.blank_to_null(F.col("c_campus")).isNotNull(), q(F.concat(F.lit("["), F.col("c_campus"), F.lit("]")))).otherwise(F.lit(""))
    literal = F.concat(F.lit("^(?:닫기)?([0-9]+)칸"), q(F.col("c_university")), F.lit(r"\[(?:교과|종합)\]"), q(F.col("c_admission")), campus, q(F.col("c_department")), F.lit(r"([0-9]+)명내 점수([0-9]+(?:\.[0-9]+)?)점"))
    r = r.filter(equal & U.host_within(U.host(F.col("page")), domain) & (U.scheme(F.col("page")) == "https") & F.col("observed_at").isNotNull() & (F.col("fingerprint") != "")).withColumn("_p", literal).filter(F.expr("evidence rlike _p"))
    for k, c in enumerate(("stability_bars", "capacity", "score"), 1):
        told = F.expr(f"cast(regexp_extract(evidence, _p, {k}) as double)")
        r = r.withColumn(f"_{c}", told).filter(V.finite(F.col(c)).isNull() | (F.col(c) == F.col(f"_{c}"))).withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    return r.select("identity_key", "year", "stability_bars", "capacity", "score", U.safe_path(F.col("page"), True).alias("source"), "fingerprint", "observed_at")
