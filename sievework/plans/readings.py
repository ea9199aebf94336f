"""Queries that read labelled values and contexts from made-up page texts, built from the tables so that each source wins somewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.extract import PREDICTION_LABEL
from .registry import Registry, spread, table

R = Registry()

_N = "CAST(p_size AS VARCHAR)"
#: Phrases of a report, each on the parts that a rule picks.
_PHRASES = (
    ("p_partkey % 2 = 0", f"'내 점수 ' || {_N} || '.5점 '"), ("p_partkey % 5 = 0", f"'전교과 ' || {_N} || '등급 '"), ("p_partkey % 3 = 0", f"'환산점수: ' || {_N} || ' '"), ("p_partkey % 7 = 0", f"'내 등급 ' || {_N} || '.1 '"),
    ("p_partkey % 4 = 1", f"'모집인원 1,0' || {_N} || '명 '"), ("p_partkey % 4 = 2", f"{_N} || '명 내 점수 '"), ("p_partkey % 3 = 1", f"'모의지원자수 ' || {_N} || ' '"), ("p_partkey % 3 = 2", f"'모의지원자 수 ' || {_N} || ' '"),
    ("p_partkey % 5 = 1", "'합격안정성 7칸 '"), ("p_partkey % 5 = 4", "'| 6칸 '"), ("p_partkey % 5 = 2", f"'적정지원컷 ' || {_N} || '.25 '"), ("p_partkey % 5 = 3", f"'예상 합격선: ' || {_N} || ' '"), ("p_partkey % 6 = 0", f"'합격률 ' || {_N} || '.5% '"),
    ("p_partkey % 6 = 1", "'수능최저 기준 미충족 '"), ("p_partkey % 8 = 0", "'지원전략 소신지원 '"), ("p_partkey % 9 = 0", f"'추가합격자수 ' || {_N} || ' '"), ("p_partkey % 9 = 1", f"'현재 지원자수 2,1' || {_N} || ' '"),
    ("p_partkey % 7 = 1", f"'전년도 경쟁률 ' || {_N} || '.3 모의지원 경쟁률 ' || {_N} || '.4 '"), ("p_partkey % 11 = 0", f"'나의 순위 ' || {_N} || ' 모의지원자 평균점 ' || {_N} || '점 '"),
)
_TEXT = " || ".join(f"CASE WHEN {when} THEN {phrase} ELSE '' END" for when, phrase in _PHRASES)


def _sql(pattern: str) -> str:
    """The pattern for an engine without look-behind: the one place that uses it may read the character before."""
    return pattern.replace("(?<![0-9.])", "(?:^|[^0-9.])").replace("'", "''")


def _read(pattern: str) -> str:
    return f"TRY_CAST(nullif(replace(regexp_extract(s, '{_sql(pattern)}', 1), ',', ''), '') AS DOUBLE)"


def _rules_sql(rules: M.Rules) -> str:
    cols = []
    for name, patterns in rules.items():
        cols.append(f"coalesce({', '.join(_read(p) for _, p in patterns)}) AS {name}")
        cols.append("CASE " + " ".join(f"WHEN {_read(p)} IS NOT NULL THEN '{src}'" for src, p in patterns) + f" END AS {name}_source")
    return ", ".join(cols)


def _flat(rules: M.Rules):
    return [F.col(f"metrics.{m}.{part}").alias(m if part == "value" else f"{m}_source") for m in rules for part in ("value", "source")]


_REPORTS = f"r AS (SELECT p_partkey, trim(regexp_replace({_TEXT}, '\\s+', ' ', 'g')) AS s FROM part)"
_SAID = f"nullif(trim(regexp_extract(s, '{_sql(M.MINIMUM)}', 1)), '') AS minimum, nullif(trim(regexp_extract(s, '{_sql(PREDICTION_LABEL)}', 1)), '') AS prediction_label"


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", "p_size", F.expr(_TEXT.replace("VARCHAR", "STRING")).alias("text"))


@R.add(f"WITH {_REPORTS} SELECT p_partkey, {_SAID}, {_rules_sql(M.PREDICTION)} FROM r")
def prediction_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.predictions(_reports(spark, d), "text").select("p_partkey", "minimum", "prediction_label", *_flat(M.PREDICTION))


_WHERE = "CASE WHEN p_partkey % 4 = 0 THEN 'm' || p_partkey END AS mission_key, CASE WHEN p_partkey % 3 = 0 THEN 'u' END AS university, CASE WHEN p_partkey % 5 < 2 THEN 'd' END AS department, CASE WHEN p_partkey % 7 = 0 THEN 'a' END AS admission"


@R.add(f"""WITH {_REPORTS}, m AS (SELECT p_partkey, {_SAID}, {_rules_sql(M.SUMMARY)}, {_WHERE} FROM r)
SELECT * EXCLUDE (mission_key, university, department, admission), CASE WHEN p_partkey % 10 = 0 THEN 'prediction-snapshot' ELSE 'page-summary' END AS record_type, CASE WHEN mission_key IS NOT NULL THEN 'same-application-mission' ELSE 'page-context' END AS context_source,
 CASE WHEN mission_key IS NOT NULL THEN 'low' WHEN university IS NOT NULL AND department IS NOT NULL THEN 'high' WHEN university IS NOT NULL OR department IS NOT NULL OR admission IS NOT NULL THEN 'medium' ELSE 'raw' END AS confidence
FROM m WHERE coalesce({', '.join(M.SUMMARY)}) IS NOT NULL OR minimum IS NOT NULL OR prediction_label IS NOT NULL""")
def summary_metrics(spark: SparkSession, d: str) -> DataFrame:
    where = [F.expr(x) for x in ("CASE WHEN p_partkey % 4 = 0 THEN 'm' || p_partkey END AS mission_key", "CASE WHEN p_partkey % 3 = 0 THEN 'u' END AS university", "CASE WHEN p_partkey % 5 < 2 THEN 'd' END AS department", "CASE WHEN p_partkey % 7 = 0 THEN 'a' END AS admission")]
    scope = F.when(F.col("p_partkey") % 10 == 0, "current-prediction").otherwise("reference")
    pages = _reports(spark, d).select("p_partkey", "text", scope.alias("scope"), F.lit("low").alias("mission_confidence"), *where)
    return M.summaries(pages, "text").select("p_partkey", "minimum", "prediction_label", *_flat(M.SUMMARY), "record_type", "context_source", "confidence")


_BARS, _TRACKS = "CASE WHEN p_partkey % 3 = 0 THEN '7칸 ' ELSE '' END", "CASE p_partkey % 5 WHEN 0 THEN '교과우수' WHEN 1 THEN '창의인재(면접형)' WHEN 2 THEN '지역인재교과' WHEN 3 THEN '일반' ELSE '' END"
_CARD = f"{_BARS} || CASE WHEN p_partkey % 6 = 0 THEN '' ELSE '대' || p_size || '대학교' END || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '[교과]' END || {_TRACKS} || CASE WHEN p_partkey % 7 = 0 THEN '[서울]' ELSE '' END || '학과' || p_size || CASE WHEN p_partkey % 8 = 0 THEN '' ELSE '과 20명 내 점수 3' END"


@R.add(f"""WITH c AS (SELECT p_partkey, regexp_replace({_CARD}, '^7칸 ', '') AS t FROM part), u AS (SELECT *, regexp_extract(t, '^([가-힣A-Za-z0-9·.&+\\-]+(?:\\([^)]+\\))?)\\[', 1) AS u FROM c), w AS (SELECT *, CASE WHEN u = '' THEN t ELSE substr(t, length(u) + 1) END AS w FROM u),
 k AS (SELECT *, nullif(regexp_extract(w, '^\\[([^\\]]+)\\]', 1), '') AS category, regexp_replace(w, '^\\[[^\\]]+\\]', '') AS v FROM w), b AS (SELECT *, nullif(trim(regexp_extract(v, '^(.+?)[0-9]{{1,4}}\\s*명\\s*내\\s*점수', 1)), '') AS combined FROM k),
 a AS (SELECT *, nullif(regexp_extract(combined, '^({_sql(M.RECOMMENDED)})', 1), '') AS admission FROM b), d AS (SELECT *, nullif(trim(regexp_replace(substr(combined, length(coalesce(admission, '')) + 1), '^(?:\\[[^\\]]+\\])+', '')), '') AS department FROM a)
SELECT p_partkey, CASE WHEN ok THEN u END AS university, CASE WHEN ok THEN category END AS category, CASE WHEN ok THEN admission END AS admission, CASE WHEN ok THEN department END AS department, CASE WHEN ok THEN combined END AS combined FROM (SELECT *, u <> '' AND department IS NOT NULL AS ok FROM d)""")
def recommendation_contexts(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "part").select("p_partkey", F.expr(_CARD).alias("text"))
    return M.recommended(cards, "text").select("p_partkey", "university", "category", "admission", "department", "combined")


#: Header and cell of a made-up table row of an order; a metric may have two columns.
_COLUMNS = (
    ("'전형/학과'", "'t' || nth"), ("'모집단위'", "CASE WHEN nth > 2 THEN 'u' || nth ELSE '' END"), ("'학과명'", "CASE WHEN nth < 4 THEN 'n' || nth ELSE ' ' END"), ("'전형명'", "'a'"), ("'전년도 경쟁률'", "o_custkey || ':1'"), ("'모의지원 경쟁률'", "nth || '.5'"),
    ("'경쟁률'", "'none'"), ("'경쟁률#2'", "CASE WHEN nth % 2 = 0 THEN '-1,2' || nth || '.25' ELSE '' END"), ("'모의지원자 평균점'", "'88.' || nth"), ("'지원자 평균 등급'", "'3.' || nth"), ("'합격예측(컷)'", "nth || '0'"), ("'모집인원'", "'1,00' || nth || '명'"),
    ("'모의지원자 수'", "nth || '7'"), ("'지원인원'", "nth || '8'"), ("'충원율'", "'150%'"), ("'충원'", "nth || ''"), ("'50%'", "'2.1'"), ("'70%컷'", "'2.' || nth"), ("'평균등급'", "'2.9'"), ("'비고'", "'77'"),
)
_METRIC = "CASE " + " ".join("WHEN " + (f"regexp_matches(k, '{r}')" if isinstance(r, str) else " AND ".join(f"contains(k, '{w}')" for w in r)) + f" THEN '{name}'" for name, r in M.HEADERS) + " END"


@R.add(f"""WITH c AS (SELECT o_orderkey, unnest([{', '.join(f"{{'i': {i}, 'k': {k}, 'v': {v}}}" for i, (k, v) in enumerate(_COLUMNS))}]) AS x FROM (SELECT *, o_orderkey % 7 + 1 AS nth FROM orders)),
 m AS (SELECT o_orderkey, x.i AS i, x.k AS k, x.v AS v, nullif(regexp_extract(replace(x.v, ',', ''), '-?[0-9]+(?:\\.[0-9]+)?'), '')::DOUBLE AS n FROM c), n AS (SELECT *, {_METRIC} AS metric FROM m),
 i AS (SELECT o_orderkey, arg_max(v, i) FILTER (regexp_matches(k, '전형/학과|전형/모집단위') AND trim(v) <> '') AS combined, arg_max(v, i) FILTER (regexp_matches(k, '^모집단위$|학과명|^학과$|^전공$') AND trim(v) <> '') AS department, arg_max(v, i) FILTER (regexp_matches(k, '^전형$|전형명') AND trim(v) <> '') AS admission FROM n GROUP BY 1)
SELECT o_orderkey, metric, arg_max(n, i) AS value, any_value(combined) AS combined, any_value(department) AS department, any_value(admission) AS admission FROM n JOIN i USING (o_orderkey) WHERE metric IS NOT NULL AND n IS NOT NULL GROUP BY 1, 2""")
def header_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("nth", F.col("o_orderkey") % 7 + 1)
    columns = F.array(*(F.struct(F.expr(k).alias("k"), F.expr(v).alias("v")) for k, v in _COLUMNS))
    got = M.table_metrics(rows.select("o_orderkey", columns.alias("columns")))
    return got.select("o_orderkey", F.explode_outer("metrics").alias("metric", "value"), "combined", "department", "admission").filter("metric is not null")


_SELECTION = "CASE WHEN p_partkey % 2 = 0 THEN '가' || p_size || '대학교' ELSE ' ' END"
_TITLE = "CASE WHEN p_partkey % 3 = 0 THEN '2026학년도 모집단위: 국문' || p_size || '학과' WHEN p_partkey % 3 = 1 THEN '전형명: 지원 안내 전형' ELSE '' END"
_BLOCK = "CASE WHEN p_partkey % 5 = 0 THEN '컴퓨터공학부 수학과 경쟁률학과' WHEN p_partkey % 5 = 1 THEN '학생부교과 일반' || p_size || '전형 | 서류 전형' ELSE '본문' END"
_CELL = "CASE WHEN p_partkey % 7 = 0 THEN '나' || p_size || '과학기술원' ELSE '물리학과 2025년' END"


def _context_sql(text: str, at: str) -> str:
    """university, department, admission and year of a text column, as columns with a suffix."""
    clean = lambda x: f"trim(regexp_replace(regexp_replace({x}, '^[^가-힣A-Za-z0-9]+|[^가-힣A-Za-z0-9)\\]]+$', '', 'g'), '\\s+', ' ', 'g'))"
    every = lambda s, p: f"list_transform(regexp_extract_all({s}, '{_sql(p)}', 1), lambda y: {clean('y')})"
    segments = f"list_filter(list_transform(string_split({text}, '|'), lambda g: {clean('g')}), lambda g: g <> '')"
    both = lambda label, p: f"flatten(list_transform({segments}, lambda g: list_concat({every('g', label)}[1:1], {every('g', p)})))"
    sized = f"list_filter({both(M._UNIT_LABEL, M._UNIT)}, lambda x: length(x) BETWEEN 2 AND 40 AND regexp_matches(x, '{M._UNIT_END}') AND NOT regexp_matches(x, '{M._UNIT_NOISE}'))"
    university = ", ".join(f"list_filter({every(text, p)}, lambda x: length(x) BETWEEN 4 AND 45)[1]" for p in M._UNIVERSITY)
    track = f"list_filter({both(M._TRACK_LABEL, M._TRACK)}, lambda x: length(x) BETWEEN 2 AND 40 AND NOT regexp_matches(x, '{_sql(M._TRACK_NOISE)}'))[1]"
    shortest = f"list_filter({sized}, lambda z: length(z) = list_min(list_transform({sized}, lambda q: length(q))))[1]"
    return f"coalesce({university}) AS university{at}, {shortest} AS department{at}, {track} AS admission{at}, nullif(regexp_extract({text}, '{_sql(M._YEAR)}', 1), '')::INT AS year{at}"


@R.add(f"""WITH p AS (SELECT p_partkey, {_SELECTION} AS sel, {_TITLE} AS title, {_BLOCK} AS block, {_CELL} AS cell FROM part),
 t AS (SELECT p_partkey, array_to_string(list_filter([trim(sel), title, block], lambda x: x <> ''), ' | ') AS near, trim(regexp_replace(array_to_string(list_filter([title, block, '표', '값 | ' || cell], lambda x: x <> ''), ' '), '\\s+', ' ', 'g')) AS whole FROM p),
 a AS (SELECT *, {_context_sql('near', '_a')} FROM t), b AS (SELECT *, {_context_sql('whole', '_b')} FROM a), c AS (SELECT *, university_a IS NOT NULL AND department_a IS NOT NULL AS enough FROM b)
SELECT p_partkey, {', '.join(f"CASE WHEN enough THEN {n}_a ELSE coalesce({n}_a, {n}_b) END AS {n}, CASE WHEN {n}_a IS NOT NULL THEN 'selection' WHEN NOT enough AND {n}_b IS NOT NULL THEN 'page' END AS {n}_source" for n in ('university', 'department', 'admission', 'year'))} FROM c""")
def page_contexts(spark: SparkSession, d: str) -> DataFrame:
    array = lambda e: F.array(F.expr(e))
    tables = F.array(F.struct(F.lit("표").alias("caption"), F.array(F.array(F.lit("값"), F.expr(_CELL))).alias("rows")))
    parts = spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    pages = parts.select("p_partkey", array(_SELECTION).alias("selection"), F.expr(_TITLE).alias("title"), F.array().cast("array<string>").alias("context"), array(_BLOCK).alias("blocks"), tables.alias("tables"))
    got = M.inferred_contexts(pages)
    return got.select("p_partkey", *(F.col(f"{s}.{n}").alias(n if s == "inferred" else f"{n}_source") for n in ("university", "department", "admission", "year") for s in ("inferred", "sources")))
