"""Queries whose rows meet every rule of a ladder: page types, lanes, merge policies, publish states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import binding, navigate, pages, tables
from .registry import Registry, table

R = Registry()


def _nth(texts: list[str], by: str) -> str:
    return f"CASE {by} % {len(texts)} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(texts)) + " END"


def _case(rules: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {when} THEN '{name}'" for name, when in rules) + f" ELSE '{other}' END"


_OFFICIAL = _nth([path for _, path in pages.OFFICIAL_PAGES] + ["/other.do"], "page_id")


@R.add(f"""WITH c AS (SELECT {_case([(kind, f"contains(u, '{part}')") for kind, part in pages.OFFICIAL_PAGES], 'other')} AS kind FROM (SELECT 'https://h.kr' || {_OFFICIAL} || '?n=' || page_id AS u FROM pages)) SELECT kind, count(*) AS pages FROM c GROUP BY 1""")
def official_page_types(spark: SparkSession, d: str) -> DataFrame:
    url = F.expr(f"'https://h.kr' || {_OFFICIAL} || '?n=' || page_id")
    return table(spark, d, "pages").groupBy(pages.official_page_type(url).alias("kind")).agg(F.count("*").alias("pages"))


#: An address, a title and a heading for each rule of report pages, and some that fit none or several.
_SHOTS = (
    ("/signin", "t", ""), ("/x", "t", "로그인 아이디 비밀번호"), ("/x", "404 Not Found", ""), ("/x", "302  found", ""), ("/x", "가나대에 대한 모든 입시정보 | 대학정보 | 곳", ""), ("/univ-entrance-info/ipsi-analysis/ipsi-strategy/1", "t", ""), ("/ipsi-knowledge/a", "t", ""),
    ("/univ-entrance-info/susi-special", "t", ""), ("/some-tv/1", "t", ""), ("/univ-major/major-info/major-deep-analysis", "t", ""), ("/x", "대학 심층분석", ""), ("/", "t", ""), ("/index.html", "t", ""), ("/sapplysample/1", "t", ""), ("/x", "t", "모의지원 리포트"), ("/PassCase", "t", ""), ("/x", "t", "전년도 입시결과 상세"),
    ("/eSatMinUniv", "t", ""), ("/minimum-requirement", "t", ""), ("/InfoView.aspx", "t", ""), ("/Calc", "t", ""), ("/x", "t", "성적산출 리포트"), ("/storage", "t", ""), ("/x", "저장소", ""), ("/four-year-university/search", "t", ""), ("/x", "t", "대학검색"), ("/curation/3", "t", ""), ("/x", "t", "추천대학 목록"),
    ("/Predict", "t", ""), ("/x", "t", "7 칸"), ("/x", "t", "아무것"), ("/signin/ipsi-knowledge", "404 Not Found", "추천대학"),
)
_SHOT = tuple(_nth([s[i] for s in _SHOTS], "page_id") for i in range(3))
_OF = {"url": "low", "path": "path", "title": "title", "headings": "heads"}
_REPORT = _case([(kind, " OR ".join(f"regexp_matches({_OF[k]}, '{p}')" for k, p in rule.items())) for kind, rule in pages.REPORT_PAGES], "other")


@R.add(f"""WITH s AS (SELECT page_id, 'https://h.kr' || {_SHOT[0]} AS url, trim(regexp_replace({_SHOT[1]}, '\\s+', ' ', 'g')) AS title, {_SHOT[2]} AS head FROM pages), t AS (SELECT page_id, lower(url) AS low, lower(regexp_extract(url, '^https://[^/]*([^?#]*)', 1)) AS path, title, trim(title || ' ' || head) AS heads FROM s)
SELECT page_id, {_REPORT} AS kind FROM t""")
def report_page_types(spark: SparkSession, d: str) -> DataFrame:
    url, title, head = F.expr(f"'https://h.kr' || {_SHOT[0]}"), F.expr(_SHOT[1]), F.expr(_SHOT[2])
    return table(spark, d, "pages").select("page_id", pages.report_page_type(url, title, F.array(head)).alias("kind"))


#: Addresses and labels that meet each rule of the lanes of routes, and some that meet none or several.
_ROUTES = (
    ("/four-year-university/library", ""), ("/x", "내 저장소"), ("/four-year-university/report/pass-predict/3", ""), ("/four-year-university/report/actual-admission", ""), ("/four-year-university/report/admission-result", ""), ("/PassCase", ""), ("/x", "실제합격자"), ("/sApplySample", ""), ("/x", "지원자 분포"), ("/university-major-predict", ""),
    ("/x", "대학/학과별 합격예측"), ("/univ-major/univ-info/univ-search/detail", ""), ("/x", "최근 3개년 경쟁률"), ("/Calc", ""), ("/x", "수능최저"), ("/recommend-university", ""), ("/x", "추천대학"), ("/ipsi-analysis/ipsi-strategy", ""), ("/x", "입시전략"), ("/ipsi-knowledge", ""), ("/x", "입시 상식"), ("/some-tv/x", ""), ("/early/x", ""), ("/univ-entrance-info/q", ""), ("/x", "그 밖"), ("/early/score", "저장소"),
)
_ROUTE = tuple(_nth([r[i] for r in _ROUTES], "page_id") for i in range(2))
_LANE = _case([(name, " OR ".join(f"regexp_matches({c}, '{p}')" for c, p in (("path", at), ("low", said)) if p)) for name, _, at, said in navigate.LANES], "unknown")


@R.add(f"WITH r AS (SELECT page_id, 'https://h.kr' || {_ROUTE[0]} AS url, {_ROUTE[1]} AS label FROM pages), t AS (SELECT page_id, lower(url || ' ' || label) AS low, lower(regexp_extract(url, '^https://[^/]*(.*)', 1)) AS path FROM r) SELECT page_id, {_LANE} AS lane FROM t")
def lanes_of_routes(spark: SparkSession, d: str) -> DataFrame:
    url, label = F.expr(f"'https://h.kr' || {_ROUTE[0]}"), F.expr(_ROUTE[1])
    return table(spark, d, "pages").select("page_id", navigate.lane(url, label)["lane"].alias("lane"))


_LABELS = ["과거 입시결과", "지원자분포", "합격 안정성", "성적 산출", "환산점수", "전형 정보", "입시 결과", "경쟁률", "입시 지식", "리포트 보기", "리포트", " 리포트  보기 ", "리포트 더보기", "다음", "모의 지원 합격 예측"]
_KINDS, _TYPES = ["", "합격예측", "read"], [*navigate.PAGE_LANES, "home", "none"]
_TOLD = (_nth(_LABELS, "event_id"), _nth(_KINDS, "user_id"), _nth(_TYPES, "event_id"), "CASE WHEN user_id % 4 = 0 THEN 'h.kr/four-year-university/library' ELSE 'h.kr/x' END")
_ladder = lambda c, rules: _case([(name, f"regexp_matches({c}, '{p}')") for name, p in rules], "reference")


@R.add(f"""WITH e AS (SELECT event_id, {_TOLD[0]} AS label, {_TOLD[1]} AS kind, {_TOLD[2]} AS page_type, {_TOLD[3]} AS origin FROM events), l AS (SELECT *, {_ladder("label || ' ' || kind", navigate.LABEL_LANES)} AS said, {_ladder("label", navigate.HINT_LANES)} AS hint FROM e)
SELECT event_id, {_case([(lane, f"page_type = '{t}'") for t, lane in navigate.PAGE_LANES.items()], 'reference')} AS page_lane, said AS label_lane, hint, CASE WHEN said <> 'reference' THEN said WHEN (page_type = 'early-storage' OR contains(origin, '/four-year-university/library')) AND regexp_matches(trim(regexp_replace(label, '\\s+', ' ', 'g')), '^리포트( 보기)?$') THEN 'current-prediction' ELSE 'reference' END AS at_origin FROM l""")
def lane_ladders(spark: SparkSession, d: str) -> DataFrame:
    label, kind, page_type, origin = (F.expr(e) for e in _TOLD)
    return table(spark, d, "events").select(
        "event_id", navigate.page_lane(page_type).alias("page_lane"), navigate.label_lane(label, kind).alias("label_lane"), navigate.lane_hint(label).alias("hint"), navigate.lane_at_origin(label, kind, origin, page_type).alias("at_origin")
    )


_OLD = "CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END"
_UPSERT = ("value AS most", "value AS least", "event_type AS last_type", "CASE WHEN value > 60 THEN event_type END AS kept", "CASE WHEN value > 40 THEN event_type ELSE ' ' END AS told", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS first_type", "CASE WHEN event_id % 5 = 0 THEN value END AS last_value")


@R.add(f"""WITH e AS (SELECT user_id, {{'o': {_OLD}, 't': ts, 'e': event_id}} AS place, {', '.join(_UPSERT)} FROM events),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS n, row_number() OVER (PARTITION BY user_id ORDER BY place DESC) AS m FROM e)
SELECT user_id, max(most) AS most, min(least) AS least, max(CASE WHEN m = 1 THEN last_type END) AS last_type, arg_max(kept, place) FILTER (kept IS NOT NULL) AS kept, arg_max(told, place) FILTER (trim(told) <> '') AS told, max(CASE WHEN n = 1 THEN first_type END) AS first_type, max(CASE WHEN m = 1 THEN last_value END) AS last_value FROM r GROUP BY 1""")
def upsert_every_policy(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("user_id", "ts", "event_id", *_UPSERT)
    policies = {"most": "max", "least": "min", "last_type": "last", "kept": "keep", "told": "text", "first_type": "first", "last_value": "last"}
    return tables.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id"], ["ts", "event_id"], policies)


#: Decks of six slots: which candidates, how many.
_DECKS = {"ready": ("state = 'accepted'", 6), "warned": ("state IN ('accepted', 'provisional')", 6), "alone": ("state IN ('accepted', 'provider-only')", 6), "incomplete": ("state = 'incomplete'", 6), "waiting": ("state = 'accepted'", 5), "stale": ("state = 'none'", 6)}
_CAND = "cand AS (SELECT c_custkey AS id, c_custkey % 4 <> 3 AS complete, CASE c_custkey % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'provisional' WHEN 2 THEN 'provider-only' WHEN 3 THEN 'incomplete' ELSE 'accepted' END AS state FROM customer WHERE c_custkey % 4 <> 3 OR c_custkey % 5 = 3)"
_DECK_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS deck, slot, " + (f"-slot AS id FROM range(1, {k + 1}) t(slot)" if n == "stale" else f"id FROM (SELECT id, row_number() OVER (ORDER BY id {'DESC' if n == 'alone' else ''}) AS slot FROM cand WHERE {where}) WHERE slot <= {k}") for n, (where, k) in _DECKS.items()
)


@R.add(f"""WITH {_CAND}, deck AS ({_DECK_SQL}), v AS (SELECT deck, slot, deck.id, coalesce(state, 'stale') AS state, coalesce(complete, false) AS complete FROM deck LEFT JOIN cand USING (id)), c AS (SELECT count(*) AS candidates, count(*) FILTER (complete) AS full_coverage FROM cand),
 n AS (SELECT deck, count(*) AS selected, count(DISTINCT id) AS uniq, count(*) FILTER (state <> 'stale') AS resolvable, count(*) FILTER (state <> 'stale' AND complete) AS full_, count(*) FILTER (state = 'provisional') AS prov, count(*) FILTER (state = 'provider-only') AS alone, count(*) FILTER (state = 'stale') AS stale FROM v GROUP BY 1), r AS (SELECT *, selected = 6 AND uniq = 6 AND resolvable = 6 AND full_ = 6 AS ready FROM n, c)
SELECT deck, selected, resolvable, full_ AS selected_full, ready AS hub_ready, CASE WHEN NOT ready AND selected < 6 THEN 'WAITING_FOR_USER_SELECTION' WHEN NOT ready THEN 'BLOCKED_QUALITY' WHEN prov > 0 OR alone > 0 THEN 'READY_WITH_WARNINGS' ELSE 'READY' END AS publish_state,
 array_to_string(list_filter([CASE WHEN selected < 6 THEN 'six-application-selection-incomplete' END, CASE WHEN uniq <> selected THEN 'duplicate-application-slot' END, CASE WHEN stale > 0 THEN 'stale-slot-binding' END, CASE WHEN full_ < selected THEN 'selected-application-core-coverage-incomplete' END], lambda x: x IS NOT NULL), ',') AS blockers,
 array_to_string(list_filter([CASE WHEN candidates > full_coverage THEN 'candidate-core-coverage-incomplete' END, CASE WHEN prov > 0 THEN 'selected-provisional-binding' END, CASE WHEN alone > 0 THEN 'selected-provider-only-no-safe-binding' END], lambda x: x IS NOT NULL), ',') AS warnings FROM r""")
def publish_states(spark: SparkSession, d: str) -> DataFrame:
    """Six decks of the customers as candidates, one for each publish state and for each warning."""
    k = F.col("c_custkey")
    state = F.when(k % 5 == 1, "provisional").when(k % 5 == 2, "provider-only").when(k % 5 == 3, "incomplete").otherwise("accepted")
    c = table(spark, d, "customer").filter((k % 4 != 3) | (k % 5 == 3)).select(k.alias("identity_key"), (k % 4 != 3).alias("complete"), state.alias("quality_state"))
    out = []
    for name, (where, n) in _DECKS.items():
        if name == "stale":
            slots = spark.range(1, n + 1).select(F.col("id").cast("int").alias("slot"), (-F.col("id")).alias("identity_key"))
        else:
            best = c.filter(where.replace("state", "quality_state")).orderBy(F.desc("identity_key") if name == "alone" else F.asc("identity_key")).limit(n).agg(F.sort_array(F.collect_list("identity_key")).alias("ids"))  # six at most
            slots = best.select(F.posexplode("ids").alias("slot", "identity_key")).withColumn("slot", (F.col("slot") + 1).cast("int"))
        out.append(binding.audit(binding.slots_view(slots.withColumn("occupied", F.lit(True)), c), c).withColumn("deck", F.lit(name)))
    return reduce(DataFrame.unionByName, out).select("deck", "selected", "resolvable", "selected_full", "hub_ready", "publish_state", "blockers", "warnings")
