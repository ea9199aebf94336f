"""Queries of the desk: dashboard, finish gate, providers, purge, planned tasks, statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dashboard, planning, sources
from .registry import Registry, table

R = Registry()
PROVIDERS = ("official", "portal")

_SYNC = (
    "event_id", "event_id % 31 = 0 AS login_required", "event_id % 29 = 0 AS login_checking", "CASE WHEN event_id % 23 = 0 THEN true WHEN event_id % 5 = 0 THEN false END AS recovering", "event_id % 3 = 0 AS running", "event_id % 7 = 0 AS requires_user_action",
    "CASE event_type WHEN 'view' THEN 'official' WHEN 'click' THEN 'portal' WHEN 'error' THEN 'other' END AS phase", "CASE event_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' END AS status",
    "CASE user_id % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'portal' WHEN 2 THEN 'idle' END AS persisted_phase", "CASE user_id % 3 WHEN 0 THEN 'completed-with-deferred-ERRORS' WHEN 1 THEN 'completed' END AS completion_reason",
    "CASE WHEN event_id % 2 = 0 THEN CAST(floor(value) AS INT) END AS targets", "CAST(floor(value / 2) AS INT) AS confirmed", "CAST(floor(value) AS INT) % 3 AS outstanding",
)
_STATE = """CASE WHEN login_required THEN 'USER_LOGIN_REQUIRED' WHEN login_checking THEN 'LOGIN_CHECK' WHEN coalesce(recovering, false) THEN 'RECOVERING' WHEN running AND ph = 'official' THEN 'SYNCING_OFFICIAL' WHEN running AND ph = 'portal' THEN 'SYNCING_PORTAL' WHEN running THEN 'SYNCING'
 WHEN requires_user_action THEN 'USER_ACTION_REQUIRED' WHEN st = 'completed' AND coalesce(completion_reason, '') ILIKE '%error%' THEN 'COMPLETE_WITH_WARNINGS' WHEN st = 'completed' THEN 'COMPLETE' WHEN st = 'running' AND pp = 'official' THEN 'SYNCING_OFFICIAL' WHEN st = 'running' AND pp = 'portal' THEN 'SYNCING_PORTAL' WHEN st = 'running' THEN 'SYNCING' ELSE 'IDLE' END"""
_SYNC_SQL = f"s0 AS (SELECT {', '.join(_SYNC)} FROM events), s AS (SELECT *, coalesce(status, 'unknown') AS st, coalesce(persisted_phase, 'idle') AS pp, coalesce(phase, persisted_phase, 'idle') AS ph FROM s0), t AS (SELECT *, {_STATE} AS state FROM s)"


def _sync(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(*_SYNC)


@R.add(f"""WITH {_SYNC_SQL} SELECT event_id, state, CASE WHEN running THEN ph ELSE pp END AS shown_phase,
 CASE WHEN coalesce(targets, 0) > 0 THEN confirmed || '/' || targets || ' 완료' || CASE WHEN outstanding > 0 THEN ' · ' || outstanding || ' 남음' ELSE '' END WHEN state IN ('COMPLETE', 'COMPLETE_WITH_WARNINGS') THEN '수집 완료' ELSE '진행 수치 대기' END AS progress FROM t""")
def sync_states(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.sync_state(_sync(spark, d), PROVIDERS).select("event_id", "state", "shown_phase", "progress")


@R.add(f"WITH {_SYNC_SQL} SELECT state, count(*) AS rows FROM t GROUP BY 1")
def sync_state_reach(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each state, from the decision table's own account of which rule each row meets first."""
    return dashboard.rules_met(_sync(spark, d), PROVIDERS).groupBy("state").agg(F.sum("rows").alias("rows"))


_DECK_SQL = """o AS (SELECT o_custkey AS grp, (o_orderkey % 6 + 1)::INT AS slot, max(o_orderkey) AS k FROM orders GROUP BY 1, 2), n AS (SELECT DISTINCT grp, unnest(range(1, 7))::INT AS slot FROM o),
 l AS (SELECT l_orderkey AS k, count(*) AS lines, min(l_returnflag) AS flag, max(l_linenumber) AS top FROM lineitem GROUP BY 1),
 d AS (SELECT n.grp, n.slot, coalesce(o.k % 5 <> 0, false) AS occupied, CASE WHEN o.k % 5 <> 0 THEN o.k END AS k, o.k AS any_k FROM n LEFT JOIN o USING (grp, slot)),
 c AS (SELECT d.*, l.k IS NOT NULL AS there, lines, flag, top FROM d LEFT JOIN l USING (k)),
 e AS (SELECT *, CASE WHEN NOT occupied THEN 'empty' WHEN NOT there THEN 'stale' ELSE CASE k % 6 WHEN 0 THEN 'accepted' WHEN 1 THEN 'provisional' WHEN 2 THEN 'provider-only' WHEN 3 THEN 'incomplete' WHEN 4 THEN 'odd' ELSE 'unknown' END END AS state FROM c)"""


def _deck(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    slots = orders.groupBy(F.col("o_custkey").alias("group"), (F.col("o_orderkey") % 6 + 1).cast("int").alias("slot")).agg(F.max("o_orderkey").alias("k"))
    slots = slots.select("group", "slot", (F.col("k") % 5 != 0).alias("occupied"), F.col("k").cast("string").alias("identity_key"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("지원 "), "k")).alias("display_label"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("lines"), F.min("l_returnflag").alias("flag"), F.max("l_linenumber").alias("top"))
    quality = F.element_at(F.create_map(*(F.lit(x) for kv in {0: "accepted", 1: "provisional", 2: "provider-only", 3: "incomplete", 4: "odd"}.items() for x in kv)), (F.col("k") % 6).cast("int"))
    c = orders.select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("k")).join(lines, "k").select(
        "group", F.col("k").cast("string").alias("identity_key"), F.when(F.col("k") % 3 != 0, F.concat(F.lit("u"), "k")).alias("university"), F.when(F.col("k") % 4 != 0, F.concat(F.lit("d"), "k")).alias("department"),
        F.when(F.col("flag") == "A", "a").otherwise(" ").alias("admission"), F.when(F.col("top") > 5, F.col("flag")).alias("campus"), quality.alias("quality_state"), F.col("lines").alias("covered_count"), (F.col("lines") > 3).alias("complete"),
    )
    return dashboard.cards(slots, c)


@R.add(f"""WITH {_DECK_SQL} SELECT grp AS "group", slot, occupied, k::VARCHAR AS identity_key, there AS resolvable, state,
 CASE state WHEN 'accepted' THEN '공식 전형 연결 확인' WHEN 'provisional' THEN '공식 전형 연결 확인 필요' WHEN 'provider-only' THEN '제공처 중심 · 공식 결합 없음' WHEN 'incomplete' THEN '수집 보강 필요' WHEN 'stale' THEN 'canonical 연결 복구 필요' WHEN 'empty' THEN '지원안 미선택' ELSE '데이터 품질 확인 필요' END AS label,
 CASE WHEN NOT occupied THEN slot || '. 비어 있음' WHEN NOT there THEN slot || '. ' || CASE WHEN k % 2 = 0 THEN '지원 ' || k ELSE '연결 확인 필요' END WHEN k % 3 = 0 AND k % 4 = 0 THEN slot || '. 지원안' WHEN k % 3 = 0 THEN 'd' || k WHEN k % 4 = 0 THEN 'u' || k ELSE 'u' || k || ' · d' || k END AS title,
 CASE WHEN there THEN concat_ws(' · ', CASE WHEN flag = 'A' THEN 'a' END, CASE WHEN top > 5 THEN '[' || flag || ']' END) END AS subtitle, coalesce(lines, 0) AS covered_count, coalesce(lines > 3, false) AS complete FROM e""")
def dashboard_cards(spark: SparkSession, d: str) -> DataFrame:
    return _deck(spark, d)


@R.add(f"""WITH {_DECK_SQL}, q AS (SELECT grp, count(*) FILTER (occupied) AS selected, count(*) FILTER (there) AS resolvable, count(*) FILTER (state = 'accepted') AS accepted, count(*) FILTER (state = 'provisional') AS provisional, count(*) FILTER (state = 'provider-only') AS provider_only, count(*) FILTER (lines > 3) AS full_coverage FROM e GROUP BY 1)
SELECT grp AS "group", CASE WHEN grp % 2 = 0 THEN 6 ELSE selected END AS selected, CASE WHEN grp % 4 = 0 THEN 5 ELSE resolvable END AS resolvable, CASE WHEN grp % 2 = 0 THEN grp % 7 ELSE accepted END AS accepted, provisional, provider_only, CASE WHEN grp % 6 = 0 THEN 0 ELSE full_coverage END AS full_coverage FROM q""")
def dashboard_summary(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("group")
    audits = table(spark, d, "customer").select(F.col("c_custkey").alias("group")).filter(g % 2 == 0).select(
        "group", F.lit(6).alias("selected"), F.when(g % 4 == 0, 5).alias("resolvable"), (g % 7).alias("accepted"), F.lit(None).cast("int").alias("provisional"), F.lit(None).cast("int").alias("provider_only"), F.when(g % 6 == 0, 0).alias("full_coverage")
    )
    return dashboard.summary(_deck(spark, d), audits)


@R.add("""SELECT c_nationkey, count(*) AS applications, count(*) FILTER (c_custkey % 3 = 0) AS verified_conversions, count(*) FILTER (c_custkey % 4 <> 0) AS official_outcomes, count(*) FILTER (c_mktsegment = 'BUILDING') AS comparable, count(*) FILTER (c_mktsegment <> 'BUILDING') AS holds,
 count(*) FILTER (c_acctbal > 0) AS predictions, count(*) FILTER (c_acctbal > 5000) AS structured_predictions FROM customer GROUP BY 1""")
def score_counters(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        "c_nationkey", F.when(k % 3 == 0, "verified").when(k % 3 == 1, "none").alias("conversion_state"), F.when(k % 4 != 0, F.lit(1.0)).alias("official_outcome"),
        F.when(F.col("c_mktsegment") == "BUILDING", "comparable").when(k % 2 == 0, "hold").alias("decision"), F.when(F.col("c_acctbal") > 0, "collected").alias("prediction_state"), (F.col("c_acctbal") > 5000).alias("structured"),
    )
    return dashboard.score_summary(rows, ["c_nationkey"])


@R.add("""WITH p AS (SELECT o_custkey AS run_id, count(*) FILTER (o_orderstatus <> 'F') AS pending, count(*) FILTER (o_orderstatus <> 'F' AND o_orderpriority = '5-LOW') AS deferred FROM orders GROUP BY 1)
SELECT c_custkey AS run_id, coalesce(pending, 0) AS pending, coalesce(deferred, 0) AS deferred, CASE WHEN c_custkey % 11 < c_custkey % 10 AND c_custkey % 25 < 20 THEN 'drain' WHEN coalesce(pending, 0) > coalesce(deferred, 0) THEN 'refused' WHEN deferred > 0 THEN 'completed-with-deferred-errors' ELSE 'completed' END AS verdict
FROM customer LEFT JOIN p ON run_id = c_custkey""")
def run_finish_gate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    runs = table(spark, d, "customer").select(k.alias("run_id"), (k % 10).alias("uploaded"), (k % 11).alias("processed"), (k % 25).alias("drains"))
    pages = table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("error").alias("state"), (F.col("o_orderpriority") == "5-LOW").alias("deferred"))
    return dashboard.finish_gate(runs, pages)


def _title(captures: DataFrame) -> DataFrame:
    return captures.select("capture_id", F.lit("title").alias("record_type"), F.create_map(F.lit("title"), F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("payload"))


def _anchors(captures: DataFrame) -> DataFrame:
    return captures.select("capture_id", F.lit("links").alias("record_type"), F.create_map(F.lit("links"), F.size(F.split("html", "(?i)<a ")).cast("string")).alias("payload"))


def providers() -> sources.Providers:
    """Three made-up providers of the pages table, with different kinds, parsers and policies."""
    tongue = lambda df: F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)/", 1)
    one = sources.Provider("com", ("example.com",), tongue, {"en": _title, "de": _anchors}, active=("public-deterministic-collection", "authenticated-user-workflow"), allowed=("/en/", "/fr/"))
    two = sources.Provider("net", ("example.net",), lambda df: F.when(F.contains("url", F.lit("page=")), "list").otherwise("detail"), {"list": _anchors, "detail": _title}, active=("user-view-capture-fallback",), discoverable=("authorized-api-sync",), denied=sources.UNSAFE, closed=("m.ththth.example.net",))
    rest = sources.Provider("blog", ("blog.example.com", "example.org"), tongue, {"fr": _title}, discoverable=("authorized-report-import",))
    return sources.Providers(rest, one, two)


_OWNER = """CASE WHEN h = 'blog.example.com' OR h LIKE '%.blog.example.com' OR h = 'example.org' OR h LIKE '%.example.org' THEN 'blog' WHEN h = 'example.com' OR h LIKE '%.example.com' THEN 'com' WHEN h = 'example.net' OR h LIKE '%.example.net' THEN 'net' END"""
_DEALT = f"""h AS (SELECT page_id, url, html, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS h, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS tongue, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ''), '/') AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages),
 o AS (SELECT *, {_OWNER} AS provider FROM h), d AS (SELECT *, CASE provider WHEN 'net' THEN CASE WHEN contains(url, 'page=') THEN 'list' ELSE 'detail' END ELSE tongue END AS kind FROM o WHERE provider IS NOT NULL)"""


@R.add(f"""WITH {_DEALT} SELECT page_id, provider, kind, CASE provider WHEN 'com' THEN path LIKE '/en/%' OR path LIKE '/fr/%' WHEN 'net' THEN h <> 'm.ththth.example.net' AND NOT regexp_matches(lower(path || '?' || query), '{sources.UNSAFE}') AND NOT regexp_matches(path, '{sources.FILES}') ELSE true END AS navigable,
 CASE provider WHEN 'net' THEN 'discoverable' ELSE 'none' END AS api_sync, CASE provider WHEN 'com' THEN 'active' ELSE 'none' END AS public_collection FROM d""")
def provider_dealing(spark: SparkSession, d: str) -> DataFrame:
    p = providers()
    rows = p.dealt(table(spark, d, "pages"))
    ask = lambda c: p.capability(F.col("provider"), F.lit(c))
    return rows.select("page_id", "provider", "kind", p.navigable(F.col("url")).alias("navigable"), ask("authorized-api-sync").alias("api_sync"), ask("public-deterministic-collection").alias("public_collection"))


@R.add(f"""WITH {_DEALT} SELECT provider, kind, page_id::VARCHAR AS capture_id, CASE WHEN (provider, kind) IN (('com', 'de'), ('net', 'list')) THEN 'links' ELSE 'title' END AS record_type,
 CASE WHEN (provider, kind) IN (('com', 'de'), ('net', 'list')) THEN len(regexp_extract_all(html, '(?i)<a '))::INT + 1 || '' ELSE regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) END AS value FROM d WHERE (provider, kind) IN (('com', 'en'), ('com', 'de'), ('net', 'list'), ('net', 'detail'), ('blog', 'fr'))""")
def provider_records(spark: SparkSession, d: str) -> DataFrame:
    got = providers().records(table(spark, d, "pages").withColumn("capture_id", F.col("page_id")))
    return got.select("provider", "kind", "capture_id", "record_type", F.coalesce(F.col("payload")["title"], F.col("payload")["links"]).alias("value"))


@R.add("""WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey <> 7), o AS (SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) AND o_orderpriority <> '1-URGENT')
SELECT 'customer' AS name, c_custkey AS k, 1 AS n FROM c UNION ALL SELECT 'orders', o_orderkey, 1 FROM o UNION ALL SELECT 'lineitem', l_orderkey, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)) GROUP BY 2""")
def purged_tables(spark: SparkSession, d: str) -> DataFrame:
    """What is left of customers, orders and lines when a nation's customers and all urgent orders go."""
    t = {n: table(spark, d, n) for n in ("customer", "orders", "lineitem")}
    depends = [("lineitem", "orders", {"l_orderkey": "o_orderkey"}), ("orders", "customer", {"o_custkey": "c_custkey"})]
    kept = sources.purge(t, depends, {"customer": F.col("c_nationkey") == 7, "orders": F.col("o_orderpriority") == "1-URGENT"})
    one = lambda n, k: kept[n].groupBy(F.lit(n).alias("name"), F.col(k).cast("long").alias("k")).agg(F.count("*").alias("n"))
    return one("customer", "c_custkey").unionByName(one("orders", "o_orderkey")).unionByName(one("lineitem", "l_orderkey"))


@R.add("""WITH c AS (SELECT DISTINCT trim(s) AS code FROM (SELECT CASE s_suppkey % 5 WHEN 0 THEN ' ' ELSE ' ' || s_nationkey || ' ' END AS s FROM supplier) WHERE trim(s) <> ''), k AS (SELECT unnest(['UNIVERSITY_DETAIL', 'DEPARTMENTS', 'ADMISSIONS', 'CURRENT_CRITERIA', 'HISTORICAL_RESULTS']) AS kind)
SELECT sha256('official|2027|' || code || '|' || kind) AS task_id, 2027 AS academic_year, code, kind, 'https://example.org/detail?menuId=1&searchSyr=2027&unvCd=' || code AS url FROM c, k""")
def planned_tasks(spark: SparkSession, d: str) -> DataFrame:
    codes = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), "s_nationkey", F.lit(" "))).alias("code"))
    return planning.planned_tasks(codes, "code", 2027, "official", "https://example.org/detail?menuId=1")


_RAW = """CASE event_id % 5 WHEN 0 THEN '{"status":"running","stats":{"recordCount":' || user_id || ',"completedPages":"3","errors":"","errorCount":2,"pending":null,"outstanding":5}}' WHEN 1 THEN '{"run":{"state":" ","phase":"upload","records":"x","totalRecords":9,"completed":4,"totalPages":8,"completionReason":"done","finishedAt":"t' || event_id || '"}}'
 WHEN 2 THEN '{"status":{"status":"complete","summary":{"acceptedRecords":1.5,"pagesCompleted":7,"errorPages":1}}}' WHEN 3 THEN '{}' ELSE '{"phase":"idle","completed":250,"total":100,"updated_at":"u"}' END"""


@R.add("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN user_id::DOUBLE WHEN 1 THEN 9 WHEN 2 THEN 1.5 ELSE 0 END AS records, CASE event_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 7 WHEN 3 THEN 0 ELSE 250 END::DOUBLE AS completed, CASE event_id % 5 WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END::DOUBLE AS errors, CASE event_id % 5 WHEN 0 THEN 5 ELSE 0 END::DOUBLE AS pending,
 CASE event_id % 5 WHEN 1 THEN 8 WHEN 4 THEN 100 ELSE 0 END::DOUBLE AS total, CASE event_id % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'upload' WHEN 2 THEN 'complete' WHEN 3 THEN 'unknown' ELSE 'idle' END AS status, CASE event_id % 5 WHEN 1 THEN 'done' ELSE '—' END AS reason, CASE event_id % 5 WHEN 1 THEN 't' || event_id WHEN 4 THEN 'u' ELSE '—' END AS updated,
 CASE event_id % 5 WHEN 0 THEN 30 WHEN 1 THEN 50 WHEN 2 THEN 87.5 WHEN 3 THEN 0 ELSE 100 END::DOUBLE AS percent FROM events""")
def normal_statuses(spark: SparkSession, d: str) -> DataFrame:
    return planning.normal_statuses(table(spark, d, "events").select("event_id", F.expr(_RAW).alias("raw")), "raw").drop("raw")


@R.add("""WITH s AS (SELECT o_custkey AS target_id, max(o_orderkey) AS snapshot_id, arg_max(o_orderdate, o_orderkey) AS collected_at FROM orders GROUP BY 1)
SELECT c_custkey AS target_id, snapshot_id, collected_at, l_linenumber AS ordinal, l_quantity AS value FROM customer LEFT JOIN s ON target_id = c_custkey LEFT JOIN lineitem ON l_orderkey = snapshot_id""")
def latest_snapshot_rows(spark: SparkSession, d: str) -> DataFrame:
    snapshots = table(spark, d, "orders").select(F.col("o_custkey").alias("target_id"), F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("collected_at"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("snapshot_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_quantity").alias("value"))
    return planning.latest_rows(table(spark, d, "customer").select(F.col("c_custkey").alias("target_id")), snapshots, rows)


@R.add("""WITH t AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'u' || event_type END AS university, CASE WHEN event_id % 4 = 0 THEN 'd' ELSE ' ' END AS department, 'a' || event_id AS admission, CASE WHEN event_id % 7 = 0 THEN 'c' END AS campus, event_id % 4 AS sure FROM events WHERE event_id % 5 <> 0),
 r AS (SELECT *, ((university IS NOT NULL)::INT + (trim(department) <> '')::INT + 1 + (campus IS NOT NULL)::INT) * 10 + sure AS full_ FROM t), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY full_ DESC, event_id) AS n FROM r) WHERE n = 1),
 l AS (SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS coverage FROM events WHERE value >= 80 AND event_type <> 'view' GROUP BY 1)
SELECT user_id::VARCHAR AS identity_key, university, department, admission, campus, coalesce(coverage, '') AS coverage FROM b LEFT JOIN l USING (user_id)""")
def mission_applications(spark: SparkSession, d: str) -> DataFrame:
    e, k, user = table(spark, d, "events"), F.col("event_id"), F.col("user_id").cast("string")
    targets = e.select(
        user.alias("identity_key"), F.when(k % 5 == 0, "other").otherwise(user).alias("context_key"), F.when(k % 3 == 0, F.concat(F.lit("u"), "event_type")).alias("university"), F.when(k % 4 == 0, "d").otherwise(" ").alias("department"),
        F.concat(F.lit("a"), k).alias("admission"), F.when(k % 7 == 0, "c").alias("campus"), (k % 4).alias("confidence_rank"), k.alias("place"),
    )
    coverage = e.filter("value >= 80").select(user.alias("identity_key"), F.when(F.col("event_type") == "view", "reference").otherwise(F.col("event_type")).alias("lane"))
    got = planning.mission_applications(targets, coverage)
    return planning.in_order(got).withColumn("coverage", F.array_join("coverage", ","))
