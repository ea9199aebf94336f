"""Queries on collection state: resume plans, progress, latest states, merges, queues, time series.

The tables stand for the evidence model: an order is a list to collect and its
line numbers are pages; users' events are captures, states and time series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import resume, tables
from .registry import Registry, table

R = Registry()
NOW = "2000-01-01 00:00:00"
RANKS = {"view": 0, "click": 10, "error": 30, "signup": 40, "purchase": 50}
ALLOWED = {"view": ("click", "error"), "click": ("purchase", "signup", "error"), "signup": ("purchase",), "error": ("view",)}
_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_LAST = "PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC"
_PAGES = f"""pages AS (
  SELECT l_orderkey AS order_key, l_linenumber::INT AS page, l_suppkey AS supp_key, CASE WHEN l_returnflag <> 'R' THEN 'completed' WHEN l_linestatus = 'O' THEN 'error' ELSE 'pending' END AS state,
         (l_quantity::INT % 4)::INT AS retry_count, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN CASE WHEN l_quantity > 25 THEN 'server-error' ELSE 'timeout' END END AS error_type, l_shipdate AS updated_at
  FROM (SELECT *, row_number() OVER ({_LAST}) AS n FROM lineitem) WHERE n = 1)"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.keep_last(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], _ORDER)
    bad = F.col("l_returnflag") == "R"
    server = bad & (F.col("l_linestatus") == "O")
    return rows.select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").cast("int").alias("page"), F.col("l_suppkey").alias("supp_key"),
        F.when(~bad, "completed").when(server, "error").otherwise("pending").alias("state"), (F.col("l_quantity").cast("int") % 4).alias("retry_count"),
        F.when(server, F.when(F.col("l_quantity") > 25, "server-error").otherwise("timeout")).alias("error_type"), F.col("l_shipdate").alias("updated_at"),
    )


_STATUS = f"""CASE WHEN p.state IS NULL THEN 'missing' WHEN p.state = 'completed' THEN 'completed'
 WHEN p.error_type = 'server-error' AND p.retry_count >= 2 AND epoch(TIMESTAMP '{NOW}') - epoch(p.updated_at) < 21600 THEN 'deferred' ELSE 'retry' END"""


@R.add(f"""WITH {_PAGES} SELECT o.order_key, o.page, {_STATUS} AS status, p.retry_count
FROM (SELECT o_orderkey AS order_key, unnest(range(1, 8))::INT AS page FROM orders) o LEFT JOIN pages p USING (order_key, page)""")
def resume_plan_pages(spark: SparkSession, d: str) -> DataFrame:
    families = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), F.lit(7).alias("total_pages"))
    return resume.resume_plan(families, _pages(spark, d), ["order_key"], F.lit(NOW).cast("timestamp"))


@R.add(f"""WITH {_PAGES}, plan AS (SELECT o.order_key, o.page, {_STATUS} AS status, p.retry_count
FROM (SELECT o_orderkey AS order_key, unnest(range(2, 8))::INT AS page FROM orders) o LEFT JOIN pages p USING (order_key, page))
SELECT order_key, page, status, retry_count, n_all >= 2 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY order_key, status ORDER BY page) AS n, count(*) OVER (PARTITION BY order_key, status) AS n_all FROM plan) WHERE n <= 2""")
def resume_plan_limited(spark: SparkSession, d: str) -> DataFrame:
    families = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), F.lit(7).alias("total_pages"))
    return resume.limited(resume.resume_plan(families, _pages(spark, d), ["order_key"], F.lit(NOW).cast("timestamp"), start_page=2), ["order_key"], 2)


@R.add(f"""WITH {_PAGES} SELECT order_key, page, state, error_type, max_page FROM (SELECT *, max(page) OVER (PARTITION BY order_key) AS max_page FROM pages) WHERE state <> 'completed'""")
def pending_with_group_max(spark: SparkSession, d: str) -> DataFrame:
    return resume.pending_with_known_total(_pages(spark, d), ["order_key"]).select("order_key", "page", "state", "error_type", "max_page")


@R.add(f"""WITH {_PAGES} SELECT supp_key, year(updated_at)::INT AS year, max(page) AS max_page, count(*) AS known_pages, count(*) FILTER (state = 'completed') AS completed_pages,
 count(*) FILTER (state = 'error') AS error_pages, count(*) FILTER (state NOT IN ('completed', 'error')) AS open_pages FROM pages GROUP BY ALL""")
def family_progress(spark: SparkSession, d: str) -> DataFrame:
    return resume.progress(_pages(spark, d).withColumn("year", F.year("updated_at")), ["supp_key", "year"])


@R.add(f"WITH {_PAGES} SELECT error_type, count(*) AS n FROM pages WHERE error_type IS NOT NULL GROUP BY 1")
def errors_by_type(spark: SparkSession, d: str) -> DataFrame:
    return resume.errors_by_type(_pages(spark, d))


@R.add("""SELECT count(*) AS n_all, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_orderstatus = 'F') AS n_done, count(*) FILTER (o_orderstatus = 'P') AS n_part,
 count(DISTINCT o_custkey) AS n_keys, count(*) FILTER (o_orderstatus = 'O') + (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS unresolved FROM orders""")
def run_stats_panel(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    orders = table(spark, d, "orders").agg(F.count("*").alias("n_all"), *(F.count_if(status == s).alias(n) for s, n in (("O", "n_open"), ("F", "n_done"), ("P", "n_part"))), F.count_distinct("o_custkey").alias("n_keys"))
    back = table(spark, d, "lineitem").filter("l_returnflag = 'R'").agg(F.count("*").alias("_b"))
    return orders.crossJoin(back).withColumn("unresolved", F.col("n_open") + F.col("_b")).drop("_b")  # a row by a row


@R.add("""SELECT c_custkey AS run, c_mktsegment AS segment, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O') AS has_open,
 CASE WHEN EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O') THEN 0 ELSE 1 END::INT AS place FROM customer c""")
def active_run_exists(spark: SparkSession, d: str) -> DataFrame:
    open_ = table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_o", F.lit(True))
    has = F.coalesce("_o", F.lit(False))
    return table(spark, d, "customer").join(open_, "c_custkey", "left").select(F.col("c_custkey").alias("run"), F.col("c_mktsegment").alias("segment"), has.alias("has_open"), F.when(has, 0).otherwise(1).alias("place"))


@R.add("SELECT user_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_event_per_user(spark: SparkSession, d: str) -> DataFrame:
    return tables.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "ts", "event_type", "value")


_RANK = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 10 WHEN 'error' THEN 30 WHEN 'signup' THEN 40 WHEN 'purchase' THEN 50 ELSE -1 END"


@R.add(f"""WITH e AS (SELECT *, {_RANK} AS r FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC, ts DESC, event_id DESC) AS n FROM e)
SELECT b.user_id, b.event_type AS state, b.r::INT AS state_rank, f.first AS first_persisted_at, b.ts AS state_at, f.n_events
FROM b JOIN (SELECT user_id, min(ts) AS first, count(*) AS n_events FROM events GROUP BY 1) f USING (user_id) WHERE b.n = 1""")
def monotone_state_merge(spark: SparkSession, d: str) -> DataFrame:
    return tables.merge_by_rank(table(spark, d, "events"), "user_id", "event_type", RANKS, "ts", "event_id")


@R.add("""SELECT user_id, event_type, count(*) AS seen_count, min(ts) AS first_observed_at, max(ts) AS last_observed_at, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id
FROM events GROUP BY 1, 2""")
def observation_merge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("_tie", F.col("event_id"))
    return tables.merge_observations(e, ["user_id", "event_type"], "ts", "_tie", ["value", "event_id"])


@R.add("""WITH e AS (SELECT user_id, ts, event_id, (value >= 50)::VARCHAR AS content FROM events), l AS (SELECT *, lag(content) OVER w AS p, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, ts, event_id, content FROM l WHERE n = 1 OR content IS DISTINCT FROM p""")
def unchanged_suppression(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("value") >= 50).cast("string").alias("content"))
    return tables.changes_only(e, "user_id", ["ts", "event_id"], "content")


_DIFF = "round((epoch_us(ts) - epoch_us(p)) / 60000000.0)::BIGINT"


@R.add(f"""WITH l AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), m AS (SELECT *, {_DIFF} AS diff FROM l)
SELECT user_id, event_id, CASE WHEN diff BETWEEN 1 AND 120 THEN CASE WHEN list_contains([1,2,3,5,10,15,20,30,60,120], diff) THEN diff
 ELSE list_filter([1,2,3,5,10,15,20,30,60,120], lambda n: diff % n = 0 AND diff / n <= 6)[1] END END::INT AS minutes FROM m""")
def cadence_inference(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("_p", before).select("user_id", "event_id", V.cadence(F.col("_p"), F.col("ts")).alias("minutes"))


@R.add("""WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_state FROM events)
SELECT user_id, event_id, event_type, previous_state, previous_state IS NULL OR previous_state = event_type OR (previous_state || '>' || event_type) IN
 ('view>click', 'view>error', 'click>purchase', 'click>signup', 'click>error', 'signup>purchase', 'error>view') AS legal FROM l""")
def transition_validity(spark: SparkSession, d: str) -> DataFrame:
    return tables.transitions(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", ALLOWED).select("user_id", "event_id", "event_type", "previous_state", "legal")


_TASKS = """tasks AS (SELECT o_orderkey AS task_id, o_orderpriority AS provider, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'claimed' ELSE 'completed' END AS state, (o_totalprice / 1000)::INT AS priority,
 (o_orderkey % 6)::INT AS attempt_count, CASE WHEN o_orderstatus = 'P' THEN 'worker' END AS lease_owner, CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS lease_expires_at, o_orderdate AS updated_at FROM orders)"""


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    held = F.col("o_orderstatus") == "P"
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("provider"), F.when(F.col("o_orderstatus") == "O", "pending").when(held, "claimed").otherwise("completed").alias("state"),
        F.round(F.col("o_totalprice") / 1000).cast("int").alias("priority"), (F.col("o_orderkey") % 6).cast("int").alias("attempt_count"), F.when(held, "worker").alias("lease_owner"),
        F.when(held, F.col("o_orderdate")).alias("lease_expires_at"), F.col("o_orderdate").alias("updated_at"),
    )


@R.add(f"""WITH {_TASKS}, t AS (SELECT *, state = 'pending' AND attempt_count < 4 AS free FROM tasks), n AS (SELECT *, row_number() OVER (PARTITION BY provider, free ORDER BY priority DESC, updated_at, task_id) AS k FROM t)
SELECT task_id, provider, CASE WHEN free AND k <= 12 THEN 'claimed' ELSE state END AS state, (attempt_count + (free AND k <= 12)::INT)::INT AS attempt_count, CASE WHEN free AND k <= 12 THEN 'me' ELSE lease_owner END AS lease_owner FROM n""")
def frontier_claim_topk(spark: SparkSession, d: str) -> DataFrame:
    return resume.claim(_tasks(spark, d), "me", F.lit(NOW).cast("timestamp"), 12).select("task_id", "provider", "state", "attempt_count", "lease_owner")


@R.add(f"""WITH {_TASKS} SELECT task_id, CASE WHEN state = 'claimed' AND lease_expires_at < TIMESTAMP '{NOW}' THEN CASE WHEN attempt_count >= 4 THEN 'failed' ELSE 'pending' END ELSE state END AS state,
 CASE WHEN NOT coalesce(state = 'claimed' AND lease_expires_at < TIMESTAMP '{NOW}', false) THEN lease_owner END AS lease_owner FROM tasks""")
def lease_release(spark: SparkSession, d: str) -> DataFrame:
    return resume.release_expired(_tasks(spark, d).fillna("", ["lease_owner"]).withColumn("lease_owner", F.nullif("lease_owner", F.lit(""))), F.lit(NOW).cast("timestamp")).select("task_id", "state", "lease_owner")


@R.add("""SELECT l_orderkey AS order_key, count(*) AS received, count(DISTINCT l_linenumber) AS fresh, count(*) - count(DISTINCT l_linenumber) AS duplicate, count(*) FILTER (l_returnflag = 'R') AS errors FROM lineitem GROUP BY 1""")
def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(
        F.count("*").alias("received"), F.count_distinct("l_linenumber").alias("fresh"), (F.count("*") - F.count_distinct("l_linenumber")).alias("duplicate"), F.count_if(F.col("l_returnflag") == "R").alias("errors")
    )


@R.add("SELECT min(doc_id) AS doc_id, sha256(text) AS text_sha256 FROM documents GROUP BY text")
def dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    return tables.keep_first(docs, ["text_sha256"], ["doc_id"])


@R.add(f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate FROM (SELECT *, row_number() OVER ({_LAST}) AS n FROM lineitem) WHERE n = 1")
def dedupe_keep_last(spark: SparkSession, d: str) -> DataFrame:
    return tables.keep_last(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], _ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")


@R.add("""WITH s AS (SELECT l_suppkey AS family, l_linenumber AS page, sha256(string_agg(l_returnflag || l_linestatus, chr(10) ORDER BY l_returnflag || l_linestatus)) AS signature, count(*) AS n_rows FROM lineitem GROUP BY 1, 2)
SELECT family, page, signature, n_rows, min(page) OVER (PARTITION BY family, signature) AS owner FROM s""")
def page_signature_owner(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("family"), F.col("l_linenumber").alias("page"), F.concat("l_returnflag", "l_linestatus").alias("m"))
    return tables.page_signatures(rows, ["family"], "page", F.col("m"))


@R.add("""SELECT o_orderkey AS order_key, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'yr:' || year(o_orderdate) || ':' || sha256(o_orderkey::VARCHAR) ELSE sha256(o_orderkey::VARCHAR) END AS fingerprint FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')""")
def year_scoped_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    mark = V.scoped_fingerprint(F.col("o_orderpriority"), F.year("o_orderdate"), F.sha2(F.col("o_orderkey").cast("string"), 256), ("1-URGENT", "2-HIGH"))
    return table(spark, d, "orders").join(known, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("order_key"), mark.alias("fingerprint"))


@R.add("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, max(value) AS most, min(ts) AS first_at, count(*) FILTER (event_type = 'error') AS errors,
 max(CASE WHEN n = 1 THEN event_type END) AS last_type FROM e GROUP BY 1""")
def upsert_policies(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.col("value").alias("most"), F.col("ts").alias("first_at"), F.col("event_type").alias("last_type"))
    merged = tables.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id"], ["ts", "event_id"], {"most": "max", "first_at": "min"})
    errors = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    return merged.join(errors, "user_id")


@R.add("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.k')::BIGINT >= 50 AS high FROM events")
def json_metric_extract(spark: SparkSession, d: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").select("event_id", k.alias("k"), (k >= 50).alias("high"))


@R.add()
def nested_export(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import export

    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), "o_orderstatus", "o_totalprice")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key"), "l_linenumber", "l_partkey", "l_quantity")
    return export.nested(orders, lines, "order_key", ["l_linenumber", "l_partkey", "l_quantity"], "lines")
