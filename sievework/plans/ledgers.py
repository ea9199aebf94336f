"""Queries on the ledger of a collection: counts, choice, gates, slots, dossiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger, navigate, pages
from .evidence import _PATH as URL_PATH
from .registry import Registry, table

R = Registry()
LANES = ("purchase", "signup", "click", "view")
_STATE = "CASE WHEN value >= 90 THEN 'confirmed' WHEN value >= 70 THEN 'clicked' WHEN value >= 50 THEN 'deferred' WHEN value >= 20 THEN 'pending' WHEN value >= 10 THEN 'failed' ELSE 'skipped' END"
_TARGETS = f"t AS (SELECT event_id AS target_id, user_id AS identity_key, event_type AS lane, {_STATE} AS state, floor(value)::INT AS priority FROM events)"


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("target_id"), F.col("user_id").alias("identity_key"), F.col("event_type").alias("lane"), F.expr(_STATE).alias("state"), F.floor("value").cast("int").alias("priority"))


_COUNTS = "count(*) AS targets, count(DISTINCT identity_key) AS identities, " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ledger.STATES)


@R.add(f"WITH {_TARGETS} SELECT lane, {_COUNTS} FROM t GROUP BY 1")
def ledger_by_lane(spark: SparkSession, d: str) -> DataFrame:
    return ledger.state_counts(_targets(spark, d), ["lane"])


@R.add(f"WITH {_TARGETS} SELECT {_COUNTS} FROM t")
def ledger_totals(spark: SparkSession, d: str) -> DataFrame:
    return ledger.state_counts(_targets(spark, d), [])


@R.add(f"""WITH {_TARGETS}, e AS (SELECT identity_key, count(*) AS t, count(*) FILTER (state IN ('pending', 'clicked', 'deferred')) AS o, count(DISTINCT CASE WHEN state = 'confirmed' THEN lane END) AS lanes FROM t GROUP BY 1)
SELECT count(identity_key) AS identities, sum(t)::BIGINT AS targets, sum(o)::BIGINT AS outstanding, count(*) FILTER (lanes >= 4) AS with_4_lanes, count(*) FILTER (lanes >= 6) AS with_6_lanes FROM e""")
def confirmed_depth(spark: SparkSession, d: str) -> DataFrame:
    return ledger.confirmed_depth(_targets(spark, d))


@R.add(f"""WITH {_TARGETS}, m AS (SELECT *, identity_key % 100 AS grp, NOT bool_or(state = 'confirmed') OVER (PARTITION BY identity_key % 100, identity_key, lane) AS lane_missing FROM t),
 r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY (identity_key % 7 = 0) DESC, lane_missing DESC, CASE lane WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END, priority DESC NULLS LAST, target_id) AS n FROM m WHERE state IN ('pending', 'deferred'))
SELECT grp, target_id, identity_key, lane, priority, lane_missing FROM r WHERE n = 1""")
def mission_choice(spark: SparkSession, d: str) -> DataFrame:
    t = _targets(spark, d).withColumns({"grp": F.col("identity_key") % 100, "preferred": F.col("identity_key") % 7 == 0})
    return ledger.mission_choice(t, ["grp"], LANES)


@R.add("SELECT o_orderstatus AS run, coalesce(o_orderpriority, 'unknown') AS record_type, year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY 1, 2, 3")
def record_breakdown(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumns({"run": F.col("o_orderstatus"), "_year": F.year("o_orderdate")})
    return ledger.breakdown(o, ["run"], "o_orderpriority", "_year")


_TYPE = "CASE " + " ".join(f"WHEN contains(url, '{part}') THEN '{kind}'" for kind, part in pages.OFFICIAL_PAGES) + " WHEN contains(url, '/en/') THEN 'english' ELSE 'other' END"


@R.add(f"WITH c AS (SELECT {_TYPE} AS kind, count(*) AS pages FROM pages GROUP BY 1) SELECT kind, pages, (SELECT sum(pages)::BIGINT FROM c) AS total, round(pages::DOUBLE / (SELECT sum(pages) FROM c), 6) AS share FROM c")
def page_type_histogram(spark: SparkSession, d: str) -> DataFrame:
    kind = pages.official_page_type(F.col("url"))
    return ledger.histogram(table(spark, d, "pages").select(F.when((kind == "other") & F.contains("url", F.lit("/en/")), "english").otherwise(kind).alias("k")), "k")


_LOWER_PATH = f"CASE WHEN url LIKE '%://%' THEN lower({URL_PATH}) ELSE lower(url) END"
_LANE = "CASE " + " ".join("WHEN " + " OR ".join(f"regexp_matches({c}, '{p}')" for c, p in (("path", at), ("low", said)) if p) + f" THEN '{name}'" for name, _, at, said in navigate.LANES) + " ELSE 'unknown' END"


@R.add(f"SELECT page_id, {_LANE} AS lane FROM (SELECT page_id, lower(url) || ' ' AS low, {_LOWER_PATH} AS path FROM pages)")
def route_lanes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", navigate.lane(F.col("url"), F.lit(""))["lane"].alias("lane"))


_SOME = "({0} IS NOT NULL AND trim({0}) NOT IN ('', 'null'))"


@R.add(f"""SELECT source, count(*) AS records, count(*) FILTER ({_SOME.format('source')}) AS university_bound, count(*) FILTER ({_SOME.format('lang')}) AS department_bound, count(*) FILTER (quality IS NOT NULL) AS admission_bound,
 count(*) FILTER ({_SOME.format('source')} AND {_SOME.format('lang')} AND quality IS NOT NULL) AS fully_bound FROM (SELECT source, lang, quality FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1""")
def binding_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return ledger.binding_stats(rows.withColumn("_u", F.col("source")), ["source"], "_u", "lang", "quality")


@R.add("WITH n AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events) SELECT event_id, nth::INT AS nth, NOT (event_type = 'view' AND nth > 2) AS expand FROM n")
def repeat_capture_gate(spark: SparkSession, d: str) -> DataFrame:
    return ledger.repeat_captures(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], F.col("event_type") == "view").select("event_id", "nth", "expand")


_TOLD = "CASE s_suppkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(left(n_name, 4)) || ' ' WHEN 2 THEN 'nation-' || n_nationkey ELSE 'none' END"


@R.add(f"""WITH told AS (SELECT s_suppkey, {_TOLD} AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
 known AS (SELECT n_nationkey AS place, 'nation-' || n_nationkey AS target_id, unnest([lower('nation-' || n_nationkey), replace(lower(n_name), ' ', ''), replace(lower(left(n_name, 4)), ' ', '')]) AS k FROM nation), one AS (SELECT k, arg_min(target_id, place) AS target_id FROM known GROUP BY 1)
SELECT s_suppkey, name, target_id FROM told LEFT JOIN one ON k = replace(lower(name), ' ', '')""")
def alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    told = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.expr(_TOLD).alias("name"))  # at most 25 nations
    targets = n.select(F.col("n_nationkey").alias("place"), F.expr("'nation-' || n_nationkey").alias("target_id"), F.col("n_name").alias("university"), F.array(F.substring("n_name", 1, 4)).alias("aliases"))
    return ledger.resolve_alias(told, "name", targets)


@R.add("""WITH a AS (SELECT l_orderkey AS k, arg_max(l_partkey, {'n': l_linenumber, 'p': l_partkey}) AS entity FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS fingerprint, CASE WHEN k IS NULL THEN 'provisional' ELSE 'accepted' END AS quality_state, CASE WHEN k IS NULL THEN o_custkey ELSE entity END AS entity FROM orders LEFT JOIN a ON k = o_orderkey""")
def quality_propagation(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "orders").select(F.col("o_orderkey").alias("fingerprint"), F.lit("provisional").alias("quality_state"), F.col("o_custkey").alias("entity"))
    accepted = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("fingerprint"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("entity"))
    return ledger.propagate_quality(records, accepted, ["entity"])


@R.add("""WITH s AS (SELECT * FROM (SELECT o_custkey AS c, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS slot FROM orders) WHERE slot <= 6), q AS (SELECT c, id FROM (SELECT o_custkey AS c, max(o_orderkey) AS id FROM orders GROUP BY 1)),
 j AS (SELECT s.*, q.id AS new, max(CASE WHEN s.id = q.id THEN s.slot END) OVER (PARTITION BY s.c) AS came FROM s JOIN q USING (c))
SELECT c AS cust_key, (CASE WHEN slot = 2 THEN came ELSE slot END)::INT AS slot, id AS identity_key FROM j WHERE id <> new AND (slot <> 2 OR came IS NOT NULL) UNION ALL SELECT c, 2, id FROM q""")
def slot_swap(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("cust_key"), F.col("o_orderkey").alias("identity_key"), F.lit("").alias("label"))
    slots = o.withColumn("slot", F.row_number().over(W.partitionBy("cust_key").orderBy("identity_key"))).filter("slot <= 6")  # six slots each
    asked = o.groupBy("cust_key").agg(F.max("identity_key").alias("identity_key")).withColumns({"slot": F.lit(2), "label": F.lit("")})
    return ledger.place_in_slots(slots, asked, ["cust_key"]).select("cust_key", "slot", "identity_key")


@R.add("""WITH o AS (SELECT o_custkey AS k, count(*) AS outcomes, max(o_totalprice) AS best FROM orders GROUP BY 1), p AS (SELECT user_id AS k, arg_max(value, {'t': ts, 'e': event_id}) AS bars, max(ts) AS seen FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT c_custkey AS identity_key, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS score, coalesce(outcomes, 0) AS outcomes, best AS best_outcome, bars, seen AS predicted_at, CASE WHEN seen IS NOT NULL THEN 'collected' WHEN c_custkey % 3 = 0 THEN 'failed' ELSE 'not-observed' END AS prediction_state
FROM customer LEFT JOIN o ON o.k = c_custkey LEFT JOIN p ON p.k = c_custkey""")
def application_dossier(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "identity_key")
    outcomes = table(spark, d, "orders").select(F.col("o_custkey").alias("identity_key"), F.col("o_totalprice").alias("value"))
    predictions = table(spark, d, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("identity_key"), F.col("ts").alias("observed_at"), F.col("event_id").alias("place"), F.col("value").alias("bars"))
    lanes = c.filter("identity_key % 3 = 0").select("identity_key", F.lit("failed").alias("lane_state"))
    return ledger.dossier(c.select("identity_key"), c.filter("c_acctbal > 0").select("identity_key", F.col("c_acctbal").alias("score")), outcomes, predictions, lanes)


@R.add(f"""WITH {_TARGETS}, e AS (SELECT identity_key, count(DISTINCT CASE WHEN state = 'confirmed' THEN lane END) AS lanes, count(*) FILTER (state = 'pending') AS o, count(*) FILTER (state = 'clicked') AS r FROM t GROUP BY 1),
 a AS (SELECT count(*) AS expected, count(*) FILTER (lanes >= 3) AS full_coverage, coalesce(sum(o), 0)::BIGINT AS outstanding, count(*) FILTER (r > 0) AS returns FROM e)
SELECT expected, full_coverage, outstanding, returns, expected >= 6 AND full_coverage = expected AND outstanding = 0 AND returns >= expected AS closed FROM a""")
def coverage_closure(spark: SparkSession, d: str) -> DataFrame:
    count = lambda s: F.count_if(F.col("state") == s)
    each = _targets(spark, d).groupBy("identity_key").agg(F.count_distinct(F.when(F.col("state") == "confirmed", F.col("lane"))).alias("covered_count"), count("pending").alias("outstanding"), count("clicked").alias("returned"))
    return ledger.coverage_closed(each, 3)
