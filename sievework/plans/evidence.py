"""Queries on evidence: extraction, redaction, binding, coverage, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..functions import values as V
from ..operators import binding, decide, extract, tables
from .registry import Registry, table

R = Registry()
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
_PATH = "CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END"
_SECRET = "(?i)token|session|auth|csrf|transkey|captcha|password|passwd|secret|credential|userid|ipmac"
TOPIC_WORDS = (("license", "(?i)licen[sc]e"), ("mail", "@"), ("digits", "[0-9]{4}"), ("question", r"\?"), ("list", "(?m)^[-*] "))


@R.add(f"""SELECT page_id, {_HOST} || {_PATH} AS safe_path, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || {_HOST} || {_PATH} || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical,
 CASE WHEN page = '' THEN NULL ELSE page END::INT AS page FROM (SELECT *, list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(regexp_extract(p, '^([^=]*)', 1), '{_SECRET}')) AS kept,
 regexp_extract(url, '[?&]page=([0-9]+)', 1) AS page FROM pages)""")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", U.safe_path(url, most=10_000).alias("safe_path"), U.canonical(url).alias("canonical"), U.parameter(url, "page").try_cast("int").alias("page"))


@R.add(f"SELECT {_PATH} AS family, count(*) AS n_pages, count(DISTINCT {_HOST}) AS n_hosts FROM pages WHERE url LIKE '%://%' GROUP BY 1")
def url_families(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(U.family_key(F.col("url")).alias("family"), U.host(F.col("url")).alias("host")).filter("family is not null")
    return p.groupBy("family").agg(F.count("*").alias("n_pages"), F.count_distinct("host").alias("n_hosts"))


@R.add(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '[\s\x{00A0}\x{3000}]+', ' ', 'g')) AS title FROM pages""")
def page_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


_LINKS = r"""regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*["'']([^"'']+)["'']', 1)"""


@R.add(f"""WITH l AS (SELECT page_id, {_LINKS} AS links FROM pages), x AS (SELECT page_id, unnest(links) AS link, generate_subscripts(links, 1) AS pos FROM l), f AS (SELECT page_id, link, min(pos) AS pos FROM x GROUP BY 1, 2)
SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY pos)::INT AS place FROM f""")
def link_extraction(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    found = table(spark, d, "pages").select("page_id", F.posexplode(U.links(F.col("html"))).alias("at", "link"))
    return found.groupBy("page_id", "link").agg(F.min("at").alias("at")).select("page_id", "link", F.row_number().over(W.partitionBy("page_id").orderBy("at")).alias("place"))


@R.add(f"""WITH l AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, {_LINKS} AS links FROM pages), x AS (SELECT page_id, h, p, unnest(links) AS link, generate_subscripts(links, 1) AS pos FROM l),
 r AS (SELECT page_id, h, pos, CASE WHEN link LIKE '/%' THEN link ELSE regexp_replace(p, '[^/]*$', '') || link END AS u FROM x WHERE NOT regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:|^//|^[?#]|(^|/)[.]')),
 u AS (SELECT page_id, pos, 'https://' || h || regexp_extract(u, '^([^?#]*)', 1) || regexp_extract(u, '^[^?#]*(\\?[^#]+)', 1) AS url FROM r WHERE h IN ('example.com', 'example.org', 'net') OR regexp_matches(h, '[.](example[.]com|example[.]org|net)$')), f AS (SELECT page_id, url, min(pos) AS pos FROM u GROUP BY 1, 2)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos)::INT AS place, url FROM f""")
def public_frontier_links(spark: SparkSession, d: str) -> DataFrame:
    """Links resolved against their page and cleaned for the frontier; the SQL knows rooted and plain relative links, as the pages have no others."""
    pages = table(spark, d, "pages").withColumn("url", F.regexp_replace("url", "^http://", "https://"))
    return extract.public_links(pages, "page_id", ("example.com", "example.org", "net"))


@R.add()
def page_text(spark: SparkSession, d: str) -> DataFrame:
    """Visible text of pages as digest and length (not in SQL: character references)."""
    text = F.col("visible")
    return table(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("visible")).select("page_id", F.length(text).alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


@R.add(r"""SELECT doc_id, sha256(regexp_replace(trim(regexp_replace(coalesce(text, ''), '[\s\x{00A0}\x{3000}\x0B]+', ' ', 'g')), '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}', '[redacted-email]', 'g')) AS text_sha256,
 len(regexp_extract_all(coalesce(text, ''), '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}'))::INT AS n_emails FROM documents""")
def email_redaction(spark: SparkSession, d: str) -> DataFrame:
    pattern, said = T.REDACTIONS[0]
    out = F.regexp_replace(T.squeeze(T.text_of(F.col("text"))), pattern, said)
    return table(spark, d, "documents").select("doc_id", F.sha2(out, 256).alias("text_sha256"), F.regexp_count(T.text_of(F.col("text")), F.lit(pattern)).alias("n_emails"))


@R.add()
def pii_redaction(spark: SparkSession, d: str) -> DataFrame:
    """All redaction rules (not in SQL: rules that look behind)."""
    marks = {s.strip("[]").replace("-", "_"): s for _, s in T.REDACTIONS}
    out = F.col("out")  # a column of its own, so that the rules run once a text
    return table(spark, d, "documents").select("doc_id", T.redact(F.col("text")).alias("out")).select("doc_id", F.sha2(out, 256).alias("text_sha256"), *(F.regexp_count(out, F.lit(rf"\Q{s}\E")).alias(n) for n, s in marks.items()))


@R.add("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}' END" for n, p in TOPIC_WORDS) + "], lambda x: x IS NOT NULL), ',') AS topics FROM documents")
def topic_tagging(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(extract.topics(T.text_of(F.col("text")), TOPIC_WORDS), ",").alias("topics"))


@R.add(r"""SELECT doc_id, nullif(regexp_extract(coalesce(text, ''), '([A-Z][a-z]{3,12})', 1), '') AS first_name, list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]{3,6}')), 'ASC')[1] AS least_number FROM documents""")
def context_first_match(spark: SparkSession, d: str) -> DataFrame:
    text = T.text_of(F.col("text"))
    return table(spark, d, "documents").select(
        "doc_id", F.nullif(F.regexp_extract(text, "([A-Z][a-z]{3,12})", 1), F.lit("")).alias("first_name"), F.get(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9]{3,6}"), F.lit(0)))), F.lit(0)).alias("least_number")
    )


@R.add("""WITH b AS (SELECT *, greatest(0, 400 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS room FROM conversations)
SELECT conv_id, turn, role, substr(text, 1, room::BIGINT) AS text FROM b WHERE room > 0""")
def text_budget(spark: SparkSession, d: str) -> DataFrame:
    return tables.text_budget(table(spark, d, "conversations"), "conv_id", ["turn"], "text", 400)


@R.add("""WITH s AS (SELECT conv_id, turn, role, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS segment,
 last_value(CASE WHEN role = 'user' THEN left(text, 40) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM conversations)
SELECT conv_id, turn, segment, header FROM s WHERE role <> 'user' AND segment > 0""")
def segment_scope_fill(spark: SparkSession, d: str) -> DataFrame:
    c, user = table(spark, d, "conversations"), F.col("role") == "user"
    c = tables.segments(c, ["conv_id"], ["turn"], user)
    head = tables.carried(c, ["conv_id"], ["turn"], F.when(user, F.substring("text", 1, 40)))
    return c.withColumn("header", head).filter(~user & (F.col("segment") > 0)).select("conv_id", "turn", "segment", "header")


@R.add("SELECT o_custkey AS cust_key, o_orderpriority AS label, year(o_orderdate)::INT AS year, count(*)::VARCHAR AS value FROM orders WHERE year(o_orderdate) BETWEEN 2000 AND 2001 GROUP BY 1, 2, 3")
def unpivot_year_columns(spark: SparkSession, d: str) -> DataFrame:
    years = [2000, 2001]
    group = F.col("o_custkey").alias("cust_key"), F.col("o_orderpriority").alias("label")
    wide = table(spark, d, "orders").groupBy(*group).agg(*(F.count_if(F.year("o_orderdate") == y).alias(str(y)) for y in years))
    rows = wide.select(
        "cust_key", F.array(F.lit("전형/모집단위"), *(F.lit(f"{y}학년도") for y in years)).alias("header"),
        F.array("label", *(F.when(F.col(str(y)) > 0, F.col(str(y)).cast("string")).otherwise("") for y in years)).alias("cells"),
    )
    return extract.unpivot_years(rows, ["cust_key"])


_KEY = "regexp_replace(lower({}), '[^0-9a-z가-힣]', '', 'g')"


@R.add(f"SELECT {_KEY.format('p_name')} AS name_key, count(*) AS parts, count(DISTINCT p_brand) AS brands, min(p_partkey) AS first_part FROM part GROUP BY 1")
def entity_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(T.loose_key(F.col("p_name")).alias("name_key")).agg(F.count("*").alias("parts"), F.count_distinct("p_brand").alias("brands"), F.min("p_partkey").alias("first_part"))


def _bound(spark: SparkSession, d: str) -> DataFrame:
    """Parts as records and applications: brand is the university, type the department, name the admission."""
    p = table(spark, d, "part")
    rows = p.groupBy("p_brand", "p_type", "p_name").agg(F.min("p_partkey").alias("k"))
    one = rows.select(F.col("k").cast("string").alias("fingerprint"), F.col("p_type").alias("record_type"), F.lit(0).alias("year"), F.col("p_brand").alias("university"), F.col("p_type").alias("department"), F.col("p_name").alias("admission"))
    apps = rows.select(F.col("k").cast("string").alias("identity_key"), F.lit(0).alias("year"), F.col("p_brand").alias("university"), F.concat("p_type", F.when(F.col("k") % 3 == 0, "학과").otherwise("")).alias("department"), F.split("p_name", " ")[1].alias("admission"))
    return binding.bind_records(one, apps)


_BOUND = """rows AS (SELECT p_brand, p_type, p_name, min(p_partkey)::VARCHAR AS k FROM part GROUP BY 1, 2, 3), keyed AS (SELECT *, lower(p_brand) AS u, regexp_replace(lower(p_type), '[^0-9a-z]', '', 'g') AS t,
 regexp_replace(lower(p_name), '[^0-9a-z]', '', 'g') AS r, regexp_replace(lower(string_split(p_name, ' ')[2]), '[^0-9a-z]', '', 'g') AS a FROM rows),
bound AS (SELECT x.k AS identity_key, y.k AS fingerprint, y.p_type AS record_type, CASE WHEN x.k::BIGINT % 3 = 0 THEN 'suffix-equivalent' ELSE 'exact' END AS unit_match, CASE WHEN x.a = y.r THEN 'exact' ELSE 'related' END AS track_match,
 CASE WHEN x.a = y.r AND x.k::BIGINT % 3 <> 0 THEN 'accepted' ELSE 'provisional' END AS match_class, y.u || '|' || y.t || '|' || y.r AS signature
 FROM keyed x JOIN keyed y ON x.u = y.u AND x.t = y.t WHERE x.a <> '' AND (x.a = y.r OR (length(x.a) >= 2 AND length(y.r) >= 2 AND (contains(x.a, y.r) OR contains(y.r, x.a)))))"""


@R.add(f"WITH {_BOUND} SELECT * FROM bound")
def match_quality(spark: SparkSession, d: str) -> DataFrame:
    return _bound(spark, d)


@R.add(f"""WITH {_BOUND}, b AS (SELECT identity_key, signature, bool_or(match_class = 'accepted') AS ok, count(*) AS records, list(DISTINCT record_type) AS types FROM bound GROUP BY 1, 2)
SELECT identity_key, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS provisional, sum(records)::BIGINT AS records, array_to_string(list_sort(list_distinct(flatten(list(types)))), ',') AS record_types,
 CASE WHEN count(*) FILTER (ok) = 1 THEN 'accepted' WHEN count(*) FILTER (ok) > 1 THEN 'provisional' WHEN count(*) FILTER (NOT ok) > 0 THEN 'provisional' ELSE 'provider-only' END AS quality FROM b GROUP BY 1""")
def binding_rollup(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(0)
    return binding.rollup(_bound(spark, d)).withColumn("quality", binding.binding_quality(F.col("accepted"), none, F.col("provisional"), none))


LANES = ("view", "click", "signup", "purchase", "error")


@R.add("""WITH h AS (SELECT user_id, list(DISTINCT event_type) AS have FROM events WHERE value >= 90 GROUP BY 1)
SELECT user_id, array_to_string(list_filter(['view','click','signup','purchase','error'], lambda x: list_contains(have, x)), ',') AS covered, array_to_string(list_filter(['view','click','signup','purchase','error'], lambda x: NOT list_contains(have, x)), ',') AS missing,
 len(list_filter(['view','click','signup','purchase','error'], lambda x: list_contains(have, x)))::INT AS covered_count, len(list_filter(['view','click','signup','purchase','error'], lambda x: NOT list_contains(have, x))) = 0 AS complete FROM h""")
def lane_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = binding.coverage(table(spark, d, "events").filter("value >= 90"), "user_id", "event_type", LANES)
    return c.withColumns({"covered": F.array_join("covered", ","), "missing": F.array_join("missing", ",")})


@R.add("SELECT event_type AS lane, count(DISTINCT user_id) AS identities, count(*) AS records FROM events GROUP BY 1")
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("lane")).agg(F.count_distinct("user_id").alias("identities"), F.count("*").alias("records"))


_CAND = "cand AS (SELECT c_custkey AS identity_key, c_mktsegment AS segment, c_acctbal > 0 AS complete, CASE WHEN c_acctbal <= 0 THEN 'incomplete' WHEN c_acctbal > 5000 THEN 'accepted' WHEN c_acctbal > 2000 THEN 'provisional' ELSE 'provider-only' END AS quality_state FROM customer)"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("c_acctbal")
    state = F.when(b <= 0, "incomplete").when(b > 5000, "accepted").when(b > 2000, "provisional").otherwise("provider-only")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("identity_key"), F.col("c_mktsegment").alias("segment"), (b > 0).alias("complete"), state.alias("quality_state"))


@R.add(f"""WITH {_CAND}, slots AS (SELECT slot::INT AS slot, (slot * 11)::BIGINT AS identity_key FROM range(1, 6) t(slot)), view AS (SELECT n.slot::INT AS slot, s.slot IS NOT NULL AS occupied, s.identity_key, coalesce(c.complete, false) AS complete,
 CASE WHEN s.slot IS NULL THEN 'empty' WHEN c.quality_state IS NULL THEN 'stale' ELSE c.quality_state END AS state FROM range(1, 7) n(slot) LEFT JOIN slots s USING (slot) LEFT JOIN cand c USING (identity_key))
SELECT (SELECT count(*) FROM cand) AS candidates, count(*) FILTER (occupied) AS selected, count(*) FILTER (occupied AND state <> 'stale') AS resolvable, count(*) FILTER (occupied AND complete) AS selected_full,
 count(*) FILTER (state = 'accepted') AS selected_accepted, 'WAITING_FOR_USER_SELECTION' AS publish_state,
 array_to_string(list_filter(['six-application-selection-incomplete', CASE WHEN count(*) FILTER (state = 'stale') > 0 THEN 'stale-slot-binding' END, CASE WHEN count(*) FILTER (occupied AND complete) < count(*) FILTER (occupied) THEN 'selected-application-core-coverage-incomplete' END], lambda x: x IS NOT NULL), ',') AS blockers FROM view""")
def slots_and_audit(spark: SparkSession, d: str) -> DataFrame:
    slots = spark.range(1, 6).select(F.col("id").cast("int").alias("slot"), (F.col("id") * 11).alias("identity_key"), F.lit(True).alias("occupied"))
    c = _candidates(spark, d)
    return binding.audit(binding.slots_view(slots, c), c).select("candidates", "selected", "resolvable", "selected_full", "selected_accepted", "publish_state", "blockers")


@R.add("""WITH o AS (SELECT o_custkey AS session_id, o_orderpriority AS identity_key, o_orderdate FROM orders), p AS (SELECT '1-URGENT' AS identity_key UNION ALL SELECT '2-HIGH')
SELECT session_id, count(DISTINCT identity_key) AS candidates, count(DISTINCT CASE WHEN identity_key IN (SELECT identity_key FROM p) THEN identity_key END) AS resolved, max(o_orderdate) AS newest FROM o GROUP BY 1 HAVING count(DISTINCT identity_key) >= 4
 AND count(DISTINCT CASE WHEN identity_key IN (SELECT identity_key FROM p) THEN identity_key END) = 2""")
def reusable_session_having(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderpriority").alias("identity_key"), F.col("o_orderdate").alias("observed_at"))
    pins = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "identity_key string")
    return binding.reusable_session(c, pins, 4).select("session_id", "candidates", "resolved", "newest")


@R.add("""WITH c AS (SELECT o_custkey AS cust_key, o_orderdate::DATE::VARCHAR AS day, o_orderkey AS slot FROM orders), w AS (SELECT cust_key, day AS value, array_to_string(list_sort(list(slot)), ',') AS slots FROM c GROUP BY 1, 2 HAVING count(*) > 1),
 s AS (SELECT cust_key, count(*) AS n FROM c GROUP BY 1 HAVING count(*) < 6)
SELECT cust_key, 'same-interview-date' AS warning, value, slots FROM w UNION ALL SELECT cust_key, 'selection-incomplete', n::VARCHAR, '' FROM s""")
def portfolio_conflicts(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "orders").select(F.col("o_custkey").alias("cust_key"), F.col("o_orderkey").alias("slot"), F.lit("").alias("university"), F.to_date("o_orderdate").alias("interview_date"), F.lit(True).alias("occupied"))
    return decide.portfolio_warnings(cards, ["cust_key"])


@R.add("""WITH l AS (SELECT l_orderkey, list({'v': l_extendedprice, 's': l_returnflag}) AS o, count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS n, count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber = 1) AS m,
 max(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN l_extendedprice END) AS one, max(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber = 1 THEN l_extendedprice END) AS main FROM lineitem GROUP BY 1),
 d AS (SELECT o_orderkey AS order_key, CASE WHEN o_orderstatus = 'P' THEN 'UNVERIFIED_CONVERSION' WHEN o_orderpriority = '5-LOW' THEN 'UNVERIFIED_APPLICATION_BINDING' WHEN coalesce(n, 0) = 0 THEN 'NO_COMPARABLE_OFFICIAL_OUTCOME'
  WHEN m > 1 THEN 'AMBIGUOUS_PRIMARY_REFERENCE' WHEN m = 0 AND n > 1 THEN 'AMBIGUOUS_OFFICIAL_REFERENCE' END AS hold, o_totalprice - CASE WHEN m = 1 THEN main ELSE one END AS margin FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT order_key, CASE WHEN hold IS NULL THEN 'COMPARABLE' ELSE 'HOLD' END AS status, coalesce(hold, CASE WHEN margin > 1e-9 THEN 'ABOVE_REFERENCE' WHEN margin < -1e-9 THEN 'BELOW_REFERENCE' ELSE 'AT_REFERENCE' END) AS decision_code,
 CASE WHEN hold IS NULL THEN round(margin, 2) END AS advantage_margin FROM d""")
def score_decision(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.struct(
        (F.col("l_linestatus") == "F").alias("verified"), F.col("l_extendedprice").alias("value"), F.col("l_returnflag").alias("scale"), F.lit(None).cast("double").alias("max_score"), (F.col("l_linenumber") == 1).alias("is_primary")
    )
    outcomes = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(outcome).alias("outcomes"))  # an order's few lines
    conversion = F.struct(
        (F.col("o_orderstatus") != "P").alias("verified"), F.lit("verified").alias("status"), F.col("o_totalprice").alias("score"), F.lit(None).cast("double").alias("max_score"), F.lit("A").alias("scale"),
        F.lit("higher-is-better").alias("direction"), F.lit(False).alias("identity_verified"),
    )
    quality = F.when(F.col("o_orderpriority") == "5-LOW", "provisional").otherwise("accepted")
    rows = table(spark, d, "orders").select("o_orderkey", quality.alias("quality"), conversion.alias("conversion")).join(outcomes, "o_orderkey", "left")
    out = decide.score_decision(rows)
    return out.select(F.col("o_orderkey").alias("order_key"), "status", "decision_code", F.round("advantage_margin", 2).alias("advantage_margin"))


@R.add("""SELECT source, count(*) AS n, round(CASE WHEN count(*) FILTER (n_chars > 5000 AND quality IS NULL) = 0 AND sum(CASE WHEN n_chars IS NOT NULL THEN quality + 1 END) > 0 THEN sum(n_chars * (quality + 1))::DOUBLE / sum(quality + 1) END, 6) AS mean_chars,
 count(quality) AS weighted FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR n_chars > 5000) GROUP BY 1""")
def weighted_mean_guarded(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").filter("quality is not null or n_chars > 5000")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.round(decide.weighted_mean(F.col("n_chars").cast("double"), F.col("quality") + 1), 6).alias("mean_chars"), F.count("quality").alias("weighted"))


@R.add("""SELECT doc_id, CASE WHEN trim(lang) <> '' AND trim(source) <> '' AND quality IS NOT NULL THEN 'high' WHEN trim(lang) <> '' AND trim(source) <> '' THEN 'medium' WHEN trim(lang) <> '' THEN 'low' ELSE 'raw' END AS confidence
FROM documents LEFT JOIN labels USING (doc_id)""")
def confidence_ladder(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", decide.confidence(F.col("lang"), F.col("source"), F.col("quality").cast("string")).alias("confidence"))


_RATIO = "round(CASE WHEN l_partkey % 5 = 0 THEN l_extendedprice / l_quantity + 1 ELSE l_extendedprice / l_quantity END, 2)"


@R.add(f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, abs(l_extendedprice / l_quantity - {_RATIO}) <= 0.015 AS fits FROM lineitem WHERE l_quantity <> 0")
def ratio_consistency(spark: SparkSession, d: str) -> DataFrame:
    exact = F.col("l_extendedprice") / F.col("l_quantity")
    given = F.round(F.when(F.col("l_partkey") % 5 == 0, exact + 1).otherwise(exact), 2)
    return table(spark, d, "lineitem").filter("l_quantity <> 0").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", V.ratio_fits(F.col("l_quantity"), F.col("l_extendedprice"), given).alias("fits"))


@R.add("SELECT doc_id, 'uni-' || left(sha256(lower(source)), 24) AS entity_id, left(sha256(concat_ws('|', lang, source, n_chars::VARCHAR)), 16) AS record_key FROM documents")
def canonical_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", V.entity_id(F.col("source")).alias("entity_id"), F.substring(V.digest(F.col("lang"), F.col("source"), F.col("n_chars")), 1, 16).alias("record_key"))
