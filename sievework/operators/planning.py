"""Tasks worked out from codes, applications with their coverage, snapshots with their rows, and small facts of captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U

#: Kinds of tasks of a university; fixed values.
TASKS = ("UNIVERSITY_DETAIL", "DEPARTMENTS", "ADMISSIONS", "CURRENT_CRITERIA", "HISTORICAL_RESULTS")
#: What a match token leaves out; fixed values.
TOKEN_DROPS = " \t\n·・ㆍ[]()-_.|:"


def detail_url(base: str, year: Column, code: Column) -> Column:
    """The address of a university's detail page; ``base`` ends where the year's value begins to be asked for."""
    return F.concat(F.lit(base), F.lit("&searchSyr="), year.cast("string"), F.lit("&unvCd="), F.trim(code))


def planned_tasks(codes: DataFrame, code: str, year: int, provider: str, base: str, kinds: tuple[str, ...] = TASKS) -> DataFrame:
    """task_id, academic_year, code, kind, url: every kind of task for each distinct code that isn't blank."""
    if not 2000 <= year <= 2100:
        raise ValueError("an academic year from 2000 to 2100")
    c = codes.select(F.trim(F.col(code).cast("string")).alias("code")).filter("code <> ''").distinct()
    t = c.select(F.lit(year).alias("academic_year"), "code", F.explode(F.array(*(F.lit(k) for k in kinds))).alias("kind"))
    return t.select(F.sha2(F.concat_ws("|", F.lit(provider), "academic_year", "code", "kind"), 256).alias("task_id"), "academic_year", "code", "kind", detail_url(base, F.col("academic_year"), F.col("code")).alias("url"))


def unknown_or_in(c: Column, values: tuple[str, ...]) -> Column:
    """Null, blank or one of the values that say nothing."""
    return c.isNull() | c.isin("", *values)


def match_token(c: Column) -> Column:
    """Lower case without blanks, dots, brackets and bars."""
    return F.translate(F.lower(T.text_of(c)), TOKEN_DROPS, "")


def script_route(script: Column, base: Column, longest: int | None = 4096) -> Column:
    """The address that an inline script goes to: an explicit one (assignment, assign or replace, open), else the first quoted address; null if none or if the script is longer than ``longest``."""
    s = F.trim(F.replace(T.text_of(script), F.lit("&amp;"), F.lit("&")))
    quoted = r"""['"]((?:https?://[^'"]+|/[^'"]+\.do(?:\?[^'"]*)?))['"]"""
    explicit = (r"""location(?:\.href)?\s*=\s*['"]([^'"]+)['"]""", r"""location\.(?:assign|replace)\s*\(\s*['"]([^'"]+)['"]""", r"""window\.open\s*\(\s*['"]([^'"]+)['"]""")
    found = F.coalesce(*(F.nullif(F.regexp_extract(s, f"(?i){p}", 1), F.lit("")) for p in (*explicit, quoted)))
    return F.when((F.length(s) <= longest) if longest else F.lit(True), F.when(found.isNotNull(), U.resolve(base, found)))


def iso_time(c: Column) -> Column:
    """A text as a timestamp, null if it is none."""
    return F.try_to_timestamp(F.nullif(F.trim(c.cast("string")), F.lit("")))


def list_fingerprint(total: Column, first_rows: Column) -> Column:
    """What tells one list from another: its total and the rows of its first page."""
    return F.sha2(F.concat_ws("|", total.cast("string"), F.array_join(F.transform(first_rows, lambda r: F.array_join(r, "␟")), "\n")), 256)


def explicit_context(digest: Column) -> Column:
    """struct page_type, context, selection from a capture's JSON digest; absent lists are empty."""
    d = F.from_json(digest, "pageType string, analysisBundle struct<context:array<string>,selectionContext:array<string>>")
    none = F.array().cast("array<string>")
    return F.struct(F.coalesce(d["pageType"], F.lit("")).alias("page_type"), F.coalesce(d["analysisBundle"]["context"], none).alias("context"), F.coalesce(d["analysisBundle"]["selectionContext"], none).alias("selection"))


def route_counts(captures: DataFrame, route: list[str]) -> DataFrame:
    """How often each route was captured."""
    return captures.groupBy(*route).agg(F.count("*").alias("captures"))


def digest_coverage(digests: DataFrame, by: list[str], parts: tuple[str, ...] = ("cards", "tables", "blocks")) -> DataFrame:
    """For each part its number at the source and in captures, characters captured, and how often the text budget was used up.

    digests: source_<part>, captured_<part>, characters, budget.
    """
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    of = [n(f"{side}_{p}").alias(f"{side}_{p}") for p in parts for side in ("source", "captured")]
    return digests.groupBy(*by).agg(F.count("*").alias("captures"), *of, n("characters").alias("characters"), F.count_if(F.coalesce(F.col("characters") >= F.col("budget"), F.lit(False))).alias("exhausted"))


def _value(c: str) -> Column:
    return T.blank_to_null(F.col(c).cast("string"))


def mission_applications(targets: DataFrame, coverage: DataFrame) -> DataFrame:
    """An application an identity, with its fullest context and the lanes that are covered (sorted); applications without coverage have none.

    targets: identity_key, context_key, university, department, admission,
    campus, confidence_rank, place. coverage: identity_key, lane. A context of
    another identity doesn't count, nor does a blank identity or the lane
    ``reference``. Of equally full contexts the first by ``place`` stays.
    """
    t = targets.withColumn("identity_key", _value("identity_key")).filter("identity_key is not null and context_key = identity_key")
    full = sum((_value(c).isNotNull().cast("int") for c in ("university", "department", "admission", "campus")), start=F.lit(0)) * 10 + F.coalesce("confidence_rank", F.lit(0))
    kept = ("university", "department", "admission", "campus")
    best = t.groupBy("identity_key").agg(F.max_by(F.struct(*kept), F.struct(full, -F.col("place"))).alias("_c")).select("identity_key", "_c.*")
    lanes = coverage.withColumns({"identity_key": _value("identity_key"), "lane": _value("lane")}).filter("identity_key is not null and lane is not null and lane <> 'reference'").groupBy("identity_key").agg(F.array_sort(F.collect_set("lane")).alias("coverage"))
    return best.join(lanes, "identity_key", "left").withColumn("coverage", F.coalesce("coverage", F.array().cast("array<string>")))


def in_order(applications: DataFrame) -> DataFrame:
    """Applications sorted by the keys of university, admission and department, then identity."""
    return applications.orderBy(T.entity_key(F.col("university")), T.loose_key(F.col("admission")), T.loose_key(F.col("department")), "identity_key")


def latest_rows(targets: DataFrame, snapshots: DataFrame, rows: DataFrame) -> DataFrame:
    """Each target with its newest snapshot (the highest id) and that snapshot's rows, a row each; a target without one has a row of nulls.

    targets: target_id. snapshots: target_id, snapshot_id, collected_at. rows: snapshot_id, ordinal, value.
    """
    newest = snapshots.groupBy("target_id").agg(F.max("snapshot_id").alias("snapshot_id"), F.max_by("collected_at", "snapshot_id").alias("collected_at"))
    return targets.join(newest, "target_id", "left").join(rows, "snapshot_id", "left").select("target_id", "snapshot_id", "collected_at", "ordinal", "value")


#: Keys under which a status may carry a fact, in order; fixed values.
STATUS_KEYS = {
    "records": ("records", "recordCount", "acceptedRecords", "totalRecords"), "completed": ("completedPages", "completedDocuments", "completed", "pagesCompleted", "documentsCompleted"),
    "errors": ("errorPages", "errorDocuments", "errors", "errorCount"), "pending": ("unresolved", "pending", "pendingPages", "outstanding"), "total": ("totalPages", "total", "plannedPages"),
}
STATUS_TEXTS = {"status": ("status", "state", "phase"), "reason": ("completionReason", "reason"), "updated": ("updatedAt", "updated_at", "lastUpdatedAt", "finishedAt")}


def normal_statuses(reports: DataFrame, raw: str) -> DataFrame:
    """Adds the facts of a status reported as JSON: each from the first key that carries one (numbers; texts that aren't blank), in the status itself or its ``stats`` or ``summary``; and percent done.

    A status may lie under ``status``, ``run`` or ``summary`` of what was reported. Each level is parsed once.
    """
    fields = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    inner = lambda m, keys: F.coalesce(*(F.when(F.startswith(F.trim(F.col(m)[k]), F.lit("{")), F.col(m)[k]) for k in keys))
    r = reports.withColumn("_raw", fields(F.col(raw)))
    r = r.withColumn("_s", F.when(inner("_raw", ("status", "run", "summary")).isNull(), F.col("_raw")).otherwise(fields(inner("_raw", ("status", "run", "summary")))))
    r = r.withColumn("_stats", F.when(inner("_s", ("stats", "summary")).isNull(), F.col("_s")).otherwise(fields(inner("_s", ("stats", "summary")))))
    number = lambda k: F.nullif(F.col("_stats")[k], F.lit("")).try_cast("double")
    told = lambda m, k: F.when(F.trim(F.col(m)[k]) != "", F.col(m)[k])
    r = r.withColumns({n: F.coalesce(*(number(k) for k in keys), F.lit(0.0)) for n, keys in STATUS_KEYS.items()})
    for n, keys in STATUS_TEXTS.items():
        r = r.withColumn(n, F.coalesce(*(told("_s", k) for k in keys), *((told("_raw", k) for k in keys) if n == "status" else ()), F.lit("unknown" if n == "status" else "—")))
    of = F.when(F.col("total") > 0, F.col("total")).otherwise(F.greatest(F.col("completed") + F.col("pending") + F.col("errors"), F.lit(1.0)))
    return r.withColumn("percent", F.round(F.least(F.greatest(F.col("completed") / of * 100, F.lit(0.0)), F.lit(100.0)), 1)).drop("_raw", "_s", "_stats")
