"""Binding records to applications, coverage of lanes, slots and the quality audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import segments

#: Required lanes in order, the number of slots; fixed values.
CORE_LANES = ("saved-application", "current-prediction", "mock-support", "actual-admit", "score-analysis")
SLOTS = 6
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}


def bind_records(records: DataFrame, apps: DataFrame, compat: bool = True) -> DataFrame:
    """Pairs of an application and a record of its university whose unit and track agree.

    records: fingerprint, record_type, year, university, department, admission.
    apps: identity_key, year, university, department, admission. Keys are made
    once a row. Only departments whose keys are equal but for one unit suffix
    can match, so both sides are dealt out under their key and under it without
    its suffix, and the join is on the university's key and that stem; the exact
    rules then judge the pairs that meet.
    """
    keys = lambda u, d, t: {"_u": T.entity_key(F.col(u)), "_d": T.loose_key(F.col(d), compat), "_t": T.loose_key(F.col(t), compat)}
    r = records.withColumns(keys("university", "department", "admission")).filter("_u <> '' and _d <> '' and _t <> ''")
    a = apps.withColumns(keys("university", "department", "admission")).filter("_u <> '' and _d <> '' and _t <> ''")
    a = a.select("identity_key", F.col("year").alias("app_year"), "_u", F.col("_d").alias("app_d"), F.col("_t").alias("app_t"))
    dealt = lambda df, d: df.withColumn("_stem", F.explode(F.array_distinct(F.array(d, T.unit_stem(F.col(d))))))
    both = dealt(r, "_d").join(dealt(a, "app_d"), ["_u", "_stem"])
    both = both.filter(F.col("_stem") == F.when(F.length("app_d") <= F.length("_d"), F.col("app_d")).otherwise(F.col("_d")))  # a pair meets once
    both = both.filter(F.coalesce((F.col("year") <= 0) | (F.col("app_year") <= 0) | (F.col("year") == F.col("app_year")), F.lit(True)))
    both = both.withColumns({"unit_match": T.unit_keys_match(F.col("app_d"), F.col("_d")), "track_match": T.track_keys_match(F.col("app_t"), F.col("_t"))})
    both = both.filter(F.col("unit_match").isin("exact", "suffix-equivalent") & (F.col("track_match") != "none"))
    sure = (F.col("unit_match") == "exact") & (F.col("track_match") == "exact")
    signature = F.concat_ws("|", "_u", "_d", "_t")
    return both.select("identity_key", "fingerprint", "record_type", "unit_match", "track_match", F.when(sure, "accepted").otherwise("provisional").alias("match_class"), signature.alias("signature"))


def rollup(bound: DataFrame) -> DataFrame:
    """One row an application: accepted and provisional signatures, records, record types."""
    buckets = bound.groupBy("identity_key", "signature").agg(F.max(F.col("match_class") == "accepted").alias("ok"), F.count("*").alias("records"), F.collect_set("record_type").alias("types"))
    return buckets.groupBy("identity_key").agg(
        F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("provisional"), F.sum("records").alias("records"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))), ",").alias("record_types"),
    )


def binding_quality(accepted: Column, structural: Column, provisional: Column, related: Column) -> Column:
    """One accepted signature, or structural evidence without any, is accepted; several contradict each other."""
    return (
        F.when(accepted == 1, "accepted").when(accepted > 1, "provisional").when(structural > 0, "accepted")
        .when((provisional > 0) | (related > 0), "provisional").otherwise("provider-only")
    )


def quality_state(complete: Column, binding: Column) -> Column:
    return F.when(~complete, "incomplete").otherwise(binding)


def segment_bindings(tables: DataFrame, compat: bool = True) -> DataFrame:
    """Rows of official tables that name a unit, under a scope row that names the track.

    tables: table_id, row, cells, unit, track, kind (the application's). A
    scope reaches to the next scope row; its id is carried down, so there is
    no range join.
    """
    t = segments(tables.withColumn("_scope", T.declares_scope(F.col("cells"))), ["table_id"], ["row"], F.col("_scope")).filter("segment > 0")
    heads = t.filter("_scope").select("table_id", "segment", F.col("row").alias("scope_row"), T.row_track_match(F.col("cells"), F.col("track"), F.col("kind"), compat).alias("track_match"), F.substring(F.trim(F.get("cells", F.lit(0))), 1, 80).alias("scope_label"))
    rows = t.filter("not _scope").select("table_id", "segment", F.col("row").alias("unit_row"), T.row_unit_match(F.col("cells"), F.col("unit")).alias("unit_match"))
    hit = rows.filter(F.col("unit_match") != "none").join(heads.filter("track_match = 'exact'"), ["table_id", "segment"])
    return hit.select("table_id", "scope_row", "unit_row", "track_match", "unit_match", "scope_label")


def single_seed(candidates: DataFrame, seeds: DataFrame, key: str, text: str) -> DataFrame:
    """Candidates whose text names exactly one seed's university, department and admission.

    A candidate meets the seeds of its own university only: its text is cut
    into words, whose keys are looked up, in place of comparing all with all.
    """
    words = candidates.select(key, text, F.explode(F.array_distinct(F.transform(F.split(F.col(text), r"[\s\[\]|]+"), T.entity_key))).alias("_u")).filter("_u <> ''")
    s = seeds.withColumn("_u", T.entity_key(F.col("university")))
    named = lambda c: F.contains(T.loose_key(F.col(text)), T.loose_key(F.col(c)))
    hits = words.join(s, "_u").filter(named("department") & named("admission")).select(key, "identity_key").distinct()
    return hits.groupBy(key).agg(F.count("*").alias("_n"), F.first("identity_key").alias("identity_key")).filter("_n = 1").drop("_n")


def best_contexts(contexts: DataFrame, key: str, order: str) -> DataFrame:
    """The fullest context of each identity; of equal ones the first."""
    parts = sum((T.blank_to_null(F.col(c)).isNotNull().cast("int") for c in ("university", "department", "admission", "campus")), start=F.lit(0))
    sure = F.coalesce(F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))[F.col("confidence")], F.lit(0))
    by = W.partitionBy(key).orderBy((parts * 10 + sure).desc(), order)
    return contexts.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def coverage(lanes: DataFrame, key: str, lane: str = "lane", required: tuple[str, ...] = CORE_LANES) -> DataFrame:
    """Covered and missing lanes (in required order) of each identity."""
    need = F.array(*(F.lit(x) for x in required))
    have = lanes.groupBy(key).agg(F.collect_set(lane).alias("_have"))
    out = have.select(key, F.array_intersect(need, "_have").alias("covered"), F.array_except(need, "_have").alias("missing"))
    return out.withColumns({"covered_count": F.size("covered"), "complete": F.size("missing") == 0})


def slots_view(slots: DataFrame, candidates: DataFrame) -> DataFrame:
    """Slots 1 to 6 with their candidates; an occupied slot without a candidate is stale."""
    numbers = slots.sparkSession.range(1, SLOTS + 1).select(F.col("id").cast("int").alias("slot"))
    s = numbers.join(slots, "slot", "left").withColumn("occupied", F.coalesce("occupied", F.lit(False)))
    c = candidates.select("identity_key", "quality_state", "complete")
    out = s.join(c, "identity_key", "left")
    state = F.when(~F.col("occupied"), "empty").when(F.col("quality_state").isNull(), "stale").otherwise(F.col("quality_state"))
    return out.select("slot", "occupied", "identity_key", F.coalesce("complete", F.lit(False)).alias("complete"), state.alias("state"))


def audit(view: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: candidate and slot counts, blockers, warnings, publish state."""
    c = candidates.agg(F.count("*").alias("candidates"), F.count_if("complete").alias("full_coverage"))
    used = F.col("occupied")
    there = used & (F.col("state") != "stale")
    s = view.agg(
        F.count_if(used).alias("selected"), F.count_distinct(F.when(used, F.col("identity_key"))).alias("unique_selected"), F.count_if(there).alias("resolvable"),
        F.count_if(there & F.col("complete")).alias("selected_full"), *(F.count_if(used & (F.col("state") == q)).alias(f"selected_{q.replace('-', '_')}") for q in ("accepted", "provisional", "provider-only", "stale")),
    )
    a = s.crossJoin(c)  # a row by a row
    ready = (F.col("selected") == SLOTS) & (F.col("unique_selected") == SLOTS) & (F.col("resolvable") == SLOTS) & (F.col("selected_full") == SLOTS)
    soft = (F.col("selected_provisional") > 0) | (F.col("selected_provider_only") > 0)
    state = F.when(~ready & (F.col("selected") < SLOTS), "WAITING_FOR_USER_SELECTION").when(~ready, "BLOCKED_QUALITY").when(soft, "READY_WITH_WARNINGS").otherwise("READY")
    blockers = F.array_compact(F.array(
        F.when(F.col("selected") < SLOTS, "six-application-selection-incomplete"), F.when(F.col("unique_selected") != F.col("selected"), "duplicate-application-slot"),
        F.when(F.col("selected_stale") > 0, "stale-slot-binding"), F.when(F.col("selected_full") < F.col("selected"), "selected-application-core-coverage-incomplete"),
    ))
    warnings = F.array_compact(F.array(
        F.when(F.col("candidates") > F.col("full_coverage"), "candidate-core-coverage-incomplete"), F.when(F.col("selected_provisional") > 0, "selected-provisional-binding"),
        F.when(F.col("selected_provider_only") > 0, "selected-provider-only-no-safe-binding"),
    ))
    return a.withColumns({"hub_ready": ready, "publish_state": state, "blockers": F.array_join(blockers, ","), "warnings": F.array_join(warnings, ",")})


def reusable_session(candidates: DataFrame, pinned: DataFrame, at_least: int = SLOTS) -> DataFrame:
    """Sessions, newest first, with enough candidates that resolve every pinned identity."""
    pins = pinned.select("identity_key").distinct()
    have = candidates.join(pins.withColumn("_pin", F.lit(1)), "identity_key", "left").groupBy("session_id").agg(
        F.count_distinct("identity_key").alias("candidates"), F.count_distinct(F.when(F.col("_pin") == 1, F.col("identity_key"))).alias("resolved"), F.max("observed_at").alias("newest")
    )
    return have.crossJoin(F.broadcast(pins.agg(F.count("*").alias("pins")))).filter((F.col("candidates") >= at_least) & (F.col("resolved") == F.col("pins"))).orderBy(F.desc("newest"), "session_id")


def prefer_rebind(pinned: Column, reusable: Column, latest_candidates: Column, latest_status: Column, latest_reusable: Column) -> Column:
    """Whether stored evidence serves better than a new collection: all pins can be resolved, and the latest session is no better source."""
    return (pinned >= SLOTS) & (reusable >= SLOTS) & (latest_reusable | (latest_candidates < SLOTS) | (latest_status != "completed"))
