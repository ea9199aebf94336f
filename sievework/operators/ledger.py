"""Targets, slots and records of a collection: counts, choice, gates, updates by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

STATES = ("pending", "clicked", "deferred", "confirmed", "failed", "skipped")


def state_counts(targets: DataFrame, by: list[str], states: tuple[str, ...] = STATES) -> DataFrame:
    """Targets, identities and one count a state for each group; states in between are counted as targets alone."""
    return targets.groupBy(*by).agg(F.count("*").alias("targets"), F.count_distinct("identity_key").alias("identities"), *(F.count_if(F.col("state") == s).alias(s) for s in states))


def confirmed_depth(targets: DataFrame, at_least: tuple[int, ...] = (4, 6)) -> DataFrame:
    """One row: identities, targets, outstanding ones, and identities that have so many confirmed lanes."""
    each = targets.groupBy("identity_key").agg(
        F.count("*").alias("_t"), F.count_if(F.col("state").isin("pending", "clicked", "deferred")).alias("_o"), F.count_distinct(F.when(F.col("state") == "confirmed", F.col("lane"))).alias("_lanes")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return each.agg(F.count("identity_key").alias("identities"), total("_t").alias("targets"), total("_o").alias("outstanding"), *(F.count_if(F.col("_lanes") >= n).alias(f"with_{n}_lanes") for n in at_least))


def lane_rank(lane: Column, order: tuple[str, ...]) -> Column:
    """A lane's place in the order; unknown ones come last."""
    at = F.array_position(F.array(*(F.lit(x) for x in order)), lane).cast("int")
    return F.when(at > 0, at - 1).otherwise(len(order))


def mission_choice(targets: DataFrame, group: list[str], order: tuple[str, ...], open_states: tuple[str, ...] = ("pending", "deferred")) -> DataFrame:
    """The next target of each group: of the preferred identity if it has one open, then of a lane that nothing confirms yet, then by lane, priority and id.

    targets: group, target_id, identity_key, lane, state, priority, preferred (boolean).
    """
    lane = [*group, "identity_key", "lane"]
    done = targets.filter("state = 'confirmed'").select(*lane).distinct().withColumn("_done", F.lit(True))
    t = targets.filter(F.col("state").isin(*open_states)).join(done, lane, "left").withColumn("lane_missing", F.col("_done").isNull())
    # the first in order is a minimum, which combines before the exchange
    place = F.struct(~F.coalesce("preferred", F.lit(False)), ~F.col("lane_missing"), lane_rank(F.col("lane"), order), F.col("priority").isNull(), -F.col("priority"), "target_id")
    best = t.groupBy(*group).agg(F.min_by(F.struct("target_id", "identity_key", "lane", "priority", "lane_missing"), place).alias("_b"))
    return best.select(*group, "_b.*")


def breakdown(records: DataFrame, by: list[str], kind: str, year: str) -> DataFrame:
    """Records by type and year; a missing type is unknown, a missing year stays missing."""
    return records.groupBy(*by, F.coalesce(kind, F.lit("unknown")).alias("record_type"), F.col(year).alias("year")).agg(F.count("*").alias("n"))


def histogram(pages: DataFrame, kind: str) -> DataFrame:
    """Pages of each kind, their share of all and the total; the total is a sum of the counts, not a second scan."""
    counts = pages.groupBy(F.coalesce(kind, F.lit("unknown")).alias("kind")).agg(F.count("*").alias("pages"))
    total = counts.agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.try_divide("pages", "total"), 6))  # one row


def binding_stats(records: DataFrame, by: list[str], university: str, department: str, admission: str) -> DataFrame:
    """How many records name a university, a department, an admission, and all three."""
    u, d, a = (T.blank_to_null(F.col(c).cast("string")).isNotNull() for c in (university, department, admission))
    counts = {"records": F.count("*"), "university_bound": F.count_if(u), "department_bound": F.count_if(d), "admission_bound": F.count_if(a), "fully_bound": F.count_if(u & d & a)}
    return records.groupBy(*by).agg(*(c.alias(n) for n, c in counts.items()))


def repeat_captures(captures: DataFrame, route: list[str], order: list[str], low_value: Column, most: int = 2) -> DataFrame:
    """Adds nth (capture of its route, from 1) and expand: low-value pages are followed in the first ``most`` captures of a route only."""
    nth = F.row_number().over(W.partitionBy(*route).orderBy(*order))
    return captures.withColumn("nth", nth).withColumn("expand", ~(F.coalesce(low_value, F.lit(False)) & (F.col("nth") > most)))


def resolve_alias(names: DataFrame, name: str, targets: DataFrame) -> DataFrame:
    """Adds target_id: the target whose id, university or alias equals the name, spaces and case aside.

    Of several targets the first by ``place`` wins; a name that fits none, or is blank, gets null.
    """
    known = targets.select("place", F.col("target_id"), F.explode(F.array_distinct(F.transform(F.concat(F.array("target_id", "university"), F.coalesce("aliases", F.array().cast("array<string>"))), T.entity_key))).alias("_k")).filter("_k <> ''")
    one = known.groupBy("_k").agg(F.min_by("target_id", F.struct("place", "target_id")).alias("target_id"))
    return names.withColumn("_k", F.nullif(T.entity_key(F.col(name)), F.lit(""))).join(one, "_k", "left").drop("_k")


def propagate_quality(records: DataFrame, accepted: DataFrame, carried: list[str]) -> DataFrame:
    """Marks records whose fingerprint accepted evidence holds, and gives them that evidence's ``carried`` columns.

    records: fingerprint, quality_state and the carried columns. accepted:
    fingerprint, place and the carried columns; of several rows of a
    fingerprint the last by place wins, also with its nulls.
    """
    last = accepted.groupBy("fingerprint").agg(F.max_by(F.struct(*carried), F.struct("place", *carried)).alias("_a"))
    hit = F.col("_a").isNotNull()
    new = {c: F.when(hit, F.col(f"_a.{c}")).otherwise(F.col(c)) for c in carried} | {"quality_state": F.when(hit, "accepted").otherwise(F.col("quality_state"))}
    return records.join(last, "fingerprint", "left").withColumns(new).drop("_a")


def place_in_slots(slots: DataFrame, requests: DataFrame, group: list[str]) -> DataFrame:
    """Slots after one request a group puts an identity into a slot.

    An identity that sits elsewhere moves, and the slot's occupant goes where
    it came from; an occupant of the slot leaves if the identity is new.
    slots and requests: group, slot, identity_key, label.
    """
    asked = requests.select(*group, F.col("slot").alias("_slot"), F.col("identity_key").alias("_id"))
    s = slots.select(*group, "slot", "identity_key", "label").join(asked, group, "left")
    came_from = F.max(F.when(F.col("identity_key") == F.col("_id"), F.col("slot"))).over(W.partitionBy(*group))
    s = s.withColumn("_from", came_from).filter(~F.coalesce(F.col("identity_key") == F.col("_id"), F.lit(False)))
    s = s.withColumn("slot", F.when(F.coalesce(F.col("slot") == F.col("_slot"), F.lit(False)), F.col("_from")).otherwise(F.col("slot"))).filter("slot is not null")
    return s.select(*group, "slot", "identity_key", "label").unionByName(requests.select(*group, "slot", "identity_key", "label"))


def dossier(applications: DataFrame, conversions: DataFrame, outcomes: DataFrame, predictions: DataFrame, lanes: DataFrame) -> DataFrame:
    """Applications with their conversion, outcomes, latest prediction, or where there is none the state of the prediction's lane.

    All by identity_key: conversions (score; at most one), outcomes (value),
    predictions (observed_at, place, bars), lanes (lane_state; at most one).
    Outcomes and predictions are brought to one row an identity before the joins.
    """
    out = outcomes.groupBy("identity_key").agg(F.count("*").alias("outcomes"), F.max("value").alias("best_outcome"))
    last = predictions.groupBy("identity_key").agg(F.max_by("bars", F.struct("observed_at", "place")).alias("bars"), F.max("observed_at").alias("predicted_at"))
    a = applications
    for one in (conversions.select("identity_key", "score"), out, last, lanes.select("identity_key", "lane_state")):
        a = a.join(one, "identity_key", "left")
    said = F.when(F.col("predicted_at").isNotNull(), "collected").otherwise(F.coalesce("lane_state", F.lit("not-observed")))
    return a.withColumns({"outcomes": F.coalesce("outcomes", F.lit(0)), "prediction_state": said}).drop("lane_state")


def coverage_closed(identities: DataFrame, required: int, at_least: int = 6) -> DataFrame:
    """One row: whether collection is closed, from (identity_key, covered_count, outstanding, returned).

    Closed: enough identities, each with all its ``required`` lanes, nothing outstanding, each returned to at least once.
    """
    full, back = F.col("covered_count") >= required, F.col("returned") > 0
    a = identities.agg(F.count("*").alias("expected"), F.count_if(full).alias("full_coverage"), F.coalesce(F.sum("outstanding"), F.lit(0)).alias("outstanding"), F.count_if(back).alias("returns"))
    closed = (F.col("expected") >= at_least) & (F.col("full_coverage") == F.col("expected")) & (F.col("outstanding") == 0) & (F.col("returns") >= F.col("expected"))
    return a.withColumn("closed", closed)
