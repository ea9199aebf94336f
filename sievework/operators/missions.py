"""Targets of a mission: states that only move on, and lanes for which one confirmed target is enough.

Events have identity_key, target_id, lane, event, reason, priority and an
order ``seq`` that no two events of an identity share. ``capture`` makes a
target known (its first capture names its lane; a later one can only raise the
priority, and that only while the target is pending or failed), ``attempt``
counts, ``click``, ``defer``, ``fail`` and ``confirm`` move a target on,
``retry`` gives a pending one a reason, ``cover`` says that a lane is covered
and ``close`` ends all that is outstanding. A move to a lower rank changes
nothing, nor does an event of a target that isn't known yet or a confirmation
under another lane. A confirmed or covered lane skips the identity's other
targets of it that are still pending at that moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranks of the states; fixed values.
RANKS = {"pending": 0, "clicked": 10, "deferred": 20, "failed": 30, "skipped": 40, "confirmed": 50}
MOVES = {"click": "clicked", "defer": "deferred", "fail": "failed", "confirm": "confirmed"}
OUTSTANDING = ("pending", "clicked", "deferred")
BY_CONFIRM, BY_COVER = "lane-confirmed-by-alternate-target", "lane-already-covered"


def state_of(rank: Column) -> Column:
    return F.create_map(*(F.lit(x) for state, r in RANKS.items() for x in (r, state)))[rank]


def _next(value: Column, keys: list[str]) -> Column:
    """The next event's value that isn't null: rows are read backwards, so each is looked at once."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, -1))


def fold(events: DataFrame) -> DataFrame:
    """identity_key, target_id, lane, state, attempts, reason, priority of each target after all events.

    Whatever the order of rows: states, attempts and reasons come from
    aggregates a target, and what a target's siblings do to it is the first
    trigger of its lane after its capture, if that lies before its own first
    move. A lane's or an identity's events are read in order in one task, row by
    row.
    """
    key = ["identity_key", "target_id"]
    known = events.filter("event = 'capture' and target_id is not null").groupBy(*key).agg(F.min_by("lane", "seq").alias("lane"), F.min("seq").alias("captured"))
    own = events.filter("target_id is not null").withColumnRenamed("lane", "said").join(known, key).filter("(seq > captured or event = 'capture') and (event <> 'confirm' or said = lane)")
    # what ends a target's time as pending: its own first move, or a close
    closes = events.filter("event = 'close'").select("identity_key", "seq", F.struct("seq", "reason").alias("close"))
    triggers = own.filter("event = 'confirm'").select("identity_key", "lane", "seq", F.lit(BY_CONFIRM).alias("by")).unionByName(
        events.filter("event = 'cover'").select("identity_key", "lane", "seq", F.lit(BY_COVER).alias("by"))
    ).select("identity_key", "lane", "seq", F.struct("seq", "by").alias("trigger"))
    at = known.select("identity_key", "target_id", "lane", F.col("captured").alias("seq"))
    at = at.unionByName(triggers, allowMissingColumns=True).withColumn("trigger", _next(F.col("trigger"), ["identity_key", "lane"])).filter("target_id is not null")
    at = at.unionByName(closes, allowMissingColumns=True).withColumn("close", _next(F.col("close"), ["identity_key"])).filter("target_id is not null")
    move = F.col("event").isin(*MOVES)
    rank = F.create_map(*(F.lit(x) for e, s in MOVES.items() for x in (e, RANKS[s])))[F.col("event")]
    first = lambda e: F.min(F.when(F.col("event") == e, F.col("seq")))
    facts = own.groupBy(*key).agg(
        F.max(F.when(move, rank)).alias("rank"), F.min(F.when(move, F.col("seq"))).alias("moved"), F.count_if(F.col("event") == "attempt").alias("attempts"),
        F.max_by(F.struct("reason"), F.when(F.col("event") == "fail", F.col("seq"))).alias("failed"), *(first(e).alias(f"first_{e}") for e in MOVES),
    )
    t = at.join(facts, key, "left")
    pending_to = F.least("moved", F.col("close.seq"))
    skipped = F.coalesce(F.col("trigger.seq") < pending_to, F.col("trigger").isNotNull())
    t = t.withColumns({"pending_to": F.least(pending_to, F.when(skipped, F.col("trigger.seq"))), "skipped": skipped})
    closed = F.when(F.col("close").isNotNull(), RANKS["failed"])
    t = t.withColumn("rank", F.greatest(F.coalesce("rank", F.lit(0)), F.when(F.col("skipped"), RANKS["skipped"]), closed))
    # a pending target's last reason, and its priority, which captures raise while it is pending or failed
    t = t.withColumns({"failed_from": F.least("first_fail", F.col("close.seq")), "failed_to": F.least("first_confirm", F.when(F.col("skipped"), F.col("trigger.seq")))})
    span = own.join(t.select(*key, "pending_to", "failed_from", "failed_to"), key)
    pending = F.coalesce(F.col("seq") < F.col("pending_to"), F.lit(True))
    failed = F.coalesce(F.col("seq") > F.col("failed_from"), F.lit(False)) & F.coalesce(F.col("seq") < F.col("failed_to"), F.lit(True))
    told = span.groupBy(*key).agg(
        F.max(F.when((F.col("event") == "capture") & ((F.col("seq") == F.col("captured")) | pending | failed), F.col("priority"))).alias("priority"),
        F.max_by(F.struct("reason"), F.when((F.col("event") == "retry") & pending, F.col("seq"))).alias("retried"),
    )
    t = t.join(told, key, "left").withColumn("state", state_of(F.col("rank")))
    clicked_first = F.col("first_click").isNotNull() & F.coalesce(F.col("first_click") < F.col("first_defer"), F.lit(True))
    reason = (
        F.when(F.col("state") == "skipped", F.col("trigger.by")).when((F.col("state") == "failed") & F.col("failed").isNotNull(), F.col("failed.reason")).when(F.col("state") == "failed", F.col("close.reason"))
        .when((F.col("state") == "pending") | ((F.col("state") == "deferred") & ~clicked_first), F.col("retried.reason"))
    )
    return t.select("identity_key", "target_id", "lane", "state", F.coalesce("attempts", F.lit(0)).alias("attempts"), reason.alias("reason"), "priority")


def restore(targets: DataFrame, persisted: DataFrame) -> DataFrame:
    """Targets united with persisted ones by id: the higher state with its reason, the larger number of attempts, the larger priority; equal states keep what is there."""
    rows = targets.withColumn("_new", F.lit(0)).unionByName(persisted.filter("trim(target_id) <> '' and trim(identity_key) <> '' and trim(lane) <> ''").withColumn("_new", F.lit(1)))
    rank = F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv))[F.col("state")]
    rows = rows.withColumn("_rank", F.coalesce(rank, F.lit(0)))
    best = F.struct("_rank", -F.col("_new"))
    return rows.groupBy("target_id").agg(
        *(F.min_by(c, "_new").alias(c) for c in ("identity_key", "lane")), state_of(F.max("_rank")).alias("state"), F.max("attempts").alias("attempts"), F.max_by(F.struct("reason"), best)["reason"].alias("reason"), F.max("priority").alias("priority")
    ).select(*targets.columns)
