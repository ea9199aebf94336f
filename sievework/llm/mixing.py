"""Mixing sources to target weights, with DataFrame functions alone.

Every document gets a key by hashing its id and text, so a rerun draws the
same mix. Within a source, documents are ordered by key; prefix sums of their
sizes are taken in two steps (sums of key ranges, then sums within a range), so
that a source of any share of the corpus spreads over many tasks. A source
whose target exceeds its size is taken whole as often as fits, and the rest is
cut from the same order at the exact word.

A null text has size 0. A null source is a source of its own, the last one.
Documents of size 0 are taken 0 times. A very long text is a document as any
other; the cut may fall into it. Rows that share an id but not the text, or have
none, lie in different places; rows equal in both are separate documents with
neighbouring places. If all sizes are 0, so are all targets; an empty table
gives no rows. The targets come from a table of a row a source, which one task
sorts: some million sources at most. Extra columns, whatever their names, are
not read by ``mix`` and are kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, fresh

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_EPOCHS = 2
#: Documents that one range of keys holds on average.
RANGE_DOCS = 4096
#: The plan (a row a source) is broadcast up to this size; beyond it the join is salted.
BROADCAST_SOURCES, BROADCAST_BYTES = 50_000, 8 << 20
SALTS = 64
_WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and the hash key that orders a source's documents."""
    return docs.select(
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
        F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(F.col("text").cast("string"), F.lit(""))), 256).alias("key"),
    )


def targets(per_source: DataFrame, share_percent: int = SHARE_PERCENT, most: int = MOST_EPOCHS) -> DataFrame:
    """Adds target to (source, source_size): shares by weight, none above ``most`` times the source's size.

    Raising the water level: with level L every source gets min(weight * L,
    most * size). Ordered by the level at which each is full, L follows from
    running sums, so no loop is needed. The table has a row a source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*(F.lit(float(w)) for w in WEIGHTS))
    t = per_source.withColumn("weight", F.element_at(weights, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    t = t.withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("full_at", F.col("cap") / F.col("weight"))
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    order = W.orderBy("full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("budget", F.sum("source_size").over(whole) * (share_percent / 100.0))
    t = t.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn(
        "open", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    )
    # the level if this source and all that fill up later are not full: the first such level in order that is within reach
    t = t.withColumn("level", (F.col("budget") - F.col("spent")) / F.col("open"))
    t = t.withColumn("final", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(whole))
    return t.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("final"), F.col("cap"))).alias("target"))


def _key_range(key: Column, ranges: Column) -> Column:
    """Which of ``ranges`` equal ranges of the hash space a key lies in."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * ranges).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) for each row of ``docs``."""
    sized = cut(sizes(docs))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = targets(per_source.select("source", "source_size")).withColumnRenamed("source", "s")
    plan = per_source.join(plan.drop("source_size"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), "source_size", "target", F.ceil(F.col("n") / RANGE_DOCS).alias("ranges")
    )
    plan = (
        cut(plan)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.floor(F.col("target")).cast("long") - F.col("whole") * F.col("source_size"))
    )
    rows = sized.withColumns({"s": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()})
    much = plan.agg(F.count("*"), F.sum(F.octet_length("s"))).first()
    if much[0] <= BROADCAST_SOURCES and (much[1] or 0) <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(plan), ["s", "none"])
    else:  # a source's rows go to as many tasks as there are salts
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["s", "none", "salt"]).drop("salt")
    rows = rows.withColumn("range", _key_range(F.col("key"), F.col("ranges")))
    group = ["s", "none", "range"]
    sums = rows.groupBy(*group).agg(F.sum("size").alias("in_range"))
    before = W.partitionBy("s", "none").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("in_range").over(before), F.lit(0))).select(*group, "offset")
    inside = W.partitionBy(*group).orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, group)
    part = F.least(F.greatest(F.col("rest") - F.col("offset") - F.col("inside"), F.lit(0)), F.col("size"))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows of ``docs``: a document comes as often as its words are taken.

    Whole documents only: the one that the cut falls into is taken if at least
    half of it lies before the cut, so that a source misses its target by half
    a document at most.
    """
    # A doc_id that repeats counts with its mean, so that a row comes as often whichever of them it is.
    times, mixed, copy = fresh(docs, "times"), fresh(docs, "mixed"), fresh(docs, "copy")
    taken = mix(docs).groupBy(F.col("doc_id").alias(mixed)).agg(F.coalesce(F.floor(F.try_divide(F.sum("taken"), F.sum("size")) + 0.5), F.lit(0)).cast("int").alias(times))
    out = docs.join(taken.filter(F.col(times) > 0), F.col("doc_id").eqNullSafe(F.col(mixed)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(times, mixed, copy)
