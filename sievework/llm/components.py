"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every vertex hands its neighbours on one side the smallest vertex it knows.

    Minima come from a map-side combined aggregate and are joined back, so the
    neighbourhood of a hot vertex is never gathered as a list.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    # A large star sends everything to a vertex no larger than the one it is at; the edge to the minimum itself stays.
    if large:
        out = out.unionByName(least.filter("m < u").select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    Self-loops and rows with a null end are ignored. An empty edge list gives
    an empty result.
    """
    e = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = cut(e)
    seen = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum("v")).first()
        if now[0] == 0 or now == seen:
            return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = now
        e = cut(_star(_star(e, True), False))
