"""The frontier: claimed, fetched, searched for links, and begun again with what is new, until nothing is.

A round takes pending tasks (all, or the first so many of each provider),
joins them with the captured pages, and takes the links of those that are
there; what neither the frontier nor an earlier round knows is enqueued. Tasks
of a round are written to a folder of its own and read as one table, so that
the plan of a round doesn't grow with the number of rounds before, and a round
that is run again writes the same files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import url as U
from .store import new_folder

_TASK = "provider string, url string, priority int, depth int, found_at string"


def same_source(source: Column, configured: Column) -> Column:
    """Whether an observed source is absent, or an http(s) address on the very host that is configured."""
    return source.isNull() | (source == "") | F.coalesce(U.scheme(source).isin("http", "https") & (U.host(source) == U.host(configured)), F.lit(False))


def crawl(seeds: DataFrame, links: DataFrame, per_round: int | None = None, most_rounds: int = 1_000) -> DataFrame:
    """provider, url, priority, depth, found_at, round, state of every task that is reached from ``seeds``.

    seeds: provider, url, priority. links: provider, url (of a captured page),
    link (null of a page without links), one row a link. ``depth`` is the number of links to a seed
    in the order of rounds, ``found_at`` the smallest page that a task was
    found on in the round that enqueued it. A task is ``completed`` in the
    round that claims it if its page is captured, else ``missing``; with
    ``per_round`` a provider's tasks wait as ``pending`` until their turn, by
    priority and then url. After ``most_rounds`` what is left stays pending.

    Rows of ``links`` that repeat, and links from several pages to one, count
    once. Each round is a join of its claims with ``links`` by url, and an
    anti-join of what is found with what is known; a round's hot target is
    brought to one row by an aggregate before either.
    """
    spark = seeds.sparkSession
    folder, key = new_folder(spark, "frontier"), ["provider", "url"]
    start = seeds.filter("url is not null").groupBy(*key).agg(F.min("priority").cast("int").alias("priority")).withColumns({"depth": F.lit(0), "found_at": F.lit(None).cast("string")})
    start.write.parquet(f"{folder}/tasks/round=0")
    spark.createDataFrame([], "provider string, url string, state string").write.parquet(f"{folder}/claims/round=-1")
    tasks = lambda: spark.read.schema(f"{_TASK}, round int").parquet(f"{folder}/tasks")
    claims = lambda: spark.read.schema("provider string, url string, state string, round int").parquet(f"{folder}/claims")
    captured = links.select(*key).distinct()
    for k in range(most_rounds):
        # without a limit each round claims exactly what the round before enqueued
        open_ = tasks().filter(F.col("round") == k) if per_round is None else tasks().join(claims(), key, "left_anti")
        if per_round is not None:
            turn = F.row_number().over(W.partitionBy("provider").orderBy("priority", "url"))
            open_ = open_.withColumn("_n", turn).filter(F.col("_n") <= per_round).drop("_n")
        there = captured.withColumn("_there", F.lit(True))
        state = F.when(F.col("_there"), "completed").otherwise("missing")
        open_.join(there, key, "left").select(*key, state.alias("state"), "priority", "depth").write.parquet(f"{folder}/claims/round={k}")
        claimed = spark.read.schema("provider string, url string, state string, priority int, depth int").parquet(f"{folder}/claims/round={k}")
        if claimed.isEmpty():
            break
        found = claimed.filter("state = 'completed'").join(links.filter("link is not null"), key)
        found = found.groupBy("provider", F.col("link").alias("link")).agg(F.min("priority").alias("priority"), F.min("depth").alias("depth"), F.min("url").alias("found_at"))
        new = found.select("provider", F.col("link").alias("url"), (F.col("priority") + 1).alias("priority"), (F.col("depth") + 1).alias("depth"), "found_at")
        new.join(tasks().select(*key), key, "left_anti").write.parquet(f"{folder}/tasks/round={k + 1}")
    done = claims().filter("round >= 0").select(*key, F.col("state").alias("_state"), F.col("round").alias("claimed_in"))
    return tasks().drop("round").join(done, key, "left").select("provider", "url", "priority", "depth", "found_at", F.col("claimed_in").alias("round"), F.coalesce("_state", F.lit("pending")).alias("state"))
