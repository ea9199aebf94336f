"""The end of a run: refused while pages of its plan are missing from what the stream has stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dashboard import finish_gate


class RunIncomplete(Exception):
    """A run can't be finished. ``pending`` names the first pages that are missing, ``count`` how many there are."""

    def __init__(self, run_id: str, pending: list[tuple], count: int):
        self.run_id, self.pending, self.count = run_id, pending, count
        super().__init__(f"run {run_id} has {count} pages pending, {pending[:5]} among them")


def stored(spark: SparkSession, folder: str, upto: dict[str, int]) -> DataFrame:
    """The ledger of stored chunks as of the batches in ``upto`` (query to batch): later ones, which may still be written, aren't looked at."""
    seen = spark.read.schema("runId string, chunkId string, query string, batch long").parquet(f"{folder}/ledger")
    held = F.lit(False)
    for query, batch in upto.items():
        held = held | ((F.col("query") == query) & (F.col("batch") <= batch))
    return seen.filter(held).select(F.col("runId").alias("run_id"), F.col("chunkId").alias("chunk_id")).distinct()


def committed(query) -> dict[str, int]:
    """The last batch that a query has ended, and so its sink."""
    done = query.lastProgress
    return {query.id if isinstance(query.id, str) else str(query.id): done["batchId"]} if done else {}


def pending_pages(plan: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of ``plan`` (run_id, page, chunk_id) whose chunk isn't stored."""
    return plan.join(ledger, ["run_id", "chunk_id"], "left_anti")


def finish(run_id: str, plan: DataFrame, ledger: DataFrame, named: int = 100) -> DataFrame:
    """The gate's row of the run; raises ``RunIncomplete`` with the first ``named`` pending pages while there are any.

    plan: run_id, page, chunk_id, deferred (pages that wait by the plan's own
    leave don't refuse). Plan and ledger are read once each, the ledger as of
    ended batches, so both stand still while they are compared.
    """
    own = plan.filter(F.col("run_id") == run_id)
    left = pending_pages(own, ledger)
    state = own.select("run_id", "page", "chunk_id", "deferred").join(left.select("page", "chunk_id").withColumn("_open", F.lit(True)), ["page", "chunk_id"], "left")
    pages = state.select("run_id", F.when(F.col("_open"), "pending").otherwise("completed").alias("state"), "deferred")
    runs = own.sparkSession.createDataFrame([(run_id, 0, 0, 0)], "run_id string, uploaded int, processed int, drains int")
    verdict = finish_gate(runs, pages)
    if verdict.first().verdict == "refused":
        refusing = left.filter(~F.coalesce("deferred", F.lit(False)))
        raise RunIncomplete(run_id, [tuple(r) for r in refusing.select("page").orderBy("page").limit(named).collect()], refusing.count())
    return verdict
