"""Streams: idempotent ingest of chunks, monotone states, leases with generations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import captures


def ingest_batch(folder: str):
    """A foreachBatch function: chunks that were not seen before are stored once, bad ones go to a dead-letter folder.

    Records and the ledger of seen chunks are Parquet under ``folder``, written
    to a folder a query and batch, so a batch that is retried overwrites itself
    and a query with a new checkpoint, whose batches count from 0 again, nothing
    of an older one. The ledger is read without what the query wrote from this
    batch on, for the same reason.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
        at = f"query={query}/batch={batch_id}"
        rows = batch.withColumn("errors", captures.chunk_errors())
        rows.filter(F.size("errors") > 0).write.mode("overwrite").json(f"{folder}/dead/{at}")
        good = rows.filter(F.size("errors") == 0).drop("errors").dropDuplicates(["runId", "chunkId"])
        spark.createDataFrame([], "runId string, chunkId string").write.mode("ignore").parquet(f"{folder}/ledger/query=begun/batch=-1")
        seen = spark.read.schema("runId string, chunkId string, query string, batch long").parquet(f"{folder}/ledger")
        seen = seen.filter((F.col("query") != query) | (F.col("batch") < batch_id)).select("runId", "chunkId").distinct()
        good = good.join(seen, ["runId", "chunkId"], "left_anti")
        captures.chunk_records(good).write.mode("overwrite").parquet(f"{folder}/records/{at}")
        good.select("runId", "chunkId").write.mode("overwrite").parquet(f"{folder}/ledger/{at}")

    return run


def ingest(spark: SparkSession, source: str, folder: str, checkpoint: str, files_per_batch: int = 100):
    """Starts the ingest of everything that lies in ``source`` and returns the query."""
    stream = spark.readStream.schema(captures.CHUNK).option("columnNameOfCorruptRecord", "_bad").option("maxFilesPerTrigger", files_per_batch).json(source)
    return stream.writeStream.foreachBatch(ingest_batch(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class FurthestState(StatefulProcessor):
    """Keeps the furthest state of a key and emits it whenever it moves on."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "rank int, state string, at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        known = self.best.get() if self.best.exists() else None
        best = (known[0], known[1], known[2]) if known else None
        begun = best
        for part in rows:
            for state, at in zip(part["state"], part["at"], strict=True):
                got = (self.ranks.get(state, -1), state, at.to_pydatetime())
                if best is None or (got[0], got[2]) >= (best[0], best[2]):
                    best = got
        if best is not None and best != begun:
            self.best.update(best)
            yield pd.DataFrame({"key": [key[0]], "state": [best[1]], "state_rank": [best[0]]})

    def close(self) -> None:
        pass


def furthest_states(stream: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """key, state, state_rank whenever a key (of key, state, at) reaches a further state. Needs the RocksDB state store."""
    return stream.groupBy("key").transformWithStateInPandas(FurthestState(ranks), "key string, state string, state_rank int", "Update", "None")


class Leases(StatefulProcessor):
    """One running operation a cell; a finish counts only with the running operation's generation."""

    def __init__(self, stale_ms: int):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.running = handle.getValueState("running", "operation long, generation int, at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        now = self.running.get() if self.running.exists() else None
        out = []
        events = pd.concat(list(rows)).sort_values(["event_ms", "operation"])
        for e in events.itertuples():
            if now and e.event_ms - now[2] > self.stale_ms:
                out.append((key[0], now[0], "EXPIRED", e.event_ms))
                now = None
            if e.event == "BEGIN":
                if now:
                    out.append((key[0], now[0], "SUPERSEDED", e.event_ms))
                now = (int(e.operation), int(e.generation), int(e.event_ms))
                out.append((key[0], now[0], "STARTED", e.event_ms))
            elif e.event == "FINISH":
                ok = now is not None and (now[0], now[1]) == (e.operation, e.generation)
                out.append((key[0], int(e.operation), "FINISHED" if ok else "REJECTED", e.event_ms))
                now = None if ok else now
        if now:
            self.running.update(now)
        else:
            self.running.clear()
        yield pd.DataFrame(out, columns=["cell", "operation", "outcome", "event_ms"])

    def close(self) -> None:
        pass


def lease_outcomes(stream: DataFrame, stale_ms: int) -> DataFrame:
    """cell, operation, outcome, event_ms from events (cell, operation, generation, event, event_ms)."""
    return stream.groupBy("cell").transformWithStateInPandas(Leases(stale_ms), "cell string, operation long, outcome string, event_ms long", "Update", "None")
