"""Streams over files, run to their end."""

import json

import pandas as pd
import pytest

from sievework.streaming import flows


def _chunk(run, chunk, n):
    return json.dumps({"runId": run, "chunkId": chunk, "provider": "p", "records": [{"recordType": "t", "university": f"u{i}", "year": 2026} for i in range(n)]})


def test_ingest_stores_chunks_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join([_chunk("r", "a", 2), _chunk("r", "a", 2), _chunk("", "b", 1), "{broken", _chunk("r", "big", 251)]))
    args = spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")
    flows.ingest(*args).awaitTermination()
    (src / "2.json").write_text("\n".join([_chunk("r", "a", 2), _chunk("r", "c", 3)]))
    flows.ingest(*args).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/records"))
    assert got.count() == 5 and got.select("fingerprint").distinct().count() == 3
    assert spark.read.text(str(tmp_path / "out/dead")).count() == 3


def test_a_new_checkpoint_keeps_what_was_stored(spark, tmp_path):
    """Batches of a new checkpoint count from 0: they overwrite nothing and store nothing twice."""
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text(_chunk("r", "a", 2))
    flows.ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp1")).awaitTermination()
    (src / "2.json").write_text(_chunk("r", "b", 3))
    flows.ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/records")).count() == 5


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def _run(df, tmp_path, name):
    rows = []
    q = df.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).foreachBatch(lambda b, _: rows.extend(b.collect())).start()
    q.awaitTermination()
    return rows


def test_furthest_state(rocks, tmp_path):
    at = pd.to_datetime(["2026-01-01", "2026-01-02", "2026-01-03"])
    rocks.createDataFrame(pd.DataFrame({"key": ["a"] * 3, "state": ["clicked", "confirmed", "deferred"], "at": at})).write.parquet(str(tmp_path / "s"))
    stream = rocks.readStream.schema("key string, state string, at timestamp").parquet(str(tmp_path / "s"))
    rows = _run(flows.furthest_states(stream, {"clicked": 10, "deferred": 20, "confirmed": 50}), tmp_path, "c1")
    assert rows[-1].state == "confirmed" and rows[-1].state_rank == 50


def test_late_finish_is_rejected(rocks, tmp_path):
    e = pd.DataFrame([("c", 1, 1, "BEGIN", 0), ("c", 2, 2, "BEGIN", 5000), ("c", 1, 1, "FINISH", 5001), ("c", 2, 2, "FINISH", 5002)], columns=["cell", "operation", "generation", "event", "event_ms"])
    spec = "cell string, operation long, generation int, event string, event_ms long"
    rocks.createDataFrame(e, spec).write.parquet(str(tmp_path / "s"))
    rows = _run(flows.lease_outcomes(rocks.readStream.schema(spec).parquet(str(tmp_path / "s")), 1000), tmp_path, "c2")
    assert [(r.operation, r.outcome) for r in rows] == [(1, "STARTED"), (1, "EXPIRED"), (2, "STARTED"), (1, "REJECTED"), (2, "FINISHED")]
