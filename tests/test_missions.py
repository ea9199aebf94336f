"""Missions, page retries, the frontier and recovery: streams over several batches against folds of all events, and rebuilds that break off."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.operators import frontier, missions, recovery
from sievework.streaming import missions as streams

EVENTS = "identity_key string, target_id string, lane string, event string, reason string, priority int, seq long"
KINDS = ["capture"] * 4 + ["click", "defer", "confirm", "fail", "attempt", "retry"] * 2 + ["cover", "close"]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def made_up(seed, n=240):
    rng, out = random.Random(seed), []
    for seq in range(n):
        t = rng.randrange(6)
        lane = f"lane{(t + (rng.random() < 0.1)) % 3}"
        kind = rng.choice(KINDS) if rng.random() < 0.9 or seq % 40 else "close"
        if kind == "close" and rng.random() < 0.7:
            kind = "attempt"
        out.append((f"i{rng.randrange(8)}", None if kind in ("cover", "close") else f"t{t}", lane, kind, f"r{rng.randrange(4)}", rng.choice([None, 1, 5, 9]), seq))
    return out


def replayed(events):
    """The rules, event by event."""
    t = {}
    for i, k, lane, event, reason, p, _ in sorted(events, key=lambda e: e[6]):
        own, trigger = t.get((i, k)), None
        if event == "close":
            for x, v in t.items():
                if x[0] == i and v["state"] in missions.OUTSTANDING:
                    v |= {"state": "failed", "reason": reason}
        elif event == "cover":
            trigger = missions.BY_COVER
        elif own is None:
            if event == "capture":
                t[i, k] = {"lane": lane, "state": "pending", "attempts": 0, "reason": None, "priority": p}
        elif event == "capture":
            if own["state"] in ("pending", "failed"):
                own["priority"] = max((x for x in (own["priority"], p) if x is not None), default=None)
        elif event == "attempt":
            own["attempts"] += 1
        elif event == "retry":
            if own["state"] == "pending":
                own["reason"] = reason
        else:
            to = missions.MOVES[event]
            if missions.RANKS[to] >= missions.RANKS[own["state"]] and (to != "confirmed" or lane == own["lane"]):
                own["reason"] = reason if to == "failed" else own["reason"] if to == "deferred" else None
                own["state"] = to
                trigger = missions.BY_CONFIRM if to == "confirmed" else None
        if trigger:
            for x, v in t.items():
                if x[0] == i and v["lane"] == lane and v["state"] == "pending":
                    v |= {"state": "skipped", "reason": trigger}
    return {(*k, v["lane"], v["state"], v["attempts"], v["reason"], v["priority"]) for k, v in t.items()}


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_fold_equals_replay(spark, seed):
    events = made_up(seed, 600)
    got = {tuple(r) for r in missions.fold(spark.createDataFrame(random.Random(seed).sample(events, len(events)), EVENTS)).collect()}
    assert got == replayed(events) and {r[3] for r in got} >= {"failed", "skipped", "confirmed"}


def _run(stream, folder, name, sink):
    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()


def test_confirm_skips_alternates_over_batches(rocks, tmp_path):
    """Three batches with restarts between them, late events among them, against the fold of all that is in time."""
    events = made_up(7, 240)
    late = [(*e[:3], "confirm", e[4], e[5], e[6]) for e in events[:30] if e[1]]
    changes = []
    for k, some in enumerate((events[:100], events[100:170], late + events[170:])):
        rocks.createDataFrame(some, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
        stream = rocks.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        _run(streams.target_changes(stream), tmp_path, "cp", lambda b, _: changes.extend(b.collect()))
    last = {}
    for c in sorted(changes, key=lambda c: c.seq):
        last[c.identity_key, c.target_id] = c
    # an identity's late events lie before what it had seen by then
    seen = {}
    for e in events[:170]:
        seen[e[0]] = e[6]
    in_time = events[:170] + [e for e in sorted(late + events[170:], key=lambda e: e[6]) if e[6] > seen.get(e[0], -1)]
    got = {(*k, c.lane, c.state, c.attempts, c.reason, c.priority) for k, c in last.items()}
    assert got == replayed(in_time) and any(c.reason == missions.BY_CONFIRM for c in changes)
    assert got == {tuple(r) for r in missions.fold(rocks.createDataFrame(in_time, EVENTS)).collect()}


def test_restore_keeps_the_higher_state(spark):
    spec = "identity_key string, target_id string, lane string, state string, attempts int, reason string, priority int"
    have = spark.createDataFrame([("i", "a", "l", "clicked", 2, None, 5), ("i", "b", "l", "confirmed", 1, None, 5), ("i", "c", "l", "failed", 1, "own", 5)], spec)
    old = spark.createDataFrame([("i", "a", "l", "failed", 1, "x", 9), ("i", "b", "l", "skipped", 3, "y", 1), ("i", "c", "l", "failed", 1, "theirs", 5), ("i", "d", "l", "nonsense", 0, None, 1), (" ", "e", "l", "failed", 0, None, 1)], spec)
    got = {r.target_id: (r.state, r.attempts, r.reason, r.priority) for r in missions.restore(have, old).collect()}
    assert got == {"a": ("failed", 2, "x", 9), "b": ("confirmed", 3, None, 5), "c": ("failed", 1, "own", 5), "d": ("pending", 0, None, 1)}


def test_breaker_waits_opens_and_goes(rocks, tmp_path):
    at = lambda s: (pd.Timestamp("2026-01-01", tz="UTC") + pd.Timedelta(seconds=s)).to_pydatetime()
    spec = "page string, event string, reason string, at timestamp"
    batches = [
        [("p", "failure", "timeout", at(0)), ("q", "failure", "timeout", at(0))],
        [("x", "request", None, at(100))],  # the watermark passes the first wait
        [("p", "failure", "timeout", at(110)), ("p", "failure", "server-error", at(120)), ("p", "request", None, at(121)), ("q", "success", None, at(120))],
        [("x", "request", None, at(300))],
        [("p", "request", None, at(310)), ("p", "failure", "server-error", at(311)), ("p", "failure", "gone", at(312)), ("p", "failure", "gone", at(313)), ("q", "failure", "timeout", at(311))],
    ]
    for k, rows in enumerate(batches):
        rocks.createDataFrame(rows, spec).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
        stream = rocks.readStream.schema(spec).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = streams.page_retries(stream, "1 second").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(streams.sort_out(str(tmp_path / "out"))).start()
        q.awaitTermination()
    out = rocks.read.parquet(str(tmp_path / "out/outcomes")).orderBy("at_ms", "attempt").collect()
    zero = int(pd.Timestamp("2026-01-01", tz="UTC").timestamp() * 1000)
    got = [((r.at_ms - zero) / 1000, r.outcome, r.attempt, None if r.due_ms is None else (r.due_ms - zero) / 1000) for r in out if r.page == "p"]
    assert got == [
        (0, "WAITING", 1, 2.2), (2.2, "RELEASED", 1, None), (110, "WAITING", 2, 113.2), (120, "OPEN", 3, 124.2), (121, "REFUSED", 3, 124.2), (124.2, "RELEASED", 3, None),
        (310, "ALLOWED", 3, None), (311, "OPEN", 4, 316.2), (313, "REFUSED", 5, None),
    ]
    dead = rocks.read.json(str(tmp_path / "out/dead")).collect()
    assert [(r.page, r.attempt, r.reason) for r in dead] == [("p", 5, "gone")]
    assert [(r.outcome, r.attempt) for r in out if r.page == "q"] == [("WAITING", 1), ("RELEASED", 1), ("CLOSED", 1), ("WAITING", 1)]


def test_frontier_rounds(spark):
    links = [("a", "1", "2"), ("a", "1", "3"), ("a", "1", "3"), ("a", "2", "3"), ("a", "2", "4"), ("a", "4", "1"), ("a", "4", "4"), ("a", "4", None), ("b", "1", "9"), ("a", "7", "8"), ("c", "5", None)]
    edges = spark.createDataFrame(links, "provider string, url string, link string")
    seeds = spark.createDataFrame([("a", "1", 5), ("a", "1", 7), ("b", "1", 0), ("c", "5", 0), ("c", None, 0)], "provider string, url string, priority int")
    got = {(r.provider, r.url): (r.priority, r.depth, r.found_at, r.round, r.state) for r in frontier.crawl(seeds, edges).collect()}
    assert got == {
        ("a", "1"): (5, 0, None, 0, "completed"), ("a", "2"): (6, 1, "1", 1, "completed"), ("a", "3"): (6, 1, "1", 1, "missing"), ("a", "4"): (7, 2, "2", 2, "completed"),
        ("b", "1"): (0, 0, None, 0, "completed"), ("b", "9"): (1, 1, "1", 1, "missing"), ("c", "5"): (0, 0, None, 0, "completed"),
    }
    one = {(r.provider, r.url): (r.round, r.state) for r in frontier.crawl(seeds, edges, per_round=1).collect()}
    assert one == {("a", "1"): (0, "completed"), ("a", "2"): (1, "completed"), ("a", "3"): (2, "missing"), ("a", "4"): (3, "completed"), ("b", "1"): (0, "completed"), ("b", "9"): (1, "missing"), ("c", "5"): (0, "completed")}
    stopped = {r.url: r.state for r in frontier.crawl(seeds.filter("provider = 'a'"), edges, most_rounds=1).collect()}
    assert stopped == {"1": "completed", "2": "pending", "3": "pending"}
    assert frontier.crawl(seeds.filter("false"), edges).count() == 0
    deep = spark.createDataFrame([("a", str(i), str(i + 1)) for i in range(8)], "provider string, url string, link string")
    plan = frontier.crawl(seeds.filter("provider = 'a'").limit(1), deep)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 3  # whatever the number of rounds
    same = spark.createDataFrame([("https://h.kr/a", "https://h.kr/b"), (None, "https://h.kr"), ("", "https://h.kr"), ("ftp://h.kr/a", "https://h.kr"), ("https://x.h.kr", "https://h.kr"), ("nonsense", "https://h.kr")], "s string, c string")
    assert [r[0] for r in same.select(frontier.same_source(F.col("s"), F.col("c"))).collect()] == [True, True, True, False, False, False]


def test_recovery_versions(spark, tmp_path):
    slots = spark.createDataFrame([("s", True, "a"), ("s", True, "a"), ("s", True, "b"), ("s", True, "c"), ("s", False, "d"), ("s", True, " "), ("t", True, "a")], "session_id string, occupied boolean, identity_key string")
    candidates = spark.createDataFrame([("s", "a", ["x"]), ("s", "a", []), ("s", "b", []), ("t", "a", None)], "session_id string, identity_key string, missing array<string>")
    both, at = slots.select("session_id").distinct(), F.to_timestamp(F.lit("2026-01-01"))
    store = recovery.RecoveryScope(spark, str(tmp_path / "scope"))
    states = lambda: {(r.session_id, r.identity_key): r.state for r in store.read().collect()}
    assert states() == {}
    for _ in range(2):  # repeated under one name
        store.rebuild(both, slots, candidates, "v1", at)
        assert states() == {("s", "a"): "pending", ("s", "b"): "complete", ("s", "c"): "stale", ("t", "a"): "complete"} and store.read().count() == 4
    # one that breaks off before its manifest leaves what was
    broken = recovery.scope(slots, candidates).limit(1).withColumns({"attempts": F.lit(9), "updated_at": at})
    broken.write.parquet(str(tmp_path / "scope/data/version=v2"))
    assert store.read().count() == 4 and store.read().filter("attempts = 9").count() == 0
    later = F.to_timestamp(F.lit("2026-01-02"))
    for _ in range(2):
        store.refresh(both.filter("session_id = 's'"), spark.createDataFrame([("s", "a", []), ("s", "c", ["y"])], candidates.schema), "v2", later)
        assert states() == {("s", "a"): "complete", ("s", "b"): "stale", ("s", "c"): "pending", ("t", "a"): "complete"}
    store.finish(both, "abandoned", "v3", F.to_timestamp(F.lit("2026-01-03")))
    assert states()["s", "c"] == "abandoned" and states()["t", "a"] == "complete"
    store.rebuild(both.filter("session_id = 't'"), slots.filter("false"), candidates, "v4", F.to_timestamp(F.lit("2026-01-04")))
    assert {k[0] for k in states()} == {"s"}
    with pytest.raises(Exception, match="checkpoint"):
        from sievework.operators import store as S

        class Bare:
            sparkContext = type("C", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})  # noqa: N815
            conf = type("F", (), {"get": staticmethod(lambda *_: None)})

        S.shared_folder(Bare)
