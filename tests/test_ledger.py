"""Ledger operators on small fixtures: empty input, ties, nulls, repeats."""

from pyspark.sql import functions as F

from sievework.operators import ledger

SLOTS = "g int, slot int, identity_key string, label string"


def slots_after(spark, have, ask):
    s = spark.createDataFrame([(1, n, i, i) for n, i in have], SLOTS)
    return sorted((r.slot, r.identity_key) for r in ledger.place_in_slots(s, spark.createDataFrame([(1, *ask, ask[1])], SLOTS), ["g"]).collect())


def test_slots(spark):
    assert slots_after(spark, [(1, "a"), (2, "b")], (2, "a")) == [(1, "b"), (2, "a")]  # swapped
    assert slots_after(spark, [(1, "a")], (3, "a")) == [(3, "a")]  # moved
    assert slots_after(spark, [(1, "a"), (2, "b")], (1, "c")) == [(1, "c"), (2, "b")]  # replaced
    assert slots_after(spark, [(1, "a")], (1, "a")) == [(1, "a")]
    assert slots_after(spark, [], (6, "z")) == [(6, "z")]


def test_empty_tables_give_zeros(spark):
    t = spark.createDataFrame([], "identity_key string, lane string, state string")
    assert tuple(ledger.confirmed_depth(t).first()) == (0, 0, 0, 0, 0)
    assert tuple(ledger.state_counts(t, []).first()) == (0,) * 8
    assert ledger.histogram(spark.createDataFrame([], "k string"), "k").count() == 0
    r = ledger.coverage_closed(spark.createDataFrame([], "identity_key string, covered_count int, outstanding int, returned int"), 4).first()
    assert (r.expected, r.outstanding, r.closed) == (0, 0, False)


def test_closure(spark):
    spec = "identity_key string, covered_count int, outstanding int, returned int"
    closed = lambda *odd: ledger.coverage_closed(spark.createDataFrame([(str(i), 4, 0, 1) for i in range(5)] + [odd], spec), 4).first().closed
    assert closed("x", 4, 0, 1) and not closed("x", 3, 0, 1) and not closed("x", 4, 1, 1) and not closed("x", 4, 0, 0)


def test_aliases_and_quality(spark):
    targets = spark.createDataFrame([(2, "b", "나 대학교", None), (1, "a", "가대학교", ["같은", "같은"]), (3, "c", "다대학교", ["같은"])], "place int, target_id string, university string, aliases array<string>")
    names = spark.createDataFrame([("나대",), ("같 은",), ("B",), (None,), ("없음",)], "name string")
    assert {r.name: r.target_id for r in ledger.resolve_alias(names, "name", targets).collect()} == {"나대": "b", "같 은": "a", "B": "b", None: None, "없음": None}
    records = spark.createDataFrame([("f", "raw", "u"), ("g", "raw", "u"), (None, "raw", "u")], "fingerprint string, quality_state string, entity string")
    said = spark.createDataFrame([("f", 1, "x"), ("f", 2, None)], "fingerprint string, place int, entity string")
    assert {(r.fingerprint, r.quality_state, r.entity) for r in ledger.propagate_quality(records, said, ["entity"]).collect()} == {("f", "accepted", None), ("g", "raw", "u"), (None, "raw", "u")}


def test_choice_and_gate(spark):
    spec = "g int, target_id string, identity_key string, lane string, state string, priority int, preferred boolean"
    rows = [(1, "t1", "i", "b", "confirmed", 9, None), (1, "t2", "i", "b", "pending", 9, None), (1, "t3", "i", "a", "pending", 1, None), (1, "t4", "j", "z", "pending", 1, None), (2, "t5", "i", "z", "failed", 1, True)]
    pick = lambda r: [(x.g, x.target_id, x.lane_missing) for x in ledger.mission_choice(spark.createDataFrame(r, spec), ["g"], ("b", "a")).collect()]
    assert pick(rows) == [(1, "t3", True)]
    assert pick([*rows, (1, "t6", "k", "z", "deferred", None, True)]) == [(1, "t6", True)]
    caps = spark.createDataFrame([(1, n, k) for n, k in ((1, "low"), (2, "low"), (3, "low"), (4, None))], "route int, at int, kind string")
    assert [r.expand for r in ledger.repeat_captures(caps, ["route"], ["at"], F.col("kind") == "low").orderBy("at").collect()] == [True, True, False, True]
