"""N-gram Jaccard join by a token-group matrix.

The exact links between documents whose sets of five-word shingles have a
Jaccard similarity of at least 0.8, and their connected components.

1. Documents with equal sets fall together by a 128-bit digest of the set, so
   copies cost one narrow row each however many there are; the smallest doc_id
   stands for them, and only it takes part in what follows. Sets with very many
   copies are joined back by broadcast or with salts.
2. *Partition.* Min-hash keys propose for each representative a leader; the
   link to it is checked exactly, and components of checked links form the
   clusters. Each cluster is dealt out to groups of bounded size.
3. *Matrix.* A row (token, group) for the tokens of each group's members that
   lie in the members' prefixes: a pair with the wanted overlap shares a
   token of both prefixes. Tokens that one cluster alone holds link nothing new
   and go. Prefixes take rare tokens first; which are common is read off a
   hashed sample of the sets as a bitmap of bounded size. Any order gives the
   same links, so the sample decides on cost alone. The groups of a token that
   very many hold are met with salts, some hundreds of them in a task.
4. *Bound.* Two groups of different clusters stay only if sizes allow a link and
   they meet in as many tokens of their prefixes as a linked pair must; then
   each member's overlap with the other group's token union bounds its overlap
   with every member, and only groups that pass are opened.
5. *Open.* Members of opened groups are compared exactly.

Empty or null texts have no set, link with nothing and are their own
component. A repeated row is a copy; of links at exactly 0.8 all count. A very
long text is one slice of its own, and its prefix is as long as its set asks
for. Rows that share a doc_id but not the text are documents of their own, each
with its own links: they take part under keys made of id and text, above all ids
(which lie below 2**61), and a component that holds one is named by the smallest
doc_id among all its rows. A row without doc_id takes part under a key made of its
text's hash, above all those, so it names a component of such rows alone, and that
component is null. An empty table gives no rows. Extra columns are not
read, whatever their names; ``keep_one`` keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textbits as tb
from .common import batches_of, cut, few, fresh, joined, mapped
from .components import components

PERCENT = 80
KEYS, ROWS_PER_KEY = 4, 2
GROUP_DOCS, GROUP_TOKENS = 16, 30_000
#: A prefix is longer by a twentieth of the set than one shared token would need, and a pair must share as many.
PREFIX_SHARE = 20
SAMPLE_ONE_IN = 32
#: Ids that may be broadcast to pick texts (8 MB); beyond it the join is shuffled.
BROADCAST_IDS = 500_000
#: Pairs of groups that a task opens at once.
OPENED_AT_ONCE = 64
COMMON_FROM = 3
#: A set with as many copies is hot; a token in the prefixes of more groups, or a leader of more texts, is met in several tasks.
HOT_COPIES, HOT_GROUPS, SALTS = 256, 256, 64
#: Rows without doc_id are keyed from here on.
UNNAMED = 1 << 62
#: Rows of an id that several texts have are keyed from here on.
ALIASED = 1 << 61
_SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64)
_TURNS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, (KEYS * ROWS_PER_KEY, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _digest(u: np.ndarray) -> list[int]:
    return [int(tb.mix(u ^ s).sum(dtype=np.uint64)) for s in _SALTS]


_KEYS = [f"k{i}" for i in range(KEYS)]
_SET = ["n", "d1", "d2"]


def _profiles(batches):
    """doc_id, set size, digest of the set, min-hash keys."""
    for batch in batches:
        size, one, two, keys = [], [], [], []
        for part in tb.parts(batch.column(1)):
            for u in part.shingle_sets():
                size.append(len(u))
                if not len(u):
                    one.append(0), two.append(0), keys.append(np.zeros(KEYS, np.int64))
                    continue
                a, b = _digest(u)
                one.append(a), two.append(b)
                least = (tb.mix(u) * _TURNS).min(axis=1)
                keys.append(tb.signed(tb.mix(least[0::2] * np.uint64(3) + tb.mix(least[1::2])) + np.arange(KEYS, dtype=np.uint64)))
        keys = np.array(keys, np.int64).reshape(-1, KEYS)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(tb.signed(np.array(one, np.uint64))), pa.array(tb.signed(np.array(two, np.uint64))), *(pa.array(np.ascontiguousarray(k)) for k in keys.T)],
            names=["doc_id", *_SET, *_KEYS],
        )


def profiles(docs: DataFrame) -> DataFrame:
    return mapped(docs.select("doc_id", "text"), _profiles, ", ".join(f"{c} long" for c in ["doc_id", *_SET, *_KEYS]))


def _sets(batches):
    """Digest and tokens of each set."""
    for batch in batches:
        ones, sets = [], []
        for part in tb.parts(batch.column(0)):
            for u in part.shingle_sets():
                if len(u):
                    ones.append(_digest(u)[0]), sets.append(tb.signed(u))
        yield pa.RecordBatch.from_arrays([pa.array(tb.signed(np.array(ones, np.uint64))), pa.array(sets, pa.list_(pa.int64()))], names=["d1", "tokens"])


def common_tokens(docs: DataFrame) -> np.ndarray:
    """A bitmap (at most 16 MB) of the tokens that several sets among those of every 32nd text (by its hash) hold."""
    sampled = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_ONE_IN)) == 0)
    sets = mapped(sampled, _sets, "d1 long, tokens array<long>").dropDuplicates(["d1"])
    often = cut(sets.select(F.explode("tokens").alias("t")).groupBy("t").count().filter(F.col("count") >= COMMON_FROM).select("t"))
    bits = min(27, max(16, (16 * often.count()).bit_length()))
    at = F.shiftrightunsigned("t", 64 - bits)
    words = often.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(t, {64 - bits}) & 63 as int))")).alias("b")).collect()
    out = np.zeros(1 << (bits - 6), np.uint64)
    if words:
        out[[r.w for r in words]] = tb.unsigned(np.array([r.b for r in words], np.int64))
    return out


def _needed(size: np.ndarray | int) -> np.ndarray | int:
    """The least overlap that a set of this size has with any partner."""
    return -(-PERCENT * size // 100)


def _shared(size):
    """How many tokens the prefixes of a linked pair share at least, by the smaller of the two sizes."""
    return 1 + size // PREFIX_SHARE


def _prefixes(common: np.ndarray):
    bits = np.uint64(64 - (len(common).bit_length() - 1 + 6))

    def run(batches):
        done = set()  # a row that repeats within a task is dealt out once
        for batch in batches:
            doc = batch.column(0).to_pylist()
            ids, size, tokens = [], [], []
            for part in tb.parts(batch.column(1)):
                for i, u in enumerate(part.shingle_sets(), part.at):
                    if not len(u) or (told := (doc[i], len(u), int(u[0]))) in done:
                        continue
                    done.add(told)
                    at = u >> bits
                    often = (common[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
                    many = len(u) - _needed(len(u)) + _shared(len(u))
                    rare = u[~often]
                    first = rare[:many] if len(rare) >= many else np.concatenate([rare, u[often][: many - len(rare)]])
                    ids.append(i), size.append(len(u)), tokens.append(tb.signed(first))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(size, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], names=["doc_id", "n", "tokens"]
            )

    return run


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def _check_pairs(batches):
    """Of (a, b, text of a, text of b), the pairs that link."""
    for batch in batches:
        keep = []
        left, right = batch.column(2), batch.column(3)
        for lo in range(0, batch.num_rows, 256):
            x = [u for p in tb.parts(left.slice(lo, 256)) for u in p.shingle_sets()]
            y = [u for p in tb.parts(right.slice(lo, 256)) for u in p.shingle_sets()]
            keep += [_linked(a, b) for a, b in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _open_groups(batches):
    """Of pairs of groups (their clusters, their members' texts), those in which a pair of members links."""
    sets_of = lambda texts: [u for p in tb.parts(texts) for u in p.shingle_sets()]
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            a, b = (sets_of(batch.column(k)[i].values) for k in (2, 3))
            union_a, union_b = (np.unique(np.concatenate(x)) for x in (a, b))
            bound = lambda u, union: len(np.intersect1d(u, union, assume_unique=True)) >= _needed(len(u))
            a, b = [u for u in a if bound(u, union_b)], [u for u in b if bound(u, union_a)]
            keep.append(any(_linked(x, y) for x in a for y in b))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents in ``ids`` (doc_id), one row each. Few ids are broadcast, so that only their texts move."""
    return docs.join(few(ids, BROADCAST_IDS), "doc_id", "left_semi").dropDuplicates(["doc_id"])


def _leader_links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Checked links (a, b), b the smallest representative that shares a key with a and may link by its size."""
    keyed = reps.select("doc_id", "n", F.explode("keys").alias("k"))
    lead = keyed.groupBy("k").agg(F.min(F.struct("doc_id", "n")).alias("lead"), F.count("*").alias("many")).filter("many > 1").select("k", "lead")
    pairs = (
        keyed.join(lead, "k")
        .filter((F.col("doc_id") > F.col("lead.doc_id")) & (100 * F.least("n", "lead.n") >= PERCENT * F.greatest("n", "lead.n")))
        .select(F.col("doc_id").alias("a"), F.col("lead.doc_id").alias("b"))
        .distinct()
    )
    pairs = cut(pairs)
    texts = _texts(docs, cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()))
    # a leader of very many comes to as many tasks as its followers fill
    leaders = few(cut(pairs.groupBy("b").agg(F.ceil(F.count("*") / HOT_GROUPS).alias("salts"))), BROADCAST_IDS)
    of_leaders = texts.withColumnsRenamed({"doc_id": "b", "text": "tb"}).join(leaders, "b").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    followers = pairs.join(leaders, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"))
    both = followers.join(texts.withColumnsRenamed({"doc_id": "a", "text": "ta"}), "a").join(of_leaders, ["b", "salt"]).select("a", "b", "ta", "tb")
    return cut(mapped(both, _check_pairs, "a long, b long").distinct())


def _cross_links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between clusters, as (a, b) of cluster ids. reps: doc_id, n, cluster."""
    per = reps.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))
    bins = F.greatest(F.ceil(F.col("docs") / GROUP_DOCS), F.ceil(F.col("tokens") / GROUP_TOKENS)).cast("int")
    grouped = cut(reps.join(per, "cluster").select("doc_id", "cluster", F.pmod(F.xxhash64("doc_id"), bins).alias("bin")))
    of_token = W.partitionBy("t")  # the one exchange of the representatives' prefixes: tokens of one cluster alone end here
    rows = (
        mapped(docs.select("doc_id", "text"), _prefixes(common_tokens(docs)), "doc_id long, n int, tokens array<long>")
        .join(few(grouped, BROADCAST_IDS), "doc_id")
        .select("cluster", "bin", "n", F.posexplode("tokens").alias("pos", "t"))
        .withColumns({"lo": F.min("cluster").over(of_token), "hi": F.max("cluster").over(of_token)})
        .filter("lo != hi")
    )
    matrix = rows.groupBy("t", "cluster", "bin").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("left"))
    matrix = matrix.withColumn("salts", F.ceil(F.count("*").over(of_token) / HOT_GROUPS))
    salts = {"x": F.pmod(F.xxhash64("cluster", "bin"), F.col("salts")), "y": F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))}
    x, y = (matrix.select("t", salts[s].alias("salt"), *(F.col(c).alias(f"{c}_{s}") for c in matrix.columns if c not in ("t", "salts"))) for s in "xy")
    # A pair of overlap o shares k tokens at least among those with o - k others behind them in both sets (their
    # sizes give o >= 80/180 of the sum); groups stand for their members by the extreme sizes.
    small, large = F.least("least_x", "least_y"), F.least("most_x", "most_y")
    meets = x.join(y, ["t", "salt"]).filter(
        (F.col("cluster_x") < F.col("cluster_y"))
        & (100 * F.col("most_x") >= PERCENT * F.col("least_y"))
        & (100 * F.col("most_y") >= PERCENT * F.col("least_x"))
        & ((100 + PERCENT) * (F.least("left_x", "left_y") + F.floor(large / PREFIX_SHARE)) >= PERCENT * (F.col("least_x") + F.col("least_y")))
    )
    # a token that a linked pair shares has no larger ``small`` than the pair's smaller set; others may, so the least counts
    meets = meets.groupBy("cluster_x", "bin_x", "cluster_y", "bin_y").agg(F.count("*").alias("shared"), F.min(1 + F.floor(small / PREFIX_SHARE)).alias("wanted"))
    meets = meets.filter("shared >= wanted")
    pairs = cut(meets.select("cluster_x", "bin_x", "cluster_y", "bin_y"))
    wanted = pairs.select(F.col("cluster_x").alias("cluster"), F.col("bin_x").alias("bin")).unionByName(
        pairs.select(F.col("cluster_y").alias("cluster"), F.col("bin_y").alias("bin"))
    )
    members = cut(grouped.join(wanted.distinct(), ["cluster", "bin"], "left_semi").select("doc_id", "cluster", "bin"))
    texts = members.join(_texts(docs, members.select("doc_id")), "doc_id").groupBy("cluster", "bin").agg(F.collect_list("text").alias("texts"))
    a, b = (texts.select(*(F.col(c).alias(f"{c}_{s}") for c in texts.columns)) for s in "xy")
    both = pairs.join(a, ["cluster_x", "bin_x"]).join(b, ["cluster_y", "bin_y"]).select("cluster_x", "cluster_y", "texts_x", "texts_y")
    with batches_of(docs.sparkSession, OPENED_AT_ONCE):
        return cut(both.mapInArrow(_open_groups, "a long, b long").distinct())


def _with_component(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows (doc_id, n, d1, d2) with their set's component_id; no task gets all copies of a set."""
    hot = classes.filter(F.col("copies") >= HOT_COPIES).select(*_SET, F.col("component_id").alias("hot"))
    if hot.count() <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(hot), _SET, "left")
    else:
        salted = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(SALTS)).cast("int")).join(salted, [*_SET, "salt"], "left").drop("salt")
    cold = classes.filter(F.col("copies") < HOT_COPIES).select(*_SET, "component_id")
    return rows.filter("hot is not null").select("doc_id", "n", F.col("hot").alias("component_id")).unionByName(
        rows.filter("hot is null").join(cold, _SET).select("doc_id", "n", "component_id")
    )


def _keyed(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with a key that names a row's id and text, and (key, real id) of the ids that several texts have, if any do.

    The key is the doc_id itself, so that few rows need a second name: those of
    an id with several texts get one each, above all ids, and those without id
    one above these.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    told = F.xxhash64(text, F.lit(1))
    several = docs.filter("doc_id is not null").groupBy(doc_id.alias("id")).agg(F.min(told).alias("least"), F.max(told).alias("most")).filter("least <> most").select("id")
    several = cut(several)
    plain = F.coalesce(doc_id, F.lit(UNNAMED) + F.shiftrightunsigned(F.xxhash64(text), 2))
    if several.isEmpty():
        return docs.withColumn(key, plain), None
    id_, found = fresh(docs, "id"), fresh(docs, "found")
    own = F.lit(ALIASED) + F.shiftrightunsigned(F.xxhash64(doc_id, text), 3)
    known, rows = several.select(F.col("id").alias(id_), F.lit(True).alias(found)), docs.withColumn(id_, doc_id)
    if several.count() <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(known), id_, "left")
    else:  # an id of very many rows goes to several tasks
        salt = fresh(rows, "salt")
        spread = known.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn(salt, F.pmod(told, F.lit(SALTS)).cast("int")).join(spread, [id_, salt], "left").drop(salt)
    named = rows.withColumn(key, F.when(F.col(found), own).otherwise(plain)).drop(id_, found)
    return named, cut(named.filter(F.col(key).between(ALIASED, UNNAMED - 1)).select(F.col(key).alias("doc_id"), doc_id.alias("real")).distinct())


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, n, component_id for each row of ``docs`` (doc_id, text), whose doc_id is no null."""
    all_docs = cut(profiles(docs))
    classes = cut(all_docs.filter("n > 0").groupBy(*_SET).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *(F.min(k).alias(k) for k in _KEYS)))
    reps = classes.select(F.col("rep").alias("doc_id"), "n", F.array(*_KEYS).alias("keys")).dropDuplicates(["doc_id"])
    cluster = cut(components(_leader_links(docs, reps), "a", "b"))
    reps = reps.join(cluster.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n", F.coalesce("component", "doc_id").alias("cluster")
    )
    merged = components(_cross_links(docs, reps), "a", "b").select(F.col("node").alias("component"), F.col("component").alias("merged"))
    final = cluster.join(merged, "component", "left").select(F.col("node").alias("rep"), F.coalesce("merged", "component").alias("component_id"))
    lone = merged.join(cluster, "component", "left_anti").select(F.col("component").alias("rep"), F.col("merged").alias("component_id"))
    named = classes.join(final.unionByName(lone), "rep", "left").select(*_SET, "copies", F.coalesce("component_id", "rep").alias("component_id"))
    out = _with_component(all_docs.filter("n > 0").select("doc_id", *_SET), cut(named))
    return out.unionByName(all_docs.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text)."""
    key = fresh(docs, "key")
    keyed, aliases = _keyed(docs.select("doc_id", "text"), key)
    found = _grouped(keyed.select(F.col(key).alias("doc_id"), "text"))
    named = lambda c: F.when(F.col(c) < UNNAMED, F.col(c))
    if aliases is not None:
        found = cut(joined(found, aliases, "doc_id", BROADCAST_IDS))
        names = found.filter("real is not null").groupBy("component_id").agg(F.min("real").alias("least"))
        found = joined(found, cut(names), "component_id", BROADCAST_IDS)
        component = F.least("least", F.when(F.col("component_id") < ALIASED, F.col("component_id")), F.when(F.col("component_id") >= UNNAMED, F.col("component_id")))
        found = found.select(F.coalesce("real", "doc_id").alias("doc_id"), "n", component.alias("component_id"))
    return found.select(named("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), named("component_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component: one document of each group stays.

    Of rows that repeat a doc_id with the same text one stays; rows without
    text stay, as they are linked with nothing. A row without doc_id stays if
    no row of its group has one and its text's hash is the smallest; one of an
    id that several texts have stays if all rows of its group are such rows or
    have no id, and its hash is the smallest.
    """
    key = fresh(docs, "key")
    keyed, _ = _keyed(docs, key)
    kept = _grouped(keyed.select(F.col(key).alias("doc_id"), "text")).filter("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(kept, key, "left_semi").drop(key).dropDuplicates(["doc_id", "text"])
