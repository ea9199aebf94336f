"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by pseudo-random rotations (three rounds of random
signs and a fast Hadamard transform) and assigned to the nearest signed axis.
A table joins as many such hashes as the number of rows asks for, so that its
buckets grow in number and not in size. A query looks into several buckets of
every table, those whose axes it leans to most (multiprobe); all of a bucket's
candidates are compared exactly, in double precision on the original vectors.

How many tables and probes there are is measured and not assumed: a bounded
number of queries (``MEASURED``, by the hash of their ids) is searched exactly in
one pass over all rows, and of all settings under which ``AIM`` of these true
neighbours lie in a probed bucket the one of fewest comparisons is taken, with
fewer hashes a table where no setting reaches it. Vectors without any structure
ask for a large share of all buckets, clustered ones for a few.

Directions say little of nearness where lengths vary: the nearest of a short
vector are other short ones at any angle. Tables of lifted vectors come in then,
with one more component of a low or the middle length, so that vectors
much shorter than it share a direction. A query that finds fewer than it asks
for is compared with all rows, in blocks.

Equal vectors fall together first: no query needs more of them than its own
number of neighbours plus itself, the smallest ids, so that many copies of a
vector cost one row. A bucket is dealt to blocks of bounded size and a query
goes to every block of the buckets it probes; no pair of rows is ever shuffled,
only each block's best few.

Vectors that are null, of length zero, or hold null or non-finite components
take no part; so do vectors of another length than the most frequent one. Null
ids take no part. A repeated row (same id and vector) counts once; an id with
several vectors is a candidate by the nearest of them and asks by the smallest.
Ties go to the smaller id. With fewer candidates than asked for, all of them
come back. An empty table gives no rows. Extra columns, whatever their names,
are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, few

TABLES = 6
#: Queries that are searched exactly to choose the setting, the share of their neighbours to be found, and the most probes of a table of several hashes.
MEASURED, AIM, MOST_PROBES = 128, 0.95, 1024
#: Where the longest vector exceeds the shortest by this factor: tables of vectors lifted by each of these quantiles of the lengths.
LENGTHS_VARY, LIFTS, LIFTED_TABLES = 1.01, (0.1, 0.5), 3
BLOCK_ROWS = 4096
#: Buckets' sizes are broadcast up to so many rows.
BROADCAST_ROWS = 500_000
QUERY_EVERY = 100
NEIGHBOURS = 10


def rotations(dim: int, hashes: int, seed: int, rounds: int = 3) -> np.ndarray:
    """Signs of the pseudo-rotations, (hashes, rounds, padded dim)."""
    size = 1 << max(1, (dim - 1).bit_length())
    return np.random.Generator(np.random.PCG64(seed)).choice([-1.0, 1.0], (hashes, rounds, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, size = x.shape
    step = 1
    while step < size:
        x = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(n, size) / np.sqrt(size)


def turned(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    y = np.zeros((len(x), signs.shape[1]))
    y[:, : x.shape[1]] = x
    for s in signs:
        y = hadamard(y * s)
    return y


def leanings(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """(rows, hashes, signed axes): how far each unit vector leans to an axis; axis a is number 2a, its negative 2a + 1."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    y = np.stack([turned(x, s) for s in signs], axis=1)
    return np.stack([y, -y], axis=3).reshape(len(x), len(signs), -1)


class Table:
    """One hash table: so many pseudo-rotations, of vectors as they are or with one more component."""

    def __init__(self, dim: int, hashes: int, seed: int, lift: float | None = None):
        self.signs, self.lift = rotations(dim + (lift is not None), hashes, seed), lift
        self.axes = 2 * self.signs.shape[2]
        #: Of each hash, how many axes a query combines.
        self.breadth = self.axes if hashes == 1 else min(self.axes, 64 if hashes == 2 else 16)
        self.buckets = self.axes**hashes

    def _leanings(self, x: np.ndarray) -> np.ndarray:
        return leanings(x if self.lift is None else np.column_stack([x, np.full(len(x), self.lift)]), self.signs)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each row."""
        return self._number(self._leanings(x).argmax(axis=2))

    def _number(self, axes: np.ndarray) -> np.ndarray:
        out = np.zeros(axes.shape[:1] + axes.shape[2:], np.int64)
        for h in range(axes.shape[1]):
            out = out * self.axes + axes[:, h]
        return out

    def probed(self, x: np.ndarray, probes: int) -> np.ndarray:
        """(rows, probes) of buckets, those first whose axes the row leans to most in sum."""
        lean = self._leanings(x)
        best = np.argsort(-lean, axis=2, kind="stable")[:, :, : self.breadth]
        total, number = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
        for h in range(lean.shape[1]):
            more = np.take_along_axis(lean[:, h], best[:, h], axis=1)
            total = (total[:, :, None] + more[:, None]).reshape(len(x), -1)
            number = (number[:, :, None] * self.axes + best[:, h][:, None]).reshape(len(x), -1)
            if h:  # no later hash lifts a bucket over more than the probed ones
                keep = np.argsort(-total, axis=1, kind="stable")[:, :probes]
                total, number = np.take_along_axis(total, keep, axis=1), np.take_along_axis(number, keep, axis=1)
        return number[:, :probes]

    @property
    def most(self) -> int:
        return self.axes if len(self.signs) == 1 else min(MOST_PROBES, self.breadth ** len(self.signs))


def tables_of(dim: int, hashes: int, lifts: list[float]) -> list[Table]:
    """All tables that may be used, the kinds in turn."""
    kinds = [[Table(dim, hashes, 5 + n) for n in range(TABLES)]] + [[Table(dim, hashes, 1000 * (k + 1) + n, lift) for n in range(LIFTED_TABLES)] for k, lift in enumerate(lifts)]
    return [kind[n] for n in range(TABLES) for kind in kinds if n < len(kind)]


def _may_miss(pairs: int) -> int:
    """How many of the measured pairs may be missed, so that ``AIM`` lies two standard deviations below what is measured."""
    mean = (1 - AIM) * pairs
    return max(0, int(mean - 2 * np.sqrt(mean * AIM)))


def setting(dim: int, rows: int, lifts: list[float], queries: np.ndarray, near: list[np.ndarray]) -> tuple[list[Table], int]:
    """The tables and the number of probes: of those that find ``AIM`` of the queries' true neighbours, the cheapest."""
    axes = 2 << max(1, (dim - 1).bit_length())
    hashes = 1
    while axes**hashes * BLOCK_ROWS < rows:
        hashes += 1
    for hashes in range(hashes, 0, -1):
        tables = tables_of(dim, hashes, lifts)
        if not len(queries):
            return tables[:1], 1
        first = []  # by table: at which probe of its query each true neighbour turns up
        for t in tables:
            found = t.probed(queries, t.most)
            at = [np.argmax(hit, axis=1) + np.where(hit.any(axis=1), 0, 1 << 30) for row, x in zip(found, near, strict=True) if len(x) for hit in [t.home(x)[:, None] == row[None]]]
            first.append(np.concatenate(at) if at else np.zeros(1, np.int64))
        choices = []
        for n in range(1, len(tables) + 1):
            least = np.sort(np.min(first[:n], axis=0))
            probes = int(least[len(least) - 1 - _may_miss(len(least))]) + 1
            if probes <= min(t.most for t in tables[:n]):
                choices.append((sum(probes / t.buckets for t in tables[:n]), n, probes))
        if choices:
            _, n, probes = min(choices)
            return tables[:n], probes
    raise AssertionError("a table of one hash has all buckets among its probes")


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _hashed(dim: int, tables: list[Table], probes: int | None):
    """Rows with each table's bucket of theirs, or with each of the buckets they probe."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                x = _rows(some.column(1), dim)
                for t, table in enumerate(tables):
                    b = table.home(x)[:, None] if probes is None else table.probed(x, probes)
                    take = pa.array(np.repeat(np.arange(len(x)), b.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(take) for c in some.columns), pa.array(np.full(b.size, t, np.int32)), pa.array(b.ravel())], names=[*batch.schema.names, "tab", "bucket"]
                    )

    return run


def _best(dim: int, k: int):
    def run(key, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(queries):
            v = np.stack(index["embedding"].to_numpy()).astype(np.float64)
            ids, same = index["vec_id"].to_numpy(), index["same"].to_numpy()
            half = (v * v).sum(axis=1) / 2
            for q, x in zip(queries["query_id"].to_numpy(), queries["embedding"].to_numpy(), strict=True):
                x = np.asarray(x, np.float64)
                near = half - v @ x
                few = min(k + 2, len(near))
                # what rounding could confuse with the last of the few stays in
                edge = np.partition(near, few - 1)[few - 1] + 1e-12 * (half.max() + x @ x)
                take = np.flatnonzero(near <= edge)
                d = np.sqrt(((v[take] - x) ** 2).sum(axis=1))
                found = [(s, i) for s, at in zip(d.tolist(), take.tolist(), strict=True) for i in same[at] if i != q]
                out += [(q, i, s) for s, i in sorted(found)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The vectors that take part, and their length."""
    e = F.col("embedding")
    ok = (
        F.col("vec_id").isNotNull()
        & e.isNotNull()
        & (F.size(e) > 0)
        & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(e, lambda x: x != 0)
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).filter(ok)
    common = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = common.dim if common else 1
    return rows.filter(F.size("embedding") == dim), dim


def lifts_of(rows: DataFrame) -> list[float]:
    """The lengths to lift by; none where all vectors are about as long."""
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    told = rows.select(length.alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.percentile_approx("n", list(LIFTS)).alias("at")).first()
    return list(told.at) if told.least is not None and told.most > LENGTHS_VARY * told.least else []


def _nearest_of_each_task(dim: int, k: int, ids: np.ndarray, queries: np.ndarray):
    """For a few queries: what is nearest to each among a task's rows, with the vectors."""

    def run(batches):
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty((0, dim)))] * len(ids)
        for batch in batches:
            v, own = _rows(batch.column(1), dim), batch.column(0).to_numpy()
            for i, (q, x) in enumerate(zip(ids, queries, strict=True)):
                d = np.concatenate([kept[i][0], np.where(own == q, np.inf, ((v - x) ** 2).sum(axis=1))])
                best = np.argsort(d, kind="stable")[:k]
                kept[i] = d[best], np.concatenate([kept[i][1], v])[best]
        n = [int(np.isfinite(d).sum()) for d, _ in kept]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(ids)), n), pa.int32()),
                pa.array(np.concatenate([d[:m] for (d, _), m in zip(kept, n, strict=True)]) if n else [], pa.float64()),
                pa.array([list(row) for (_, v), m in zip(kept, n, strict=True) for row in v[:m]], pa.list_(pa.float64())),
            ],
            names=["q", "d", "v"],
        )

    return run


def measured(classes: DataFrame, queries: DataFrame, dim: int, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """``MEASURED`` queries at most, and the vectors of each one's true k nearest: a pass over all rows, a bounded answer."""
    asked = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(MEASURED).collect()
    ids, x = np.array([r.query_id for r in asked], np.int64), np.array([r.embedding for r in asked], np.float64).reshape(-1, dim)
    if not len(ids):
        return x, []
    found = classes.select("vec_id", "embedding").mapInArrow(_nearest_of_each_task(dim, k, ids, x), "q int, d double, v array<double>")
    best = found.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy("d", "v"))).filter(F.col("n") <= k).collect()
    return x, [np.array([r.v for r in best if r.q == i], np.float64).reshape(-1, dim) for i in range(len(ids))]


def _against_all(classes: DataFrame, asked: DataFrame, many: int, best, spec: str) -> DataFrame:
    """Each of ``many`` queries compared with all rows, a block of queries with a block of rows at a time."""
    blocks, chunks = -(-classes.count() // BLOCK_ROWS), -(-many // BLOCK_ROWS)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = classes.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("chunk", all_of(chunks))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")).withColumn("block", all_of(blocks))
    return index.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInPandas(best, spec)


def equal_vectors(rows: DataFrame, k: int) -> DataFrame:
    """vec_id, embedding, same: a row a vector with the smallest k + 1 ids that have it, which are cut before the exchange."""
    rows = rows.withColumn("h", F.xxhash64("embedding")).dropDuplicates(["h", "embedding", "vec_id"])
    by = W.partitionBy("h", "embedding").orderBy("vec_id")
    rows = rows.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k + 1)
    return rows.groupBy("h", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("same")).select(F.element_at("same", 1).alias("vec_id"), "embedding", "same")


def nearest(vectors: DataFrame, every: int = QUERY_EVERY, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``every`` divides, its k nearest found."""
    rows, dim = usable(vectors)
    kind = rows.schema["embedding"].dataType.simpleString()
    classes = cut(equal_vectors(rows, k))
    queries = cut(rows.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding")))
    tables, probes = setting(dim, classes.count(), lifts_of(classes), *measured(classes, queries, dim, k))
    index = classes.mapInArrow(_hashed(dim, tables, None), f"vec_id long, embedding {kind}, same array<long>, tab int, bucket long")
    sizes = few(cut(index.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))), BROADCAST_ROWS)
    index = index.join(sizes, ["tab", "bucket"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    asked = queries.mapInArrow(_hashed(dim, tables, probes), f"query_id long, embedding {kind}, tab int, bucket long")
    # queries of a bucket come in chunks, so that a group holds no more of either side than a block; buckets that no query probes end here
    chunks = few(cut(asked.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("chunks"))), BROADCAST_ROWS)
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    index = index.join(chunks, ["tab", "bucket"]).withColumn("chunk", all_of("chunks"))
    asked = asked.join(sizes, ["tab", "bucket"]).join(chunks, ["tab", "bucket"]).withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks"))).withColumn("block", all_of("blocks"))
    key = ["tab", "bucket", "block", "chunk"]
    found = "query_id long, vec_id long, score double"
    best = cut(
        index.select(*key, "vec_id", "embedding", "same").groupBy(*key)
        .cogroup(asked.select(*key, "query_id", "embedding").groupBy(*key))
        .applyInPandas(_best(dim, k), found)
    )
    served = best.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).filter(F.col("n") >= k)
    short = cut(queries.join(served, "query_id", "left_anti"))
    many = short.count()
    if many:
        best = best.unionByName(_against_all(classes, short, many, _best(dim, k), found))
    by = W.partitionBy("query_id").orderBy("score", "vec_id")
    return best.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
