"""Importance resampling towards a target distribution of hashed n-grams.

A text's features are its runs of 1 to ``LENGTH`` consecutive words (A-Z
lower-cased; letters, digits and all beyond ASCII), joined by one space. Each
task lays the words of some texts end to end as word ids and sorts their
suffixes, as far as ``LENGTH`` words, into a suffix array. Neighbours that share
their first k words (a run of longest common prefixes of k and more) are the
places of one n-gram: it is hashed once a run, from the hash of the run that it
extends, and the run's bucket is scattered back to all its places. A run never
leaves its text. The arrays are cut by bytes (``SLICE_BYTES``), one text at
least, so their size bounds a task's memory.

Counts of buckets over all documents and over all of the target meet in a table
of ``BUCKETS`` rows, whatever the size of either. A bucket's gain compares both
shares; a document's weight is the floored mean of its features' gains; a draw
by hash of its id (Gumbel) is added, and the highest scores are drawn.

Ranks without a global sort: scores are whole numbers, whose distinct values
are bounded by the logarithms of the counts and the draw (some ten thousand);
their counts give how many lie above each, and rows of one score are ordered by
doc_id. The draw deals rows of equal weight over thousands of scores, so no
score holds more than some thousandths of them; rows that repeat, which share
their draw, are ranked as one row with a count.

Null and empty texts have no features, weight 0, and are not drawn while they
have fewer than ``LEAST_WORDS`` words. A null doc_id draws as an empty one and
comes last among ties. Rows that share an id draw alike; ties beyond doc_id go by
features and weight, then to either. Rows that repeat are counted and drawn
each. Very long texts are a slice of their own. An empty target leaves gains by
the documents alone; an empty table gives no rows. Extra columns, whatever their
names, are not read; ``drawn_documents`` keeps them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textbits as tb
from .common import cut, few, fresh, mapped

LENGTH, BUCKETS = 2, 10_000
LEAST_WORDS, SHARE_PERCENT, SEED = 20, 25, 7
SLICE_BYTES = 4 << 20
#: Distinct scores that may be broadcast; their number is bounded by the logarithms of all counts.
BROADCAST_SCORES = 500_000


class Suffixes:
    """The suffix array of a slice's words, to a depth of ``length`` words, and its runs.

    Words are known by their 64-bit hashes within a slice.
    """

    def __init__(self, part: tb.Slice, length: int):
        part.words(tb.ALNUM)
        self.part, self.length, self.w = part, length, part.w
        n = len(part.starts)
        distinct, first, ids = np.unique(part.hashes(), return_index=True, return_inverse=True)
        self.first_place, self.ids = first, ids
        #: Words from each place to the end of its text.
        self.left = np.repeat(part.w[1:], np.diff(part.w)) - np.arange(n)
        ranks, rank = [ids], ids
        for k in range(1, length):
            following = np.zeros(n, np.int64)
            inside = self.left > k
            following[inside] = ids[np.flatnonzero(inside) + k] + 1
            if k == length - 1:
                rank = rank * (len(distinct) + 1) + following
            else:
                rank = np.unique(rank * (len(distinct) + 1) + following, return_inverse=True)[1]
            ranks.append(rank)
        self.order = np.argsort(rank, kind="stable")
        #: For each place of the array, how many words it shares with the one before; by depth, up to ``length``.
        self.shares = [np.concatenate([[False], r[1:] == r[:-1]]) if n else np.zeros(0, bool) for r in (rank[self.order] for rank in ranks)]

    def runs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each k: k, the places of all k-grams in the array's order, the number in each run, and the CRC-32 of each run's n-gram."""
        buf, order = self.part.buf, self.order
        starts, ends = self.part.starts, self.part.ends
        words = [buf[a:b].tobytes() for a, b in zip(starts[self.first_place].tolist(), ends[self.first_place].tolist(), strict=True)]
        crcs, above = np.array([zlib.crc32(x) for x in words], np.int64), None
        for k in range(1, self.length + 1):
            opens = ~self.shares[k - 1]
            long = self.left[order] >= k  # of a run all or none, as an end of text differs from any word
            run_of = np.cumsum(opens) - 1
            at = np.flatnonzero(opens & long)
            if k > 1:
                spaced = [zlib.crc32(b" ", c) for c in crcs.tolist()]
                last = self.ids[order[at] + k - 1].tolist()
                grown = np.zeros(int(opens.sum()), np.int64)
                grown[run_of[at]] = [zlib.crc32(words[j], spaced[r]) for j, r in zip(last, above[at].tolist(), strict=True)]
                crcs = grown
            above = run_of
            yield k, order[long], np.bincount(run_of[long], minlength=int(opens.sum()))[run_of[at]], crcs[run_of[at]]


def _counts(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in tb.parts(batch.column(0), SLICE_BYTES):
                for _, _, many, crc in Suffixes(part, length).runs():
                    np.add.at(total, crc % buckets, many)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, length: int = LENGTH, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    found = mapped(texts.select(F.col("text").cast("string")), _counts(length, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log of how much likelier a bucket is in the target, floored; one is added to every count."""
    s_all, t_all, many = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = lambda s, t: float(t + 1) * float(s_all + many) / (float(s + 1) * float(t_all + many))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(texts: pa.Array, gain: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Number of words, number of features and weight of each text, slice by slice."""
    for part in tb.parts(texts, SLICE_BYTES):
        suffixes = Suffixes(part, length)
        n, place = np.diff(suffixes.w), np.zeros(len(suffixes.ids), np.int64)
        for _, at, many, crc in suffixes.runs():  # a bucket goes from its run to all places of the run
            place[at] += np.repeat(gain[crc % len(gain)], many)
        upto = np.concatenate([[0], np.cumsum(place)])
        features = sum(np.maximum(n - k, 0) for k in range(length))
        yield n, features, np.where(features > 0, (upto[suffixes.w[1:]] - upto[suffixes.w[:-1]]) // np.maximum(features, 1), 0)


def _weighed(gain, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(weights(batch.column(1), gain.value, length))
            cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols), batch.column(2)], names=["doc_id", "n_words", "n_features", "weight", "row"])

    return run


def _draw(seed: int):
    """floor(-1000 ln(-ln(u))) of a u between 0 and 1 from the hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scores(docs: DataFrame, target: DataFrame, length: int = LENGTH, buckets: int = BUCKETS, seed: int = SEED, row: str | None = None) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row of ``docs``, nearer to ``target`` is higher; and row, if a column is named that numbers the rows."""
    gain = gains(bucket_counts(docs, length, buckets), bucket_counts(target, length, buckets))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), (F.col(row) if row else F.lit(0)).cast("long").alias("row"))
    held = docs.sparkSession.sparkContext.broadcast(gain)
    out = mapped(texts, _weighed(held, length), "doc_id long, n_words long, n_features long, weight long, row long").withColumn("score", F.col("weight") + _draw(seed))
    return out if row else out.drop("row")


def ranked(scored: DataFrame, share_percent: int = SHARE_PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds rank (1, 2, 3 ...) to the ``share_percent`` of rows with enough words that score highest, null to all others."""
    may = F.col("n_words") >= least_words
    per_score = cut(scored.filter(may).groupBy("score").agg(F.count("*").alias("many")))
    draws = (per_score.agg(F.sum("many")).first()[0] or 0) * share_percent // 100
    above = F.coalesce(F.sum("many").over(W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_ = cut(per_score.select("score", above.alias("above")).filter(F.col("above") < draws))
    lowest = open_.agg(F.min("score")).first()[0]
    best = may & (F.col("score") >= F.lit(lowest).cast("long"))
    rest = scored.filter(~F.coalesce(best, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    rows = scored.filter(best).groupBy(*scored.columns).agg(F.count("*").alias("copies")).join(few(open_, BROADCAST_SCORES), "score")
    within = W.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), *(c for c in ("n_features", "weight", "n_words", "row") if c in scored.columns)).rowsBetween(W.unboundedPreceding, -1)
    first = F.col("above") + F.coalesce(F.sum("copies").over(within), F.lit(0)) + 1
    out = rows.withColumn("first", first).withColumn("rank", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)))
    return rest.unionByName(out.select(*scored.columns, F.when(F.col("rank") <= draws, F.col("rank")).alias("rank")))


def resample(docs: DataFrame, target: DataFrame, share_percent: int = SHARE_PERCENT, least_words: int = LEAST_WORDS, length: int = LENGTH, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each row of ``docs``."""
    return ranked(cut(scores(docs, target, length, buckets, seed)), share_percent, least_words)


def drawn_documents(
    docs: DataFrame, target: DataFrame, share_percent: int = SHARE_PERCENT, least_words: int = LEAST_WORDS, length: int = LENGTH, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns. The rows are written once, so that their numbers, which break the last ties, hold."""
    row = fresh(docs, "row")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    scored = cut(scores(numbered.select("doc_id", "text", row), target, length, buckets, seed, row))
    drawn = ranked(scored, share_percent, least_words).filter("rank is not null")
    return numbered.join(drawn.select(F.col("row").alias(row)), row, "left_semi").drop(row)
