"""Quality scores by histogram gradient-boosted trees over document statistics.

Statistics of a text's bytes, words and lines are binned; each tree level picks
splits from histograms of gradients over the bins. A fitted model is a few flat
arrays (complete binary trees), and a batch of documents walks all trees at
once with numpy.

``FIT_ROWS`` labelled documents (those of smallest id hash outside the held-out
fold) are used at most, each once however often it repeats; of an id's several
labels the larger counts, of its several texts the smallest. Null and empty
texts have all-zero statistics and get the model's score of those. A very long
text is a slice of its own. Without labels, or with labels of one kind only,
the score is that kind's smoothed share. Of splits of equal gain the one of the
first statistic and lowest bin is taken. Rows that repeat are scored each; an
empty table gives no rows. Extra columns, whatever their names, are not read;
``good_documents`` keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbits as tb
from .common import fold_of, mapped, rows_where

FOLDS, HELD_OUT = 5, 0
FIT_ROWS = 12_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE = 40, 4, 64, 0.2
RIDGE, LEAST_ROWS = 1.0, 10

_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n", ".", ",", "!", "?", "|", "%&$#*", "@", "\"'()[]{}<>=/\\", ":;-_+~^`")
FEATURES = (
    "log_bytes", *(f"share_{i}" for i in range(len(_CLASSES))), "share_wide", "log_words", "mean_word", "std_word", "longest_word", "distinct_words", "top_word", "repeats", "distinct_shingles",
    "log_lines", "mean_line", "distinct_lines", "word_entropy",
)
_OF_BYTE = np.zeros((256, len(_CLASSES) + 1))
for _i, _chars in enumerate(_CLASSES):
    _OF_BYTE[list(_chars.encode()), _i] = 1
_OF_BYTE[0x80:, -1] = 1
_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def statistics(part: tb.Slice) -> np.ndarray:
    """A row of FEATURES for each text of the slice."""
    out = np.zeros((part.n, len(FEATURES)))
    wide = len(_CLASSES) + 1
    cuts = part.offsets - part.offsets[0]
    part.words(_LINE)
    lines, ends, line_of = part.starts, part.ends, part.w
    line_h = part.hashes()
    # the blank that closes a text belongs to no line
    part.words(tb.NOT_SPACE)
    h, w = part.hashes(), part.w
    size = part.ends - part.starts
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    k = tb.SHINGLE
    rows = len(h) - k + 1
    s = tb.mix(sum((h[j : rows + j] * np.uint64(2 * j + 3) for j in range(k)), start=np.uint64(0))) if rows > 0 else h[:0]
    for i in range(part.n):
        raw, a, b = part.raw[cuts[i] : cuts[i + 1]], int(w[i]), int(w[i + 1])
        if not len(raw):
            continue
        x = out[i]
        x[0] = np.log1p(len(raw))
        x[1 : 1 + wide] = np.bincount(raw, minlength=256) @ _OF_BYTE / len(raw)
        n = b - a
        if n:
            sz = size[a:b]
            many = np.unique(h[a:b], return_counts=True)[1]
            p = many / n
            x[1 + wide : 9 + wide] = (
                np.log1p(n), sz.mean(), sz.std(), np.log1p(sz.max()), len(many) / n, many.max() / n, same[a + 1 : b].sum() / n, len(np.unique(s[a : b - k + 1])) / (n - k + 1) if n >= k else 1.0,
            )
            x[12 + wide] = -(p * np.log(p)).sum() / np.log(n + 1)
        c, d = int(line_of[i]), int(line_of[i + 1])
        if d > c:
            x[9 + wide : 12 + wide] = np.log1p(d - c), np.log1p((ends[c:d] - lines[c:d]).mean()), len(np.unique(line_h[c:d])) / (d - c)
    return out


class Trees:
    """Complete binary trees in arrays: node j's children are 2j + 1 and 2j + 2, leaves come last."""

    def __init__(self, start: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.start, self.feature, self.threshold, self.leaf = start, feature, threshold, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Boosted trees on logistic loss from binned statistics."""
    n, width = x.shape if len(x) else (0, len(FEATURES))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    share = (y.sum() + 1) / (n + 2)
    start = float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return Trees(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(width) * BINS
    total, out = np.full(n, start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            shape = (many, width, BINS)
            g, h, c = (np.bincount(cell, np.repeat(v, width), many * width * BINS).reshape(shape).cumsum(axis=2) for v in (grad, hess, np.ones(n)))
            gt, ht, ct = g[:, :1, -1:], h[:, :1, -1:], c[:, :1, -1:]
            gain = g**2 / (h + RIDGE) + (gt - g) ** 2 / (ht - h + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(c < LEAST_ROWS) | (ct - c < LEAST_ROWS)] = -1
            gain[:, :, -1] = -1
            best = gain.reshape(many, -1).argmax(axis=1)
            for j in range(many):
                f, b = divmod(int(best[j]), BINS)
                if gain[j, f, b] > 1e-9 and b < len(edges[f]):
                    feature[first + j], threshold[first + j] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf_of = node - inner
        g, h = np.bincount(leaf_of, grad, leaves), np.bincount(leaf_of, hess, leaves)
        leaf = -RATE * g / (h + RIDGE)
        total = total + leaf[leaf_of]
        out.append((feature, threshold, leaf))
    return Trees(start, *(np.stack(z) for z in zip(*out, strict=True)))


def _fit_rows(batches):
    for batch in batches:
        x = [statistics(part) for part in tb.parts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(np.concatenate(x)) if x else [], pa.list_(pa.float64()))], names=["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Trees:
    rows = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    rows = rows.filter(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # bounded, so it may be broadcast
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    # a document that repeats is fitted once, and of several texts of an id the smallest, so that fit_rows bounds what comes to the driver
    train = train.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = mapped(train.select("y", "text"), _fit_rows, "y int, x array<double>").toArrow()
    y = got["y"].to_numpy().astype(float)
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if len(y) else np.empty((0, len(FEATURES)))
    order = np.lexsort((*x.T, y)) if len(y) else np.empty(0, np.int64)  # whatever order the rows come in
    return fit_trees(x[order], y[order])


def _score(trees):
    def run(batches):
        for batch in batches:
            score = [trees.value.score(statistics(part)) for part in tb.parts(batch.column(2))]
            score = np.concatenate(score) if score else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    trees = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of(F.col("doc_id").cast("long"), FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string"))
    return mapped(rows, _score(trees), "doc_id long, held_out boolean, score double, predicted int")


def good_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    trees = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows))

    def good(texts):
        keep = [trees.value.score(statistics(part)) >= THRESHOLD for part in tb.parts(texts)]
        return np.concatenate(keep) if keep else np.empty(0, bool)

    return rows_where(docs, good)
