"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of 13 consecutive words of benchmark items (a shorter
item is one window). Patterns of one length m share a shift table over blocks
of two words, which says how far a cursor may jump on because no pattern ends
before; where the shift is zero, the bucket of that block's hash names the
patterns that end in it, and a direct comparison of all m words confirms an
occurrence. A document's words are cut into stretches with a cursor each, and
all cursors of a slice move at once.

The benchmark travels to the tasks in blocks of bounded bytes, one after the
other: a block is compiled, sent, scanned for, and let go before the next one
comes to the driver. Only documents with hits leave a row; hits of several
blocks are united per document.

Null and empty texts have no words and no hits. Items without words have no
window, items without id are left out. Documents that repeat are judged row by
row; rows of the benchmark that repeat go before it is cut into blocks, and equal
item_ids count once, whatever the number of their texts. Windows
that several items share name all of them. Overlapping occurrences hit a word
once. A very long text is a slice of its own, cut into stretches. An empty
benchmark marks nothing, an empty table gives no rows. Extra columns, whatever
their names, are not read; ``clean_documents`` keeps them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textbits as tb
from .common import cut, few, fresh, mapped, rows_where

WINDOW = 13
#: Bytes of benchmark text that one scan carries; compiled they take about ten times as much.
BLOCK_BYTES = 4 << 20
#: Documents with hits that may be broadcast.
BROADCAST_ROWS = 500_000
#: Occurrences whose bytes are compared at once.
_COMPARED = 20_000
_STRETCH = 512
_TABLE_BITS = 18
_RANGE_BITS = 12


def _block_hash(h: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words that end at ``end`` (inclusive)."""
    x = h[end]
    if width == 2:
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[end - 1]
    return (tb.mix(x) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


class Words:
    """The words of some texts: hashes, sizes, and their bytes end to end, word i's from ``place[i]``."""

    def __init__(self, part: tb.Slice):
        part.words(tb.ALNUM)
        self.hash, self.w, self.size = part.hashes(), part.w, part.ends - part.starts
        self.place = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = part.buf[tb.ALNUM[part.buf]]


class Patterns:
    """All distinct windows of one length: a shift table, suffix buckets, and the words to compare.

    ``at`` is the first word of each window in ``words``; window k's items are ``item[held[k]:held[k + 1]]``.
    """

    def __init__(self, words: Words, m: int, at: np.ndarray, item: np.ndarray):
        self.words, self.m, self.width = words, m, min(2, m)
        mixed = np.zeros(len(at), np.uint64)
        for k in range(m):
            mixed = tb.mix(mixed + words.hash[at + k])
        order = np.lexsort((item, mixed))
        at, item, mixed = at[order], item[order], mixed[order]
        new = np.ones(len(at), bool)
        new[1:] = mixed[1:] != mixed[:-1]
        for k in range(m):  # windows of one hash with other words stay apart
            new[1:] |= words.hash[at[1:] + k] != words.hash[at[:-1] + k]
        self.at, self.item, self.held = at[new], item, np.concatenate([np.flatnonzero(new), [len(at)]])
        jump = m - self.width + 1
        self.shift = np.full(1 << _TABLE_BITS, jump, np.int32)
        for end in range(self.width - 1, m):
            np.minimum.at(self.shift, _block_hash(words.hash, self.at + end, self.width), m - 1 - end)
        suffix = _block_hash(words.hash, self.at + m - 1, self.width)
        self.ids = np.argsort(suffix, kind="stable")
        self.bucket = np.searchsorted(suffix[self.ids], np.arange((1 << _TABLE_BITS) + 1))

    def _same(self, text: Words, end: np.ndarray, pattern: np.ndarray) -> np.ndarray:
        """Whether the windows that end at ``end`` are the patterns, word by word and then byte by byte."""
        same, at = np.ones(len(end), bool), self.at[pattern]
        for k in range(self.m):
            i, j = end - self.m + 1 + k, at + k
            same &= (text.hash[i] == self.words.hash[j]) & (text.size[i] == self.words.size[j])
        kept = np.flatnonzero(same)
        for lo in range(0, len(kept), _COMPARED):
            some = kept[lo : lo + _COMPARED]
            a, b = text.place[end[some] - self.m + 1], self.words.place[at[some]]
            size = text.place[end[some] + 1] - a
            upto = np.cumsum(size) - size
            nth = np.arange(int(size.sum())) - np.repeat(upto, size)
            equal = text.bytes[np.repeat(a, size) + nth] == self.words.bytes[np.repeat(b, size) + nth]
            same[some] = np.logical_and.reduceat(equal, upto)
        return same

    def find(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """(start word, pattern) of every occurrence in the texts."""
        m, h, w = self.m, text.hash, text.w
        first, last = w[:-1] + m - 1, w[1:]  # ends of windows
        many = np.maximum(0, -(-(last - first) // _STRETCH))
        doc = np.repeat(np.arange(len(many)), many)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        at = first[doc] + nth * _STRETCH
        stop = np.minimum(at + _STRETCH, last[doc])
        starts, found = [], []
        while len(at):
            block = _block_hash(h, at, self.width)
            shift = self.shift[block]
            hit = shift == 0
            if hit.any():
                end, block = at[hit], block[hit]
                many = self.bucket[block + 1] - self.bucket[block]
                end = np.repeat(end, many)
                nth = np.arange(len(end)) - np.repeat(np.cumsum(many) - many, many)
                pattern = self.ids[np.repeat(self.bucket[block], many) + nth]
                same = self._same(text, end, pattern)
                starts.append(end[same] - m + 1), found.append(pattern[same])
            at = at + np.maximum(shift, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not starts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(starts), np.concatenate(found)


def compile_patterns(items: list[tuple[int, str | None]], window: int = WINDOW) -> list[Patterns]:
    """The windows of the items, by their length."""
    by_length: dict[int, list[tuple[Words, np.ndarray, np.ndarray]]] = {}
    texts = pa.array([t for _, t in items], pa.string())
    for part in tb.parts(texts, 1 << 40):
        words, ids = Words(part), np.array([i for i, _ in items], np.int64)
        n = np.diff(words.w)
        m = np.minimum(window, n)
        many = np.where(n > 0, n - m + 1, 0)
        item = np.repeat(np.arange(part.n), many)
        at = words.w[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        for size in np.unique(m[n > 0]).tolist():
            of = m[item] == size
            by_length.setdefault(size, []).append((words, at[of], ids[item[of]]))
    return [Patterns(words, size, at, item) for size, some in sorted(by_length.items()) for words, at, item in some]


def scan(part: tb.Slice, patterns: list[Patterns]) -> list[tuple[int, np.ndarray, set[int]]]:
    """For each text of the slice: number of words, the words hit (ascending), the items found."""
    text = Words(part)
    w = text.w
    hit, items = np.zeros(len(text.hash) + 1, np.int32), [set() for _ in range(part.n)]
    for p in patterns:
        starts, found = p.find(text)
        np.add.at(hit, starts, 1)
        np.add.at(hit, starts + p.m, -1)
        for d, k in set(zip((np.searchsorted(w, starts, "right") - 1).tolist(), found.tolist(), strict=True)):
            items[d].update(p.item[p.held[k] : p.held[k + 1]].tolist())
    covered = np.cumsum(hit[:-1]) > 0
    return [(int(w[i + 1] - w[i]), np.flatnonzero(covered[w[i] : w[i + 1]]), items[i]) for i in range(part.n)]


def _judge(n_words: int, n_hit: int, items) -> tuple[int, int, int, str, bool]:
    names = ",".join(sorted(map(str, items)))
    return n_words, n_hit, len(items), hashlib.sha256(names.encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words


class Benchmark:
    """The distinct items, cut into blocks by running bytes. Any one block is compiled when it is asked for.

    Items are ordered by a hash of theirs; the bytes before each come from sums
    of ranges of hashes and running sums within a range. A block holds
    ``block_bytes`` and one item more at most.
    """

    def __init__(self, benchmark: DataFrame, block_bytes: int):
        items = benchmark.filter("item_id is not null and text is not null")
        self.items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
        total = self.items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.blocks = 1
        if total > block_bytes:
            sized = cut(self.items.withColumns({"hash": F.xxhash64("item_id", "text"), "bytes": F.octet_length("text").cast("long")}).withColumn("range", F.shiftrightunsigned("hash", 64 - _RANGE_BITS)))
            sums = sized.groupBy("range").agg(F.sum("bytes").alias("of_range"))
            earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
            before = sums.select("range", F.coalesce(F.sum("of_range").over(earlier(W.orderBy("range"))), F.lit(0)).alias("before"))  # a row a range
            within = F.coalesce(F.sum("bytes").over(earlier(W.partitionBy("range").orderBy("hash", "item_id"))), F.lit(0))
            placed = sized.withColumn("within", within).join(F.broadcast(before), "range")
            self.items = cut(placed.select("item_id", "text", F.floor((F.col("before") + F.col("within")) / block_bytes).alias("block")))
            self.blocks = self.items.agg(F.max("block")).first()[0] + 1

    def block(self, k: int) -> list[Patterns]:
        part = self.items if self.blocks == 1 else self.items.filter(F.col("block") == k)
        return compile_patterns([(r.item_id, r.text) for r in part.collect()])  # a block's bytes and one item at most


def _one_scan(patterns):
    def run(batches):
        p = patterns.value
        for batch in batches:
            rows = [_judge(n, len(hit), items) for part in tb.parts(batch.column(1)) for n, hit, items in scan(part, p)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return run


def _hits_scan(patterns):
    """row, words hit, items found, of the texts with any."""

    def run(batches):
        p = patterns.value
        for batch in batches:
            some = [x for part in tb.parts(batch.column(1)) for x in scan(part, p)]
            at = [i for i, x in enumerate(some) if len(x[1])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array([some[i][1] for i in at], pa.list_(pa.int64())),
                    pa.array([sorted(some[i][2]) for i in at], pa.list_(pa.int64())),
                ],
                names=["row", "hit", "items"],
            )

    return run


def _word_counts(batches):
    for batch in batches:
        n = [np.diff(Words(part).w) for part in tb.parts(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(n) if n else [], pa.int64())], names=["doc_id", "row", "n_words"])


_RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _row() -> Column:
    """128 bits of a row's id and text."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.coalesce(F.col("text").cast("string"), F.lit("")))))


def _of_blocks(docs: DataFrame, items: Benchmark) -> DataFrame:
    """row (128 bits of id and text) and _RESULT for each row of ``docs``, by a scan a block."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", _row())
    found = None
    for k in range(items.blocks):
        held = sc.broadcast(items.block(k))
        one = mapped(rows.select("row", "text"), _hits_scan(held), "row binary, hit array<long>, items array<long>").dropDuplicates(["row"])
        one = cut(one)  # this block's hits are written before the next block comes
        held.destroy()
        found = one if found is None else found.unionByName(one)
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))  # noqa: E731  # a row a block at most
    found = cut(found.groupBy("row").agg(F.size(union("hit")).cast("long").alias("n_hit"), union("items").alias("items")))
    counted = mapped(rows.select("doc_id", "row", "text"), _word_counts, "doc_id long, row binary, n_words long")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<long>"))
    names = F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ",")
    return counted.join(few(found, BROADCAST_ROWS), "row", "left").select(
        "row", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs`` (doc_id, text)."""
    items = Benchmark(benchmark, block_bytes)
    if items.blocks > 1:
        return _of_blocks(docs, items).drop("row")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return mapped(texts, _one_scan(docs.sparkSession.sparkContext.broadcast(items.block(0))), _RESULT)


def clean_documents(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    items = Benchmark(benchmark, block_bytes)
    if items.blocks > 1:  # hits of several blocks add up: judge them together first
        row = fresh(docs, "row")
        bad = cut(_of_blocks(docs, items).filter("contaminated").select(F.col("row").alias(row)).distinct())
        return docs.withColumn(row, _row()).join(few(bad, BROADCAST_ROWS), row, "left_anti").drop(row)
    held = docs.sparkSession.sparkContext.broadcast(items.block(0))

    def clean(texts):
        return [not _judge(n, len(hit), found)[4] for part in tb.parts(texts) for n, hit, found in scan(part, held.value)]

    return rows_where(docs, clean)
