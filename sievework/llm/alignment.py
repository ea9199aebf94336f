"""How the tokens of two tokenizers align, by a dictionary of groups.

A is a byte-level BPE that reads a blank and the text, B a piece model that
puts the blank in itself. Byte offsets where a token of both ends cut their
tokens into groups; tokens of a group that end together are linked, which
within a group only its last ones do, as no token is empty.

Texts are cut before a blank that follows no white space. Neither tokenizer
joins bytes over such a place (A's pattern takes a blank with what follows, and
no piece of B has one behind another character), so each distinct piece is
encoded and aligned once by a Python worker, up to ``KNOWN_PIECES``; a document
is then a row of piece numbers.

Groups are interned: a task hands on each distinct group (ids of A, ids of B)
once, with how often it came. Spark adds these up, expands a group's links once
whatever its frequency, counts id pairs by frequency, finds the highest count of
each B id, and sums links, counts and best links for each group. Documents get
these sums back by group key: from sorted arrays, broadcast while there are
``BROADCAST_GROUPS`` distinct groups at most, or else by a shuffled join of
each document's distinct groups, with the same result. Keys are 64-bit hashes
of both id rows.

Null and empty texts, and those whose joined token bytes of A or B differ from
blank and text, have no tokens: zeros and an empty digest. Strings of special
tokens are plain text. Rows that repeat are counted and reported each; ties for
the highest count are all best. A very long text is a slice of its own. An empty
table gives no rows. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbits as tb
from .common import cut, few, mapped

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICE_BYTES = 1 << 20
#: Pieces that a Python worker remembers, some 200 bytes each.
KNOWN_PIECES = 600_000
#: Pieces that are encoded at a time.
_PIECES = 4_096
#: Distinct groups that may be broadcast, 24 bytes each.
BROADCAST_GROUPS = 2_000_000
BROADCAST_PAIRS = 500_000
SALTS = 16
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
#: White space beyond ASCII, after which a text isn't cut either.
_WIDE_BLANK = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_BLANK_PIECE = "▁"


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, and the bytes of each of their ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        byte = _byte_of_character()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK_PIECE, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in many], np.int64) for many in (self.bytes_a, self.bytes_b))
        self.blank = [self.b.piece_to_id(_BLANK_PIECE)]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B of texts that begin with a blank; B puts it in itself, but not before nothing."""
        a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        return a, [ids if len(t) > 1 else self.blank for t, ids in zip(texts, b, strict=True)]


def _key(ids: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each group's row of ids; groups begin at ``first``."""
    nth = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
    return tb.mix(np.add.reduceat(tb.mix(ids.astype(np.uint64) + (nth.astype(np.uint64) << np.uint64(32)) + np.uint64(salt)), first))


class Aligner:
    """The pieces that a worker knows, each by hash: numbers of tokens and groups, group keys, and the groups written out."""

    def __init__(self, path_a: str, path_b: str):
        self.t = Tokenizers(path_a, path_b)
        self.begin()

    def begin(self) -> None:
        self.hashes, self.number = np.empty(0, np.uint64), np.empty(0, np.int64)
        #: A row a piece: ids of A, ids of B, groups, and whether its bytes came back.
        self.facts = np.zeros((0, 4), np.int64)
        self.written: list[bytes] = []
        self.first, self.keys = np.zeros(1, np.int64), np.empty(0, np.uint64)
        self.groups: dict[int, tuple[list[int], list[int], bytes]] = {}
        self.times = np.zeros(0, np.int64)
        #: Count of links and best links of each piece, filled in as far as asked for.
        self.worth, self.worth_of = np.zeros((0, 2), np.int64), None

    def _comes_back(self, pieces: list[bytes], a: list[list[int]], b: list[list[int]]) -> list[bool]:
        """Whether the bytes of A's and of B's tokens are the piece: of all at once if they are, else one by one."""
        whole, sizes = b"".join(pieces), list(map(len, pieces))
        for ids, of, size in ((a, self.t.bytes_a, self.t.size_a), (b, self.t.bytes_b, self.t.size_b)):
            flat = list(chain.from_iterable(ids))
            ends = np.concatenate([[0], np.cumsum(size[flat])])[np.cumsum(list(map(len, ids)))]
            if b"".join([of[i] for i in flat]) != whole or ends.tolist() != np.cumsum(sizes).tolist():
                return [b"".join([self.t.bytes_a[i] for i in x]) == p == b"".join([self.t.bytes_b[i] for i in y]) for p, x, y in zip(pieces, a, b, strict=True)]
        return [True] * len(pieces)

    def _learn(self, pieces: list[bytes]) -> None:
        a, b = self.t.encode([p.decode() for p in pieces])
        ok = self._comes_back(pieces, a, b)
        a, b = ([x if good else [] for x, good in zip(ids, ok, strict=True)] for ids in (a, b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (a, b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a, b))
        ends_a, ends_b = np.cumsum(self.t.size_a[flat_a]), np.cumsum(self.t.size_b[flat_b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, both), np.searchsorted(ends_b, both)
        first_a, first_b = (np.concatenate([[0], last[:-1] + 1]).astype(np.int64)[: len(both)] for last in (last_a, last_b))
        piece_ends = np.concatenate([[0], np.cumsum(np.where(ok, [len(p) for p in pieces], 0))])
        group_of = np.searchsorted(both, piece_ends, "right")
        keys = tb.mix(_key(flat_a, first_a, 1) * np.uint64(3) + _key(flat_b, first_b, 2)) if len(both) else np.empty(0, np.uint64)
        distinct, at, back = np.unique(keys, return_index=True, return_inverse=True)
        for key, k in zip(distinct.tolist(), at.tolist(), strict=True):  # each group is taken apart and written out once
            if key not in self.groups:
                ids = flat_a[first_a[k] : last_a[k] + 1].tolist(), flat_b[first_b[k] : last_b[k] + 1].tolist()
                self.groups[key] = (*ids, f"{','.join(map(str, ids[0]))}|{','.join(map(str, ids[1]))}".encode())
        some = [self.groups[key][2] for key in distinct.tolist()]
        one = [some[j] for j in back.tolist()]
        self.written += [b";".join(one[i:j]) for i, j in zip(group_of[:-1].tolist(), group_of[1:].tolist(), strict=True)]
        self.facts = np.concatenate([self.facts, np.stack([n_a, n_b, np.diff(group_of), np.array(ok, np.int64)], axis=1)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.diff(group_of))])
        self.keys = np.concatenate([self.keys, keys])

    def pieces(self, part: tb.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts of a slice (as it is), and where each text's begin and end."""
        size = np.diff(part.offsets)
        buf = np.empty(len(part.raw) + part.n, np.uint8)
        first = np.concatenate([[0], np.cumsum(size + 1)])
        led = np.zeros(len(buf), bool)
        led[first[:-1]] = True
        buf[led], buf[~led] = 0x20, part.raw
        blank = _BLANK[buf]
        raw = buf.tobytes()
        if len(raw) and (buf >= 0x80).any():
            for m in _WIDE_BLANK.finditer(raw):
                blank[m.end() - 1] = True
        cuts = (buf == 0x20) & ~np.concatenate([[True], blank[:-1]]) | led
        starts = np.flatnonzero(cuts)
        ends = np.append(starts[1:], len(buf))
        bounds = np.searchsorted(starts, first)
        distinct, where, back = np.unique(tb.word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            n = len(self.hashes)
            self.hashes, self.number = np.insert(self.hashes, at[new], distinct[new]), np.insert(self.number, at[new], np.arange(n, n + len(new)))
            for lo in range(0, len(new), _PIECES):
                some = where[new[lo : lo + _PIECES]]
                self._learn([raw[i:j] for i, j in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
        return self.number[np.searchsorted(self.hashes, distinct)][back], bounds

    def count(self, numbers: np.ndarray, bounds: np.ndarray, whole: np.ndarray) -> None:
        """Count the pieces of texts that have tokens."""
        if len(self.times) < len(self.facts):
            self.times = np.concatenate([self.times, np.zeros(len(self.facts) - len(self.times), np.int64)])
        np.add.at(self.times, numbers[np.repeat(whole, np.diff(bounds))], 1)

    def counted(self) -> tuple[list[int], np.ndarray]:
        """Keys of the groups of all counted pieces, and how often each came; counting begins anew."""
        times = np.concatenate([self.times, np.zeros(len(self.facts) - len(self.times), np.int64)])
        distinct, back = np.unique(self.keys, return_inverse=True)
        n = np.zeros(len(distinct), np.int64)
        np.add.at(n, back, np.repeat(times, np.diff(self.first)))
        self.times = np.zeros(0, np.int64)
        return distinct[n > 0].tolist(), n[n > 0]

    def valued(self, table: Groups) -> np.ndarray:
        """Sum of counts and number of best links of each known piece, by a table of groups."""
        if self.worth_of != table.name:
            self.worth, self.worth_of = np.zeros((0, 2), np.int64), table.name
        n = len(self.worth)
        if n < len(self.facts):
            values = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(table.find(self.keys[self.first[n] :]), axis=0)])
            at = self.first[n:] - self.first[n]
            self.worth = np.concatenate([self.worth, values[at[1:]] - values[at[:-1]]])
        return self.worth


class Groups:
    """Sum of counts and number of best links by group key, keys ascending; the name tells a worker whether it has looked things up in it."""

    def __init__(self, t: pa.Table):
        self.name = uuid.uuid4().hex
        keys = tb.unsigned(t["key"].to_numpy())
        by = np.argsort(keys)
        self.keys = keys[by]
        self.values = np.stack([t["count_sum"].to_numpy(), t["n_best"].to_numpy()], axis=1).astype(np.int64)[by]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of each key; 0 of groups that only texts without tokens have, or texts of another corpus."""
        out = np.zeros((len(keys), 2), np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            same = self.keys[at] == keys
            out[same] = self.values[at[same]]
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner_of(path_a: str, path_b: str) -> Aligner:
    """The aligner of this Python worker, which later tasks find with what it has learnt."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _sums(per_piece: np.ndarray, numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    upto = np.concatenate([np.zeros((1, per_piece.shape[1]), np.int64), np.cumsum(per_piece[numbers], axis=0)])
    return upto[bounds[1:]] - upto[bounds[:-1]]


def _whole(aligner: Aligner, part: tb.Slice, numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Facts of each text, and whether it has tokens."""
    facts = _sums(aligner.facts, numbers, bounds)
    return facts, (facts[:, 3] == np.diff(bounds)) & (np.diff(part.offsets) > 0)


def _group_counts(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = aligner.counted()
            for lo in range(0, len(keys), 20_000):
                some = keys[lo : lo + 20_000]
                a, b, _ = zip(*(aligner.groups[k] for k in some), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(tb.signed(np.array(some, np.uint64))), pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.int32())), pa.array(n[lo : lo + 20_000])], names=["key", "a", "b", "n"])

        aligner.times = np.zeros(0, np.int64)  # of a task that broke off
        for batch in batches:
            for part in tb.parts(batch.column(0), SLICE_BYTES, tb.AS_IT_IS):
                if len(aligner.facts) > KNOWN_PIECES:
                    yield from out()
                    aligner.begin()
                numbers, bounds = aligner.pieces(part)
                aligner.count(numbers, bounds, _whole(aligner, part, numbers, bounds)[1])
        yield from out()

    return run


_ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _aligned(path_a: str, path_b: str, table):
    """``_ROW`` with n_best and count_sum by a broadcast table; without one, with each text's distinct group keys and their times."""
    names = [c.split()[0] for c in _ROW.split(", ")] + (["count_sum", "n_best"] if table else ["keys", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)
        for batch in batches:
            for part in tb.parts(batch.column(1), SLICE_BYTES, tb.AS_IT_IS):
                if len(aligner.facts) > KNOWN_PIECES:
                    aligner.begin()
                numbers, bounds = aligner.pieces(part)
                facts, whole = _whole(aligner, part, numbers, bounds)
                facts[~whole] = 0
                digests, nth = [], numbers.tolist()
                for i, good in enumerate(whole.tolist()):
                    written = b";".join([aligner.written[k] for k in nth[bounds[i] : bounds[i + 1]]]) if good else b""
                    digests.append(hashlib.sha256(written).hexdigest() if good else "")
                if table:
                    worth = _sums(aligner.valued(table.value), numbers, bounds)
                    worth[~whole] = 0
                    rest = [pa.array(worth[:, 0]), pa.array(worth[:, 1])]
                else:
                    own = []
                    for i, good in enumerate(whole.tolist()):
                        some = numbers[bounds[i] : bounds[i + 1]] if good else numbers[:0]
                        many = (aligner.first[some + 1] - aligner.first[some]) if len(some) else some
                        at = np.repeat(aligner.first[some], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                        own.append(np.unique(aligner.keys[at], return_counts=True))
                    rest = [pa.array([tb.signed(k) for k, _ in own], pa.list_(pa.int64())), pa.array([n for _, n in own], pa.list_(pa.int64()))]
                columns = [pa.array(facts[:, 0]), pa.array(facts[:, 1]), pa.array(facts[:, 2]), pa.array(facts[:, 2]), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.at, part.n), *columns, *rest], names=names)

    return run


def group_dictionary(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """key, a, b (rows of ids), n: a row a distinct group of the corpus, with how often it comes."""
    found = mapped(docs.select(F.col("text").cast("string")), _group_counts(path_a, path_b), "key long, a array<int>, b array<int>, n long")
    return found.groupBy("key").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.sum("n").alias("n"))


def links(groups: DataFrame) -> DataFrame:
    """key, a, b, n: the linked ids of each group; of tokens that aren't empty only the last ones of a group end together."""
    return groups.select("key", F.element_at("a", -1).alias("a"), F.element_at("b", -1).alias("b"), "n")


def pair_counts(linked: DataFrame) -> DataFrame:
    """a, b, count, best: a row an id pair, and whether its count is the highest of its B id."""
    pairs = linked.groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = pairs.groupBy("b").agg(F.max("count").alias("most"))
    return pairs.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def group_sums(groups: DataFrame) -> DataFrame:
    """key, count_sum, n_best: what a document gets for each time that it has the group."""
    linked = links(groups)
    pairs = cut(pair_counts(linked))
    return linked.join(few(pairs, BROADCAST_PAIRS), ["a", "b"]).groupBy("key").agg(F.sum("count").alias("count_sum"), F.count_if("best").alias("n_best"))


def align(docs: DataFrame, path_a: str, path_b: str, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of ``docs``."""
    spark = docs.sparkSession
    groups = cut(group_dictionary(docs, path_a, path_b))
    sums = cut(group_sums(groups))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    if sums.count() <= broadcast_groups:
        held = spark.sparkContext.broadcast(Groups(sums.toArrow()))
        rows = mapped(texts, _aligned(path_a, path_b, held), f"{_ROW}, count_sum long, n_best long")
    else:
        every = cut(mapped(texts, _aligned(path_a, path_b, None), f"{_ROW}, keys array<long>, times array<long>").withColumn("row", F.monotonically_increasing_id()))
        own = every.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
        salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")  # a group that most documents have goes to several tasks
        spread = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = own.withColumn("salt", salt).join(spread, ["key", "salt"])
        total = found.groupBy("row").agg(F.sum(F.col("times") * F.col("count_sum")).alias("count_sum"), F.sum(F.col("times") * F.col("n_best")).alias("n_best"))
        rows = every.drop("keys", "times").join(total, "row", "left").fillna(0, ["count_sum", "n_best"])
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
