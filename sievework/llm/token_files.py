"""Token ids as Parquet list columns that allow selective reads.

Documents are dealt to files by ranges of doc_id and encoded where they land,
so that files in order of their part number, and rows in order within, hold all
ids in ascending doc_id order. Each row has its place within the part, so a
reader that wants positions reads two narrow columns and never the ids.

The format: one row a document; ``tokens`` is a list of 32-bit ids, dictionary
encoded (the default, as a vocabulary is small) or delta encoded (``delta``:
page format 2 without dictionary); row groups and pages have set sizes; each
file carries column and page indexes, and rows are sorted by doc_id, so a read
of an id range opens only the row groups and pages that hold it.

Whole texts are encoded. Texts are cut at white space, which the tokenizer
drops, and between ASCII characters of two kinds, where its pattern never joins
them, and each distinct piece is encoded once by a Python worker; a piece keeps
its ids wherever it stands. A-Z are lower-cased first, as the tokenizer does so
to all letters. Null and empty texts give the end id alone. A very long text is
a slice of its own; its size bounds a task's memory, as files are cut by bytes.
Rows that repeat a doc_id keep their own places, in the order of their texts'
hashes (the range sampling reads texts for that: ties must not hang on the order
rows come in); a null doc_id comes first. Rows equal in both are the same and
may lie in any order. Extra columns, whatever their names, are not written. An
empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textbits as tb
from .common import mapped, shared_folder

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
#: Bytes of text that a file holds on average.
FILE_BYTES = 32 << 20
#: Pieces that are encoded at a time.
_PIECES = 2_048
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 512 << 10
#: Pieces that a Python worker remembers, about 40 bytes each.
KNOWN_PIECES = 800_000
#: Kinds of ASCII characters: letter 1, digit 2, mark 3, apostrophe 4; white space and other bytes 0.
_KIND = np.zeros(256, np.uint8)
_KIND[: 0x80][tb.NOT_SPACE[: 0x80]] = 3
_KIND[list(b"abcdefghijklmnopqrstuvwxyz")], _KIND[list(b"0123456789")], _KIND[list(b"'")] = 1, 2, 4
#: Whether the tokenizer's pattern always parts a character of one kind from the next of another: a digit stands alone, a letter ends
#: before a mark or an apostrophe, a mark before a letter (an apostrophe may open 's and its like).
_PARTS = np.zeros((5, 5), bool)
_PARTS[2, 1:] = _PARTS[1:, 2] = True
_PARTS[1, [3, 4]] = _PARTS[3, 1] = True
#: Pieces with special tokens, or white space beyond ASCII that the tokenizer may treat in its own way, are encoded with the text around them.
_ODD = re.compile(rb"<\||\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2[\x80\x81]|\xe3\x80\x80|[\x1c-\x1f]")
_ROW = "part int, doc_id long, place long, n_tokens int, tokens array<int>"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes the texts of a slice; a table of pieces, which grows without being sorted anew, keeps what is known."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._begin()

    def _begin(self) -> None:
        #: Ascending hashes of known pieces and the number of each, by which its ids are found.
        self.hashes, self.number = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.start, self.ids = np.zeros(1 << 12, np.int64), np.empty(1 << 14, np.int32)

    def _learn(self, h: np.ndarray, raw: bytes, a: np.ndarray, b: np.ndarray) -> None:
        """Put pieces (by hash, ascending) that are not known yet into the table."""
        first = len(self.hashes)
        at = np.searchsorted(self.hashes, h)
        self.hashes, self.number = np.insert(self.hashes, at, h), np.insert(self.number, at, np.arange(first, first + len(h), dtype=np.int32))
        while len(self.start) <= len(self.hashes):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        for lo in range(0, len(a), _PIECES):  # an encoding holds far more than its ids
            pieces = [raw[i:j].decode() for i, j in zip(a[lo : lo + _PIECES].tolist(), b[lo : lo + _PIECES].tolist(), strict=True)]
            got = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            k, done = first + lo, self.start[first + lo]
            ends = done + np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))
            self.start[k + 1 : k + 1 + len(got)] = ends
            while len(self.ids) < ends[-1]:
                self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
            self.ids[done : ends[-1]] = list(chain.from_iterable(got))

    def encode(self, part: tb.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text's ids), each text closed by the end id."""
        part.words(tb.NOT_SPACE)
        kind = _KIND[part.buf]
        cut = np.flatnonzero(_PARTS.ravel()[kind[:-1] * np.uint8(5) + kind[1:]]) + 1
        starts, ends = np.concatenate([part.starts, cut]), np.concatenate([part.ends, cut])
        starts.sort(kind="stable"), ends.sort(kind="stable")
        part.starts, part.ends = starts, ends
        part.w = np.searchsorted(starts, np.concatenate([part.first, [len(part.buf)]]))
        distinct, where, back = np.unique(part.hashes(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        fresh = np.ones(len(distinct), bool)
        inside = at < len(self.hashes)
        fresh[inside] = self.hashes[at[inside]] != distinct[inside]
        if fresh.any():
            if len(self.hashes) > KNOWN_PIECES:
                self._begin()
                fresh[:] = True
            self._learn(distinct[fresh], part.buf.tobytes(), starts[where[fresh]], ends[where[fresh]])
            at = np.searchsorted(self.hashes, distinct)
        number = self.number[at]
        from_, long = self.start[number][back], (self.start[number + 1] - self.start[number])[back]
        # each text's pieces, then its end id
        upto = np.concatenate([[0], np.cumsum(long)])
        text_ends = upto[part.w[1:]] + np.arange(1, part.n + 1)
        out = np.full(int(text_ends[-1]) if part.n else 0, END_ID, np.int32)
        to = upto[:-1] + np.repeat(np.arange(part.n), np.diff(part.w))
        for k in range(int(long.max(initial=0))):  # the k-th id of all pieces that have as many
            more = long > k if k else slice(None)
            if k and not more.any():
                break
            if k == 0 and long.min(initial=1) == 0:
                more = long > 0
            out[to[more] + k] = self.ids[from_[more] + k]
        return out, text_ends

    def encode_odd(self, text: str) -> np.ndarray:
        return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END_ID], np.int32)


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of this Python worker, which later tasks find with what it has learnt."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encode(path: str):
    def run(batches):
        encoder, place = encoder_of(path), 0
        for batch in batches:
            texts = batch.column(2)
            for part in tb.parts(texts, SLICE_BYTES):
                ids, ends = encoder.encode(part)
                if _ODD.search(part.raw.tobytes()):
                    rows = np.split(ids, ends[:-1])
                    for i in range(part.n):
                        raw = part.raw[part.offsets[i] - part.offsets[0] : part.offsets[i + 1] - part.offsets[0]].tobytes()
                        if _ODD.search(raw):
                            rows[i] = encoder.encode_odd(raw.decode())
                    ids, ends = np.concatenate(rows), np.cumsum([len(x) for x in rows])
                size = np.diff(ends, prepend=0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.at, part.n),
                        batch.column(1).slice(part.at, part.n),
                        pa.array(place + ends - size, pa.int64()),
                        pa.array(size, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids)),
                    ],
                    names=["part", "doc_id", "place", "n_tokens", "tokens"],
                )
                place += int(ends[-1])

    return run


def encode_documents(docs: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """part, doc_id, place, n_tokens, tokens: ranges of doc_id a part, ascending within."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // file_bytes))
    rows = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    return mapped(rows.select(F.spark_partition_id().alias("part"), "doc_id", "text"), _encode(path), _ROW)


def write_tokens(tokens: DataFrame, folder: str, delta: bool = False) -> None:
    writer = (
        tokens.write.mode("overwrite")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.enable.dictionary", str(not delta).lower())
        .option("compression", "zstd" if delta else "snappy")
    )
    if delta:
        writer = writer.option("parquet.writer.version", "PARQUET_2_0")
    writer.parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_ROW).parquet(folder)


def positions(files: DataFrame) -> DataFrame:
    """part, start: ids in all parts before. Reads no ids; a row a file."""
    sums = files.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("ids"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))


def _sums(batches):
    for batch in batches:
        tokens = batch.column(3)
        off = tokens.offsets.to_numpy()
        ids = np.ascontiguousarray(tokens.values.to_numpy(), "<u4")
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(crc, pa.int64())], names=["part", "doc_id", "place", "n_tokens", "ids_crc32"])


def token_report(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row of the files."""
    rows = mapped(files.select("part", "doc_id", "place", "tokens", "n_tokens"), _sums, "part int, doc_id long, place long, n_tokens int, ids_crc32 long")
    return rows.join(positions(files), "part").select(
        "doc_id", (F.col("before") + F.col("place")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32"
    )


def tokenized(docs: DataFrame, path: str, folder: str | None = None, delta: bool = False) -> DataFrame:
    """Encode, write to ``folder`` (a new one beside the checkpoints by default) and read back."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(encode_documents(docs, path), folder, delta)
    return read_tokens(spark, folder)
