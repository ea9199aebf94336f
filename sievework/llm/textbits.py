"""Array views of many texts at once: words, word hashes and shingles.

The UTF-8 bytes of a slice of documents are laid end to end with a blank after
each document; words, their hashes and shingle hashes then come from whole
arrays, without a Python step per word. Lower-casing touches A-Z alone. The
slices are cut by bytes, so a task's memory does not depend on how many or how
long the documents of an Arrow batch are, save for one document's own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_HASH_SPAN = 1 << 20
SHINGLE = 5

_BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
AS_IT_IS = _BYTES
#: Words of the shingle and size contracts: runs without white space.
NOT_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Words of the phrase and benchmark contracts: letters, digits, non-ASCII.
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)

_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_PLACE = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, _HASH_SPAN + 1)
        out = []
        for b in (_BASE, _BASE_INV):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``buf[start:end]``, by spans of bounded size."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + _HASH_SPAN, "right")))
        at, to = int(starts[lo]), int(ends[hi - 1])
        up, down = _pow(to - at + 1)
        sums = np.empty(to - at + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE_CODE[buf[at:to]] * up[: to - at], out=sums[1:])
        s, e = starts[lo:hi] - at, ends[lo:hi] - at
        out[lo:hi] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


class Slice:
    """Some consecutive texts of a column: ``buf`` has their bytes as ``fold`` maps them, text i lies in ``buf[first[i]:last[i]]``."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, at: int, fold: np.ndarray = LOWER):
        n = len(offsets) - 1
        self.at, self.n, self.raw, self.offsets = at, n, raw, offsets
        sep = offsets[1:] - offsets[0] + np.arange(n)
        buf = np.empty(len(raw) + n, np.uint8)
        keep = np.ones(len(buf), bool)
        keep[sep] = False
        buf[keep] = fold[raw]
        buf[sep] = 0x20
        self.buf, self.last = buf, sep
        self.first = np.concatenate([[0], sep[:-1] + 1]).astype(np.int64)

    def words(self, kind: np.ndarray) -> None:
        """Set ``starts``, ``ends``, and ``w``: words w[i]:w[i+1] are text i's."""
        inside = np.zeros(len(self.buf) + 2, np.int8)
        inside[1:-1] = kind[self.buf]
        inside[1 + self.last] = 0  # nothing crosses from one text into the next
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.w = np.searchsorted(self.starts, np.concatenate([self.first, [len(self.buf)]]))

    def hashes(self) -> np.ndarray:
        return word_hashes(self.buf, self.starts, self.ends)

    def shingle_sets(self) -> Iterator[np.ndarray]:
        """Each text's sorted distinct shingle hashes; a shorter text's whole word sequence is its one shingle."""
        self.words(NOT_SPACE)
        h, k = self.hashes(), SHINGLE
        rows = len(h) - k + 1
        s = sum((h[j : rows + j] * _PLACE[j] for j in range(k)), start=np.uint64(0)) if rows > 0 else h[:0]
        s = mix(s) if rows > 0 else s
        for i in range(self.n):
            a, b = int(self.w[i]), int(self.w[i + 1])
            if b - a >= k:
                yield np.unique(s[a : b - k + 1])
            elif b > a:
                short = sum((h[a + j : a + j + 1] * _PLACE[j] for j in range(b - a)), start=_PLACE[7 + b - a])
                yield mix(short)
            else:
                yield h[:0]


def parts(column: pa.Array, at_most: int = SLICE_BYTES, fold: np.ndarray = LOWER) -> Iterator[Slice]:
    """The column's texts in order, cut into slices of about ``at_most`` bytes; a null text is empty. ``fold`` maps each byte: lower case, or ``AS_IT_IS``."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + at_most, "right")) - 1)
        hi = min(hi, len(column))
        yield Slice(data[off[lo] : off[hi]], off[lo : hi + 1], lo, fold)
        lo = hi


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(np.uint64)
