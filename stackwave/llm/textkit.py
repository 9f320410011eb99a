"""Vectorised word kernels over Arrow string columns.

Everything here works on the UTF-8 buffers of an Arrow column with numpy, so a Python worker spends a few
nanoseconds a byte and no time in per-word Python code.  Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.

Nulls count as empty texts.  Texts are processed whole; a batch is cut into row slices of about ``SLICE_BYTES`` bytes
so that the temporaries stay bounded whatever the batch size is (one text longer than that is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: For terms without punctuation: every ASCII byte but letters and digits separates.
SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PRIME = 0x9E3779B97F4A7C15 | 1


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), elementwise."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_BYTE_LOWER = _BYTE[_LOWER]
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64; at least n of each."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = pow(_PRIME, -1, 1 << 64)
        for name, base in (("up", _PRIME), ("down", inverse)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
        if size > 8 * SLICE_BYTES:  # one very long text: its tables are not kept
            out = _powers.pop("up"), _powers.pop("down")
            return out
    return _powers["up"], _powers["down"]


def ragged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of all ranges, one range after the other."""
    size = end - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw, offs


def lowered(column: pa.Array) -> pa.Array:
    """The column in lower case, by Unicode; for terms that should match whatever their case."""
    return pc.utf8_lower(column)


def row_slices(offsets: np.ndarray, budget: int = SLICE_BYTES, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``budget`` bytes of text and at most ``rows`` rows."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + budget, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + rows)
        yield lo, hi
        lo = hi


class Words:
    """The words of a slice of rows: for each word its hash, row (from 0), and byte span inside ``raw``."""

    __slots__ = ("_sums", "ends", "first", "hash", "n_rows", "raw", "row", "starts")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, white: np.ndarray = _WHITE):
        n = self.n_rows = len(offsets) - 1
        base = int(offsets[0])
        self.raw = seg = raw[base : int(offsets[-1])]
        offs = offsets - base
        size = len(seg)
        if size == 0:
            none = np.zeros(0, np.int64)
            self.starts, self.ends, self.row, self.hash = none, none, none, np.zeros(0, np.uint64)
            self.first, self._sums = np.zeros(n + 1, np.int64), np.zeros(1, np.uint64)
            return
        white = white[seg]
        before = np.empty(size, bool)
        before[0] = True
        before[1:] = white[:-1]
        before[offs[:-1][offs[:-1] < size]] = True
        after = np.empty(size, bool)
        after[-1] = True
        after[:-1] = white[1:]
        after[offs[1:][offs[1:] > 0] - 1] = True
        black = ~white
        self.starts = np.flatnonzero(black & before)
        self.ends = np.flatnonzero(black & after) + 1
        self.row = np.searchsorted(offs[1:], self.starts, "right")
        self.first = np.searchsorted(self.starts, offs)
        up, down = _power(size + 1)
        v = _BYTE_LOWER[seg]
        v *= up[:size]
        sums = np.empty(size + 1, np.uint64)
        sums[0] = 0
        np.cumsum(v, out=sums[1:])
        h = sums[self.ends] - sums[self.starts]
        h *= down[self.starts]
        self.hash, self._sums = mix64(h), sums

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words longer than ``size`` bytes, and the hashes of their first ``size`` bytes as if words."""
        at = np.flatnonzero(self.ends - self.starts > size)
        start = self.starts[at]
        h = self._sums[start + size] - self._sums[start]
        h *= _power(len(self.raw) + 1)[1][start]
        return at, mix64(h)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def window_hashes(words: Words, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word windows in word order, and the n + 1 row offsets into them.

    With ``short``, a row of 1 to ``size - 1`` words has one hash, that of its whole sequence.
    """
    h, n = words.hash, len(words.hash)
    mult = np.uint64(0xA24BAED4963EE407)
    counts = words.counts
    full = np.maximum(counts - size + 1, 0)
    few = (counts > 0) & (counts < size) if short else np.zeros(len(counts), bool)
    offsets = np.concatenate([[0], np.cumsum(full + few)])
    out = np.empty(int(offsets[-1]), np.uint64)
    if n >= size:
        acc = h[: n - size + 1].copy()
        for j in range(1, size):
            acc *= mult
            acc += h[j : n - size + 1 + j]
        inside = words.row[: n - size + 1] == words.row[size - 1 :]
        target = np.repeat(offsets[:-1], full) + (np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full))
        out[target] = mix64(acc[inside])
    for r in np.flatnonzero(few):
        acc = np.uint64(counts[r])
        with np.errstate(over="ignore"):
            for x in h[words.first[r] : words.first[r + 1]]:
                acc = acc * mult + x
        out[offsets[r]] = mix64(np.array([acc ^ np.uint64(0x5851F42D4C957F2D)], np.uint64))[0]
    return out, offsets


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its ``size``-word shingles."""
    raw, offs = string_buffers(column)
    for lo, hi in row_slices(offs):
        hashes, at = window_hashes(Words(raw, offs[lo : hi + 1]), size)
        for r in range(hi - lo):
            s = np.sort(hashes[at[r] : at[r + 1]])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            yield s


class HashTable:
    """Membership of 64-bit hashes in a fixed set: a bit table rules most out before the binary search."""

    def __init__(self, hashes: np.ndarray):
        self.sorted, first = np.unique(hashes, return_index=True)
        self.order = first
        self.bits = max(12, int(len(self.sorted) * 16 - 1).bit_length()) if len(self.sorted) else 12
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.sorted >> np.uint64(64 - self.bits)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``hashes`` that are in the set, and the index of each in the array the set was made of."""
        at = np.flatnonzero(self.table[hashes >> np.uint64(64 - self.bits)])
        if not len(at) or not len(self.sorted):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        hit = self.sorted[k] == hashes[at]
        return at[hit], self.order[k[hit]]
