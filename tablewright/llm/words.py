"""Vectorised words, lines and word n-grams of whole text columns (numpy inside Arrow tasks).

A word is a longest run of characters other than the six ASCII white-space characters (space and 0x09 to 0x0D). Work is
done on the UTF-8 bytes of a slice of rows at a time, so memory follows the slice (and the longest single text), not the
Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)                      # odd, so it has an inverse modulo 2^64
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Slice:
    """The texts of rows ``first`` to ``last`` of an Arrow column: bytes ``buf``, and row ``i`` is ``buf[at[i]:at[i + 1]]``."""

    def __init__(self, buf: np.ndarray, at: np.ndarray, first: int, last: int):
        self.buf, self.at, self.first, self.last = buf, at, first, last
        self.rows = last - first
        solid = ~_SPACE[buf]
        before = np.empty_like(solid)
        before[:1], before[1:] = False, solid[:-1]
        before[at[:-1][at[:-1] < len(buf)]] = False                     # a word never crosses two texts
        self.begin = np.flatnonzero(solid & ~before)
        after = np.empty_like(solid)
        after[-1:], after[:-1] = False, solid[1:]
        ends = at[1:][at[1:] > 0]
        after[ends - 1] = False
        self.end = np.flatnonzero(solid & ~after) + 1
        self.solid = solid
        self.row = self.row_of(self.begin)
        self._sums = self._back = None

    def row_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, position, side="right") - 1

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes with a flag each row has."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.at[1:]] - total[self.at[:-1]]

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges, equal for equal bytes wherever they stand."""
        if self._sums is None:
            n = len(self.buf)
            power = np.full(n, _BASE, dtype=np.uint64)
            power[:1] = 1
            np.multiply.accumulate(power, out=power)
            self._sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTES[self.buf] * power, out=self._sums[1:])
            self._back = np.full(n + 1, _BACK, dtype=np.uint64)
            self._back[0] = 1
            np.multiply.accumulate(self._back, out=self._back)
        value = (self._sums[end] - self._sums[begin]) * self._back[begin]
        return mix(value + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.begin, self.end)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of ``size`` words inside one text."""
        words = self.word_hashes()
        if len(words) < size:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        n = len(words) - size + 1
        value = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            value = (value + words[k:k + n]) * np.uint64(0x2545F4914F6CDD1D)
        first = np.flatnonzero(self.row[:n] == self.row[size - 1:])
        return first, mix(value[first])


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The rows of a string column in order, some at a time; null texts are empty. Every row is in exactly one slice."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + n + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(at, at[first] + most, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield Slice(buf[at[first]:at[last]], at[first:last + 1] - at[first], first, last)
        first = last


def first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """Where, in arrays sorted together, a new combination of keys begins."""
    n = len(keys[0])
    new = np.ones(n, dtype=bool)
    if n:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new
