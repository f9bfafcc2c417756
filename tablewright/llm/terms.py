"""Lower-cased terms of whole text columns and their match with a given set of terms (numpy inside Arrow tasks).

A term is a longest run of ASCII letters, ASCII digits and characters beyond ASCII; only A to Z are lower-cased. A term is
known by 128 bits: a 64-bit hash of its bytes, and its first eight bytes as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import Slice, slices

_FOLD = np.full(256, 32, dtype=np.uint8)          # byte to lower-cased byte, all else to a space
for _low, _high in ((48, 57), (97, 122), (128, 255)):
    _FOLD[_low:_high + 1] = np.arange(_low, _high + 1)
_FOLD[65:91] = np.arange(97, 123)


def term_slices(column: pa.Array | pa.ChunkedArray) -> Iterator[Slice]:
    """Slices of the texts whose words are the terms; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return slices(column)
    folded = pa.py_buffer(_FOLD[np.frombuffer(data, dtype=np.uint8)])
    return slices(pa.LargeStringArray.from_buffers(len(column), offsets, folded, None, 0, column.offset))


def heads(part: Slice) -> np.ndarray:
    """The first eight bytes of every term, zeros behind a shorter one."""
    if not len(part.begin):
        return np.empty(0, dtype=np.uint64)
    padded = np.concatenate([part.buf, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(part.buf) + 1, dtype="<u8", buffer=padded, strides=(1,))
    unused = (np.maximum(0, 8 - (part.end - part.begin)) * 8).astype(np.uint64)
    return (eight[part.begin] << unused) >> unused


class Terms:
    """A sorted set of terms; ``find`` gives the place of each term of a slice in it, or -1."""

    def __init__(self, hashes: np.ndarray, firsts: np.ndarray):
        self.hashes, self.firsts = hashes, firsts      # sorted by hash; two terms of one hash stand side by side

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.hashes, hashes)
        found = np.full(len(hashes), -1)
        open_ = np.flatnonzero(at < len(self.hashes))
        while len(open_):
            open_ = open_[self.hashes[at[open_]] == hashes[open_]]
            same = self.firsts[at[open_]] == firsts[open_]
            found[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < len(self.hashes)]
        return found


def term_set(hashes: np.ndarray, firsts: np.ndarray) -> tuple[Terms, np.ndarray]:
    """The distinct ones of the given terms, and the place of each given one in it."""
    pairs = np.stack([hashes, firsts], axis=1)
    distinct, inverse = np.unique(pairs, axis=0, return_inverse=True)
    return Terms(distinct[:, 0].copy(), distinct[:, 1].copy()), inverse.ravel()


def batches_of(items: DataFrame, size, most: int) -> Iterator[DataFrame]:
    """The rows of ``items`` in batches whose ``size`` adds up to about ``most``, larger ones alone.

    Rows are dealt by a running total inside digest buckets; every row is in exactly one batch, and the number of batches
    follows the total size.
    """
    from pyspark.sql import Window

    total = items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if total <= most:
        yield items
        return
    buckets = -(-int(total) // most) * 2
    key = F.pmod(F.xxhash64(*items.columns), F.lit(buckets))
    order = Window.partitionBy("_bucket").orderBy(F.xxhash64(*[F.col(c) for c in items.columns], F.lit(1)))     # about half of ``most`` to a bucket
    placed = items.withColumn("_size", size).withColumn("_bucket", key)
    placed = placed.withColumn("_part", F.floor((F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1) / most))
    for row in placed.select("_bucket", "_part").distinct().orderBy("_bucket", "_part").collect():       # one row for each batch
        yield placed.where((F.col("_bucket") == row["_bucket"]) & (F.col("_part") == row["_part"])).select(*items.columns)
