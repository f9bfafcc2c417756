"""Sums that tasks make of their rows as numpy arrays, added up by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

DIRECT = 1 << 16        # numbers that tasks send straight to the driver in a pass; beyond it Spark adds them up first


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def totals(df: DataFrame, run: Callable[[pa.RecordBatch], np.ndarray], cells: int, tops: int = 0) -> np.ndarray:
    """What ``run`` makes of a batch, over all batches: the sums of the first ``cells`` numbers, the greatest of ``tops`` more.

    A task sends one number for each cell it has something in. ``cells`` must not grow with the rows. Where tasks times
    cells are few, one stage does; else Spark merges the numbers of a cell before they come to the driver.
    """
    none = np.concatenate([np.zeros(cells), np.full(tops, -np.inf)])

    def merge(out: np.ndarray, at, v: np.ndarray) -> None:
        added = at < cells
        np.add.at(out, at[added], v[added])
        np.maximum.at(out, at[~added], v[~added])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = none.copy()
        for batch in batches:
            if batch.num_rows:
                found = run(batch).ravel()
                out[:cells] += found[:cells]
                np.maximum(out[cells:], found[cells:], out=out[cells:])
        at = np.flatnonzero(out != none)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int64()), "v": pa.array(out[at], pa.float64())})

    found = df.mapInArrow(over, "cell long, v double")
    parts = df.rdd.getNumPartitions()
    if parts > 1 and (cells + tops) * parts > DIRECT:
        merged = found.groupBy("cell").agg(F.sum("v").alias("s"), F.max("v").alias("m"))
        found = merged.select("cell", F.when(F.col("cell") < cells, F.col("s")).otherwise(F.col("m")).alias("v"))
    table = found.toArrow()                     # a row for each cell, or DIRECT numbers at most
    out = none.copy()
    merge(out, table["cell"].to_numpy(), table["v"].to_numpy())
    return out
