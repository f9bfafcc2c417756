"""Grouped tasks over sorted partitions, and id columns, shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def schema_of(**columns: str) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def lowest(df: DataFrame, digest: Column, n: int, most: int) -> DataFrame:
    """The ``most`` rows of least ``digest`` (a 64-bit hash) out of ``n``.

    Rows whose digest is far above the cut to be expected are left out first, so that about half as many rows again as
    are wanted are sorted in one place, and not ``most`` from every task.
    """
    share = 2.0 if n < most else 1.5 * most / n + 100 / n
    near = df if share >= 1 else df.where(digest < F.lit(int(share * (1 << 64)) - (1 << 63)))
    return near.orderBy(digest).limit(most)


def map_groups(df: DataFrame, keys: list[str], run: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` on the Arrow table of every group of ``keys``, many small groups to a task.

    Rows are dealt by the keys and sorted inside the task; groups are cut from the batches as they come, so a task
    holds one group and one batch. Callers bound the size of a group themselves.
    """
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if table.num_rows == 0:
                continue
            if held:
                table = pa.concat_tables([*held, table])
            new = np.zeros(table.num_rows, dtype=bool)
            for k in keys:
                values = table.column(k).combine_chunks()
                new[1:] |= ~pa.compute.equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False).astype(bool)
            starts = [0, *np.flatnonzero(new).tolist()]
            for a, b in zip(starts, starts[1:]):
                yield from run(table.slice(a, b - a))
            held = [table.slice(starts[-1])]
        if held:
            yield from run(held[0].combine_chunks())

    import pyarrow.compute  # noqa: F401  pa.compute is used in the task

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(over, schema)
