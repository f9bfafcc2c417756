"""Leading eigenvectors of a sparse affinity, by joins.

A block of vectors is a table (id, one array a row). Multiplying by the affinity is a join with its edges and a sum. From
a few products, three-term combinations of them, the best vectors of the space they span are chosen by a small eigenvalue
problem on the driver whose size depends on the number of vectors only; they start the next round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.partials import matrix, totals
from ..session import written

SPARE = 2          # vectors carried beyond those asked for
STEPS = 8          # products between two small eigenvalue problems
ROUNDS = 6
SETTLED = 1e-6     # greatest change of an eigenvalue that ends the rounds


def normalised(edges: DataFrame) -> DataFrame:
    """(src, dst, w) of undirected (a, b, weight), both directions, by the roots of both ends' sums of weights."""
    both = written(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight")))
    degree = written(both.groupBy("src").agg(F.sum("weight").alias("degree")))
    joined = both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("degree").alias("other")), "dst")
    return written(joined.select("src", "dst", (F.col("weight") / F.sqrt("degree") / F.sqrt("other")).alias("w")))


def _times(links: DataFrame, basis: DataFrame, width: int, first: bool) -> DataFrame:
    """The basis with one more block: the product of its last block, or twice that less the block before.

    ``basis`` holds (id, x): blocks of ``width`` numbers, one after the other."""
    last = basis.select(F.col("id").alias("dst"), F.slice("x", F.size("x") - width + 1, F.lit(width)).alias("v"))
    product = links.join(last, "dst").groupBy(F.col("src").alias("id")).agg(F.array(*[F.sum(F.col("w") * F.col("v")[i]) for i in range(width)]).alias("p"))
    none = F.array_repeat(F.lit(0.0), width)
    joined = basis.join(product, "id", "left").withColumn("p", F.coalesce("p", none))
    if not first:
        before = F.slice("x", F.size("x") - 2 * width + 1, F.lit(width))
        joined = joined.withColumn("p", F.zip_with("p", before, lambda a, b: 2 * a - b))
    return written(joined.select("id", F.concat("x", "p").alias("x")))


def _best(gram: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest eigenvalues over the span of all blocks but the last, and the combination of blocks for each."""
    m = len(gram) - width
    g = gram[:m, :m]
    h = np.empty((m, m))
    h[:, :width] = gram[:m, width:2 * width]
    for at in range(width, m, width):
        h[:, at:at + width] = (gram[:m, at + width:at + 2 * width] + gram[:m, at - width:at]) / 2
    size, turn = np.linalg.eigh(g)
    held = size > size[-1] * 1e-10
    to = turn[:, held] / np.sqrt(size[held])
    value, vector = np.linalg.eigh(to.T @ ((h + h.T) / 2) @ to)
    return value[::-1][:width], (to @ vector[:, ::-1])[:, :width]


def leading_vectors(nodes: DataFrame, links: DataFrame, k: int, rounds: int = ROUNDS, steps: int = STEPS) -> tuple[DataFrame, np.ndarray]:
    """(id, x) with the ``k`` leading eigenvectors of ``links`` (src, dst, w), symmetric with eigenvalues in [-1, 1];
    and the eigenvalues. Nodes without links have zeros. Fewer vectors come back where the space has fewer."""
    width = k + SPARE
    start = F.array(*[F.xxhash64("id", F.lit(i)) / F.lit(2.0 ** 63) for i in range(width)])
    basis, values = written(nodes.select("id", start.alias("x"))), None
    while True:
        for step in range(steps):
            basis = _times(links, basis, width, step == 0)
        wide = width * (steps + 1)

        def products(batch: pa.RecordBatch) -> np.ndarray:
            x = matrix(batch.column(0))
            return x.T @ x

        gram = totals(basis.select("x"), products, wide * wide).reshape(wide, wide)
        if not gram.any():
            return nodes.select("id", F.array_repeat(F.lit(0.0), k).alias("x")), np.zeros(k)
        found, mix = _best(gram, width)
        rounds -= 1
        done = rounds == 0 or len(found) < width or (values is not None and np.abs(found[:k] - values[:k]).max() < SETTLED)
        if done:
            mix = mix[:, :k]

        def combined(batches: Iterator[pa.RecordBatch], mix=mix) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column(1))[:, :len(mix)] @ mix
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "x"])

        basis, values = written(basis.mapInArrow(combined, basis.schema)), found
        if done:
            return basis, found[:k]
