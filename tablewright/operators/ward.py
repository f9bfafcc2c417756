"""Ward's hierarchy over cluster features.

A cluster feature is (rows, centre, sum of squares about the centre). Tasks turn their rows into a bounded number of
features, features of several tasks are merged in rounds, and the hierarchy is built over the few that remain. A row
then takes the cluster of the nearest feature. Up to ``most`` different rows are features of their own, and the result
is exactly Ward's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..plans.partials import matrix
from ..session import written

MOST = 2048        # features a task keeps, and features the hierarchy is built over
BLOCK = 512        # rows taken up at a time
FAN_IN = 16        # parts whose features meet in one task of a round

FEATURE = "part long, place long, n double, centre array<double>, spread double"


def merge_costs(n: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Growth of the sum of squares when two features become one; infinite on the diagonal."""
    c = centre - centre.mean(axis=0)
    sq = (c * c).sum(axis=1)
    gap = np.maximum(sq[:, None] + sq[None] - 2 * (c @ c.T), 0)
    gap *= n[:, None] * n[None] / (n[:, None] + n[None])
    np.fill_diagonal(gap, np.inf)
    return gap


class Features:
    """Features of the rows seen so far, ``most`` and a block of new ones at the utmost.

    A row joins its nearest feature if that costs no more than the dearest merge made before, else it is a new one.
    Where there are too many, the cheapest pairs of features that are nearest to each other are merged.
    """

    def __init__(self, dims: int, most: int):
        self.most, self.limit = most, 0.0
        self.n, self.centre, self.spread = np.zeros(0), np.zeros((0, dims)), np.zeros(0)

    def add(self, n: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> None:
        for at in range(0, len(n), BLOCK):
            self._block(n[at:at + BLOCK], centre[at:at + BLOCK], spread[at:at + BLOCK])
            if len(self.n) > self.most + BLOCK:
                self.shrink()

    def _block(self, n: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> None:
        same, first = np.unique(centre, axis=0, return_inverse=True)
        first = first.ravel()
        n, centre, spread = np.bincount(first, n), same, np.bincount(first, spread)
        if self.limit > 0:
            mid = self.centre.mean(axis=0)
            old, new = self.centre - mid, centre - mid
            gap = np.maximum((new * new).sum(1)[:, None] + (old * old).sum(1)[None] - 2 * (new @ old.T), 0)
            gap *= n[:, None] * self.n[None] / (n[:, None] + self.n[None])
            near = gap.argmin(axis=1)
            cost = gap[np.arange(len(n)), near]
            joins = cost <= self.limit
            self._join(near[joins], n[joins], centre[joins], spread[joins])
            n, centre, spread = n[~joins], centre[~joins], spread[~joins]
        self.n, self.centre, self.spread = np.concatenate([self.n, n]), np.concatenate([self.centre, centre]), np.concatenate([self.spread, spread])

    def _join(self, at: np.ndarray, n: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> None:
        """Several may join one feature; sums of squares are moved to the new centre."""
        total = self.n.copy()
        np.add.at(total, at, n)
        moved = np.zeros_like(self.centre)
        np.add.at(moved, at, n[:, None] * (centre - self.centre[at]))
        moved /= total[:, None]
        own = self.spread + self.n * (moved * moved).sum(axis=1)
        np.add.at(own, at, spread + n * ((centre - self.centre[at] - moved[at]) ** 2).sum(axis=1))
        self.n, self.centre, self.spread = total, self.centre + moved, own

    def shrink(self) -> None:
        while len(self.n) > self.most:
            cost = merge_costs(self.n, self.centre)
            rows = np.arange(len(self.n))
            near = cost.argmin(axis=1)
            left = rows[(near[near] == rows) & (rows < near)]
            left = left[np.argsort(cost[left, near[left]], kind="stable")][:len(rows) - self.most]
            gone = near[left]
            self.limit = max(self.limit, float(cost[left, gone].max()))
            self._join(left, self.n[gone], self.centre[gone], self.spread[gone])
            keep = np.ones(len(rows), bool)
            keep[gone] = False
            self.n, self.centre, self.spread = self.n[keep], self.centre[keep], self.spread[keep]

    def table(self, part: int) -> pa.RecordBatch:
        self.shrink()
        return pa.RecordBatch.from_pydict({
            "part": pa.array(np.full(len(self.n), part), pa.int64()), "place": pa.array(np.arange(len(self.n)), pa.int64()), "n": pa.array(self.n, pa.float64()),
            "centre": pa.array(list(self.centre), pa.list_(pa.float64())), "spread": pa.array(self.spread, pa.float64())})


def cluster_features(pts: DataFrame, most: int = MOST) -> DataFrame:
    """(part, place, n, centre, spread): at most ``most`` features of all rows with a vector; no rows give none."""
    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                found = found or Features(x.shape[1], most)
                found.add(np.ones(len(x)), x, np.zeros(len(x)))
        if found is not None:
            yield found.table(TaskContext.get().partitionId())

    def of_features(table: pa.Table) -> pa.Table:
        table = table.sort_by([("from", "ascending"), ("place", "ascending")])
        centre = matrix(table["centre"])
        found = Features(centre.shape[1], most)
        found.add(table["n"].to_numpy(), centre, table["spread"].to_numpy())
        return pa.Table.from_batches([found.table(table["part"][0].as_py())])

    rows = pts.where("x IS NOT NULL").select("x")
    parts = rows.rdd.getNumPartitions()
    found = written(rows.mapInArrow(of_rows, FEATURE))
    while parts > 1:
        parts = -(-parts // FAN_IN)
        grouped = found.withColumn("from", F.col("part")).withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part")
        found = written(grouped.applyInArrow(of_features, FEATURE))
    return found


def hierarchy(n: np.ndarray, centre: np.ndarray) -> list[tuple[float, int, int]]:
    """(cost, a, b) of every merge by the nearest-neighbour chain; the merged group goes on under the smaller number."""
    n, centre, alive = n.astype(float), centre.copy(), np.ones(len(n), bool)
    merges, chain = [], []
    while len(merges) < len(n) - 1:
        if not chain:
            chain.append(int(alive.argmax()))
        a = chain[-1]
        cost = ((centre - centre[a]) ** 2).sum(axis=1) * (n * n[a] / (n + n[a]))
        cost[~alive] = np.inf
        cost[a] = np.inf
        b = int(cost.argmin())
        if len(chain) < 2 or cost[b] < cost[chain[-2]]:
            chain.append(b)
            continue
        b = chain[-2]
        del chain[-2:]
        low, high = min(a, b), max(a, b)
        merges.append((float(cost[b]), low, high))
        centre[low] = (n[a] * centre[a] + n[b] * centre[b]) / (n[a] + n[b])
        n[low] = n[a] + n[b]
        alive[high] = False
    return merges


def cut(merges: list[tuple[float, int, int]], n: np.ndarray, k: int) -> np.ndarray:
    """Cluster of every feature when ``k`` groups are left; clusters are numbered from the one with most rows."""
    root = np.arange(len(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for _, a, b in sorted(merges, key=lambda m: m[0])[:max(0, len(n) - k)]:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    groups = np.array([top(i) for i in range(len(n))])
    rows = np.bincount(groups, n, len(n))
    names = sorted(set(groups.tolist()), key=lambda g: (-rows[g], g))
    return np.array([names.index(g) for g in groups.tolist()], dtype=np.int32)


def ward(pts: DataFrame, k: int, most: int = MOST) -> DataFrame:
    """(id, cluster) of (id, x): Ward's agglomerative clustering cut at ``k`` clusters.

    Fewer different rows than ``k`` give as many clusters as there are. Repeated rows share a cluster, rows without a
    vector have none (null), no rows give none. Beyond ``most`` different rows close ones are merged first, so the
    hierarchy is that of the features and may depend on how rows lie in partitions.
    """
    pts = written(pts.select("id", "x"))
    top = cluster_features(pts, most).orderBy("part", "place").toArrow()        # `most` rows at the utmost
    schema = f"id {pts.schema['id'].dataType.simpleString()}, cluster int"
    if not top.num_rows:
        return pts.select("id", F.lit(None).cast("int").alias("cluster"))
    n, centre = top["n"].to_numpy(), matrix(top["centre"])
    middle = centre.mean(axis=0)
    centre = centre - middle
    label = cut(hierarchy(n, centre), n, k)
    own = (centre * centre).sum(axis=1)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(at, BLOCK)
                held = rows.column(1).is_valid().to_numpy(zero_copy_only=False)
                out = np.zeros(len(held), dtype=np.int32)
                if held.any():
                    out[held] = label[(own[None] - 2 * ((matrix(rows.column(1).drop_null()) - middle) @ centre.T)).argmin(axis=1)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, pa.int32(), mask=~held)], names=["id", "cluster"])

    return pts.mapInArrow(nearest, schema)
