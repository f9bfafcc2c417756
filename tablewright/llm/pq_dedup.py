"""Embedding near-duplicates by product quantisation.

Unit vectors are filed in coarse lists (the nearest of K centroids, per label). What is left after subtracting the
centroid is coded in M subspaces by small codebooks. A vector visits lists near it; there, distances to all codes come
from a table per subspace, pairs that cannot be close enough are dropped, and the rest is decided by exact cosine in
double precision.

Nothing is lost, so recall is 1 whatever the fitted sample: two vectors within distance r that lie in different lists
stand on different sides of the plane between the two centroids, so one of them is within r / 2 of it. Each visits all
lists whose plane is within r / 2, and a pair is taken where either meets the other (once, by a rule that both sides can
work out). And a code is only dropped when its table distance less its own coding error exceeds r.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.session import written

from .components import components
from .ngram_join import forest
from .scratch import lowest, map_groups

THRESHOLD = 0.98
SAMPLE = 16_384                    # vectors used to fit centroids and codebooks; all are filed, coded and searched
SUBSPACES, WORDS = 8, 64
BLOCK = 512                        # vectors of a list, and visitors, that meet in one task at a time
SLACK = 1e-9


def _kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Plain k-means from the first distinct rows; an empty centroid stays where it is."""
    centre = np.unique(x, axis=0)
    centre = centre[np.linspace(0, len(centre) - 1, min(k, len(centre))).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ centre.T - 0.5 * (centre ** 2).sum(1)).argmax(1)
        count = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[count > 0] = total[count > 0] / count[count > 0, None]
    return centre


class Model:
    """Coarse centroids (K x D) and one codebook per subspace (M x words x D / M); vectors are padded with zeros to D."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.width = ceil(sample.shape[1] / SUBSPACES)
        self.dims = self.width * SUBSPACES
        sample = self.padded(sample)
        self.coarse = _kmeans(sample, lists)
        rest = sample - self.coarse[self.nearest(sample)]
        books = [_kmeans(part, WORDS) for part in np.split(rest, SUBSPACES, axis=1)]
        size = max(len(b) for b in books)
        self.books = np.stack([np.concatenate([b, np.repeat(b[:1], size - len(b), axis=0)]) for b in books])

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.dims - x.shape[1]))) if x.shape[1] < self.dims else x

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.coarse.T - 0.5 * (self.coarse ** 2).sum(1)).argmax(1)

    def visits(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Home list, and for every list whether its plane towards the home list is within ``reach``."""
        score = x @ self.coarse.T - 0.5 * (self.coarse ** 2).sum(1)
        home = score.argmax(1)
        apart = np.sqrt(np.maximum(0, ((self.coarse[home][:, None] - self.coarse[None]) ** 2).sum(2))) if len(x) * len(self.coarse) < 1 << 14 else self._apart()[home]
        gap = score[np.arange(len(x)), home][:, None] - score
        return home, gap <= reach * apart + SLACK

    def _apart(self) -> np.ndarray:
        square = (self.coarse ** 2).sum(1)
        return np.sqrt(np.maximum(0, square[:, None] + square[None] - 2 * self.coarse @ self.coarse.T))

    def code(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n x M) and the distance between every vector and what its code stands for."""
        rest = (x - self.coarse[home]).reshape(len(x), SUBSPACES, self.width)
        codes = np.empty((len(x), SUBSPACES), dtype=np.uint8)
        error = np.zeros(len(x))
        for m in range(SUBSPACES):
            far = ((rest[:, m, None, :] - self.books[m][None]) ** 2).sum(2)
            codes[:, m] = far.argmin(1)
            error += far[np.arange(len(x)), codes[:, m]]
        return codes, np.sqrt(error)

    def table_distances(self, visitors: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances from visitors to coded vectors of list ``home``: one table look-up per subspace."""
        rest = (visitors - self.coarse[home]).reshape(len(visitors), SUBSPACES, self.width)
        total = np.zeros((len(visitors), len(codes)))
        for m in range(SUBSPACES):
            table = ((rest[:, m, None, :] - self.books[m][None]) ** 2).sum(2)
            total += table[:, codes[:, m]]
        return total


def _units(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(-1, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)      # so that squares neither overflow nor vanish
    return x / np.sqrt((x ** 2).sum(axis=1, keepdims=True))


def _usable(vectors: DataFrame) -> DataFrame:
    """Distinct vectors that can link: label, dims, least id, how many rows are equal to it, the vector as doubles."""
    x = F.col("embedding")
    fine = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0)
            & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))) & F.exists(x, lambda v: v != 0))
    return vectors.where(F.coalesce(fine, F.lit(False))).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dims", F.size("embedding"))


def lists_for(n: int) -> int:
    """Number of coarse lists for ``n`` vectors: half the square root, 16 at least; the sample fits 1,024 well."""
    return min(1024, max(16, round(sqrt(n) / 2)))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept`` (and ``label``).

    Vectors link when labels and lengths are equal and their cosine is ``threshold`` (above 0) or more. Vectors that are
    null, empty, zero or hold null or non-finite components, and rows with a null label, link with nothing. A row
    without id is returned with null ``component_id``, no links, kept. Rows that share an id are one node of the link
    graph. No rows give no rows; further columns are ignored.
    """
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    usable = written(_usable(given))
    # a bounded sample by digest, so the fit does not depend on how rows lie
    n = usable.count()
    picked = lowest(usable, F.xxhash64("rep"), n, SAMPLE).select("dims", "embedding").collect()
    if not picked:
        return given.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), "label")
    widest = usable.agg(F.max("dims")).first()[0]
    sample = np.zeros((len(picked), widest))
    for i, r in enumerate(picked):
        sample[i, :r.dims] = np.array(r.embedding) / np.abs(r.embedding).max()
    sample /= np.sqrt((sample ** 2).sum(1, keepdims=True))
    model = Model(sample, lists_for(n))
    radius = sqrt(max(0.0, 2 - 2 * threshold)) + SLACK

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            home = np.zeros(len(dims), dtype=np.int32)
            error = np.zeros(len(dims))
            visits, codes = [None] * len(dims), [b""] * len(dims)
            for d in np.unique(dims).tolist():
                for at in np.array_split(np.flatnonzero(dims == d), 1 + (dims == d).sum() // 2048):
                    if not len(at):
                        continue
                    x = model.padded(_units(batch.column("embedding").take(pa.array(at)), d))
                    home[at], near = model.visits(x, radius / 2)
                    code, error[at] = model.code(x, home[at])
                    for i, row, c in zip(at.tolist(), near, code):
                        visits[i], codes[i] = np.flatnonzero(row).tolist(), c.tobytes()
            columns = [batch.column(n) for n in ("label", "dims", "rep", "copies", "embedding")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(home), pa.array(visits, type=pa.list_(pa.int32())), pa.array(codes, type=pa.binary()), pa.array(error)],
                                             names=["label", "dims", "rep", "copies", "embedding", "home", "visits", "codes", "error"])

    label = usable.schema["label"].dataType.simpleString()
    filed = written(usable.select("label", "dims", "rep", "copies", "embedding").mapInArrow(
        file, f"label {label}, dims int, rep long, copies long, embedding array<double>, home int, visits array<int>, codes binary, error double"))

    place = ["label", "dims", "list"]
    members = filed.withColumn("list", F.col("home"))
    visitors = filed.withColumn("list", F.explode("visits"))
    sizes = (visitors.groupBy(*place).agg(F.count("*").alias("nv"), F.count(F.when(F.col("home") == F.col("list"), 1)).alias("nm"))
             .select(*place, F.ceil(F.col("nm") / BLOCK).cast("int").alias("km"), F.ceil(F.col("nv") / BLOCK).cast("int").alias("kv")).where("km > 0"))

    def dealt(rows: DataFrame, own: str, other: str, mine: str, its: str, visitor: bool) -> DataFrame:
        rows = rows.join(sizes, place).withColumn(mine, F.pmod(F.xxhash64("rep"), F.col(own).cast("long")).cast("int"))
        return rows.withColumn(its, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(*place, "bm", "bv", F.lit(visitor).alias("visitor"), "rep", "copies", "home", "visits", "codes", "error", "embedding")

    both = dealt(members, "km", "kv", "bm", "bv", False).unionByName(dealt(visitors, "kv", "km", "bv", "bm", True))

    def meet(group: pa.Table) -> Iterator[pa.RecordBatch]:
        visitor = group.column("visitor").to_numpy()
        m, v = np.flatnonzero(~visitor), np.flatnonzero(visitor)
        if not len(m) or not len(v):
            return
        here = group.column("list")[0].as_py()
        rep, copies, home, error = (group.column(c).to_numpy() for c in ("rep", "copies", "home", "error"))
        x = model.padded(_units(group.column("embedding"), group.column("dims")[0].as_py()))
        codes = np.frombuffer(b"".join(group.column("codes").to_pylist()), dtype=np.uint8).reshape(-1, SUBSPACES)
        far = model.table_distances(x[v], here, codes[m])
        near = np.sqrt(far) - error[m][None] <= radius
        # a pair that meets in two lists counts in the lower one; inside one list, from the larger id
        visits = group.column("visits").take(pa.array(m)).combine_chunks()
        goes = np.zeros((len(m), len(model.coarse)), dtype=bool)
        goes[np.repeat(np.arange(len(m)), np.diff(visits.offsets.to_numpy())), visits.flatten().to_numpy()] = True
        at_home = home[v] == here
        mutual = goes[:, home[v]].T
        mine = np.where(at_home[:, None], rep[v][:, None] > rep[m][None], ~mutual | (here < home[v])[:, None])
        i, j = np.nonzero(near & mine & (rep[v][:, None] != rep[m][None]))
        if not len(i):
            return
        cosine = np.concatenate([(x[v[i[a:a + 65536]]] * x[m[j[a:a + 65536]]]).sum(1) for a in range(0, len(i), 65536)])
        i, j = v[i[cosine >= threshold]], m[j[cosine >= threshold]]
        if not len(i):
            return
        gained = np.bincount(i, weights=copies[j], minlength=len(rep)) + np.bincount(j, weights=copies[i], minlength=len(rep))
        some = np.flatnonzero(gained)
        links = np.array(forest(i, j, len(rep)), dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([rep[some], rep[links[:, 0]]])),
            pa.array(np.concatenate([np.zeros(len(some), dtype=np.int64), rep[links[:, 1]]]), mask=np.arange(len(some) + len(links)) < len(some)),
            pa.array(np.concatenate([gained[some].astype(np.int64), np.zeros(len(links), dtype=np.int64)])),
        ], names=["a", "b", "links"])

    found = written(map_groups(both, [*place, "bm", "bv"], meet, "a long, b long, links long"))
    groups = components(found.where("b is not null").select("a", "b"))
    gained = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    known = (usable.join(gained, F.col("rep") == F.col("a"), "left").join(groups, F.col("rep") == F.col("node"), "left")
             .select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component")))
    same = [given.vec_id.isNotNull(), given.label == F.col("_label"), given.embedding == F.col("_embedding")]
    return given.join(known, reduce(lambda a, b: a & b, same), "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component", "vec_id")).alias("kept"), "label")
