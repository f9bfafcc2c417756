"""Exact nearest-neighbour and radius joins over numeric vectors.

No pair is shuffled. Equal vectors are merged first. The vectors grow a metric tree: a cell of
more than ``CHUNK`` vectors is parted among pivots of its own, level by level, until every leaf
is small, so the number of leaves grows with the table and neither leaves nor pivots pass
through the driver. A query first falls to its own leaf, whose k-th distance bounds it, and
then descends again into all cells that the triangle inequality cannot rule out under that
bound. Each task compares at most ``CHUNK`` queries with one leaf and returns at most ``k`` rows
(or one count) per query; vectors of many dimensions, which meet nearly all leaves, have greater
leaves and blocks, so that fewer copies of them travel. A matrix product rules pairs out, a strip
of distances at a time; those it leaves in doubt are measured. Points may carry a group ``g`` (text without ``/``): every group has
a tree of its own, all grown and searched by the same jobs, and only meets itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import at, rounded
from ..functions.draws import digest
from ..session import written

PIVOTS = 64     # most children of a cell
FANNED = 4      # children for each ``CHUNK`` vectors of a cell
CHUNK = 4_000   # vectors of a leaf, and queries that meet it in one task
WIDE = 8        # dimensions beyond which cells hardly rule each other out
GREAT = 8       # times ``CHUNK`` that a leaf of wide vectors holds; half as many queries meet it
STRIP = 1 << 20  # distances held at once
PAIRS = 1 << 22  # numbers held while single pairs are measured
FOUND = 1 << 21  # pairs that a task may return at once
SHARE = 1 << 10  # rows of one vector that are paired with others at once
FEW = 200_000   # cells whose names and sizes may be broadcast
ROOT = "r"
BLOCK = ["cell", "part"]


def nothing(**kinds) -> pd.DataFrame:
    """An empty block with column types."""
    return pd.DataFrame({c: pd.Series([], dtype=k) for c, k in kinds.items()})


def vectors(df: DataFrame, key: str, columns: list[str] | None = None, array: str | None = None, group: str | None = None) -> DataFrame:
    """(id, x[, g]): the key, the coordinates as ``array<double>`` and the group within which neighbours are sought."""
    x = at(array).cast("array<double>") if array else F.array(*[at(c).cast("double") for c in columns])
    return df.select(at(key).alias("id"), x.alias("x"), *([at(group).alias("g")] if group else []))


def _root(points: DataFrame) -> Column:
    return at("g") if "g" in points.columns else F.lit(ROOT)


def vector_id(root: Column) -> Column:
    """Digest that names a vector of a group; -0.0 is 0.0, as in grouping."""
    return F.md5(F.concat_ws(",", root, F.transform("x", lambda v: (v + F.lit(0.0)).cast("string"))))


def members_of(points: DataFrame) -> DataFrame:
    return points.withColumn("vid", vector_id(_root(points)))


def _merged(points: DataFrame) -> DataFrame:
    """One row per distinct vector, in the root cell of its group: its digest, how many rows share it and their least id."""
    return (points.groupBy(_root(points).alias("cell"), "x").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
            .withColumn("vid", vector_id(F.col("cell"))))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by direct differences (no cancellation), a few thousand rows per side."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def _pair_distances(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Euclidean distances of single pairs by direct differences."""
    out, step = np.empty(len(rows)), max(1, PAIRS // max(1, a.shape[1]))
    for i in range(0, len(rows), step):
        d = a[rows[i:i + step]] - b[cols[i:i + step]]
        out[i:i + step] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def _strips(a: np.ndarray, b: np.ndarray):
    """(rows, q, own, off) for strips of ``a``: ``q + own`` are squared distances to ``b``, none off by more than ``off``.

    By one matrix product about the middle of ``b``, in single precision unless the numbers are too great or small for it;
    ``off`` also covers the rounding of ``_pair_distances``."""
    with np.errstate(all="ignore"):
        held = b[np.isfinite(b).all(axis=1)]
        middle = held.mean(axis=0) if len(held) else np.zeros(b.shape[1])
        b = b - middle
        right = np.einsum("ij,ij->i", b, b)
        top = right.max(initial=0.0)
        a = a - middle
        owns = np.einsum("ij,ij->i", a, a)
        kind = np.float32 if 1e-20 < owns.max(initial=0.0) + top < 1e30 else np.float64
        b, left = np.vstack([b.T, right]).astype(kind), np.hstack([-2 * a, np.ones((len(a), 1))]).astype(kind)
        step = max(1, STRIP // max(1, b.shape[1]))
        for i in range(0, len(a), step):
            own = owns[i:i + step]
            off = 8 * (a.shape[1] + 8) * float(np.finfo(kind).eps) * (own + top)
            yield slice(i, i + step), left[i:i + step] @ b, own, off


def _over(q: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Which numbers of ``q`` lie above their row's limit, rounded up to the precision of ``q``; what is no number does not."""
    return q > np.nextafter(limit.astype(q.dtype), q.dtype.type(np.inf))[:, None]


def _near_pairs(a: np.ndarray, b: np.ndarray, bound: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the pairs within each row's bound; at most the ``most`` nearest of a row, ties to the first column."""
    found = []
    for at, q, own, off in _strips(a, b):
        limit = bound[at]
        with np.errstate(all="ignore"):
            doubt = ~_over(q, limit * limit * (1 + 1e-12) - own + off)          # what is no number stays
            if most is not None and np.count_nonzero(doubt) > 4 * most * len(q):
                kth = np.partition(q, min(most, q.shape[1]) - 1, axis=1)[:, min(most, q.shape[1]) - 1]
                doubt &= ~_over(q, kth + 2 * off)
            rows, cols = np.divmod(np.flatnonzero(doubt), q.shape[1])
            d = _pair_distances(a[at], b, rows, cols)
            held = d <= limit[rows]
        rows, cols, d = rows[held], cols[held], d[held]
        if most is not None:
            order = np.lexsort((cols, d, rows))
            rows, cols, d = rows[order], cols[order], d[order]
            starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, dtype=int)
            nth = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
            rows, cols, d = rows[nth < most], cols[nth < most], d[nth < most]
        found.append((rows + at.start, cols, d))
    return tuple(np.concatenate(part) for part in zip(*found))


def _within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which pairs lie within ``eps``: as ``_distances(a, b) <= eps``, a bit for each."""
    out = np.zeros((len(a), len(b)), dtype=bool)
    for at, q, own, off in _strips(a, b):
        with np.errstate(all="ignore"):
            low = (eps * eps * (1 - 1e-12) - own - off).astype(q.dtype)
            out[at] = q <= np.nextafter(low, q.dtype.type(-np.inf))[:, None]
            rows, cols = np.nonzero(~(out[at] | _over(q, eps * eps * (1 + 1e-12) - own + off)))
            out[at][rows, cols] = _pair_distances(a[at], b, rows, cols) <= eps
    return out


def _few(cells: DataFrame):
    """``broadcast`` where the cells were counted to be few, else nothing: the join is a shuffle that adaptive execution may split."""
    return F.broadcast if cells.limit(FEW + 1).count() <= FEW else lambda d: d


def _vectors(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), -1)


def _blocks(left: DataFrame, right: DataFrame, size: int | None = None, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """Add ``part`` to both sides: a cell's left rows are dealt over parts of about ``size`` rows, its right rows go to each part.

    ``stored``: the left rows are read from written tables as they are."""
    left = left if stored else written(left)
    sizes = written(left.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(size or CHUNK)).alias("parts")))
    hint = _few(sizes)
    dealt = left.join(hint(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts"))).drop("parts")
    spread = right.join(hint(sizes), "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return dealt, spread


def _together(dealt: DataFrame, spread: DataFrame, work, schema: str) -> DataFrame:
    return dealt.groupBy(*BLOCK).cogroup(spread.groupBy(*BLOCK)).applyInPandas(work, schema)


@dataclass
class Tree:
    """``leaves`` (cell, x, n, least, vid); ``levels``: per level the children (cell = parent, j, child, centre, rows, far, near)."""
    leaves: DataFrame
    levels: list[DataFrame]
    block: int                  # queries that meet a leaf in one task
    step: int                   # queries that meet a cell's children in one task


def grow(base: DataFrame, great: bool = True) -> Tree | None:
    """The metric tree of (id, x[, g]); nothing if there are no rows. ``great``: leaves of wide vectors may be great."""
    rows = written(_merged(base))
    if rows.isEmpty():
        return None
    kind = base.schema["id"].dataType.simpleString()
    wide = great and (rows.agg(F.max(F.size("x"))).first()[0] or 0) > WIDE
    size, block, step, fanned = (GREAT * CHUNK, GREAT * CHUNK // 2, max(1, CHUNK // GREAT), FANNED / 2) if wide else (CHUNK, CHUNK, CHUNK, FANNED)
    leaves, levels = None, []
    while True:
        great = written(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > size))
        if great.isEmpty():
            break
        hint = _few(great)
        small = rows.join(hint(great), "cell", "left_anti")
        leaves = small if leaves is None else leaves.unionByName(small)
        rows = rows.join(hint(great), "cell")
        first = Window.partitionBy("cell").orderBy(digest(["vid"], 42, "pivot"))       # cut before the shuffle
        wanted = F.least(F.lit(max(2, PIVOTS)), F.ceil(fanned * F.col("m") / size))        # a quarter of a leaf's rows each (wide: half), or the most
        pivots = written(rows.withColumn("j", F.row_number().over(first) - 1).where(F.col("j") < max(2, PIVOTS)).where(F.col("j") < wanted).select("cell", "j", F.col("x").alias("centre")))
        dealt, spread = _blocks(rows.drop("m"), pivots)
        rows = written(_together(dealt, spread, _nearest_child, f"parent string, j int, cell string, reach double, x array<double>, n long, least {kind}, vid string"))
        stats = rows.groupBy("parent", "j").agg(F.first("cell").alias("child"), F.sum("n").alias("rows"), F.max("reach").alias("far"), F.min("reach").alias("near"))
        levels.append(written(pivots.withColumnRenamed("cell", "parent").join(stats, ["parent", "j"]).withColumnRenamed("parent", "cell")))
        rows = rows.drop("parent", "j", "reach")
    return Tree(rows if leaves is None else leaves.unionByName(rows), levels, block, step)


def _nearest_child(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Vectors with the child whose pivot is nearest; equal distances are dealt by digest, so a cell always shrinks."""
    if left.empty or right.empty:
        return nothing(parent=object, j="int32", cell=object, reach=float, x=object, n="int64", least=object, vid=object)
    right = right.sort_values("j")
    d = _distances(_vectors(left["x"]), _vectors(right["centre"]))
    least = d.min(axis=1)
    tied = d <= least[:, None]
    tied[~tied.any(axis=1)] = True          # distances that are no numbers
    nth = np.array([int(v[:8], 16) for v in left["vid"]]) % tied.sum(axis=1)
    j = (tied.cumsum(axis=1) == nth[:, None] + 1).argmax(axis=1)
    j = right["j"].to_numpy()[j].astype("int32")
    return pd.DataFrame({"parent": left["cell"].to_numpy(), "j": j, "cell": [f"{c}/{i}" for c, i in zip(left["cell"], j)], "reach": least,
                         "x": left["x"].to_numpy(), "n": left["n"].to_numpy(), "least": left["least"].to_numpy(), "vid": left["vid"].to_numpy()})


def _limits(d: np.ndarray, far: np.ndarray, rows: np.ndarray, need: int) -> np.ndarray:
    """All rows of a cell lie within ``d + far``; the least such limit that covers ``need`` rows (none: infinite)."""
    upper = d + far
    order = upper.argsort(axis=1)
    filled = rows[order].cumsum(axis=1) >= need
    limit = np.take_along_axis(np.take_along_axis(upper, order, 1), filled.argmax(axis=1)[:, None], 1)[:, 0]
    return np.where(filled.any(axis=1), limit, np.inf)


ASKED = "vid string, x array<double>, cell string, bound double"


def _level(asked: DataFrame, level: DataFrame, step, size: int) -> tuple[DataFrame, DataFrame]:
    """(queries whose cell is a leaf, the others moved to children of their cells by ``step``)."""
    parents = level.select("cell").distinct()
    hint = _few(parents)
    dealt, spread = _blocks(asked.join(hint(parents), "cell", "left_semi").select("vid", "x", "cell", "bound"), level, size, stored=True)
    return asked.join(hint(parents), "cell", "left_anti").select("vid", "x", "cell", "bound"), written(_together(dealt, spread, step, ASKED))


def _descended(asked: DataFrame, tree: Tree, step) -> DataFrame:
    """``asked``, a written table, led down all levels: the parts of written tables that ended in a leaf."""
    ended = None
    for level in tree.levels:
        still, asked = _level(asked, level, step, tree.step)
        ended = still if ended is None else ended.unionByName(still)
    return asked if ended is None else ended.unionByName(asked)


def _bounded(asked: DataFrame, tree: Tree, need: int) -> DataFrame:
    """(vid, bound): a distance within which each query has ``need`` rows, from the way to its own leaf and that leaf's rows."""
    def own(key, left, right):
        if left.empty or right.empty:
            return nothing(vid=object, x=object, cell=object, bound=float)
        d = _distances(_vectors(left["x"]), _vectors(right["centre"]))
        bound = np.minimum(left["bound"].to_numpy(), _limits(d, right["far"].to_numpy(), right["rows"].to_numpy(), need))
        return pd.DataFrame({"vid": left["vid"], "x": left["x"], "cell": right["child"].to_numpy()[d.argmin(axis=1)], "bound": bound})

    def tighter(key, left, right):
        if left.empty:
            return nothing(vid=object, bound=float)
        bound = left["bound"].to_numpy().copy()
        if len(right):
            n, m = right["n"].to_numpy(), min(need, len(right))
            for at, q, own, off in _strips(_vectors(left["x"]), _vectors(right["x"])):
                first = np.argpartition(q, m - 1, axis=1)[:, :m]            # more rows than these are never needed
                upper = np.sqrt(np.maximum(np.take_along_axis(q, first, 1) + (own + off)[:, None], 0)) * (1 + 1e-12)
                order = upper.argsort(axis=1)
                filled = np.take_along_axis(n[first], order, 1).cumsum(axis=1) >= need
                limit = np.where(filled.any(axis=1), np.take_along_axis(np.take_along_axis(upper, order, 1), filled.argmax(axis=1)[:, None], 1)[:, 0], np.inf)
                bound[at] = np.fmin(bound[at], limit)
        return pd.DataFrame({"vid": left["vid"].to_numpy(), "bound": bound})

    dealt, spread = _blocks(_descended(asked, tree, own), tree.leaves.select("cell", "x", "n"), tree.block, stored=True)
    return _together(dealt, spread, tighter, "vid string, bound double")


def candidates(queries: DataFrame, tree: Tree, need: int | None = None, radius: float | None = None) -> DataFrame:
    """(vid, x, cell, bound): every leaf in which a query may have one of its ``need`` nearest rows, or a row within ``radius``.

    ``queries`` are merged vectors in their root cells."""
    asked = written(queries.select("vid", "x", "cell", F.lit(np.inf if radius is None else radius).alias("bound")))
    if not tree.levels:
        return asked
    if radius is None:
        asked = written(asked.drop("bound").join(_bounded(asked, tree, need), "vid").select("vid", "x", "cell", "bound"))

    def reached(key, left, right):
        if left.empty or right.empty:
            return nothing(vid=object, x=object, cell=object, bound=float)
        d = _distances(_vectors(left["x"]), _vectors(right["centre"]))
        far, near, limit = right["far"].to_numpy(), right["near"].to_numpy(), left["bound"].to_numpy()[:, None]
        # distance to a cell is at least |d - ring of radii| and at least half the gap between pivots' distances
        low = np.maximum(np.maximum(d - far, near - d), (d - d.min(axis=1)[:, None]) / 2)
        rows, cols = np.nonzero(low <= limit * (1 + 1e-12) + 1e-12)
        return pd.DataFrame({"vid": left["vid"].to_numpy()[rows], "x": left["x"].to_numpy()[rows], "cell": right["child"].to_numpy()[cols], "bound": left["bound"].to_numpy()[rows]})

    return _descended(asked, tree, reached)


def meetings(queries: DataFrame, tree: Tree, right: list[str], need: int | None = None, radius: float | None = None, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Blocks of queries (vid, x, cell, bound) beside the ``right`` columns of the leaves in which they may have neighbours."""
    return _blocks(candidates(queries, tree, need, radius), tree.leaves.select("cell", *right), block or tree.block, stored=True)


def knn_join(queries: DataFrame, base: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(id, neighbour, distance, rank): the ``k`` nearest base rows of every query row, of its own group where both sides have ``g``.

    Both inputs have (id, x). Ties go to the smaller neighbour id. ``exclude_self`` leaves out the row of the same id."""
    need = k + 1 if exclude_self else k
    tree = grow(base)
    if tree is None:
        kind = base.schema["id"].dataType.simpleString()
        return queries.sparkSession.createDataFrame([], f"id {queries.schema['id'].dataType.simpleString()}, neighbour {kind}, distance double, rank int")
    dealt, spread = meetings(_merged(queries), tree, ["vid", "x", "least"], need)
    kind = base.schema["id"].dataType.simpleString()

    def nearest(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return nothing(vid=object, near=object, distance=float, least=object)
        # `need` vectors of a block are enough; among equal distances those with the least row id
        right = right.sort_values("least", kind="stable")
        rows, cols, d = _near_pairs(_vectors(left["x"]), _vectors(right["x"]), left["bound"].to_numpy() * (1 + 1e-12), need)
        return pd.DataFrame({"vid": left["vid"].to_numpy()[rows], "near": right["vid"].to_numpy()[cols], "distance": d, "least": right["least"].to_numpy()[cols]})

    found = _together(dealt, spread, nearest, f"vid string, near string, distance double, least {kind}")
    # and so are `need` vectors of all blocks, cut before their rows are looked up
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("vid").orderBy("distance", "least"))).where(F.col("r") <= need).drop("r", "least")
    # rows behind a vector: its first `need` ids are enough
    first = Window.partitionBy("vid").orderBy("id")
    few = members_of(base).withColumn("r", F.row_number().over(first)).where(F.col("r") <= need).select(F.col("vid").alias("near"), F.col("id").alias("neighbour"))
    best = Window.partitionBy("vid").orderBy("distance", "neighbour")
    kept = found.join(few, "near").withColumn("r", F.row_number().over(best)).where(F.col("r") <= need)
    out = kept.join(members_of(queries).select("vid", "id"), "vid")
    if exclude_self:
        out = out.where(F.col("neighbour") != F.col("id"))
    rank = Window.partitionBy("id").orderBy("distance", "neighbour")
    return (out.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("id", "neighbour", "distance", "rank"))


def eps_counts(points: DataFrame, eps: float) -> DataFrame:
    """(id, neighbours): rows within ``eps`` of each row, itself included; only counts leave a task. No rows give no rows."""
    tree = grow(points)
    if tree is None:
        return points.select("id", F.lit(0).cast("long").alias("neighbours"))
    dealt, spread = meetings(_merged(points), tree, ["x", "n"], radius=eps)

    def count(key, left, right):
        if left.empty or right.empty:
            return nothing(vid=object, n="int64")
        n, x, other = np.zeros(len(left), dtype="int64"), _vectors(left["x"]), _vectors(right["x"])
        step = max(1, STRIP // len(other))
        for i in range(0, len(x), step):
            n[i:i + step] = (_within(x[i:i + step], other, eps) * right["n"].to_numpy()[None, :]).sum(axis=1)
        return pd.DataFrame({"vid": left["vid"].to_numpy(), "n": n})

    counts = _together(dealt, spread, count, "vid string, n long").groupBy("vid").agg(F.sum("n").alias("neighbours"))
    return members_of(points).join(counts, "vid").select("id", "neighbours")


def _row_pairs(pairs: DataFrame, points: DataFrame, leaves: DataFrame) -> DataFrame:
    """(left, right, distance) with left < right of all rows behind pairs of vectors, which come in both orders.

    Rows of a vector are dealt by id over shares of about ``SHARE``. Pairs of shares are dealt over the tasks, and each is
    turned into pairs of rows, of which it gives the square, only where they leave the task."""
    large = written(leaves.where(F.col("n") > SHARE).select("vid", F.ceil(F.col("n") / F.lit(SHARE)).alias("shares")))
    few = _few(large)
    ids = members_of(points).where(F.col("id").isNotNull()).groupBy("vid", "id").agg(F.count(F.lit(1)).alias("times"))
    dealt = ids.join(few(large), "vid", "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64("id"), F.col("shares")), F.lit(0).cast("long")))
    once = (ids.agg(F.max("times")).first()[0] or 1) == 1
    held = written(dealt.groupBy("vid", "share").agg(F.collect_list("id" if once else F.struct("id", "times")).alias("ids")))

    def shared(df, vid, share):
        """One row for each share of the vector ``vid``."""
        named = few(large.withColumnRenamed("vid", vid))
        return df.join(named, vid, "left").withColumn(share, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")

    side = lambda vid, share, ids: held.select(F.col("vid").alias(vid), F.col("share").alias(share), F.col("ids").alias(ids))
    met = (shared(shared(pairs.where("vid <= near"), "vid", "share"), "near", "other").where("vid <> near or share <= other")
           .withColumn("own", F.expr("vid = near and share = other"))
           .join(side("vid", "share", "a"), ["vid", "share"]).join(side("near", "other", "b"), ["near", "other"])
           .select("own", "distance", F.explode("a").alias("a"), "b").select("own", "distance", "a", F.explode("b").alias("b")))
    if not once:        # rows of one vector that share their id
        met = (met.select("own", "distance", "a.id", F.col("b.id").alias("b"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("a.times") * F.col("b.times"))))
               .withColumnRenamed("id", "a"))
    # a share beside itself gives its pairs in both orders, two shares in one
    return met.where("a < b or (a > b and not own)").select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"), "distance")


def eps_join(points: DataFrame, eps: float, copies: bool = True, digits: int | None = None) -> DataFrame:
    """(left, right, distance) with left < right: every pair of rows within ``eps``. The result itself holds all such
    pairs; use ``eps_counts`` where only their number is wanted. No rows give no rows. Distances are rounded to ``digits``
    if given, once for each pair of vectors and not of rows.

    Without ``copies``, rows of equal vectors are one class named by its least id: every pair of classes within ``eps``
    (should two classes have one name, also left = right), and a row (name, id, 0) for every member of a greater id."""
    tree = grow(points, great=False)
    if tree is None:
        return points.select(F.col("id").alias("left"), F.col("id").alias("right"), F.lit(0.0).alias("distance"))
    dealt, spread = meetings(_merged(points), tree, ["vid", "x"], radius=eps, block=max(1, FOUND // CHUNK))

    def close(key, left, right):
        if left.empty or right.empty:
            return nothing(vid=object, near=object, distance=float)
        rows, cols, d = _near_pairs(_vectors(left["x"]), _vectors(right["x"]), np.full(len(left), eps))
        return pd.DataFrame({"vid": left["vid"].to_numpy()[rows], "near": right["vid"].to_numpy()[cols], "distance": d})

    pairs = _together(dealt, spread, close, "vid string, near string, distance double")
    if digits is not None:
        pairs = rounded(pairs, digits)
    if copies:
        return _row_pairs(pairs, points, tree.leaves)
    # a vector that holds no number or an infinite one is near nothing, its copies neither
    whole = F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    named = written(tree.leaves.where(whole).select("vid", "n", F.col("least").alias("left")))
    links = (pairs.where("vid <> near").join(named.drop("n"), "vid").join(named.select(F.col("vid").alias("near"), F.col("left").alias("right")), "near")
             .where("left < right or (left = right and vid < near)").select("left", "right", "distance"))
    members = (members_of(points).join(named.where("n > 1").select("vid", "left"), "vid").where((F.col("left") < F.col("id")) & (F.lit(eps) >= 0))
               .select("left", F.col("id").alias("right"), F.lit(0.0).alias("distance")))
    return links.unionByName(members)


def impute_knn(df: DataFrame, key: str, columns: list[str], k: int = 5) -> DataFrame:
    """Each missing number takes the mean of the ``k`` rows nearest in the other columns (scaled, means for their holes)."""
    from ..functions.columns import missing, number
    from .prep import impute_mean, scale_standard
    scaled = scale_standard(impute_mean(df.select(at(key), *[number(df, c).alias(c) for c in columns]), columns), columns)
    out = df
    for c in columns:
        others = [o for o in columns if o != c]
        holes = df.where(missing(df, c)).select(at(key).alias("_k"))
        if holes.isEmpty():
            continue
        points = vectors(scaled, key, others)
        near = knn_join(points.join(holes, points["id"] == F.col("_k"), "left_semi"), points.join(holes, points["id"] == F.col("_k"), "left_anti"), k)
        values = df.select(at(key).alias("neighbour"), number(df, c).alias("_v"))
        means = near.join(values, "neighbour").groupBy("id").agg(F.avg("_v").alias("_m"))
        out = out.join(means.withColumnRenamed("id", "_id"), at(key) == F.col("_id"), "left").select(*[
            F.coalesce(number(out, c), F.col("_m")).alias(c) if n == c else at(n) for n in out.columns])
    return out
