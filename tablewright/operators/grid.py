"""The exact steps of DBSCAN for few dimensions, over a grid.

Cells are so small that all rows of a cell lie within the radius of each other, so a cell with enough rows holds core rows
only and is one node of the graph of clusters, however many rows it has. Distances are measured for rows of cells with
fewer rows, and between neighbouring cells whose link is not shown by their outermost vectors and whose clusters are not
joined by other cells. Rows are known by their coordinates; equal vectors are merged.
"""

from __future__ import annotations

from itertools import product
from math import inf, sqrt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import at
from ..session import written

DIMS = 3                # most dimensions of a grid: a cell has 5 ** DIMS neighbours
SHRUNK = 1 - 1e-6       # so that rounding parts no cell beyond the radius
FAR = 2.0 ** 31         # cells from zero up to which cell numbers are that exact


class Grid:
    """Cells of side ``eps / sqrt(dims)``, a little less."""

    def __init__(self, eps: float, dims: int):
        self.eps, self.dims, self.side = eps, dims, eps / sqrt(dims) * SHRUNK
        self.x, self.c = [f"x{i}" for i in range(dims)], [f"c{i}" for i in range(dims)]

    def rows(self, pts: DataFrame) -> DataFrame:
        """(id, coordinates, cell numbers) of the rows whose coordinates are numbers; no other row is near anything."""
        flat = pts.select("id", *[(F.get("x", F.lit(i)) + F.lit(0.0)).alias(c) for i, c in enumerate(self.x)])
        finite = [at(c).isNotNull() & (F.abs(c) < F.lit(inf)) for c in self.x]
        return flat.where(_all(finite)).withColumns({c: F.floor(at(x) / F.lit(self.side)) for x, c in zip(self.x, self.c)})

    def around(self, df: DataFrame) -> DataFrame:
        """Every row once for each cell that may hold rows within ``eps``: the cell numbers are that cell's."""
        steps = F.array(*[F.array(*map(F.lit, s)) for s in product(range(-2, 3), repeat=self.dims)])
        return df.withColumn("_s", F.explode(steps)).withColumns({c: at(c) + F.col("_s")[i] for i, c in enumerate(self.c)}).drop("_s")

    def name(self) -> Column:
        return F.concat_ws(",", *self.c)

    def close(self, a: list[Column], b: list[Column]) -> Column:
        gaps = [u - v for u, v in zip(a, b)]
        return F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])) <= F.lit(self.eps)


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def grid_of(pts: DataFrame, eps: float, min_points: int) -> Grid | None:
    """The grid of (id, x), or nothing where it does not apply: many dimensions, vectors of several lengths, a radius that is
    no number above 0 or far too small beside the coordinates."""
    if not (0 < eps < inf) or min_points < 1 or "g" in pts.columns:
        return None
    size = F.size("x")
    top = F.aggregate("x", F.lit(0.0), lambda s, v: F.when(F.abs(v) < F.lit(inf), F.greatest(s, F.abs(v))).otherwise(s))
    row = pts.agg(F.min(size).alias("least"), F.max(size).alias("most"), F.max(top).alias("top")).first()
    if row["least"] is None or row["least"] != row["most"] or not 1 <= row["least"] <= DIMS:
        return None
    grid = Grid(eps, row["least"])
    return grid if (row["top"] or 0.0) / grid.side < FAR else None


def core_ids(pts: DataFrame, grid: Grid, min_points: int) -> DataFrame:
    """``id`` of the rows with ``min_points`` rows within the radius, themselves included."""
    x, c = grid.x, grid.c
    rows = written(grid.rows(pts))
    merged = written(rows.groupBy(*x, *c).agg(F.count(F.lit(1)).alias("n")))
    full = written(merged.groupBy(*c).agg(F.sum("n").alias("rows")).where(F.col("rows") >= min_points).select(*c))
    asked = grid.around(merged.join(full, c, "left_anti").select(*x, *c))
    others = merged.select(*[at(k).alias(f"o{k}") for k in x], *c, "n")
    near = asked.join(others, c).where(grid.close([at(k) for k in x], [at(f"o{k}") for k in x]))
    found = written(near.groupBy(*x).agg(F.sum("n").alias("rows")).where(F.col("rows") >= min_points).select(*x))
    return rows.join(full, c, "left_semi").select("id").unionByName(rows.join(found, x, "left_semi").select("id"))


def core_labels(core: DataFrame, grid: Grid, components) -> DataFrame:
    """(coordinates, cell numbers, label) of the vectors of core rows: the least id of all rows that links join."""
    x, c = grid.x, grid.c
    held = written(grid.rows(core).groupBy(*x, *c).agg(F.min("id").alias("node")).withColumn("cell", grid.name()))
    ways = [w for w in product((-1, 0, 1), repeat=grid.dims) if any(w)]
    point = F.array(*x)
    outer = F.array_distinct(F.array(*[F.max_by(point, sum((at(k) * F.lit(float(s)) for k, s in zip(x, w)), F.lit(0.0))) for w in ways]))
    cells = written(held.groupBy("cell", *c).agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("m"), outer.alias("outer"),
                                                 *[F.min(k).alias(f"low_{k}") for k in x], *[F.max(k).alias(f"high_{k}") for k in x]))
    # neighbouring cells, and whether some of their outermost vectors are near; where these are all vectors, they decide
    other = cells.select(*c, F.col("cell").alias("b"), F.col("outer").alias("outer_b"), (F.size("outer") < F.col("m")).alias("more_b"))
    pairs = grid.around(cells.select(*c, F.col("cell").alias("a"), "outer", (F.size("outer") < F.col("m")).alias("more"))).join(other, c).where("a < b")
    spread = lambda v: [F.get(v, F.lit(i)) for i in range(grid.dims)]
    near = F.exists("outer", lambda u: F.exists("outer_b", lambda v: grid.close(spread(u), spread(v))))
    pairs = written(pairs.select("a", "b", near.alias("near"), (F.col("more") | F.col("more_b")).alias("more")))
    # vectors with one least id are one node, in whatever cells they lie
    shared = held.groupBy("node").agg(F.min("cell").alias("a"), F.max("cell").alias("z")).where("a <> z").select("node", "a")
    same = held.join(shared, "node").where("cell <> a").select("a", F.col("cell").alias("b"))
    joined = components(cells.select(F.col("cell").alias("node")), pairs.where("near").select("a", "b").unionByName(same))
    named = lambda side: joined.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
    doubt = written(pairs.where("more AND NOT near").select("a", "b").join(named("a"), "a").join(named("b"), "b").where("label_a <> label_b"))
    if not doubt.isEmpty():
        links = _measured(doubt, held, cells, grid)
        further = components(joined.select(F.col("label").alias("node")).distinct(), links).withColumnRenamed("label", "whole")
        joined = joined.join(further.withColumnRenamed("node", "label"), "label").select("node", F.col("whole").alias("label"))
    least = cells.select("cell", F.col("node").alias("least")).join(joined.withColumnRenamed("node", "cell"), "cell")
    least = least.select("cell", F.col("label").alias("part"), "least")
    labels = least.select("cell", "part").join(least.groupBy("part").agg(F.min("least").alias("label")), "part").select("cell", "label")
    return written(held.join(labels, "cell").select(*x, *c, "label"))


def _measured(doubt: DataFrame, held: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """(a, b) labels of those doubtful pairs of cells that have vectors within the radius; vectors out of reach of the other cell's box stay away."""
    reach = grid.eps * (1 + 1e-9)

    def side(own: str, across: str) -> DataFrame:
        box = cells.select(F.col("cell").alias(across), *[at(f"low_{k}") for k in grid.x], *[at(f"high_{k}") for k in grid.x])
        gaps = [F.greatest(at(f"low_{k}") - at(k), at(k) - at(f"high_{k}"), F.lit(0.0)) for k in grid.x]
        meets = held.select(F.col("cell").alias(own), *grid.x).join(doubt.select("a", "b").join(box, across), own)
        meets = meets.where(sum((g * g for g in gaps), F.lit(0.0)) <= F.lit(reach * reach))
        return meets.select("a", "b", *[at(k).alias(f"{own}{k}") for k in grid.x])

    left, right = side("a", "b"), side("b", "a")
    near = grid.close([at(f"a{k}") for k in grid.x], [at(f"b{k}") for k in grid.x])
    right = right.withColumnRenamed("a", "_a").withColumnRenamed("b", "_b")
    found = left.join(right, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & near, "left_semi").select("a", "b").distinct()
    return found.join(doubt, ["a", "b"]).select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))


def border(rest: DataFrame, labelled: DataFrame, grid: Grid) -> DataFrame:
    """(id, label) of non-core rows near a core row: the least label."""
    x, c = grid.x, grid.c
    rows = written(grid.rows(rest))
    others = labelled.select(*[at(k).alias(f"o{k}") for k in x], *c, "label")
    near = grid.around(rows.select(*x, *c).distinct()).join(others, c).where(grid.close([at(k) for k in x], [at(f"o{k}") for k in x]))
    return rows.join(near.groupBy(*x).agg(F.min("label").alias("label")), x).select("id", "label")
