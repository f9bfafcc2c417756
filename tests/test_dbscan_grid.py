"""DBSCAN over a grid and over the metric tree, against all distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from tablewright.operators import clusters, grid


def brute(rows, eps, least):
    kept = [(i, v) for i, v in rows if all(a is not None and np.isfinite(a) for a in v)]
    ids, x = np.array([i for i, _ in kept]), np.array([v for _, v in kept])
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core, none = near.sum(1) >= least, ids.max() + 1
    label = np.where(core, ids, none)
    while True:
        new = np.array([label[n & core].min(initial=none) if c else none for n, c in zip(near, core)])
        if (new == label).all():
            break
        label = new
    label = np.array([label[n & core].min(initial=none) for n in near])
    rank = {v: i for i, v in enumerate(sorted({v for v in label if v < none}))}
    found = {i: rank.get(v, -1) for i, v in zip(ids, label)}
    return {i: found.get(i, -1) for i, _ in rows}


@pytest.mark.parametrize("dims, scale, eps, least", [(1, 30, 0.5, 3), (2, 4, 1.0, 4), (3, 1, 0.4, 3)])
def test_grid_gives_the_clusters_of_all_distances(spark, dims, scale, eps, least):
    x = np.round(np.random.default_rng(dims).normal(size=(150, dims)) * scale, 1)
    rows = [(i * 3, v.tolist()) for i, v in enumerate(np.vstack([x, x[:7]]))]
    rows += [(9001, [None] * dims), (9002, [float("nan")] * dims), (9003, [float("inf")] * dims)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    assert grid.grid_of(df, eps, least) is not None
    assert dict(map(tuple, clusters.cluster_dbscan(df, eps, least).collect())) == brute(rows, eps, least)


def test_full_cells_that_only_inner_vectors_link(spark):
    """Two rows of points whose outermost vectors are too far apart; a pair between them is near."""
    side = grid.Grid(1.0, 2).side
    left = [(0.01 * side, y * side) for y in (0.02, 0.98)] + [(0.97 * side, 0.5 * side)] + [(0.98 * side, y * side) for y in (0.01, 0.99)]
    rows = [(i, list(v)) for i, v in enumerate(left)] + [(10 + i, [v[0] + 40, v[1]]) for i, v in enumerate(left)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    assert dict(map(tuple, clusters.cluster_dbscan(df, 1.0, 2).collect())) == brute(rows, 1.0, 2)


def test_a_crowded_spot_makes_no_pairs(spark):
    """Full cells are not met row by row: neighbours of 3,000 rows in one spot would be 9,000,000 pairs."""
    df = spark.range(3000).selectExpr("id", "array(id / 10000.0D, 0.0D) AS x")
    ids = grid.core_ids(df, grid.grid_of(df, 2.0, 4), 4)
    assert ids.count() == 3000 and grid.grid_of(df, 0.0, 4) is None


def test_many_dimensions_hold_a_strip_of_a_block(spark, monkeypatch):
    """Forest and border of the metric tree, with blocks measured two vectors at a time."""
    seen = []
    within = clusters._within
    rows = [(i, v.tolist()) for i, v in enumerate(np.round(np.random.default_rng(5).normal(size=(60, 9)), 1) * 0.5)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    assert grid.grid_of(df, 1.5, 4) is None
    taken = {}
    monkeypatch.setattr(clusters, "STRIP", 120)
    monkeypatch.setattr(clusters, "_within", lambda a, b, eps: seen.append(len(a)) or within(a, b, eps))
    monkeypatch.setattr(clusters, "meetings", lambda *a, **k: (None, None))
    monkeypatch.setattr(clusters, "_together", lambda dealt, spread, work, schema: taken.update(work=work) or df.selectExpr("'a' AS a", "'b' AS b"))
    monkeypatch.setattr(clusters, "grow", lambda df: None)
    clusters._core_links(df, 1.5)
    block = pd.DataFrame({"vid": [str(i) for i, _ in rows], "x": [v for _, v in rows]})
    found = taken["work"](None, block, block)
    assert max(seen) == 2
    joined = {v: v for v in block["vid"]}
    for a, b in zip(found["a"], found["b"]):
        old, new = joined[a], joined[b]
        joined = {k: new if v == old else v for k, v in joined.items()}
    want = brute(rows, 1.5, 1)
    pairs = lambda of: {(i, j) for i in of for j in of if of[i] == of[j]}
    assert pairs({int(k): v for k, v in joined.items()}) == pairs(want)
