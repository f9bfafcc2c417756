"""What the last findings of round three asked for: figures that grow with the input."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tablewright.operators import neighbours


# ---- radius join --------------------------------------------------------------------

def placed(spark, rows):
    return spark.createDataFrame(rows, "id long, x array<double>")


def test_radius_join_names_copies_once(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 20)        # many leaves
    rng = np.random.default_rng(5)
    spots = rng.uniform(0, 4, (60, 2)).round(3)
    place = [*range(60), *rng.integers(0, 60, 60), *[0] * 300]
    ids = rng.permutation(len(place))
    rows = [(int(i), [float(v) for v in spots[p]]) for i, p in zip(ids, place)]
    pts = placed(spark, rows)
    short = [(r.left, r.right, r.distance) for r in neighbours.eps_join(pts, 0.8, copies=False).collect()]
    assert len(short) == len(set(short)) <= 60 * 59 / 2 + len(rows)
    # every pair of rows follows from the classes, and no other
    name = {i: i for i, _ in rows}
    name.update({b: a for a, b, d in short if d == 0})
    members = {}
    for i, c in name.items():
        members.setdefault(c, []).append(i)
    full = {(min(i, j), max(i, j)) for a, b, d in short if d > 0 for i in members[a] for j in members[b]}
    full |= {(i, j) for m in members.values() for i in m for j in m if i < j}
    assert full == {(r.left, r.right) for r in neighbours.eps_join(pts, 0.8).collect()}


def test_radius_join_with_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.0, 0.0]), (2, [0.0, -0.0]), (2, [0.0, 0.0]), (2, [0.5, 0.0]), (1, [0.0, 0.5]), (None, [0.0, 0.0]), (None, [9.0, 9.0]), (3, [9.0, 9.1]),
            (4, [None, 0.0]), (5, [None, 0.0]), (6, [nan, 0.0]), (7, [nan, 0.0]), (8, [inf, 0.0]), (9, [inf, 0.0])]
    got = sorted((r.left, r.right, round(r.distance, 6)) for r in neighbours.eps_join(placed(spark, rows), 0.6, copies=False).collect())
    assert got == [(1, 1, 0.5), (1, 2, 0.0), (1, 2, 0.0), (1, 2, 0.5)]
    assert neighbours.eps_join(placed(spark, []), 0.6, copies=False).count() == 0


def test_radius_join_blocks_hold_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 50)
    monkeypatch.setattr(neighbours, "FOUND", 100, raising=False)
    most = spark.sparkContext.accumulator(0)
    real = neighbours._together

    def counted(dealt, spread, work, schema):
        def over(key, left, right):
            out = work(key, left, right)
            most.add(int(len(out) > 12 * len(right)))
            return out
        return real(dealt, spread, over if "distance" in schema else work, schema)

    monkeypatch.setattr(neighbours, "_together", counted)
    pts = spark.range(200).select("id", F.array((F.col("id") / 1000.0), F.lit(0.0)).alias("x"))
    assert neighbours.eps_join(pts, 5.0).count() == 200 * 199 / 2 and most.value == 0


# ---- screening of pairs -------------------------------------------------------------

def test_pairs_are_screened_in_single_precision_without_loss():
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(300, 64)), rng.normal(size=(500, 64))
    b[:200] = a[:200] + rng.normal(size=(200, 64)) * np.repeat([1e-12, 1e-9, 1e-6, 1e-3], 50)[:, None]        # ties nearly
    with np.errstate(all="ignore"):
        for scale, shift, kind in [(1, 0, np.float32), (1, 1e4, np.float32), (1e-8, 0, np.float32), (1e-25, 0, np.float64), (1e25, 0, np.float64), (1e160, 0, np.float64)]:
            x, y = a * scale + shift, b * scale + shift
            assert all(q.dtype == kind for _, q, _, _ in neighbours._strips(x, y))
            d = neighbours._distances(x, y)
            for eps in (d[0, 0], np.median(d), d.max(), 0.0):
                assert (neighbours._within(x, y, eps) == (d <= eps)).all()
                rows, cols, near = neighbours._near_pairs(x, y, np.full(len(x), eps))
                assert {*zip(rows, cols)} == {*zip(*np.nonzero(d <= eps))} and (near == d[rows, cols]).all()
            rows, cols, near = neighbours._near_pairs(x, y, np.full(len(x), np.inf), 11)
            first = np.argsort(d, axis=1, kind="stable")[:, :11]
            assert (near.reshape(300, 11) == np.take_along_axis(d, first, 1)).all()
