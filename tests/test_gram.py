"""Pairwise sums in one pass against the aggregates, and chained regressions against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import prep, profile
from tablewright.plans import gram


def frame(spark, x, names):
    rows = [tuple(None if np.isnan(v) else float(v) for v in row) for row in x]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(3)


def test_products_equal_the_aggregates(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 9)) @ rng.normal(size=(9, 9)) + 1e4
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 1] = 7.1                                          # constant
    x[:, 2] = np.nan                                       # empty
    x[:, 3] = np.where(np.isnan(x[:, 0]), x[:, 3], 0.1)    # constant where column 0 is present
    x[5, 4] = np.inf
    x[:, 5] *= 1e160                                       # squares are beyond doubles
    x[:, 6] = 1e9 + np.arange(300) % 2                     # large mean, small spread
    df = frame(spark, x, [f"c.{i}" for i in range(9)])
    wide = {(r.left, r.right): (r.pair, r.r) for r in profile.corr_pairs(df, per_pass=10).collect()}
    slim = {(r.left, r.right): (r.pair, r.r) for r in profile.corr_pairs(df).collect()}
    assert wide.keys() == slim.keys() and len(wide) == 36
    for pair, (place, r) in slim.items():
        assert wide[pair][0] == place
        assert (wide[pair][1] is None) == (r is None), pair
        if r is not None:
            a, b = (x[:, int(c[2:])].astype(np.longdouble) for c in pair)
            both = ~np.isnan(a) & ~np.isnan(b)
            a, b = a[both] - a[both].mean(), b[both] - b[both].mean()
            true = float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))
            # one running mean near 1e9 costs the aggregates digits that the centred products keep
            assert wide[pair][1] == pytest.approx(true, abs=1e-9) and r == pytest.approx(true, abs=1e-6), pair
    assert profile.corr_pairs(df.where("`c.1` < 0"), per_pass=10).where("r IS NOT NULL").count() == 0


def test_many_columns_take_one_pass(spark, monkeypatch):
    names = [f"c{i}" for i in range(120)]
    x = np.random.default_rng(2).normal(size=(200, 120))
    asked = []
    monkeypatch.setattr(gram, "totals", lambda df, *rest, own=gram.totals: asked.append(1) or own(df, *rest))
    found = profile.corr_pairs(frame(spark, x, names), names).collect()
    assert len(asked) == 1 and len(found) == 7140
    true = np.corrcoef(x.T)
    assert max(abs(r.r - true[int(r.left[1:]), int(r.right[1:])]) for r in found) < 1e-9


def brute_fill(x, rounds):
    gap = np.isnan(x)
    out = np.where(gap, np.nanmean(x, axis=0), x)
    for _ in range(rounds):
        for c in np.flatnonzero(gap.any(axis=0)):
            a = np.c_[np.ones(len(x)), np.delete(out, c, 1)]
            fit = np.linalg.lstsq(a[~gap[:, c]], x[~gap[:, c], c], rcond=None)[0]
            out[gap[:, c], c] = a[gap[:, c]] @ fit
    return out


def test_chained_regressions_equal_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(250, 4)) @ rng.normal(size=(4, 4)) + [0, 100, -5, 1e5]
    x[:, :3][rng.random((250, 3)) < 0.2] = np.nan
    names = ["a", "b.c", "d", "e"]
    df = frame(spark, np.c_[np.arange(250), x], ["id", *names]).withColumn("none", F.lit(None).cast("double")).withColumn("text", F.lit("t"))
    out = prep.impute_iterative(df, [*names, "none"])
    assert out.columns == df.columns
    rows = sorted(out.collect(), key=lambda r: r.id)
    assert np.array([[r[n] for n in names] for r in rows]) == pytest.approx(brute_fill(x, 3), rel=1e-8, abs=1e-6)
    assert {(r.none, r.text) for r in rows} == {(None, "t")}
    kept = {int(i): v for i, v in enumerate(x[:, 3])}
    assert all(r.e == kept[int(r.id)] for r in rows)                         # observed values keep every bit


def test_nothing_to_fill(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert prep.impute_iterative(df, ["a", "b"]).collect() == df.collect()
    assert prep.impute_iterative(df.where("a < 0"), ["a", "b"]).collect() == []
