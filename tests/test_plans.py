"""Quantiles, positions and blocks: exact whatever the size limits, partitioning and skew."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from tablewright.operators import timeseries as ts
from tablewright.operators.augment import repeat_rows
from tablewright.plans import positions, quantiles as q


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the values are one value; some missing, some infinite-looking tails."""
    rng = random.Random(3)
    rows = [(i, 5.0 if i % 3 == 0 else (None if i % 17 == 0 else rng.lognormvariate(0, 3) * (-1 if i % 5 == 0 else 1)), "hot" if i % 3 == 0 else f"g{i % 7}") for i in range(3000)]
    return spark.createDataFrame(rows, "id long, v double, g string").cache()


@pytest.mark.parametrize("small", [1, 20, 500, 100000])
def test_quantiles_are_exact_at_every_limit(skewed, small, monkeypatch):
    monkeypatch.setattr(q, "SAMPLES", (200, 400))
    probs = [0.0, 0.01, 0.25, 0.333, 0.5, 0.77, 0.99, 1.0]
    want = np.quantile([r.v for r in skewed.where("v is not null").collect()], probs)
    got = q.quantiles(skewed, ["v"], probs, small=small)["v"]
    assert np.allclose(got, want, rtol=1e-12)


def test_quantiles_of_nothing_and_one_value(spark):
    df = spark.createDataFrame([(None, 2.0), (None, 2.0)], "a double, b double")
    assert q.quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [2.0]}


def test_grouped_quantiles_with_hot_group(skewed):
    got = {r["g"]: r["q"] for r in q.grouped_quantiles(skewed, "g", "v", [0.25, 0.5], small=300).collect()}
    pdf = skewed.toPandas().dropna()
    for g, part in pdf.groupby("g"):
        assert np.allclose(got[g], np.quantile(part["v"], [0.25, 0.5]))


@pytest.mark.parametrize("few", [0, 50_000])
def test_many_great_groups_are_searched_together(spark, monkeypatch, few):
    """Ties, both signs, infinite ends, zeros of both signs and sixty orders of magnitude; ranges broadcast or salted."""
    monkeypatch.setattr(q, "FEW", few)
    monkeypatch.setattr(q, "SALTS", 4)
    rng = random.Random(5)
    shapes = [lambda: rng.gauss(0, 1), lambda: 10.0 ** rng.uniform(-30, 30), lambda: -(10.0 ** rng.uniform(-300, 300)), lambda: float(rng.randint(-2, 2)),
              lambda: rng.choice([0.0, -0.0, 5e-324, 1e300]), lambda: rng.choice([float("inf"), float("-inf"), rng.random()]), lambda: 7.0]
    rows = [(f"g{j}", shapes[j % len(shapes)]()) for j in range(40) for _ in range(60 if j % 3 else 5)] + [(None, 1.0), ("g0", None), ("none", None), ("g0", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: (r["n"], r["q"]) for r in q.grouped_quantiles(df, "g", "v", probs, small=10).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v"]).dropna()
    assert set(got) == set(pdf["g"])
    for g, part in pdf.groupby("g"):
        v = np.sort(part["v"].to_numpy())
        places = [(len(v) - 1) * p for p in probs]
        want = [v[int(h)] if h == int(h) or v[int(h)] == v[int(h) + 1] else v[int(h)] + (v[int(h) + 1] - v[int(h)]) * (h - int(h)) for h in places]
        assert got[g][0] == len(v)
        np.testing.assert_allclose(got[g][1], want, rtol=1e-12)


def test_grouped_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", None)], "g string, v double")
    assert q.grouped_quantiles(df, "g", "v", [0.5], small=1).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("m", [0, 1, 1234, 3000, 5000])
def test_hash_cut_takes_the_first_rows_of_the_digest_order(skewed, parts, m):
    from tablewright.functions.draws import digest
    want = {r.id for r in skewed.orderBy(digest(["id"], 1, "order"), "id").limit(m).collect()}
    got = positions.hash_cut(skewed.repartition(parts), ["id"], 1, m)
    assert got.count() == 3000 and {r.id for r in got.where("_first").collect()} == want


def test_hash_cut_per_group(skewed):
    got = positions.hash_cut(skewed, ["id"], 1, {"hot": 10, "g1": 99999}, "g").where("_first").groupBy("g").count()
    sizes = {r["g"]: r["count"] for r in got.collect()}
    assert sizes == {"hot": 10, "g1": skewed.where("g = 'g1'").count()}


def test_shuffled_positions_number_all_rows(skewed):
    pos = sorted(r._pos for r in positions.shuffled_positions(skewed, ["id"], 5).collect())
    assert pos == list(range(3000))


def test_ordered_positions_split_a_hot_value(skewed):
    rows, n = positions.ordered_positions(skewed, ["g", "id"])
    assert n == 3000
    want = {r.id: i for i, r in enumerate(skewed.orderBy("g", "id").collect())}
    assert {r.id: r._pos for r in rows.collect()} == want


@pytest.fixture(scope="module")
def series(spark):
    rows = [(i, f"2024-01-{1 + (i // 40) % 28:02d} 00:00:00", "a" if i % 3 else "b", None if i % 4 == 1 else float(i * i % 97)) for i in range(400)]
    return spark.createDataFrame(rows, "id long, t string, s string, v double").withColumn("t", F.col("t").cast("timestamp_ntz")).cache()


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_frames_across_blocks(series, block, monkeypatch):
    monkeypatch.setattr(positions, "BLOCK", block)
    monkeypatch.setattr(positions, "BLOCKS", 10 ** 9)
    for parts in ([], ["s"]):
        w = Window.partitionBy(*parts).orderBy("t", "id")
        known = series.na.fill(0.0)
        want = known.withColumn("v", F.lag("v", 9).over(w)).na.drop("any")
        assert sorted(ts.ts_shift(known, "t", ["id"], 9, parts, ["v"]).collect()) == sorted(want.select(*series.columns).collect())
        want = known.withColumn("v", F.lead("v", 2).over(w)).na.drop("any")
        assert sorted(ts.ts_shift(known, "t", ["id"], -2, parts, ["v"]).collect()) == sorted(want.select(*series.columns).collect())
        frame = w.rowsBetween(-2, 2)
        want = known.withColumn("v", F.when(F.count("v").over(frame) == 5, F.avg("v").over(frame))).na.drop("any")
        assert sorted(ts.ts_window_average(known, "t", ["id"], 5, parts, ["v"]).collect()) == sorted(want.collect())
        key = lambda rows: sorted((r.id, r.v is None, r.v or 0) for r in rows)
        want = series.withColumn("v", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        assert key(ts.ffill(series, "t", ["id"], ["v"], parts).collect()) == key(want.collect())
        want = series.withColumn("v", F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
        assert key(ts.bfill(series, "t", ["id"], ["v"], parts).collect()) == key(want.collect())


@pytest.mark.parametrize("freq", ["D", "W", "M", "Q", "Y"])
def test_resample_as_pandas(spark, freq):
    rows = [(f"2023-{m:02d}-{d:02d}", float(m * d)) for m in (1, 2, 3, 8, 12) for d in (1, 9, 28)]
    df = spark.createDataFrame(rows, "t string, v double")
    got = {r.t: r.v for r in ts.ts_resample(df, "t", freq).collect()}
    pdf = pd.DataFrame(rows, columns=["t", "v"]).assign(t=lambda x: pd.to_datetime(x.t)).set_index("t")
    want = pdf.resample({"M": "ME", "Q": "QE", "Y": "YE"}.get(freq, freq)).mean()["v"]
    assert list(got) and set(got) == {t.to_pydatetime() for t in want.index}
    for t, v in want.items():
        assert (got[t.to_pydatetime()] is None) == bool(np.isnan(v)) and (np.isnan(v) or got[t.to_pydatetime()] == pytest.approx(v))


def test_many_copies_of_one_row(spark):
    df = spark.createDataFrame([(1, 2500), (2, 0), (3, 1)], "id long, c int")
    rows = repeat_rows(df, F.col("c"), 2500, "copy").groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("u"), F.max("copy").alias("m")).collect()
    assert {(r.id, r.n, r.u, r.m) for r in rows} == {(1, 2500, 2500, 2499), (3, 1, 1, 0)}
