"""Many classes, strict rule files, whole advice, lossless streams, empty inputs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import balance, clusters, neighbours, prep
from tablewright.plans import positions, rules
from tablewright.streaming import jobs


def test_twenty_thousand_classes(spark):
    rows = spark.range(60_000).select("id", F.when(F.col("id") < 20_000, F.col("id")).otherwise(F.lit(0)).alias("c"), F.lit(1.5).alias("x"))
    few = rows.where("c > 0 or id < 3")
    grown = balance.oversample_random(few, "c", ["id"], {c: 2 for c in range(1, 20_000)})
    assert grown.count() == 3 - 2 + 2 * 19_999 and grown.groupBy("c").count().where("c > 0 and count <> 2").isEmpty()
    assert balance.undersample_random(rows, "c", ["id"]).count() == 20_000


def test_hash_cut_matches_sorting_for_groups(spark):
    from tablewright.functions.draws import digest
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("g"))
    wanted = {0: 3, 1: 700, 2: 10_000, 3: 0}
    got = {(r.g, r.id) for r in positions.hash_cut(df, ["id"], 5, wanted, "g").where("_first").collect()}
    ranked = [(r.g, r.id) for r in df.orderBy(digest(["id"], 5, "order"), "id").collect()]
    assert got == {x for g, m in wanted.items() for x in [y for y in ranked if y[0] == g][:m]}


def test_rule_files_are_read_strictly(tmp_path):
    file = tmp_path / "own.yaml"
    file.write_text("feature_selection:\n  - {correlation_gt: 0.95, action: a, why: b}\n  - {information_gain_lt: 0.01, action: c, why: d}\n")
    with pytest.raises(ValueError, match="own.yaml.*feature_selection.*information_gain_lt"):
        rules.rules_load(file)
    assert rules.condition_sql("data_quality", {"inconsistent_ratio_gt": 0.05}) == "inconsistent_ratio > 0.05"
    assert rules.condition_sql("distribution", {"skew": 2, "kurt": 7, "unique_lt": 20}, "or") == "(abs(skew) > 2 or kurt > 7) and unique_count < 20"


TEXT_ONLY = {"gaussian_mixture", "kde_estimation", "text_preprocessing", "seasonal_decomposition"}      # advice in words: no operator stands behind it


def test_every_advised_action_is_known():
    advised = {a for sections in rules.rules_load("preprocess").values() for s in sections for r in s.rules for a in r.actions}
    assert advised - set(prep.ACTIONS) - set(prep.KEYED) - prep.NOTHING - {"target_encode"} == TEXT_ONLY


def test_actions_with_keys_and_dates(spark):
    rows = [(i, float(i % 9) if i % 5 else None, float(i % 7), f"2024-0{1 + i % 9}-1{i % 9} 0{i % 10}:30:00", "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, y double, day string, kind string")
    advice = [("x", a) for a in ("advanced_imputation_mice", "iqr_method", "uniform_scaling", "isolation_forest", "no_transform_needed")] + [("day", a) for a in ("lag_features", "datetime_extraction", "time_based_features", "cyclical_encoding")]
    advice += [("kind", "target_encode"), ("y", "cyclical_encoding"), ("day", "datetime_cleaning"), ("y", "kde_estimation")]
    out, log = prep.apply_advice(df, advice, key="id", target="y")
    assert [s for _, _, s in log] == ["done"] * 12 + ["unknown"]
    assert out.where("x is null").count() == 0 and out.count() == 60 and {"x_outlier", "outlier", "day_year", "day_minute", "day_hour_sin", "y_sin", "x_lag_3"} <= set(out.columns)
    assert prep.apply_advice(df.withColumn("z", F.col("y") * 2), [("_all", "remove_collinear")])[0].columns == df.columns
    assert "y_rolling_std" in prep.apply_advice(df, [("day", "rolling_statistics")], key="id")[0].columns
    assert [s for _, _, s in prep.apply_advice(df, [("x", "knn_imputation"), ("kind", "target_encode")])[1]] == ["needs key", "needs target"]
    assert prep.apply_advice(df, [("x", "knn_imputation")], key="id")[0].where("x is null").count() == 0
    assert prep.apply_advice(df, [("kind", "log_transform")]) == (df, [("kind", "log_transform", "failed: not numeric")])


def test_onehot_vector(spark):
    df = spark.createDataFrame([(i, None if i == 7 else f"v{i % 1500:04}") for i in range(3000)], "id long, v string")
    got = {r.id: r.v_onehot for r in prep.encode_onehot_vector(df, "v").collect()}
    assert got[3].indices.tolist() == [3] and got[1503].indices.tolist() == [3] and len(got[3]) >= 1500 and got[1499].indices.tolist() == [1499]


def test_resampling_loses_no_late_file(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    days = [dt.datetime(2024, 1, 9), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 9, 5), dt.datetime(2024, 1, 1)]
    for i, t in enumerate(days):
        spark.createDataFrame([(t, float(i)), (None, 9.0)], "t timestamp_ntz, v double").coalesce(1).write.mode("append").parquet(str(source))
        jobs.resample_stream(spark, str(source), "*.parquet", spark.read.parquet(str(source)).schema, "t", "v", out, mark)
    got = {r.start.day: (r.v, r.n) for r in jobs.resampled(spark, out, "v").collect()}
    assert got == {9: (1.0, 2), 2: (1.0, 1), 1: (3.0, 1)}


def test_progress_of_many_steps(spark, tmp_path):
    out = str(tmp_path / "out")
    spark.range(300).select("id", F.expr("id div 2").alias("batch_id")).write.partitionBy("batch_id").parquet(out)
    rows = jobs.progress_log(spark, out, 300).collect()
    assert [r.files for r in rows][-1] == 300 and rows[-1].batch_id == 149 and len(rows) >= 10


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "id long, x array<double>")
    assert neighbours.eps_counts(none, 1.0).count() == 0 and neighbours.eps_join(none, 1.0).count() == 0 and clusters.cluster_dbscan(none, 1.0, 2).count() == 0
    holes = spark.createDataFrame([(1, None), (2, None)], "id long, v double")
    assert prep.winsorize(holes, "v").count() == 2


def test_thousand_ties(spark):
    pts = spark.createDataFrame([(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(1000)] + [(-1, [0.0, 0.0])], "id long, x array<double>")
    ring = pts.where("id >= 0").select("id", F.array(F.lit(1.0), F.lit(0.0), F.col("id") * 0.0).alias("x"))
    assert ring.count() == 1000
    near = neighbours.knn_join(pts.where("id = -1"), pts.where("id >= 0"), 5).collect()
    assert len(near) == 5 and max(abs(r.distance - 1) for r in near) < 1e-9
    grid = spark.createDataFrame([(i, [float(i % 2 * 2 - 1), 0.0] if i % 4 < 2 else [0.0, float(i % 2 * 2 - 1)]) for i in range(400)] + [(-1, [0.0, 0.0])], "id long, x array<double>")
    got = neighbours.knn_join(grid.where("id = -1"), grid.where("id >= 0"), 7).orderBy("rank").collect()
    assert [r.neighbour for r in got] == list(range(7))


def test_silhouette_is_that_of_squared_distances(spark):
    draw = np.random.default_rng(2)
    x = np.concatenate([draw.normal(size=(30, 3)), draw.normal(size=(20, 3)) + 3])
    lab = [0] * 30 + [1] * 20
    pts = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    got = clusters.cluster_scores(pts, spark.createDataFrame(list(enumerate(lab)), "id long, cluster long")).first()
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    lab = np.array(lab)
    a = np.array([d[i][lab == lab[i]].sum() / ((lab == lab[i]).sum() - 1) for i in range(50)])
    b = np.array([d[i][lab != lab[i]].mean() for i in range(50)])
    assert got.silhouette == pytest.approx(((b - a) / np.maximum(a, b)).mean()) and got.silhouette_kind == "squared"


def test_constant_columns_have_no_correlation(spark):
    from tablewright.operators import profile
    df = spark.createDataFrame([(float(i), 3.0, float(-2 * i)) for i in range(9)], "a double, b double, c double")
    assert {(r.left, r.right): r.r for r in profile.corr_pairs(df).collect()} == {("a", "b"): None, ("a", "c"): pytest.approx(-1), ("b", "c"): None}
