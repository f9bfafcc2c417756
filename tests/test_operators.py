"""Advice on known columns, readers, neighbours, clusters, images, models, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import advice, augment, balance, clusters, images, models, neighbours, prep, select
from tablewright.operators.isolation import isolation_forest
from tablewright.plans.rules import condition_sql, rules_load
from tablewright.sources import tables
from tablewright.streaming import jobs


@pytest.fixture(scope="module")
def ten(spark):
    """Columns of known shape: constant, near normal, skewed, half empty, few and many categories, dates."""
    rng = np.random.default_rng(42)
    n = 1000
    rows = [(float(a), float(b), None if i % 100 < 55 else float(a), 100.0 + (i % 2) * 0.01, ["low", "medium", "high"][i % 3], f"c{i % 25}", f"u{i}", f"2024-{1 + i % 12:02d}-01")
            for i, (a, b) in enumerate(zip(rng.normal(50, 10, n), rng.pareto(2.2, n) + 0.1))]
    return spark.createDataFrame(rows, "normal_col double, very_skewed double, high_missing double, low_variance double, low_card string, medium_card string, very_high_card string, made_on string").cache()


def actions(df, column):
    return [r.action for r in df.where(F.col("column") == column).orderBy("position").collect()]


def test_advice_for_known_columns(ten):
    out = advice.advise_preprocessing(ten, ["very_high_card"]).cache()
    assert actions(out, "normal_col") == ["no_transform_needed", "iqr_method", "min_max_scaler", "drop_column"]      # identifier-like: all values distinct
    assert actions(out, "high_missing")[:2] == ["drop_column", "no_transform_needed"]
    assert actions(out, "low_variance")[1:3] == ["drop_constant", "iqr_method"]
    assert actions(out, "very_skewed")[0] in ("yeo_johnson_transform", "boxcox_transform", "log_transform")
    assert actions(out, "low_card") == ["one_hot_encode", "ordinal_encode"]
    assert actions(out, "medium_card") == ["ordinal_encode"]
    assert actions(out, "very_high_card") == ["feature_hashing"]
    assert actions(out, "made_on") == ["datetime_extraction", "cyclical_encoding", "lag_features", "rolling_statistics"]


def test_advice_does_not_depend_on_partitioning(ten):
    rows = lambda df: sorted(map(tuple, advice.advise_preprocessing(df, ["very_high_card"]).collect()))
    assert rows(ten.repartition(1)) == rows(ten.repartition(7))


def test_condition_maps_of_user_files(tmp_path, ten):
    path = tmp_path / "mine.yaml"
    path.write_text("numeric:\n  missing_ratio:\n    - {gt: 0.5, action: drop_it, why: empty}\n  scaling_strategy:\n    - {cv_gt: 100, action: never, why: no}\n    - {action: scale_it, why: default}\n"
                    "categorical:\n  cardinality_strategy:\n    - {lte: 3, action: few, why: few}\n    - {gt: 3, action: many, why: many}\n  ordinal_analysis:\n    - {values_contain: [low], action: ranked, why: order}\n")
    out = advice.advise_any_mode(ten, rules_load(path))
    assert actions(out, "high_missing") == ["drop_it", "scale_it"]
    assert actions(out, "low_card") == ["few", "ranked"] and actions(out, "medium_card") == ["many"]
    assert condition_sql("distribution", {"skew": 2, "kurt": 7}) == "abs(skew) > 2 and kurt > 7"
    assert condition_sql("distribution", {"kurt": 7}, "or") == "abs(skew) > 0 or kurt > 7"


@pytest.mark.parametrize("encoding", ["utf-8", "cp949", "euc-kr"])
def test_csv_in_korean_encodings(spark, tmp_path, encoding):
    text = ' 이름 ,나이,점수\n"가, 나",3,N/A\n똠방각하,4,1.5\n'.replace("똠", "똠" if encoding != "euc-kr" else "동")
    (tmp_path / "a.csv").write_bytes(text.encode(encoding))
    df = tables.scan_csv(spark, str(tmp_path))
    assert df.columns == ["이름", "나이", "점수"] and dict(df.dtypes) == {"이름": "string", "나이": "bigint", "점수": "double"}
    first = df.orderBy("나이").first()
    assert first["이름"] == "가, 나" and first["점수"] is None


def test_latin_bytes_fall_through_to_latin1(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("a,b\ncaf\xe9,\xff\n".encode("latin-1"))
    assert tables.detect_encoding(spark, str(tmp_path)) == "iso-8859-1"
    assert tables.scan_csv(spark, str(tmp_path)).first()["a"] == "caf\xe9"


@pytest.mark.parametrize("chunk,pivots", [(5, 3), (4000, 64)])
def test_neighbours_match_brute_force(spark, monkeypatch, chunk, pivots):
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    monkeypatch.setattr(neighbours, "PIVOTS", pivots)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 1, (60, 3)) * 4) / 4            # quarters: squares are exact, so ties are ties
    x[::3] = [0.5, 0.5, 0.5]                                  # a third of the rows are one vector
    pts = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {(i, j) for i in range(60) for j in sorted((j for j in range(60) if j != i), key=lambda j: (d[i, j], j))[:4]}
    got = neighbours.knn_join(pts, pts, 4, exclude_self=True).collect()
    assert {(r.id, r.neighbour) for r in got} == want and max(r["rank"] for r in got) == 4
    counts = {r.id: r.neighbours for r in neighbours.eps_counts(pts, 0.8).collect()}
    assert counts == {i: int((d[i] <= 0.8).sum()) for i in range(60)}
    pairs = {(r.left, r.right) for r in neighbours.eps_join(pts, 0.8).collect()}
    assert pairs == {(i, j) for i in range(60) for j in range(i + 1, 60) if d[i, j] <= 0.8}


def test_neighbours_of_groups_match_brute_force(spark, monkeypatch):
    """Many groups in one join: deep trees, a third of the rows in one group, vectors shared between groups, queries of no group."""
    monkeypatch.setattr(neighbours, "CHUNK", 12)
    monkeypatch.setattr(neighbours, "PIVOTS", 5)
    monkeypatch.setattr(neighbours, "FEW", 3)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 2, (150, 2)) * 4) / 4
    x[-4:] = [[1e-200, 0.0], [2e-200, 0.0], [3e-200, 0.0], [4e-200, 0.0]]       # distances that vanish
    g = ["hot" if i % 3 == 0 else f"g{i % 8}" for i in range(150)]
    pts = spark.createDataFrame([(i, [float(v) for v in r], c) for (i, r), c in zip(enumerate(x), g)], "id long, x array<double>, g string")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {(i, j) for i in range(150) for j in sorted((j for j in range(150) if j != i and g[i] == g[j]), key=lambda j: (d[i, j], j))[:3]}
    asked = pts.unionByName(spark.createDataFrame([(999, [0.0, 0.0], "none")], pts.schema))
    assert {(r.id, r.neighbour) for r in neighbours.knn_join(asked, pts, 3, exclude_self=True).collect()} == want
    assert {r.id: r.neighbours for r in neighbours.eps_counts(pts, 1.0).collect()} == {i: sum(d[i, j] <= 1.0 for j in range(150) if g[i] == g[j]) for i in range(150)}


def test_distances_a_row_hardly_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 100)
    monkeypatch.setattr(neighbours, "PIVOTS", 16)
    rng = np.random.default_rng(6)

    def met(n):
        pts = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.random((n, 2)))], "id long, x array<double>")
        tree = neighbours.grow(pts)
        sizes = tree.leaves.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
        assert sizes.agg(F.max("m")).first()[0] <= 100 and tree.leaves.count() == n
        return neighbours.candidates(neighbours._merged(pts), tree, 5).join(sizes, "cell").agg(F.sum("m")).first()[0] / n
    assert met(8000) < 2 * met(800)


def brute_dbscan(x, eps, least):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core, label, c = d.sum(1) >= least, np.full(len(x), -1), 0
    for i in range(len(x)):
        if not core[i] or label[i] >= 0:
            continue
        queue = [i]
        label[i] = c
        while queue:
            j = queue.pop()
            for k in np.nonzero(d[j])[0]:
                if label[k] < 0:
                    label[k] = c
                    if core[k]:
                        queue.append(k)
        c += 1
    return label


def test_dbscan_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 8)
    monkeypatch.setattr(neighbours, "PIVOTS", 4)
    rng = np.random.default_rng(5)
    x = np.round(np.vstack([rng.normal(0, .4, (25, 2)), rng.normal(3, .4, (25, 2)), rng.uniform(-2, 5, (15, 2)), np.zeros((20, 2))]), 2)
    pts = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    got = {r.id: r.cluster for r in clusters.cluster_dbscan(pts, 0.5, 5).collect()}
    assert [got[i] for i in range(len(x))] == list(brute_dbscan(x, 0.5, 5))


def test_long_chain_is_one_component(spark):
    nodes = spark.range(40).select(F.col("id").alias("node"))
    edges = spark.range(39).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a <> 19")
    got = {r.node: r.label for r in clusters.components(nodes, edges).collect()}
    assert got == {i: 0 if i < 20 else 20 for i in range(40)}


def test_power_transforms(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.exp(rng.normal(0, 1, 800)))], "id long, x double")
    out, lam = prep.box_cox(df, "x")
    assert abs(lam) < 0.1                                      # log-normal data wants the logarithm
    assert abs(out.agg(F.skewness("x")).first()[0]) < 0.2
    both = df.union(df.select(F.col("id") + 1000, -F.col("x")))
    out, lam = prep.yeo_johnson(both, "x")
    assert abs(lam - 1) < 0.15 and out.where("x is null").count() == 0


def test_iterative_fill_follows_the_other_columns(spark):
    df = spark.createDataFrame([(float(i), None if i % 5 == 0 else 2.0 * i + 1) for i in range(200)], "a double, b double")
    out = prep.impute_iterative(df, ["a", "b"])
    assert out.where(F.abs(F.col("b") - (2 * F.col("a") + 1)) > 1e-6).count() == 0


def test_isolation_forest_flags_far_rows(spark):
    rows = [(i, float(i % 10), float(i % 7)) for i in range(380)] + [(1000 + i, 500.0 + i, -300.0) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    out = isolation_forest(df, ["id"], share=0.05, trees=25)
    assert {r.id for r in out.where("outlier").collect()} == set(range(1000, 1020))


def test_apply_advice_logs_skips(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, k string")
    out, log = prep.apply_advice(df, [("x", "standard_scaler"), ("k", "standard_scaler"), ("x", "kde_estimation"), ("gone", "drop_column"), ("k", "one_hot_encode")])
    assert [s.split(":")[0] for _, _, s in log] == ["done", "failed", "unknown", "no such column", "done"]
    assert sorted(out.columns) == ["k_a", "k_b", "x"]


def classes(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(v), float(w), 1 if i < 30 else 0) for i, (v, w) in enumerate(zip(np.r_[rng.normal(3, .5, 30), rng.normal(0, 1, 170)], rng.normal(0, 1, 200)))]
    return spark.createDataFrame(rows, "id long, a double, b double, y int")


def test_rebalancing(spark):
    df = classes(spark)
    sizes = lambda d: {r.y: r["count"] for r in d.groupBy("y").count().collect()}
    grown = balance.smote(df, "y", "id", clip=False)
    assert sizes(grown) == {0: 170, 1: 170}
    low, high = df.where("y = 1").agg(F.min("a"), F.max("a")).first()
    fresh = grown.join(df, df.columns, "left_anti")
    assert fresh.where((F.col("a") < low) | (F.col("a") > high) | (F.col("y") != 1)).count() == 0
    assert sizes(balance.oversample_random(df, "y", ["id"])) == {0: 170, 1: 170}
    assert sizes(balance.undersample_random(df, "y", ["id"])) == {0: 30, 1: 30}
    assert balance.rebalance(df, ["id"], "a").count() == 200 and balance.rebalance(df, ["id"], "y", "other").count() == 200


def test_draws_do_not_depend_on_partitioning(spark):
    df = classes(spark)
    for run in (lambda d: augment.aug_noise(d, ["id"]), lambda d: augment.aug_general(d, ["id"]), lambda d: augment.aug_drop(d, ["id"]), lambda d: augment.aug_feature(d, ["id"])):
        one = sorted((r.id, round(r.a, 9), round(r.b, 9)) for r in run(df.repartition(1)).collect())
        assert one == sorted((r.id, round(r.a, 9), round(r.b, 9)) for r in run(df.repartition(7)).collect())


def test_models_learn_and_scores_are_right(spark):
    df = classes(spark)
    out = models.compare_classifiers(df, "y", "id", ["decision_tree", "lda", "qda", "adaboost", "KNeighbors"], trees=5, rounds=4).collect()
    assert len(out) == 20 and all(0.85 < r.score <= 1 for r in out if r.metric == "accuracy") and sum(r.best for r in out) == 4
    pred = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (2.0, 1.0)], "label double, prediction double")
    s = models.class_scores(pred)
    assert s["accuracy"] == 0.5 and s["recall"] == 0.5 and s["precision"] == pytest.approx(0.5 + 0.25 / 3) and s["f1_weighted"] == pytest.approx(0.5 * 2 / 3 + 0.25 * 0.5)
    folds = models.folds(df, ["id"], 3, "y").groupBy("y", "fold").count().collect()
    assert {(r.y, r["count"]) for r in folds} == {(1, 10), (0, 57), (0, 56)}


def test_regressors(spark):
    df = spark.range(120).select("id", (F.col("id") % 12).cast("double").alias("a"), ((F.col("id") * 7) % 5).cast("double").alias("b")).withColumn("y", 3 * F.col("a") - F.col("b"))
    out = models.compare_regressors(df, "y", "id", ["linear", "adaboost"], rounds=3)
    mse = {r.model: -r.score for r in out.collect() if r.metric == "neg_mean_squared_error"}
    assert mse["linear"] < 1e-6 and mse["adaboost"] < 20


def test_image_kernels():
    a = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert (images.rotate(a, 0) == a).all() and (images.rotate(a, 90) == np.rot90(a)).all() and (images.rotate(a, 180) == a[::-1, ::-1]).all()
    assert (images.flip(images.flip(a)) == a).all() and (images.brightness(a, 1.0) == a).all() and images.brightness(a, 0).max() == 0
    assert images.brightness(np.full((1, 1, 3), 200, np.uint8), 2).max() == 255
    assert len(np.unique(images.saturation(a, 0)[0, 0])) == 1 and len(np.unique(images.contrast(a, 0))) == 1
    assert (images.noise(a, 10, 1) == images.noise(a, 10, 1)).all() and images.augmented(a, "x", {}) is a


def test_target_checks_and_errors(spark):
    df = classes(spark).withColumn("one", F.lit(1)).withColumn("t", F.lit("x"))
    assert select.target_issues(df, "y", "classify") == [] and select.target_issues(df, "one", "classify") == ["fewer_than_two_classes"]
    assert select.target_issues(df, "t", "regress") == ["target_not_numeric"] and select.target_issues(df, "no", "regress") == ["target_not_found"]
    for bad in (lambda: select.drop_columns(df, ["y"], ["y"]), lambda: select.preview_head(df, ["id"], 101), lambda: select.assert_nonempty(df.limit(0))):
        with pytest.raises(ValueError):
            bad()


def test_catalog_stream_takes_only_new_files(spark, tmp_path):
    root, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    root.mkdir()
    for i in range(5):
        (root / f"{i}.png").write_bytes(b"x" * (i + 1))
    jobs.catalog_stream(spark, str(root), out, mark, 2)
    assert spark.read.parquet(out).count() == 5 and jobs.progress_log(spark, out, 5).count() == 3
    (root / "new.zip").write_bytes(b"y")
    jobs.catalog_stream(spark, str(root), out, mark, 2)
    rows = spark.read.parquet(out)
    assert rows.count() == 6 and rows.where("file_type = '.zip'").count() == 1 and rows.agg(F.sum("file_size")).first()[0] == 16
