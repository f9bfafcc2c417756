"""Trees, boosting, random cuts and closed forms against brute force; model comparison with the library's own amount of work."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.operators import models, trees
from tablewright.plans import partials
from tablewright.queries import modelling
from tablewright.session import side_by_side, written


def frame(spark, x, y, fold=None):
    fold = np.zeros(len(y), dtype=int) if fold is None else fold
    rows = [(int(i), float(b), int(f), [float(v) for v in a]) for i, (a, b, f) in enumerate(zip(x, y, fold))]
    return written(spark.createDataFrame(rows, "id long, label double, fold int, x array<double>").repartition(3))


def predicted(df):
    return np.array([r.prediction for r in sorted(df.collect(), key=lambda r: r.id)])


@pytest.mark.parametrize("direct", [0, 1 << 22])
def test_totals(spark, monkeypatch, direct):
    monkeypatch.setattr(partials, "DIRECT", direct)
    df = spark.range(1000).repartition(5)
    run = lambda b: np.array([b.num_rows, sum(b.column("id").to_pylist()), max(b.column("id").to_pylist()), -np.inf], dtype=float)
    assert partials.totals(df, run, 2, 2).tolist() == [1000, 499500, 999, -np.inf]
    assert partials.totals(df.where("id < 0"), run, 2, 2).tolist() == [0, 0, -np.inf, -np.inf]


def brute_stumps(x, y, cuts, classes, rounds, rate):
    """SAMME by trying every cut of every column."""
    w, votes = np.ones(len(y)), np.zeros((len(y), classes))
    for _ in range(rounds):
        best = None
        share = lambda rows: np.array([w[rows & (y == c)].sum() for c in range(classes)])
        for f in range(x.shape[1]):
            for c in cuts[f]:
                left = x[:, f] <= c
                a, b = share(left), share(~left)
                if a.sum() > 1e-12 and b.sum() > 1e-12:
                    kept = (a ** 2).sum() / a.sum() + (b ** 2).sum() / b.sum()
                    if best is None or kept > best[0] * (1 + 1e-12):
                        best = kept, np.where(left, a.argmax(), b.argmax())
        said = best[1]
        e = w[said != y].sum() / w.sum()
        if e <= 1e-12:
            votes[np.arange(len(y)), said] += 1
            break
        alpha = rate * (np.log((1 - e) / e) + np.log(classes - 1))
        votes[np.arange(len(y)), said] += alpha
        w *= np.where(said != y, np.exp(alpha), 1)
    return votes.argmax(axis=1)


@pytest.mark.parametrize("classes", [2, 3])
def test_boosted_stumps_equal_brute_force(spark, classes):
    draw = np.random.default_rng(classes)
    x = draw.normal(size=(150, 4)).round(1)
    y = (np.abs(x[:, 0]) + x[:, 1] + 0.3 * draw.normal(size=150) > 1).astype(int) + (x[:, 2] > 1).astype(int) * (classes - 2)
    fold = np.arange(150) % 3
    df = frame(spark, x, y, fold)
    found = trees.boost_classes(df.select("fold", "label", "x"), [-1, 0, 1], 4, classes, 25, 0.7)
    assert (predicted(found.predict(df, 0)) == brute_stumps(x, y, found.cuts, classes, 25, 0.7)).all()
    for m, out in ((1, 0), (2, 1)):
        mine = fold != out
        assert (predicted(found.predict(df, m))[mine] == brute_stumps(x[mine], y[mine], found.cuts, classes, 25, 0.7)).all()


def test_plan_of_prediction_does_not_grow_with_rounds(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(60, 3))
    df = frame(spark, x, (x[:, 0] * x[:, 1] > 0).astype(int))
    plan = lambda rounds: trees.boost_classes(df.select("fold", "label", "x"), [-1], 3, 2, rounds, 0.1).predict(df, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan(3)) == len(plan(24))


def brute_numbers(x, y, cuts, rounds, rate):
    """AdaBoost.R2 over trees of depth 3 that try every cut of every column."""
    def grow(rows, w, level):
        mean = (w[rows] * y[rows]).sum() / w[rows].sum()
        best = None
        for f in range(x.shape[1]) if level < 3 else []:
            for c in cuts[f]:
                a, b = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                if w[a].sum() > 1e-12 * w[rows].sum() and w[b].sum() > 1e-12 * w[rows].sum():
                    kept = (w[a] @ y[a]) ** 2 / w[a].sum() + (w[b] @ y[b]) ** 2 / w[b].sum()
                    if best is None or kept > best[0] * (1 + 1e-12):
                        best = kept, a, b
        out = np.full(len(y), mean)
        if best is not None:
            for part in best[1:]:
                out[part] = grow(part, w, level + 1)[part]
        return out

    w, said, votes = np.ones(len(y)), [], []
    for _ in range(rounds):
        p = grow(np.arange(len(y)), w, 0)
        gap = np.abs(p - y) / np.abs(p - y).max()
        e = (w * gap).sum() / w.sum()
        if e >= 0.5:
            break
        beta = e / (1 - e)
        said.append(p)
        votes.append(rate * np.log(1 / beta))
        w = w * beta ** (rate * (1 - gap))
    said, votes = np.array(said).T, np.array(votes)
    order = np.argsort(said, axis=1, kind="stable")
    return np.array([r[o][(votes[o].cumsum() >= votes.sum() / 2).argmax()] for r, o in zip(said, order)])


def test_boosted_numbers(spark):
    draw = np.random.default_rng(4)
    x = draw.uniform(-2, 2, size=(200, 2))
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 0) + 0.2 * draw.normal(size=200)
    df = frame(spark, x, y)
    for rate in (1.0, 0.5):
        found = trees.boost_numbers(df.select("fold", "label", "x"), [-1], 2, 13, rate)
        assert np.allclose(predicted(found.predict(df, 0)), brute_numbers(x, y, found.cuts, 13, rate), atol=1e-9)
    flat = frame(spark, x, np.full(200, 3.0))
    assert predicted(trees.boost_numbers(flat.select("fold", "label", "x"), [-1], 2, 5).predict(flat, 0)).tolist() == [3.0] * 200


def test_random_cuts_are_even_and_leaves_pure(spark):
    draw = np.random.default_rng(8)
    x = np.column_stack([draw.uniform(0, 1, 120), draw.uniform(5, 9, 120), np.ones(120)])
    y = draw.integers(0, 2, 120)
    df = frame(spark, x, y)
    forest = trees.random_cuts(df.select("fold", "label", "x"), [-1], 3, 2, 300, 30, 1, 5)
    root = slice(0, 300)
    for f, low, high in ((0, x[:, 0].min(), x[:, 0].max()), (1, x[:, 1].min(), x[:, 1].max())):
        u = (forest.cut[root][forest.feature[root] == f] - low) / (high - low)
        assert 100 < len(u) and u.min() >= 0 and u.max() < 1
        assert np.abs(np.sort(u) - (np.arange(len(u)) + 0.5) / len(u)).max() < 1.63 / len(u) ** 0.5      # Kolmogorov's 1 % bound
    assert not (forest.feature[forest.child >= 0] == 2).any()                                              # a constant column parts nothing
    leaves = forest.leaves(x, np.arange(300))
    assert (forest.value[leaves, y[:, None]] == 1).all()                                                   # grown to the end, all rows are told apart
    assert (predicted(forest.predict(df, -1)) == y).all()


def brute_forest(x, y, grown, depth, tried, rng):
    def grow(rows, level):
        if level == depth or len(rows) < 2 or len(set(y[rows])) == 1:
            return y[rows].mean()
        best = None
        for f in rng.permutation(x.shape[1])[:tried]:
            low, high = x[rows, f].min(), x[rows, f].max()
            c = rng.uniform(low, high)
            left = x[rows, f] <= c
            if 0 < left.sum() < len(rows):
                a, b = y[rows][left], y[rows][~left]
                kept = a.sum() ** 2 / len(a) + b.sum() ** 2 / len(b)
                if best is None or kept > best[0]:
                    best = kept, f, c, left
        if best is None:
            return y[rows].mean()
        _, f, c, left = best
        return f, c, grow(rows[left], level + 1), grow(rows[~left], level + 1)

    def ask(node, v):
        while isinstance(node, tuple):
            node = node[2] if v[node[0]] <= node[1] else node[3]
        return node

    forest = [grow(np.arange(len(y)), 0) for _ in range(grown)]
    return lambda z: np.array([np.mean([ask(t, v) for t in forest]) for v in z])


def test_random_cuts_are_as_good_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trees, "PIECE", 2000)                 # rows in pieces, open nodes in portions
    draw = np.random.default_rng(2)
    x = draw.uniform(-1, 1, size=(300, 4))
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0, 2.0, 0.0) + 0.1 * draw.normal(size=300)
    fold = (np.arange(300) % 3 == 0).astype(int)
    df = frame(spark, x, y, fold)
    forest = trees.random_cuts(df.select("fold", "label", "x"), [1, 0], 4, 0, 30, 8, 4, 3)
    for held in (0, 1):
        here = fold == held
        mine = np.mean((predicted(forest.predict(df, held))[here] - y[here]) ** 2)
        brute = np.mean((brute_forest(x[~here], y[~here], 30, 8, 4, draw)(x[here]) - y[here]) ** 2)
        assert mine < 1.4 * brute < 0.2 * y.var()


def data_of(spark, x, y, fold=None):
    from pyspark.ml.functions import array_to_vector
    return frame(spark, x, y, fold).withColumn("features", array_to_vector("x"))


def test_linear_models_from_fold_sums(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(120, 4)) * [1, 10, 0.1, 1] + [1000, 0, 5, 0]
    y = x @ [1.0, -0.2, 4.0, 0.0] + 7 + draw.normal(size=120)
    fold = np.arange(120) % 3
    df = data_of(spark, x, y, fold)
    for learner, alpha, mix in ((models.linear(), 0, 0), (models.linear(1.0, 0.0, True), 1, 0), (models.linear(0.3, 1.0), 0.3, 1), (models.linear(0.3, 0.5), 0.3, 0.5)):
        for held, model in zip([-1, 0, 2], learner.together(df, None, [-1, 0, 2])):
            own = fold != held
            a, b = x[own] - x[own].mean(0), y[own] - y[own].mean()
            if mix:
                w = np.zeros(4)
                for _ in range(3000):
                    for j in range(4):
                        r = a[:, j] @ (b - a @ w + a[:, j] * w[j]) / len(b)
                        w[j] = np.sign(r) * max(0, abs(r) - alpha * mix) / ((a[:, j] ** 2).mean() + alpha * (1 - mix))
            else:
                w = np.linalg.solve(a.T @ a + alpha * np.eye(4), a.T @ b)
            want = (x - x[own].mean(0)) @ w + y[own].mean()
            assert np.allclose(predicted(model.predict(df)), want, atol=1e-6)


def test_discriminants_and_naive_bayes_from_fold_sums(spark):
    draw = np.random.default_rng(7)
    y = draw.integers(0, 3, 150)
    x = draw.normal(size=(150, 3)) * (1 + y[:, None]) + 2 * y[:, None] + 100
    fold = np.arange(150) % 2
    df = data_of(spark, x, y, fold)
    for held, model in zip([0, -1], models._by_class(models._naive_bayes(1e-9)).together(df, [0, 1, 2], [0, -1])):
        own = fold != held
        score = [np.log((y[own] == c).mean()) + sum(-0.5 * np.log(2 * np.pi * x[own][y[own] == c][:, j].var()) - (x[:, j] - x[own][y[own] == c][:, j].mean()) ** 2 / (2 * x[own][y[own] == c][:, j].var()) for j in range(3)) for c in range(3)]
        assert (predicted(model.predict(df)) == np.argmax(score, axis=0)).all()
    alone = models._by_class(models._qda)
    whole, part = alone.together(df, [0, 1, 2], [-1, 1])[1], alone(df.where("fold <> 1").drop("fold"), [0, 1, 2])
    assert (predicted(whole.predict(df)) == predicted(part.predict(df))).all()


def test_support_vectors_come_near_the_least_objective(spark):
    draw = np.random.default_rng(9)
    x = draw.uniform(-2, 2, size=(120, 2))
    y = np.sin(2 * x[:, 0]) + 0.1 * draw.normal(size=120)
    y[:6] += 5
    df = data_of(spark, x, y)
    size, gamma = 20, models._gamma(models.with_x(df))
    z = np.array([r.features.toArray() for r in sorted(models.fourier(df, gamma, size).collect(), key=lambda r: r.id)])
    objective = lambda w, b: 0.5 * w @ w + np.maximum(0, np.abs(y - z @ w - b) - 0.1).sum()
    out = predicted(models.support_vectors(size, rounds=200)(df.drop("fold"), None).predict(df))
    solved = np.linalg.lstsq(np.hstack([z, np.ones((120, 1))]), out, rcond=None)[0]
    w, b, least = np.zeros(size), 0.0, np.inf
    for i in range(60_000):                                    # brute force: subgradient steps
        r = y - z @ w - b
        s = np.where(np.abs(r) > 0.1, np.sign(r), 0)
        step = 0.3 / (100 + i)
        w, b = w - step * (w - z.T @ s), b + step * s.sum()
        least = min(least, objective(w, b))
    assert objective(solved[:-1], solved[-1]) <= 1.01 * least


def test_comparisons_run_the_defaults_for_real(spark):
    """The registered comparisons leave all parameters alone; here the same calls finish on 60 rows with 100 trees and rounds."""
    import inspect
    assert all(inspect.signature(f).parameters[p].default == 100 for f in (models.classifiers, models.regressors) for p in ("trees", "rounds"))
    source = inspect.getsource(modelling)
    assert "models.compare_classifiers(quality(spark, sf), \"quality\", \"doc_id\")" in source and "models.compare_regressors(embedded(spark, sf).drop(\"label\"), \"e0\", \"vec_id\")" in source
    draw = np.random.default_rng(0)
    x = draw.normal(size=(60, 3))
    df = spark.createDataFrame([(i, *map(float, v), int(v[0] + v[1] > 0)) for i, v in enumerate(x)], "id long, a double, b double, c double, y int")
    out = models.compare_classifiers(df, "y", "id").collect()
    assert len(out) == 4 * 12 and {r.metric for r in out if r.best} == set(models.CLASS_METRICS)
    assert all(0.5 <= r.score <= 1 for r in out if r.metric == "accuracy")


def test_tuning_of_regressors(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(60, 2))
    df = spark.createDataFrame([(i, *map(float, v), float(v[0] - 2 * v[1])) for i, v in enumerate(x)], "id long, a double, b double, y double")
    rows = models.tune_random(df, "y", "id", "randomforest", {"trees": [2, 5], "depth": [1, 4]}, trials=4, k=2, classify=False).collect()
    assert len(rows) == 4 and sum(r.best for r in rows) == 1 and max(rows, key=lambda r: r.value).best and all(r.value < 0 for r in rows)
    assert set(rows[0].params) == {"trees", "depth"}


def test_a_failing_job_is_raised(spark):
    with pytest.raises(ZeroDivisionError):
        side_by_side([lambda: spark.range(3).count(), lambda: 1 // 0])


def test_random_cuts_meet_rows_only_with_trees_that_use_them(monkeypatch):
    """A pass took every row down every tree, also those that leave out its fold; a strip at a time gives the same leaves."""
    rng = np.random.default_rng(3)
    x, y, fold = np.round(rng.normal(size=(90, 3)), 1), rng.integers(0, 2, 90).astype(float), rng.integers(0, 3, 90).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(fold), pa.array(y), pa.array(x.tolist())], ["fold", "label", "x"])
    monkeypatch.setattr(trees, "totals", lambda rows, run, cells, tops=0: run(batch).ravel())
    met, leaves = [], trees.Forest.leaves
    monkeypatch.setattr(trees.Forest, "leaves", lambda self, v, of: met.append((len(v), tuple(self.held[of]))) or leaves(self, v, of))
    found = trees.random_cuts(None, [0, 1, 2], 3, 2, 4, 5, 2, 7)
    sizes = {f: int((fold == f).sum()) for f in range(3)}
    assert met and all(len(set(of)) == 2 and n == sizes[({0, 1, 2} - set(of)).pop()] for n, of in met)
    wide = leaves(found, x, np.arange(12))
    monkeypatch.setattr(trees, "STRIP", 24)
    assert np.array_equal(leaves(found, x, np.arange(12)), wide)

    def end(row, node):
        while found.child[node] >= 0:
            node = found.child[node] + (row[found.feature[node]] > found.cut[node])
        return node
    assert wide.tolist() == [[end(row, t) for t in range(12)] for row in x]


def test_roots_alone_are_leaves_without_columns():
    bare = trees.Forest(np.zeros(2), np.zeros(2, dtype=int), np.zeros(2), np.full(2, -1), np.ones((2, 1)))
    assert bare.leaves(np.zeros((3, 0)), np.arange(2)).tolist() == [[0, 1]] * 3
