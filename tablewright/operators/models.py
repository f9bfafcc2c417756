"""Model comparison on ``pyspark.ml``. Features are numeric columns, assembled after mean fill."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import classification as mc, regression as mr
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import at, missing, number, numeric_columns
from ..functions.draws import uniform
from ..plans.partials import matrix, totals
from ..plans.positions import shuffled_positions
from ..session import side_by_side, written
from .neighbours import knn_join
from .prep import encode_ordinal, impute_mean, sorted_values
from .profile import literal_rows
from .select import inf_to_null
from .trees import boost_classes, boost_numbers, random_cuts, scored

SEED = 42


def clean_features(df: DataFrame, features: list[str], target: str | None = None) -> DataFrame:
    """Infinite to missing, then column means."""
    cols = [*features, *([target] if target in numeric_columns(df) else [])]
    return impute_mean(inf_to_null(df), cols)


def dataset(df: DataFrame, target: str, key: str, features: list[str] | None = None, classify: bool = True) -> tuple[DataFrame, list]:
    """(id, features, label) and, for classes, the class values in label order."""
    features = features or [c for c in numeric_columns(df) if c not in (target, key)]
    clean = clean_features(df, features, None if classify else target)
    classes = []
    label = number(clean, target)
    if classify:
        classes = sorted_values(clean, target, None)        # one value per class
        clean = encode_ordinal(clean.where(~missing(clean, target)).withColumn("_label", at(target)), "_label")
        label = F.col("_label")
    named = clean.select(at(key).alias("id"), label.alias("label"), *[number(clean, c).alias(f"f{i}") for i, c in enumerate(features)])
    return VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="features").transform(named).select("id", "label", "features"), classes


def folds(df: DataFrame, keys: list[str], k: int = 3, target: str | None = None, seed: int = SEED) -> DataFrame:
    """Add ``fold`` 0 to k-1: digest order dealt out in turn, per class if a target is given."""
    return shuffled_positions(df, keys, seed, [target] if target else None).withColumn("fold", F.pmod(F.col("_pos"), F.lit(k)).cast("int")).drop("_pos")


@dataclass
class Fitted:
    """Anything that adds ``prediction`` to a table with ``features``."""
    predict: Callable[[DataFrame], DataFrame]


@dataclass
class Learner:
    """``fit(train, classes)`` gives one model; ``together(data, classes, held)`` one for each fold left out of ``data``, in shared passes."""
    fit: Callable
    together: Callable | None = None

    def __call__(self, train: DataFrame, classes: list | None) -> Fitted:
        return self.fit(train, classes)


def _shared(together: Callable) -> Learner:
    return Learner(lambda train, classes: together(train.withColumn("fold", F.lit(0)), classes, [-1])[0], together)


def with_x(df: DataFrame) -> DataFrame:
    """The features also as an array."""
    return df if "x" in df.columns else df.withColumn("x", vector_to_array("features"))


def _width(data: DataFrame) -> int:
    row = data.select("features").first()
    return 0 if row is None else len(row[0])


def _spark(estimator, deep: bool = False) -> Callable:
    """``deep``: every task sends statistics of every open node, hit or not, so that no more tasks than cores take part."""
    def fit(train, classes):
        model = estimator.fit(train.coalesce(train.sparkSession.sparkContext.defaultParallelism) if deep else train)
        return Fitted(lambda df: model.transform(df).select("id", "label", "prediction"))
    return fit


def _one_vs_rest(estimator, classes):
    return mc.OneVsRest(classifier=estimator) if len(classes) > 2 else estimator


# ---- learners without a Spark class -------------------------------------------------

def adaboost(rounds: int = 100, rate: float = 0.1) -> Learner:
    """SAMME on stumps, a pass over the rows per round for all folds."""
    def together(data, classes, held):
        found = boost_classes(with_x(data).select("fold", "label", "x"), held, _width(data), max(len(classes), 1), rounds, rate)
        return [Fitted(lambda df, m=m: found.predict(with_x(df), m)) for m in range(len(held))]
    return _shared(together)


def adaboost_r2(rounds: int = 100, rate: float = 1.0) -> Learner:
    """AdaBoost.R2 on trees of depth 3, prediction by weighted median."""
    def together(data, classes, held):
        found = boost_numbers(with_x(data).select("fold", "label", "x"), held, _width(data), rounds, rate)
        return [Fitted(lambda df, m=m: found.predict(with_x(df), m)) for m in range(len(held))]
    return _shared(together)


def extra_trees(trees: int, depth: int) -> Learner:
    """Random cuts in the square root of the columns (classes) or in all of them (numbers)."""
    def together(data, classes, held):
        width, rows = _width(data), written(with_x(data).select("fold", "label", "x"))
        tried = max(1, int(width ** 0.5)) if classes else width
        found = random_cuts(rows, held, width, len(classes or []), trees, depth, tried, SEED)
        return [Fitted(lambda df, f=f: found.predict(with_x(df), f)) for f in held]
    return _shared(together)


def with_x_of(column: str):
    return vector_to_array(column).alias("x")


def _points(df: DataFrame) -> DataFrame:
    return df.select("id", with_x_of("features"))


def fit_knn(train: DataFrame, classes: list | None, k: int = 5) -> Fitted:
    """Vote (classes, ties to the least label) or mean (numbers) of the ``k`` nearest training rows."""
    def predict(df: DataFrame) -> DataFrame:
        near = knn_join(_points(df), _points(train), k).join(train.select(F.col("id").alias("neighbour"), F.col("label").alias("_l")), "neighbour")
        vote = F.mode("_l", True) if classes else F.avg("_l")
        return df.select("id", "label").join(near.groupBy("id").agg(vote.alias("prediction")), "id")
    return Fitted(predict)


def fourier(df: DataFrame, gamma: float, size: int, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """Random Fourier features of the RBF kernel (Rahimi and Recht, 2007) in place of the features; ``keep`` names further columns."""
    kept = ["id", "label", *(keep or [])]

    def turn(batches):
        for b in batches:
            x = np.array(b["x"].tolist(), dtype=float)
            if not len(b):
                continue
            rng = np.random.default_rng(seed)
            w = rng.normal(0, np.sqrt(2 * gamma), (x.shape[1], size))
            shift = rng.uniform(0, 2 * np.pi, size)
            yield pd.DataFrame({**{c: b[c] for c in kept}, "x": list(np.sqrt(2 / size) * np.cos(x @ w + shift))})
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in kept)
    out = df.select(*kept, with_x_of("features")).mapInPandas(turn, f"{kinds}, x array<double>")
    return out.select(*kept, array_to_vector("x").alias("features"))


def _gamma(train: DataFrame) -> float:
    """1 / (columns · variance over all cells)."""
    cells = _points(train).select(F.size("x").alias("d"), F.explode("x").alias("v"))
    row = cells.agg(F.max("d").alias("d"), F.var_pop("v").alias("v")).first()
    return 1.0 / (row["d"] * (row["v"] or 1.0))


def _on_fourier(estimator, size: int) -> Callable:
    def fit(train, classes):
        gamma = _gamma(train)
        model = _one_vs_rest(estimator, classes).fit(fourier(train, gamma, size)) if classes else estimator.fit(fourier(train, gamma, size))
        return Fitted(lambda df: model.transform(fourier(df, gamma, size)).select("id", "label", "prediction"))
    return fit


# ---- closed forms from additive fold statistics --------------------------------------

@dataclass
class FoldSums:
    """Per fold and class the count, sums and products of the centred row (1, x) or (1, x, label); they add up over folds."""
    centre: np.ndarray
    cells: np.ndarray               # folds x classes x width x width

    def without(self, fold: int) -> np.ndarray:
        """Classes x width x width of all rows but the fold's."""
        whole = self.cells.sum(axis=0)
        return whole - self.cells[fold] if 0 <= fold < len(self.cells) else whole


def fold_sums(data: DataFrame, classes: int, label: bool = False) -> FoldSums:
    """Two passes: the mean, and the products about it. With ``label`` it is one more column; else rows are summed by class."""
    kinds, width = max(classes, 1), _width(data) + (1 if label else 0)
    rows = with_x(data).select("fold", "label", "x")

    def values(batch):
        x = matrix(batch.column("x"))
        return np.hstack([x, batch.column("label").to_numpy()[:, None]]) if label else x

    *first, last = totals(rows, lambda b: np.concatenate([[b.num_rows], values(b).sum(axis=0), [b.column("fold").to_numpy().max()]]), width + 1, 1)
    centre, folds = np.array(first[1:]) / max(first[0], 1), int(max(last, 0)) + 1

    def products(batch):
        z = np.hstack([np.ones((batch.num_rows, 1)), values(batch) - centre])
        group = batch.column("fold").to_numpy() * kinds + (batch.column("label").to_numpy().astype(np.int64) if classes else 0)
        out = np.zeros((folds * kinds, width + 1, width + 1))
        for g in np.unique(group):
            part = z[group == g]
            out[g] = part.T @ part
        return out

    return FoldSums(centre, totals(rows, products, folds * kinds * (width + 1) ** 2).reshape(folds, kinds, width + 1, width + 1))


def _moments(sums: FoldSums, fold: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class with rows: their number, mean, scatter about the mean."""
    out = {}
    for c, m in enumerate(sums.without(fold)):
        n = m[0, 0]
        if n > 0.5:
            mean = m[0, 1:] / n
            out[c] = (n, mean + sums.centre, m[1:, 1:] - n * np.outer(mean, mean))
    return out


def _by_class(parts: Callable) -> Learner:
    """Scores per class in closed form: ``parts(moments)`` gives (class, score of a matrix of rows)."""
    def together(data, classes, held):
        sums = fold_sums(data, len(classes))

        def model(fold):
            found = parts(_moments(sums, fold))
            names = np.array([float(c) for c, _ in found])
            return Fitted(lambda df: scored(with_x(df), lambda x: names[np.stack([f(x) for _, f in found], axis=1).argmax(axis=1)]))
        return [model(f) for f in held]
    return _shared(together)


def _lda(moments):
    n = sum(m[0] for m in moments.values())
    inverse = np.linalg.pinv(sum(m[2] for m in moments.values()) / n)
    return [(c, lambda x, b=float(np.log(k / n) - 0.5 * mean @ inverse @ mean), w=inverse @ mean: b + x @ w) for c, (k, mean, _) in moments.items()]


def _qda(moments):
    n, out = sum(m[0] for m in moments.values()), []
    for c, (k, mean, scatter) in moments.items():
        cov = scatter / max(k - 1, 1)
        values = np.linalg.eigvalsh(cov)
        inverse = np.linalg.pinv(cov)
        base = float(np.log(k / n) - 0.5 * np.log(values[values > 1e-12]).sum())
        out.append((c, lambda x, b=base, mean=mean, inverse=inverse: b - 0.5 * np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)))
    return out


def _naive_bayes(smoothing: float) -> Callable:
    """Normal densities per column; ``smoothing`` times the largest variance of a column is added to each."""
    def parts(moments):
        n = sum(m[0] for m in moments.values())
        mean = sum(m[0] * m[1] for m in moments.values()) / n
        spread = sum(m[2].diagonal() + m[0] * (m[1] - mean) ** 2 for m in moments.values()) / n
        more, out = smoothing * max(spread.max(initial=0.0), 1e-300), []
        for c, (k, middle, scatter) in moments.items():
            variance = scatter.diagonal() / k + more
            base = float(np.log(k / n) - 0.5 * np.log(2 * np.pi * variance).sum())
            out.append((c, lambda x, b=base, middle=middle, variance=variance: b - 0.5 * ((x - middle) ** 2 / variance).sum(axis=1)))
        return out
    return parts


def linear(alpha: float = 0.0, mix: float = 0.0, per_row: bool = False, rounds: int = 1000) -> Learner:
    """Least squares with ``alpha`` times (``mix`` of the absolute, the rest of half the squared) coefficients, per row or in all.

    All folds come from one set of products; the absolute part by coordinate descent on them."""
    def solve(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        n = max(m[0, 0], 1.0)
        mean = m[0, 1:] / n
        s = m[1:, 1:] - n * np.outer(mean, mean)
        a, b = s[:-1, :-1], s[:-1, -1]
        strength = alpha if per_row else alpha * n
        if not mix:
            return np.linalg.pinv(a + strength * np.eye(len(b)), hermitian=True) @ b, mean[:-1], mean[-1]
        w = np.zeros(len(b))
        for _ in range(rounds):
            before = w.copy()
            for j in np.flatnonzero(a.diagonal() > 0):
                rest = b[j] - a[j] @ w + a[j, j] * w[j]
                w[j] = np.sign(rest) * max(0.0, abs(rest) - strength * mix) / (a[j, j] + strength * (1 - mix))
            if np.abs(w - before).max(initial=0.0) <= 1e-10 * max(1.0, np.abs(w).max(initial=0.0)):
                break
        return w, mean[:-1], mean[-1]

    def together(data, classes, held):
        sums = fold_sums(data, 0, label=True)

        def model(fold):
            w, x0, y0 = solve(sums.without(fold)[0])
            shift = sums.centre[:-1] + x0
            return Fitted(lambda df: scored(with_x(df), lambda x: (x - shift) @ w + (sums.centre[-1] + y0)))
        return [model(f) for f in held]
    return _shared(together)


def support_vectors(size: int, cost: float = 1.0, margin: float = 0.1, rounds: int = 60) -> Learner:
    """Half the squared coefficients plus ``cost`` times what residuals exceed ``margin`` by, over random Fourier features.

    Each round replaces the loss by a parabola that lies above it and touches it at the present residuals, and solves the
    least squares that gives, so that the objective never rises; a pass over the rows per round serves all folds."""
    def together(data, classes, held):
        gamma = _gamma(with_x(data))
        rows = written(fourier(data, gamma, size, keep=["fold"]).select("fold", "label", with_x_of("features")))
        wide = size + 1
        w = np.zeros((len(held), wide))
        weights = np.concatenate([[0.0], np.ones(size)])                    # the constant is free
        spread = rows.agg(F.stddev_pop("label")).first()[0] or 1.0
        last = np.full(len(held), np.inf)
        for _ in range(rounds):
            def sums(batch, w=w.copy()):
                z = np.hstack([np.ones((batch.num_rows, 1)), matrix(batch.column("x"))])
                y, fold = batch.column("label").to_numpy(), batch.column("fold").to_numpy()
                out = np.zeros((len(held), wide * wide + wide + 1))
                for m, left_out in enumerate(held):
                    own = fold != left_out
                    p, r = z[own], y[own] - z[own] @ w[m]
                    over, under = r - margin, -r - margin
                    a, b = (1 / (4 * np.maximum(np.abs(v), 1e-6 * spread)) for v in (over, under))
                    # parabolas (r - margin + |over|)^2 a + (-r - margin + |under|)^2 b; their least squares target per row
                    target = a * (y[own] - margin + np.abs(over)) + b * (y[own] + margin - np.abs(under))
                    out[m, :wide * wide] = ((p * (a + b)[:, None]).T @ p).ravel()
                    out[m, wide * wide:-1] = p.T @ target
                    out[m, -1] = np.maximum(0, over).sum() + np.maximum(0, under).sum()
                return out
            found = totals(rows, sums, len(held) * (wide * wide + wide + 1)).reshape(len(held), -1)
            now = 0.5 * (w ** 2 * weights).sum(axis=1) + cost * found[:, -1]
            if (now >= last * (1 - 1e-5)).all():
                break
            last = now
            for m, f in enumerate(found):
                a = 2 * cost * f[:wide * wide].reshape(wide, wide) + np.diag(weights)
                w[m] = np.linalg.lstsq(a, 2 * cost * f[wide * wide:-1], rcond=None)[0]
        return [Fitted(lambda df, v=v: scored(fourier(df, gamma, size).select("id", "label", with_x_of("features")), lambda x: v[0] + x @ v[1:])) for v in w]
    return _shared(together)


# ---- registries ---------------------------------------------------------------------

def classifiers(trees: int = 100, rounds: int = 100, depth: int = 10, neighbours: int = 5, hidden: int = 100, fourier_size: int = 200,
                learning_rate: float = 0.1, var_smoothing: float = 1e-9) -> dict[str, Callable]:
    """Name to ``fit(train, classes)``; a ``Learner`` fits all folds in shared passes."""
    return {
        "randomforest": _spark(mc.RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED)),
        "adaboost": adaboost(rounds, learning_rate),
        "gradientboost": lambda t, c: _spark(_one_vs_rest(mc.GBTClassifier(maxIter=rounds, maxDepth=6, stepSize=learning_rate, seed=SEED), c))(t, c),
        "KNeighbors": lambda t, c: fit_knn(t, c, neighbours),
        "GaussianNB": _by_class(_naive_bayes(var_smoothing)),
        "svm": _on_fourier(mc.LinearSVC(regParam=0.01, maxIter=50), fourier_size),
        "logistic_regression": lambda t, c: _spark(mc.LogisticRegression(regParam=1.0 / max(t.count(), 1), standardization=False, maxIter=100))(t, c),
        "decision_tree": _spark(mc.DecisionTreeClassifier(maxDepth=depth, seed=SEED)),
        "extra_trees": extra_trees(trees, depth),
        "mlp": lambda t, c: _spark(mc.MultilayerPerceptronClassifier(layers=[_width(t), hidden, max(len(c), 2)], maxIter=100, seed=SEED))(t, c),
        "lda": _by_class(_lda), "qda": _by_class(_qda),
    }


def regressors(trees: int = 100, rounds: int = 100, neighbours: int = 5, fourier_size: int = 200, depth: int = 10, learning_rate: float | None = None) -> dict[str, Callable]:
    """As ``classifiers``. ``learning_rate`` is 1 for AdaBoost and 0.1 for gradient boosting unless given."""
    step = 0.1 if learning_rate is None else learning_rate
    return {
        "randomforest": _spark(mr.RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=SEED), deep=True),
        "gradientboost": _spark(mr.GBTRegressor(maxIter=rounds, maxDepth=6, stepSize=step, seed=SEED)),
        "adaboost": adaboost_r2(rounds, 1.0 if learning_rate is None else learning_rate),
        "decision_tree": _spark(mr.DecisionTreeRegressor(maxDepth=30, seed=SEED), deep=True),
        "KNeighbors": lambda t, c: fit_knn(t, None, neighbours),
        "svr": support_vectors(fourier_size),
        "linear": linear(), "ridge": linear(1.0, 0.0, True), "lasso": linear(1.0, 1.0), "elastic_net": linear(1.0, 0.5),
        "extra_trees": extra_trees(trees, depth),
    }


# ---- scores -------------------------------------------------------------------------

CLASS_METRICS = ["accuracy", "recall", "precision", "f1_weighted"]


def class_scores(predicted: DataFrame) -> dict[str, float]:
    """Accuracy and weighted recall, precision, F1 from one confusion count."""
    rows = predicted.groupBy("label", "prediction").count().collect()     # classes squared at most
    total = sum(r["count"] for r in rows)
    if not total:
        return dict.fromkeys(CLASS_METRICS, 0.0)
    labels, out = {r["label"] for r in rows}, dict.fromkeys(CLASS_METRICS, 0.0)
    for c in labels:
        hit = sum(r["count"] for r in rows if r["label"] == c == r["prediction"])
        real = sum(r["count"] for r in rows if r["label"] == c)
        said = sum(r["count"] for r in rows if r["prediction"] == c)
        recall, precision = hit / real, hit / said if said else 0.0
        out["recall"] += recall * real / total
        out["precision"] += precision * real / total
        out["f1_weighted"] += (2 * recall * precision / (recall + precision) if recall + precision else 0.0) * real / total
        out["accuracy"] += hit / total
    return out


def number_scores(predicted: DataFrame) -> dict[str, float]:
    d = F.col("prediction") - F.col("label")
    row = predicted.agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae")).first()
    return {"neg_mean_squared_error": -row["mse"], "neg_mean_absolute_error": -row["mae"]}


def _held_out(data: DataFrame, classes: list | None, fit: Callable, k: int) -> list[Callable]:
    """Jobs that each return [(fold, model)]; folds that share their passes are one job."""
    train = lambda f: data.where(F.col("fold") != f).drop("fold")
    if isinstance(fit, Learner) and fit.together:
        return [lambda: list(enumerate(fit.together(data, classes, list(range(k)))))]
    return [lambda f=f: [(f, fit(train(f), classes))] for f in range(k)]


def _scored(data: DataFrame, job: Callable, score: Callable) -> list[dict[str, float]]:
    return [score(model.predict(data.where(F.col("fold") == f).drop("fold"))) for f, model in job()]


def cross_validate(data: DataFrame, classes: list, fit: Callable, k: int, score: Callable) -> dict[str, float]:
    """Mean of every metric over the folds; each model is fitted once per fold for all metrics."""
    return _cross_validated(data, classes, {"": fit}, k, score)[""]


def _cross_validated(data: DataFrame, classes: list | None, models: dict[str, Callable], k: int, score: Callable) -> dict[str, dict[str, float]]:
    """Every model's mean metrics; models and folds side by side, the long ones first in line."""
    jobs = [(name, job) for name, fit in models.items() for job in _held_out(data, classes, fit, k)]
    jobs.sort(key=lambda j: j[0] != "gradientboost")
    found = side_by_side([lambda job=job: _scored(data, job, score) for _, job in jobs])
    out: dict[str, dict[str, float]] = {name: {} for name in models}
    for (name, _), scores in zip(jobs, found):
        for one in scores:
            for metric, value in one.items():
                out[name][metric] = out[name].get(metric, 0.0) + value / k
    return out


def _compare(data, classes, models, k, score, worst) -> DataFrame:
    # fewer than two classes: no classifier can be fitted and all take the worst score; any other failure is an error
    found = {name: dict(worst) for name in models} if classes is not None and len(classes) == 1 else _cross_validated(data, classes, models, k, score)
    rows = [{"model": name, "metric": m, "score": float(v)} for name, scores in found.items() for m, v in scores.items()]
    long = literal_rows(data.sparkSession, rows, "model string, metric string, score double")
    best = Window.partitionBy("metric").orderBy(F.desc("score"), "model")      # one row per model and metric
    return long.withColumn("best", F.row_number().over(best) == 1)


def compare_classifiers(df: DataFrame, target: str, key: str, names: list[str] | None = None, k: int = 3, **parameters) -> DataFrame:
    """(model, metric, score, best) by stratified cross validation."""
    data, classes = dataset(df, target, key)
    data = written(with_x(folds(data, ["id"], k, "label")))
    models = {n: f for n, f in classifiers(**parameters).items() if names is None or n in names}
    return _compare(data, classes, models, k, class_scores, dict.fromkeys(CLASS_METRICS, 0.0))


def compare_regressors(df: DataFrame, target: str, key: str, names: list[str] | None = None, k: int = 3, **parameters) -> DataFrame:
    data, _ = dataset(df, target, key, classify=False)
    data = written(with_x(folds(data, ["id"], k)))
    models = {n: f for n, f in regressors(**parameters).items() if names is None or n in names}
    worst = dict.fromkeys(["neg_mean_squared_error", "neg_mean_absolute_error"], float("-inf"))
    return _compare(data, [], models, k, number_scores, worst)


def predictions(df: DataFrame, target: str, key: str, name: str, test, classify: bool = True, features: list[str] | None = None, **parameters) -> DataFrame:
    """(id, label, prediction) of one model on the rows where ``test(id)`` holds, fitted on the others."""
    data, classes = dataset(df, target, key, features, classify)
    data = written(data)      # learners pass over their input many times
    fit = (classifiers if classify else regressors)(**parameters)[name]
    return fit(data.where(~test), classes).predict(data.where(test))


def split_evaluate(df: DataFrame, target: str, key: str, name: str, shares: tuple = (0.6, 0.2, 0.2), seed: int = SEED, **parameters) -> DataFrame:
    """Scores on keyed train, validation and test parts."""
    data, classes = dataset(df, target, key)
    u = uniform(["id"], seed, "split")
    part = F.when(u < shares[0], "train").when(u < shares[0] + shares[1], "validation").otherwise("test")
    data = written(data.withColumn("part", part))
    model = classifiers(**parameters)[name](data.where("part = 'train'").drop("part"), classes)
    rows = [{"part": p, "metric": m, "score": v} for p in ("train", "validation", "test") for m, v in class_scores(model.predict(data.where(F.col("part") == p).drop("part"))).items()]
    return literal_rows(df.sparkSession, rows, "part string, metric string, score double")


def tune_random(df: DataFrame, target: str, key: str, name: str, ranges: dict[str, list], trials: int = 10, k: int = 5, seed: int = SEED,
                classify: bool = True, metric: str | None = None) -> DataFrame:
    """``trials`` random settings out of ``ranges`` (lists of values) with their mean ``metric`` (accuracy, or the negated mean
    squared error if not ``classify``); best marked. Settings and folds run side by side."""
    data, classes = dataset(df, target, key, classify=classify)
    data = written(with_x(folds(data, ["id"], k, "label" if classify else None)))
    metric = metric or ("accuracy" if classify else "neg_mean_squared_error")
    rng = np.random.default_rng(seed)
    chosen = [{p: v[int(rng.integers(len(v)))] for p, v in ranges.items()} for _ in range(trials)]
    registry, score = (classifiers, class_scores) if classify else (regressors, number_scores)
    found = _cross_validated(data, classes if classify else None, {str(i): registry(**c)[name] for i, c in enumerate(chosen)}, k, score)
    rows = [{"number": i, "value": float(found[str(i)][metric]), "params": {p: str(v) for p, v in c.items()}} for i, c in enumerate(chosen)]
    table = literal_rows(df.sparkSession, rows, "number int, value double, params map<string,string>")
    order = Window.orderBy(F.desc("value"), "number")       # one row per trial
    return table.withColumn("best", F.row_number().over(order) == 1)


# ---- class choice for rebalancing ---------------------------------------------------

def strategy_search(df: DataFrame, target: str, key: str, k: int = 5, trees: int = 100) -> DataFrame:
    """Cross-validated accuracy of a forest on scaled data after growing classes by each of the three target sets; folds side by side."""
    from .balance import smote_rows, strategy_levels
    from .prep import scale_standard
    levels = strategy_levels(df, target).collect()       # three rows per class at most
    features = [c for c in numeric_columns(df) if c not in (target, key)]
    base = written(folds(impute_mean(df, features), [key], k, target))
    wanted = {s: {r["label"]: r["wanted"] for r in levels if r["strategy"] == s} for s in ("max", "mean", "median")}
    same = {s: frozenset(w.items()) for s, w in wanted.items()}         # equal goals grow equal rows: one set of forests for them

    def accuracy(goals: frozenset, f: int) -> float:
        train, test = base.where(F.col("fold") != f).drop("fold"), base.where(F.col("fold") == f).drop("fold")
        # wanted sizes are for the whole table; a fold sees its share
        grown = train.unionByName(smote_rows(train, target, key, {c: int(w * (k - 1) / k) for c, w in goals}, 3).select(*train.columns)) if goals else train
        both = written(grown.withColumn("_t", F.lit(0)).unionByName(test.withColumn("_t", F.lit(1))))
        both = scale_standard(both, features)
        data, classes = dataset(both.where("_t = 0").drop("_t"), target, key, features)
        held, _ = dataset(both.where("_t = 1").drop("_t"), target, key, features)
        model = classifiers(trees=trees)["randomforest"](data, classes)
        return class_scores(model.predict(held))["accuracy"]

    jobs = [(goals, f) for goals in dict.fromkeys(same.values()) for f in range(k)]
    found = dict(zip(jobs, side_by_side([lambda job=job: accuracy(*job) for job in jobs])))
    rows = [{"strategy": s, "accuracy": float(np.mean([found[goals, f] for f in range(k)]))} for s, goals in same.items()]
    table = literal_rows(df.sparkSession, rows, "strategy string, accuracy double")
    return table.withColumn("best", F.row_number().over(Window.orderBy(F.desc("accuracy"), "strategy")) == 1)


def label_feature_selection(df: DataFrame, target: str, key: str, share: float = 0.8, trees: int = 100) -> DataFrame:
    """Classes kept both by the F-test (top ``share``) and by forest importance (at least the mean), over one-hot classes."""
    from pyspark.ml.feature import UnivariateFeatureSelector
    classes = sorted_values(df, target, None)
    hot = df.where(at(target).isNotNull()).select((F.array_position(F.array(*[F.lit(c) for c in classes]), at(target)) - 1).cast("double").alias("label"),
                                                  *[(at(target) == F.lit(c)).cast("double").alias(f"f{i}") for i, c in enumerate(classes)])
    data = VectorAssembler(inputCols=[f"f{i}" for i in range(len(classes))], outputCol="features").transform(hot)
    keep = max(1, round(len(classes) * share))
    chosen = UnivariateFeatureSelector(selectionMode="numTopFeatures", featuresCol="features", labelCol="label", outputCol="s").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(keep).fit(data)
    importance = mc.RandomForestClassifier(numTrees=trees, seed=SEED).fit(data).featureImportances.toArray()
    both = set(chosen.selectedFeatures) & {i for i, v in enumerate(importance) if v >= importance.mean()}
    kept = df.sparkSession.createDataFrame([(classes[i],) for i in sorted(both)], df.select(at(target)).schema)
    return df.join(F.broadcast(kept), target, "left_semi")
