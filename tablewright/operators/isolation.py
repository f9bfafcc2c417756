"""Isolation forest: trees from small keyed samples, scores computed where the rows are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import at, number, numeric_columns
from ..functions.draws import digest
from ..plans.quantiles import expression_quantiles
from ..session import written


def path_correction(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (n - 1) / safe, np.where(n == 2, 1.0, 0.0))


def grow(sample: np.ndarray, rng, depth: int) -> dict[str, np.ndarray]:
    """One tree as flat arrays: split column (-1 in leaves), split value, children, path length in leaves."""
    column, value, left, right, length = [], [], [], [], []

    def node(rows: np.ndarray, level: int) -> int:
        me = len(column)
        for store, empty in ((column, -1), (value, 0.0), (left, -1), (right, -1), (length, 0.0)):
            store.append(empty)
        spread = np.nonzero(rows.max(axis=0) > rows.min(axis=0))[0] if len(rows) > 1 else []
        if level >= depth or not len(spread):
            length[me] = level + float(path_correction(len(rows)))
            return me
        c = int(rng.choice(spread))
        cut = float(rng.uniform(rows[:, c].min(), rows[:, c].max()))
        below = rows[:, c] < cut
        column[me], value[me] = c, cut
        left[me], right[me] = node(rows[below], level + 1), node(rows[~below], level + 1)
        return me

    node(sample, 0)
    return {"column": np.array(column), "value": np.array(value), "left": np.array(left), "right": np.array(right), "length": np.array(length)}


def mean_path(x: np.ndarray, trees: list[dict]) -> np.ndarray:
    total = np.zeros(len(x))
    for t in trees:
        at_node = np.zeros(len(x), dtype=int)
        while True:
            c = t["column"][at_node]
            inner = np.nonzero(c >= 0)[0]
            if not len(inner):
                break
            n = at_node[inner]
            below = x[inner, c[inner]] < t["value"][n]
            at_node[inner] = np.where(below, t["left"][n], t["right"][n])
        total += t["length"][at_node]
    return total / len(trees)


def isolation_forest(df: DataFrame, keys: list[str], columns: list[str] | None = None, share: float = 0.1, trees: int = 100,
                     sample: int = 256, seed: int = 42, flag: str = "outlier") -> DataFrame:
    """Add ``score`` and a flag on the most isolated ``share`` of the rows. Missing numbers count as 0.

    The driver sees ``trees · sample`` rows at most, whatever the table's size."""
    cols = columns or [c for c in numeric_columns(df) if c not in keys]
    x = F.array(*[F.coalesce(number(df, c), F.lit(0.0)) for c in cols])
    drawn = df.select(x.alias("x"), digest(keys, seed, "forest").alias("h")).orderBy("h").limit(trees * sample).select("x").collect()
    rows = np.array([r["x"] for r in drawn], dtype=float).reshape(len(drawn), len(cols))
    rng = np.random.default_rng(seed)
    size = min(sample, len(rows))
    depth = int(np.ceil(np.log2(max(size, 2))))
    forest = [grow(rows[rng.choice(len(rows), size, replace=False)], rng, depth) for _ in range(trees)]
    unit = float(path_correction(size)) or 1.0
    shared = df.sparkSession.sparkContext.broadcast(forest)      # at most trees · 2 · sample nodes

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        return pd.Series(2.0 ** (-mean_path(np.array(v.tolist(), dtype=float).reshape(len(v), len(cols)), shared.value) / unit))

    scored = written(df.withColumn("score", score(x)))
    cut = expression_quantiles(scored, {"score": at("score")}, [1 - share])["score"][0]
    return scored.withColumn(flag, at("score") > F.lit(cut)) if cut is not None else scored.withColumn(flag, F.lit(False))
