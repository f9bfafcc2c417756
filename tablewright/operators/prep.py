"""Preprocessing actions. Parameters are fitted by one small aggregate each and then used
as literals, so the action itself is a narrow projection without joins or shuffles."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import at, double_sql, missing, number, number_sql, numeric_columns, valid
from ..plans.partials import matrix, totals
from ..plans.quantiles import SMALL, expression_quantiles, quantiles, _order_statistics
from .profile import basics, centred, corr_pairs, fences, frequencies

FEW = 10_000   # distinct values looked at on the driver; more stay in tables
INLINE = 64    # values tested one by one inside an expression; more are looked up in a broadcast table


def put(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Replace a column in place."""
    return df.select(*[value.alias(c) if c == name else at(c) for c in df.columns])


def _range(df: DataFrame, column: str) -> dict:
    return basics(df, [column])[1][column]


# ---- transforms ---------------------------------------------------------------------

def _lift(df: DataFrame, column: str, allow_zero: bool) -> Column:
    """The value, moved to ``x - min + 1`` when any is not positive (``x - min`` when zero is fine and any is negative)."""
    low, x = _range(df, column)["min"], number(df, column)
    if low is None or low > 0 or (allow_zero and low >= 0):
        return x
    return x - F.lit(low) + (0.0 if allow_zero else 1.0)


def log_transform(df: DataFrame, column: str) -> DataFrame:
    return put(df, column, F.log(_lift(df, column, False)))


def sqrt_transform(df: DataFrame, column: str) -> DataFrame:
    return put(df, column, F.sqrt(_lift(df, column, True)))


def logit_transform(df: DataFrame, column: str, edge: float = 1e-6) -> DataFrame:
    p = F.least(F.greatest(number(df, column), F.lit(edge)), F.lit(1 - edge))
    return put(df, column, F.when(number(df, column).isNotNull(), F.log(p / (1 - p))))


def arcsin_transform(df: DataFrame, column: str) -> DataFrame:
    """Arc sine of the root; values outside [0, 1] become missing."""
    x = number(df, column)
    return put(df, column, F.when((x >= 0) & (x <= 1), F.asin(F.sqrt(x))))


def log_shifted(df: DataFrame, column: str) -> DataFrame:
    """``ln(max - x + 1)`` for left-skewed columns."""
    return put(df, column, F.log(F.lit(_range(df, column)["max"]) - number(df, column) + 1))


def _box_cox(x: str, lam: float) -> str:
    return f"ln({x})" if abs(lam) < 1e-12 else f"(power({x}, {double_sql(lam)}) - 1) / {double_sql(lam)}"


def _yeo_johnson(x: str, lam: float) -> str:
    up = f"ln({x} + 1)" if abs(lam) < 1e-12 else f"(power({x} + 1, {double_sql(lam)}) - 1) / {double_sql(lam)}"
    down = f"-ln(1 - {x})" if abs(lam - 2) < 1e-12 else f"-(power(1 - {x}, {double_sql(2 - lam)}) - 1) / {double_sql(2 - lam)}"
    return f"CASE WHEN {x} >= 0 THEN {up} ELSE {down} END"


def _best_power(values: DataFrame, shape, jacobian: str) -> float:
    """Power of greatest likelihood: a grid of powers per pass, each pass a tenth of the last one's span.

    One aggregate evaluates the whole grid: ``-n/2 ln var(y) + (power - 1) sum(jacobian)``."""
    centre, span = 0.0, 4.0
    for _ in range(4):
        grid = [centre - span + span * i / 8 for i in range(17)]
        row = values.selectExpr(f"count(x) AS n", f"sum({jacobian}) AS j", *[f"var_pop({shape('x', g)}) AS v{i}" for i, g in enumerate(grid)]).first()
        scores = [(-row["n"] / 2 * log(row[f"v{i}"]) + (g - 1) * row["j"], g) for i, g in enumerate(grid) if row[f"v{i}"]]
        if not scores:
            return 1.0
        centre, span = max(scores)[1], span / 8
    return centre


def box_cox(df: DataFrame, column: str) -> tuple[DataFrame, float]:
    """Transformed table and the fitted power."""
    values = df.select(_lift(df, column, False).alias("x"))
    lam = _best_power(values, _box_cox, "ln(x)")
    moved = df.withColumn("_x", _lift(df, column, False))
    return put(moved, column, F.expr(_box_cox("_x", lam))).drop("_x"), lam


def yeo_johnson(df: DataFrame, column: str) -> tuple[DataFrame, float]:
    x = number_sql(df, column)
    lam = _best_power(df.selectExpr(f"{x} AS x"), _yeo_johnson, "sign(x) * ln(abs(x) + 1)")
    moved = df.withColumn("_x", F.expr(x))
    return put(moved, column, F.expr(f"CASE WHEN _x IS NOT NULL THEN {_yeo_johnson('_x', lam)} END")).drop("_x"), lam


def order_cuts(df: DataFrame, column: str, low: float, high: float) -> tuple[float, float] | None:
    """Values at rank ``int(low·n)`` from below and ``int(high·n)`` from above; ``None`` without values."""
    slim = df.select(number(df, column).alias("x0"))
    n = slim.selectExpr("count(x0)").first()[0]
    if not n:
        return None
    ranks = [int(low * n), n - 1 - int(high * n)]
    found = _order_statistics(slim, {(0, r) for r in ranks}, {0: n}, SMALL)
    return found[0, ranks[0]], found[0, ranks[1]]


def clip(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    x = number(df, column)
    return put(df, column, F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high))))


def winsorize(df: DataFrame, column: str, low: float = 0.05, high: float = 0.05) -> DataFrame:
    """Values beyond the cut ranks take the value at the cut; a column without values stays as it is."""
    cuts = order_cuts(df, column, low, high)
    return clip(df, column, *cuts) if cuts else df


def clip_quantiles(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    q = quantiles(df, columns, [low, high])
    for c in columns:
        if q[c][0] is not None:
            df = clip(df, c, *q[c])
    return df


# ---- outliers -----------------------------------------------------------------------

def outlier_iqr(df: DataFrame, column: str, flag: str = "outlier") -> DataFrame:
    _, _, low, high = fences(df, [column])[column]
    x = number(df, column)
    hit = (x < F.lit(low)) | (x > F.lit(high)) if low is not None else F.lit(False)
    return df.withColumn(flag, F.coalesce(hit, F.lit(False)))


def outlier_zscore(df: DataFrame, column: str, limit: float = 3.0, flag: str = "outlier") -> DataFrame:
    """More than ``limit`` population deviations from the mean; missing is no outlier."""
    s = df.select(F.avg(number(df, column)).alias("m"), F.stddev_pop(number(df, column)).alias("s")).first()
    z = F.abs(number(df, column) - F.lit(s["m"])) / F.lit(s["s"]) if s["s"] else F.lit(0.0)
    return df.withColumn(flag, F.coalesce(z > limit, F.lit(False)))


# ---- scaling ------------------------------------------------------------------------

def scale_robust(df: DataFrame, columns: list[str]) -> DataFrame:
    q = quantiles(df, columns, [0.25, 0.5, 0.75])
    for c in columns:
        low, mid, high = q[c]
        if mid is not None:
            df = put(df, c, (number(df, c) - F.lit(mid)) / F.lit((high - low) or 1.0))
    return df


def scale_standard(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean 0, population deviation 1; a constant column becomes 0."""
    _, base = basics(df, columns)
    shape = centred(df, columns, base)
    for c in columns:
        n, std = base[c]["n"], shape[c]["std"]
        if n:
            spread = (std or 0.0) * ((n - 1) / n) ** 0.5
            df = put(df, c, (number(df, c) - F.lit(base[c]["mean"])) / F.lit(spread or 1.0))
    return df


def scale_minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """To [0, 1]; a constant column becomes 0."""
    _, base = basics(df, columns)
    for c in columns:
        low, high = base[c]["min"], base[c]["max"]
        if low is not None:
            df = put(df, c, (number(df, c) - F.lit(low)) / F.lit((high - low) or 1.0))
    return df


# ---- encoding -----------------------------------------------------------------------

def sorted_values(df: DataFrame, column: str, limit: int | None) -> list | None:
    """Distinct non-missing values in order, or ``None`` if there are more than ``limit``."""
    rows = df.where(~missing(df, column)).select(at(column).alias("v")).distinct()
    rows = (rows if limit is None else rows.limit(limit + 1)).collect()
    return None if limit is not None and len(rows) > limit else sorted(r["v"] for r in rows)


def encode_binary(df: DataFrame, column: str) -> DataFrame:
    """The first two values in sort order to 0 and 1 in ``<column>_binary``; others missing."""
    firsts = [r["v"] for r in df.where(~missing(df, column)).select(at(column).alias("v")).distinct().orderBy("v").limit(2).collect()]
    out = F.lit(None).cast("int")
    for i, v in enumerate(firsts):
        out = F.when(at(column) == F.lit(v), F.lit(i)).otherwise(out)
    return df.withColumn(f"{column}_binary", out)


def encode_onehot(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """One 0/1 column per value, in place of the column; with ``limit``, more values than that are an error.

    A table cannot be wider than its plan: for columns of very many values use ``encode_onehot_vector``."""
    values = sorted_values(df, column, limit)
    if values is None:
        raise ValueError(f"{column} has more than {limit} values; use encode_onehot_vector, encode_target or encode_hash")
    return df.select(*[at(c) for c in df.columns if c != column],
                     *[F.coalesce((at(column) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values])


def encode_onehot_vector(df: DataFrame, column: str) -> DataFrame:
    """One sparse 0/1 vector ``<column>_onehot`` in place of the column, positions in value order; missing values are zero vectors."""
    from pyspark.ml.feature import OneHotEncoder
    ranked = encode_ordinal(df.withColumn("_code", valid(df, column)), "_code")
    width = ranked.agg(F.max("_code")).first()[0]
    if width is None:
        return df.drop(column)
    filled = ranked.withColumn("_code", F.coalesce("_code", F.lit(width + 1)))
    model = OneHotEncoder(inputCol="_code", outputCol=f"{column}_onehot", dropLast=False, handleInvalid="keep")
    model = model.fit(filled.select(F.explode(F.array(F.lit(0.0), F.lit(float(width)))).alias("_code")).limit(2))
    return model.transform(filled).drop("_code", column)


def lookup_encode(df: DataFrame, column: str, table: DataFrame, key: str, value: str, limit: int = 1_000_000) -> DataFrame:
    """Replace a key by the value a lookup table gives it.

    The table is broadcast only when it has at most ``limit`` rows; a larger one is joined by shuffle,
    where adaptive execution splits skewed keys."""
    slim = table.select(at(key).alias("_k"), at(value).alias("_v"))
    if slim.limit(limit + 1).count() <= limit:
        slim = F.broadcast(slim)
    joined = df.join(slim, at(column) == F.col("_k"), "left")
    return joined.select(*[F.col("_v").alias(c) if c == column else at(c) for c in df.columns])


def encode_ordinal(df: DataFrame, column: str) -> DataFrame:
    """Rank of the value among the sorted distinct values, from 0."""
    values = sorted_values(df, column, FEW)
    if values is not None and len(values) > INLINE:
        ranks = df.sparkSession.createDataFrame([(v, float(i)) for i, v in enumerate(values)], df.select(at(column).alias("v")).schema.add("pos", "double"))
        return lookup_encode(df, column, ranks, "v", "pos")
    if values is not None:
        ranks = F.array_position(F.array(*[F.lit(v) for v in values]), valid(df, column)) - 1
        return put(df, column, F.when(~missing(df, column), ranks).cast("double"))
    from ..plans.positions import ordered_positions
    distinct = df.where(~missing(df, column)).select(at(column).alias("v")).distinct()
    ranked, _ = ordered_positions(distinct, ["v"])
    return lookup_encode(df, column, ranked.select("v", F.col("_pos").cast("double").alias("pos")), "v", "pos")


encode_label = encode_ordinal


def encode_target(df: DataFrame, column: str, target: str) -> DataFrame:
    """Mean of the target per value."""
    means = df.where(~missing(df, column)).groupBy(at(column).alias("v")).agg(F.avg(number(df, target)).alias("m"))
    return lookup_encode(df, column, means, "v", "m")


def encode_hash(df: DataFrame, column: str, n: int = 100) -> DataFrame:
    """``n`` columns; the value's hash picks one of them and the sign it is counted with."""
    tagged = df.withColumn("_h", F.hash(F.coalesce(at(column).cast("string"), F.lit("nan"))))
    place, sign = F.abs(F.col("_h").cast("long")) % n, F.when(F.col("_h") >= 0, 1.0).otherwise(-1.0)
    return tagged.select(*[at(c) for c in df.columns if c != column],
                         *[F.when(place == i, sign).otherwise(0.0).alias(f"{column}_hash_{i}") for i in range(n)])


# ---- columns that carry nothing -----------------------------------------------------

def drop_constant(df: DataFrame, cv_below: float | None = None) -> DataFrame:
    """Drop columns of at most one value; with ``cv_below`` also numbers of smaller variation."""
    # one value only: least equals greatest
    row = df.agg(*[x for i, c in enumerate(df.columns) for x in (F.min(valid(df, c)).alias(f"a{i}"), F.max(valid(df, c)).alias(f"b{i}"))]).first()
    gone = {c for i, c in enumerate(df.columns) if row[f"a{i}"] == row[f"b{i}"]}
    if cv_below is not None:
        cols = [c for c in numeric_columns(df) if c not in gone]
        _, base = basics(df, cols)
        shape = centred(df, cols, base)
        gone |= {c for c in cols if base[c]["mean"] and abs((shape[c]["std"] or 0.0) / base[c]["mean"]) < cv_below}
    return df.drop(*gone)


def select_low_variance(df: DataFrame, columns: list[str], limit: float = 0.1) -> DataFrame:
    """Drop the listed columns whose population variance is at most ``limit``."""
    row = df.agg(*[F.var_pop(number(df, c)).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    return df.drop(*[c for i, c in enumerate(columns) if row[f"v{i}"] is None or row[f"v{i}"] <= limit])


def drop_missing_columns(df: DataFrame, limit: float = 0.5) -> DataFrame:
    row = df.agg(*[F.avg(missing(df, c).cast("double")).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    return df.drop(*[c for i, c in enumerate(df.columns) if (row[f"m{i}"] or 0.0) > limit])


def drop_collinear(df: DataFrame, limit: float = 0.95) -> DataFrame:
    """Drop the second column of every pair correlated above the limit."""
    pairs = corr_pairs(df).where(F.abs("r") > limit).select("right").distinct().collect()   # at most one row per column
    return df.drop(*[r["right"] for r in pairs])


# ---- missing values -----------------------------------------------------------------

def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    _, base = basics(df, columns)
    return df.select(*[F.coalesce(number(df, c), F.lit(base[c]["mean"])).alias(c) if c in columns and base[c]["mean"] is not None else at(c) for c in df.columns])


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median fill; 0 for a column without values."""
    q = quantiles(df, columns, [0.5])
    return df.select(*[F.coalesce(number(df, c), F.lit(q[c][0] if q[c][0] is not None else 0.0)).alias(c) if c in columns else at(c) for c in df.columns])


def impute_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent value, the least one on ties."""
    from .profile import top_frequencies
    top = {r["column"]: r["value"] for r in top_frequencies(frequencies(df, columns), 1).collect()}
    return df.select(*[F.coalesce(valid(df, c), F.lit(top[c]).cast(df.schema[c].dataType)).alias(c) if c in top else at(c) for c in df.columns])


def impute_iterative(df: DataFrame, columns: list[str], rounds: int = 3) -> DataFrame:
    """Chained regressions: each column with holes is predicted from the others, a few rounds over.

    A regression is the solution of the normal equations, so a fit is one pass that sums products. What earlier fits
    filled in is worked out again from the row itself in every pass, so no copy of the table is written. Columns
    without any value stay as they are and predict nothing; rows with infinite values take no part in the fits."""
    total, base = basics(df, columns)
    used = [c for c in columns if base[c]["n"] > 0]
    holes = [i for i, c in enumerate(used) if base[c]["n"] < total]
    if not holes:
        return df
    finite = [F.when(F.abs(number(df, c)) < float("inf"), number(df, c)) for c in used]
    means = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(finite)]).first()
    centre = np.array([m or 0.0 for m in means])
    fits: list[tuple[int, np.ndarray]] = []                    # column, and constant with a factor for every column

    def filled(x: np.ndarray, fits: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        gap, x = np.isnan(x), x - centre
        x[gap] = 0.0
        for c, beta in fits:
            x[gap[:, c], c] = beta[0] + x[gap[:, c]] @ beta[1:]
        return x, gap

    slim = df.select(F.array(*[number(df, c) for c in used]).alias("x"))
    for _ in range(rounds):
        for c in holes:
            def products(batch: pa.RecordBatch, c=c, fits=tuple(fits)) -> np.ndarray:
                x, gap = filled(matrix(batch.column(0)), fits)
                x = x[~gap[:, c] & np.isfinite(x).all(axis=1)]
                x = np.c_[np.ones(len(x)), x]
                return x.T @ x

            k = len(used) + 1
            gram = totals(slim, products, k * k).reshape(k, k)
            others = [i for i in range(k) if i != c + 1]
            beta = np.zeros(k)
            beta[others] = np.linalg.lstsq(gram[np.ix_(others, others)] / max(gram[0, 0], 1.0), gram[others, c + 1] / max(gram[0, 0], 1.0), rcond=None)[0]
            fits.append((c, beta))

    names = df.columns
    places = {i: names.index(used[i]) for i in holes}

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                observed, arrays = matrix(batch.columns[-1]), list(batch.columns[:-1])
                x, gap = filled(observed, fits)
                for i in holes:
                    arrays[places[i]] = pa.array(np.where(gap[:, i], x[:, i] + centre[i], observed[:, i]), pa.float64())
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    filled_names = {used[i] for i in holes}
    out = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in filled_names else f for f in df.schema])
    plain = [at(c).alias(f"c{i}") for i, c in enumerate(names)]        # names with dots cannot be handed over
    return df.select(*plain, F.array(*[number(df, c) for c in used]).alias("x")).mapInArrow(complete, out)


# ---- carrying out advice ------------------------------------------------------------

def _mice(df: DataFrame, column: str) -> DataFrame:
    """Fill the one column; the others are filled only to predict it and keep their own holes."""
    others = [c for c in numeric_columns(df) if c != column]
    marked = df.select(*[at(c) for c in df.columns], *[at(o).alias(f"_own_{i}") for i, o in enumerate(others)])
    done = impute_iterative(marked, [column, *others])
    back = {o: F.col(f"_own_{i}") for i, o in enumerate(others)}
    return done.select(*[back.get(c, at(c)).alias(c) for c in df.columns])


def _knn(df: DataFrame, column: str, key: str) -> DataFrame:
    from .neighbours import impute_knn
    others = [c for c in numeric_columns(df) if c not in (column, key)]
    filled = impute_knn(df.select(at(key), at(column), *[at(o) for o in others]), key, [column, *others]).select(at(key).alias("_key"), at(column).alias("_filled"))
    return df.join(filled, at(key) == F.col("_key"), "left").select(*[F.coalesce(number(df, column), F.col("_filled")).alias(c) if c == column else at(c) for c in df.columns])


def _forest(df: DataFrame, key: str) -> DataFrame:
    from .isolation import isolation_forest
    return isolation_forest(df, [key]).drop("score")


def _time(df: DataFrame, column: str) -> Column:
    from .timeseries import as_time
    return as_time(df, column)


def _date_parts(df: DataFrame, column: str) -> DataFrame:
    from ..functions.dates import datetime_parts
    return df.withColumns({f"{column}_{n}": p for n, p in datetime_parts(_time(df, column)).items()})


def _clock_parts(df: DataFrame, column: str) -> DataFrame:
    t = _time(df, column)
    return df.withColumns({f"{column}_{n}": f(t) for n, f in (("hour", F.hour), ("minute", F.minute), ("second", F.second))})


def _cyclical(df: DataFrame, column: str) -> DataFrame:
    """Sine and cosine of hour, weekday and month of a date; of a number, over its own range."""
    from ..functions.dates import cyclical_encode
    if column in numeric_columns(df):
        r = _range(df, column)
        if r["min"] is None:
            return df
        period = int(r["max"] - r["min"]) + 1
        parts = {"": (number(df, column) - F.lit(r["min"]), period)}
    else:
        t = _time(df, column)
        parts = {"_hour": (F.hour(t), 24), "_weekday": (F.weekday(t), 7), "_month": (F.month(t) - 1, 12)}
    both = [(n, cyclical_encode(p, period)) for n, (p, period) in parts.items()]
    return df.withColumns({f"{column}{n}_{k}": x for n, pair in both for k, x in zip(("sin", "cos"), pair)})


def _clean_dates(df: DataFrame, column: str) -> DataFrame:
    return put(df, column, _time(df, column))


def _lags(df: DataFrame, column: str, key: str) -> DataFrame:
    """Three lags of every number in the order of the date column; rows are put in order once for all of them."""
    from .timeseries import _framed, measures
    blocks, w = _framed(df, column, [key], [], 3, 0)
    lags = [F.lag(at(c), i).over(w).alias(f"{c}_lag_{i}") for c in measures(df, column, [key]) for i in (1, 2, 3)]
    return blocks.select("_own", *[at(c) for c in df.columns], *lags).where("_own").drop("_own")


def _rolling(df: DataFrame, column: str, key: str) -> DataFrame:
    """Mean and deviation of the last seven rows of every number in the order of the date column."""
    from .timeseries import _framed, measures
    blocks, w = _framed(df, column, [key], [], 6, 0)
    frame = w.rowsBetween(-6, 0)
    full = lambda c, f: F.when(F.count(number(df, c)).over(frame) == 7, f(number(df, c)).over(frame))
    stats = [full(c, f).alias(f"{c}_rolling_{n}") for c in measures(df, column, [key]) for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return blocks.select("_own", *[at(c) for c in df.columns], *stats).where("_own").drop("_own")


ACTIONS = {
    "yeo_johnson_transform": lambda df, c: yeo_johnson(df, c)[0], "boxcox_transform": lambda df, c: box_cox(df, c)[0],
    "log_transform": log_transform, "sqrt_transform": sqrt_transform, "logit_transform": logit_transform, "arcsin_transform": arcsin_transform,
    "log_transform_shifted": log_shifted, "winsorize_5_percent": winsorize, "winsorize": winsorize,
    "robust_scaler": lambda df, c: scale_robust(df, [c]), "standard_scaler": lambda df, c: scale_standard(df, [c]),
    "min_max_scaler": lambda df, c: scale_minmax(df, [c]), "uniform_scaling": lambda df, c: scale_minmax(df, [c]),
    "binary_encode": encode_binary, "one_hot_encode": encode_onehot, "ordinal_encode": encode_ordinal, "categorical_encoding": encode_ordinal, "feature_hashing": encode_hash,
    "drop_column": lambda df, c: df.drop(c), "drop_constant": lambda df, c: df.drop(c), "feature_selection": lambda df, c: select_low_variance(df, [c]),
    "median_imputation": lambda df, c: impute_median(df, [c]), "mode_imputation": lambda df, c: impute_mode(df, [c]),
    "frequent_category_imputation": lambda df, c: impute_mode(df, [c]), "advanced_imputation_mice": _mice, "remove_duplicates": lambda df, c: df.dropDuplicates(),
    "remove_collinear": lambda df, c: drop_collinear(df), "iqr_method": lambda df, c: outlier_iqr(df, c, f"{c}_outlier"),
    "cyclical_encoding": _cyclical, "datetime_extraction": _date_parts, "time_based_features": _clock_parts, "datetime_cleaning": _clean_dates,
}
KEYED = {"knn_imputation": _knn, "isolation_forest": lambda df, c, key: _forest(df, key), "lag_features": _lags, "rolling_statistics": _rolling}
NOTHING = {"no_imputation_needed", "no_transform_needed", "consider_removal"}       # advice that asks for no change
NUMERIC = {"yeo_johnson_transform", "boxcox_transform", "log_transform", "sqrt_transform", "logit_transform", "arcsin_transform", "log_transform_shifted",
           "winsorize_5_percent", "winsorize", "robust_scaler", "standard_scaler", "min_max_scaler", "uniform_scaling", "feature_selection", "median_imputation",
           "advanced_imputation_mice", "iqr_method", "knn_imputation"}
WHOLE = {"remove_duplicates", "remove_collinear"}                                     # about the table, whatever the column


def apply_advice(df: DataFrame, advice: list[tuple[str, str]], selected: list[str] | None = None, key: str | None = None,
                 target: str | None = None) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """Run (column, action) pairs in order. Returns the table and the log of (column, action, status).

    An action without an operator is logged as ``unknown``, one for a column that is not (or no longer) there as ``no such
    column``, one that needs a unique ``key`` or a ``target`` that was not given as ``needs key`` or ``needs target``, one for
    numbers on another column as ``failed: not numeric``. Any other failure raises. An action on the whole table (an isolation forest) is run once."""
    log_rows, ran = [], set()
    for column, action in advice:
        if selected and action not in selected:
            continue
        status = "done"
        if action in NOTHING:
            pass
        elif action not in ACTIONS and action not in KEYED and action != "target_encode":
            status = "unknown"
        elif column not in df.columns and action not in WHOLE:
            status = "no such column"
        elif action in NUMERIC and column not in numeric_columns(df):
            status = "failed: not numeric"
        elif action in KEYED and key is None:
            status = "needs key"
        elif action == "target_encode" and target is None:
            status = "needs target"
        elif action == "isolation_forest" and action in ran:
            pass
        elif action in KEYED:
            df = KEYED[action](df, column, key)
        elif action == "target_encode":
            df = encode_target(df, column, target)
        else:
            df = ACTIONS[action](df, column)
        ran.add(action)
        log_rows.append((column, action, status))
    return df, log_rows
