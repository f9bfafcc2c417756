"""Before/after comparison and the tables behind charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import at, missing, number
from ..functions.draws import digest
from ..functions.scalars import ratio_change
from ..plans.quantiles import grouped_quantiles
from .joins import join_category_counts
from .profile import basics, centred, corr_pair, describe, literal_rows
from .timeseries import as_time


def _summary(df: DataFrame, columns: list[str]) -> tuple[int, dict]:
    rows, base = basics(df, columns)
    shape = centred(df, columns, base)
    return rows, {c: {**base[c], "std": shape[c]["std"]} for c in columns}


def compare_numeric(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """mean, std, min, max before and after with the change, one row per column and statistic."""
    a, b = _summary(before, columns)[1], _summary(after, columns)[1]
    rows = [{"column": c, "statistic": s, "before": a[c][s], "after": b[c][s]} for c in columns for s in ("mean", "std", "min", "max")]
    table = literal_rows(before.sparkSession, rows, "column string, statistic string, before double, after double")
    return table.withColumn("change", F.col("after") - F.col("before"))


def compare_relation(before: DataFrame, after: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation and row count before and after, change and percent."""
    rows = [{"measure": "correlation", "before": corr_pair(before, x, y).first()["r"], "after": corr_pair(after, x, y).first()["r"]},
            {"measure": "rows", "before": float(before.count()), "after": float(after.count())}]
    change, percent = ratio_change(F.col("before"), F.col("after"))
    return literal_rows(before.sparkSession, rows, "measure string, before double, after double").withColumns({"change": change, "percent": percent})


def compare_categories(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Counts, shares, share change and growth per category (percent, two places)."""
    counts = join_category_counts(before, after, column)
    totals = counts.agg(F.sum("original").alias("o"), F.sum("augmented").alias("a")).first()
    share = lambda c, t: F.round(F.col(c) * 100.0 / F.lit(float(t or 1)), 2)
    growth = F.round(F.try_divide((F.col("augmented") - F.col("original")) * 100.0, F.col("original")), 2)
    out = counts.withColumn("share_before", share("original", totals["o"])).withColumn("share_after", share("augmented", totals["a"]))
    return (out.withColumn("share_change", F.round(F.col("share_after") - F.col("share_before"), 2))
            .withColumn("growth", F.coalesce(growth, F.lit(0.0))))


def compare_describe(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    one = lambda df, side: describe(df, columns).withColumn("side", F.lit(side))
    return one(before, "before").unionByName(one(after, "after"))


def compare_series(before: DataFrame, after: DataFrame, date: str, column: str) -> DataFrame:
    """Row growth, percent change of mean and deviation, and the period covered before."""
    (na, a), (nb, b) = _summary(before, [column]), _summary(after, [column])
    percent = lambda x, y: None if x in (None, 0) or y is None else (y - x) / x * 100
    bounds = before.agg(F.min(as_time(before, date)).alias("first"), F.max(as_time(before, date)).alias("last"))
    return bounds.select("first", "last", F.lit(percent(na, nb)).cast("double").alias("growth"),
                         F.lit(percent(a[column]["mean"], b[column]["mean"])).cast("double").alias("mean_change"),
                         F.lit(percent(a[column]["std"], b[column]["std"])).cast("double").alias("std_change"))


def growth(before: DataFrame, after: DataFrame) -> DataFrame:
    from .augment import aug_stats
    return aug_stats(before, after)


def histogram(df: DataFrame, columns: list[str], bins: int = 30) -> DataFrame:
    """Counts per equal-width bin of each column; the greatest value falls into the last bin."""
    _, base = basics(df, columns)
    out = None
    for c in columns:
        low, high = base[c]["min"], base[c]["max"]
        if low is None:
            continue
        width = (high - low) / bins or 1.0
        v = number(df, c)
        place = F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        part = (df.where(v.isNotNull()).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
                .select(F.lit(c).alias("column"), "bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("start"), "n"))
        out = part if out is None else out.unionByName(part)
    return out


def box_stats(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """min, quartiles, max and whisker ends (the outermost values within 1.5 IQR), per group if one is given."""
    name = group or "_all"
    rows = df if group else df.withColumn(name, F.lit("all"))
    q = grouped_quantiles(rows, name, column, [0.25, 0.5, 0.75])
    q = q.select(F.col(name).alias("category"), F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"))
    v = number(rows, column)
    # a hot category stays evenly spread: AQE splits it, and the aggregate merges before the shuffle
    values = rows.select(at(name).alias("category"), v.alias("v")).where("v IS NOT NULL").join(q, "category")
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach)
    return values.groupBy("category", "q1", "median", "q3").agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"), F.count("v").alias("n"))


def scatter_points(df: DataFrame, x: str, y: str, keys: list[str], limit: int | None = None, seed: int = 42) -> DataFrame:
    """Pairs without missing values; ``limit`` draws that many by key digest for display."""
    pairs = df.where(~missing(df, x) & ~missing(df, y))
    if limit is not None:
        pairs = pairs.orderBy(digest(keys, seed, "order"), *[at(k) for k in keys]).limit(limit)
    return pairs.select(*[at(k) for k in keys if k not in (x, y)], at(x), at(y))


def category_shares(df: DataFrame, column: str) -> DataFrame:
    """Count and share per value."""
    counts = df.where(~missing(df, column)).groupBy(at(column).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).first()["t"]
    return counts.withColumn("share", F.col("n") / F.lit(float(total or 1)))
