"""Projections, filters, checks, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import at, categorical_columns, is_float, missing, number, numeric_columns, quoted
from ..functions.draws import digest
from ..functions.scalars import LIMITS, SUPPORTED


def drop_columns(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """Drop columns; a column in ``keep`` (the target) may not be dropped."""
    held = sorted(set(columns) & set(keep))
    if held:
        raise ValueError(f"target columns cannot be dropped: {held}")
    return df.drop(*columns)


def drop_labels(df: DataFrame, target: str, labels: list) -> DataFrame:
    """Rows whose target is none of the labels; a missing target stays."""
    return df.where(~at(target).isin(*labels) | at(target).isNull())


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*[at(c) for c in numeric_columns(df)])


def select_categorical(df: DataFrame) -> DataFrame:
    return df.select(*[at(c) for c in categorical_columns(df)])


def common_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` cut down to the columns ``right`` also has, in order."""
    return left.select(*[at(c) for c in left.columns if c in right.columns])


def rename_select_fields(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Pick (nested) fields by path under new names."""
    return df.select(*[F.col(path).alias(name) for path, name in fields.items()])


def strip_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def filter_extension(df: DataFrame, path: str, keep: list[str] | None = None, drop: list[str] = (".zip",)) -> DataFrame:
    """Rows whose lower-case suffix is kept (if a list is given) and not dropped."""
    suffix = F.lower(F.regexp_extract(at(path), r"^(?:.*/)?[^/]+(\.[^./]+)$", 1))
    out = df.where(~suffix.isin(*drop))
    return out if keep is None else out.where(suffix.isin(*keep))


def filter_supported(df: DataFrame, path: str) -> DataFrame:
    return filter_extension(df, path, SUPPORTED, [])


def filter_size_range(df: DataFrame, mb: str, limit: float = 100) -> DataFrame:
    return df.where((at(mb) >= 0) & (at(mb) < limit))


def inf_to_null(df: DataFrame) -> DataFrame:
    """Infinite and NaN numbers become null."""
    inf = F.lit(float("inf"))
    return df.select(*[F.when((F.abs(at(c)) < inf) & ~F.isnan(at(c)), at(c)).alias(c) if is_float(df, c) else at(c) for c in df.columns])


def drop_missing_rows(df: DataFrame, check: bool = False) -> DataFrame:
    """Rows without any missing value; ``check`` fails if none is left."""
    out = df.na.drop("any")
    if check:
        assert_nonempty(out)
    return out


def assert_nonempty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the table has no rows")
    return df


def target_issues(df: DataFrame, target: str, task: str) -> list[str]:
    """Why ``target`` cannot serve the task (``classify`` or ``regress``); empty if it can."""
    if target not in df.columns:
        return ["target_not_found"]
    issues = []
    if not [c for c in numeric_columns(df) if c != target]:
        issues.append("no_numeric_features")
    if task == "classify" and df.select(at(target)).where(~missing(df, target)).distinct().limit(2).count() < 2:
        issues.append("fewer_than_two_classes")
    if task == "regress" and target not in numeric_columns(df):
        issues.append("target_not_numeric")
    return issues


def validate_target(df: DataFrame, target: str, task: str) -> DataFrame:
    issues = target_issues(df, target, task)
    return df.sparkSession.createDataFrame([(target, task, not issues, issues)], "target string, task string, valid boolean, issues array<string>")


def validate_limits(files: DataFrame, size: str, limits: dict = LIMITS) -> DataFrame:
    """File count and total MB against the limits, with the list of what is exceeded."""
    row = files.agg(F.count(F.lit(1)).alias("file_count"), (F.sum(at(size)) / F.lit(1048576.0)).alias("estimated_mb"))
    issues = F.array_compact(F.array(F.when(F.col("file_count") > limits["file_count_limit"], F.lit("file_count_above_limit")),
                                     F.when(F.col("estimated_mb") > limits["memory_limit_mb"], F.lit("memory_above_limit"))))
    return row.withColumn("issues", issues).withColumn("valid", F.size("issues") == 0)


# ---- sorts and limits ---------------------------------------------------------------

def preview_head(df: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """First rows by key, between 1 and 100 of them."""
    if not 1 <= n <= 100:
        raise ValueError("rows must be between 1 and 100")
    return df.orderBy(*[at(k) for k in keys]).limit(n)


def preview_sample(df: DataFrame, keys: list[str], k: int = 100, seed: int = 42) -> DataFrame:
    """``k`` rows in digest order (a top-k, no full sort)."""
    return df.orderBy(digest(keys, seed, "order"), *[at(c) for c in keys]).limit(k)


def top_categories(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values as text."""
    text = at(column).cast("string")
    return (df.where(text.isNotNull()).groupBy(text.alias("category")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "category").limit(n))


def top_n_categories(before: DataFrame, after: DataFrame, column: str, n: int) -> DataFrame:
    out = top_categories(before, column, n).withColumn("side", F.lit("before"))
    return out.unionByName(top_categories(after, column, n).withColumn("side", F.lit("after")))


def numeric_aware(column: str) -> list[Column]:
    """Sort keys: numbers by value first, then text."""
    v = at(column).try_cast("double")
    return [v.isNull(), v, at(column)]


def sort_categories_numeric_aware(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(*numeric_aware(column))


def sort_by_x(df: DataFrame, x: str, *ties: str) -> DataFrame:
    return df.orderBy(at(x), *[at(t) for t in ties])


def best_model(scores: DataFrame) -> DataFrame:
    """The (model, score) row of the greatest score; ties go to the later name."""
    top = F.max(F.struct("score", "model"))
    return scores.agg(top.alias("t")).select("t.model", "t.score")


# ---- sets ---------------------------------------------------------------------------

def union_rows(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def intersect_features(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def union_categories(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """All categories of both tables; each side is merged before the union."""
    one = lambda df: df.select(at(column).cast("string").alias("category")).where("category is not null").distinct()
    return one(before).union(one(after)).distinct()


def remove_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def metrics_wide(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per model, one column per metric, missing 0."""
    return scores.groupBy("model").pivot("metric", metrics).agg(F.max("score")).na.fill(0.0)


def metrics_long(wide: DataFrame, metrics: list[str]) -> DataFrame:
    return wide.unpivot(["model"], metrics, "metric", "score")


def model_rank(scores: DataFrame) -> DataFrame:
    """Models in score order with the best one marked (one row per model: a handful of rows)."""
    from pyspark.sql import Window
    order = Window.orderBy(F.desc("score"), "model")
    return scores.withColumn("rank", F.row_number().over(order)).withColumn("best", F.col("rank") == 1)


def trials_table(trials: DataFrame, params: list[str]) -> DataFrame:
    """Trials with their JSON parameters as columns."""
    parsed = F.from_json("params", "map<string,string>")
    return trials.select(*[at(c) for c in trials.columns if c != "params"], *[parsed[p].alias(p) for p in params])
