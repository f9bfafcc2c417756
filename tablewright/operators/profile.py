"""Column profiles and the statistics they are made of.

All per-column moments come from one aggregate, all quantiles from one more, and all
outlier counts from a third, however many columns there are. Value frequencies use one
long (column, value) count; ranked rows are cut before the shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import (DATE_TYPES, at, double_sql, is_float, is_integral, missing, number, number_sql, numeric_columns,
                                 text_columns, valid)
from ..plans.gram import correlations, pair_sums
from ..plans.quantiles import quantiles


def long_form(df: DataFrame, columns: list[str], value) -> DataFrame:
    """(column, value) rows; ``value`` maps a column name to an expression of one type."""
    names = {f"v{i}": c for i, c in enumerate(columns)}
    flat = df.select(*[value(c).alias(n) for n, c in names.items()]).unpivot([], list(names), "column", "value")
    back = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return flat.select(back[F.col("column")].alias("column"), "value")


def spread_row(df: DataFrame, columns: list[str], fields: dict) -> DataFrame:
    """Turn one wide aggregate row with ``field__i`` columns into one row per column."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{name}__{i}").cast(kind).alias(name) for name, kind in fields.items()])
        for i, c in enumerate(columns)])
    return df.select(F.explode(cells).alias("cell")).select("cell.*")


def value_text(df: DataFrame, name: str) -> Column:
    """A value as text for counting; whole floats keep their decimal form, -0.0 equals 0.0."""
    v = valid(df, name)
    return (v + F.lit(0.0) if is_float(df, name) else v).cast("string")


# ---- counts -------------------------------------------------------------------------

def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count per value, most frequent first, missing left out."""
    return (df.where(~missing(df, column)).groupBy(at(column).alias("value"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value"))


def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value as text, n). Whole numbers, other numbers and texts are counted in their own type first."""
    numeric = set(numeric_columns(df))
    whole = [c for c in columns if is_integral(df, c)]
    real = [c for c in columns if c in numeric and c not in whole]
    rest = [c for c in columns if c not in numeric]
    kinds = [(whole, lambda c: at(c).cast("long")), (real, lambda c: number(df, c) + F.lit(0.0)), (rest, lambda c: at(c).cast("string"))]
    out = None
    for cols, value in kinds:
        if cols:
            counts = (long_form(df, cols, value).where(F.col("value").isNotNull()).groupBy("column", "value")
                      .agg(F.count(F.lit(1)).alias("n")).select("column", F.col("value").cast("string").alias("value"), "n"))
            out = counts if out is None else out.unionByName(counts)
    return out


def top_frequencies(counts: DataFrame, k: int) -> DataFrame:
    """Rank rows of ``frequencies``; ranks above ``k`` are dropped before the shuffle."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def frequency_facts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: distinct values, least count, three greatest counts, most frequent value."""
    counts = frequencies(df, columns)
    whole = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"), F.min("n").alias("least"))
    top = (top_frequencies(counts, 3).groupBy("column")
           .agg(*[F.max(F.when(F.col("rank") == i, F.col("n"))).alias(f"f{i}") for i in (1, 2, 3)],
                F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("mode")))
    return whole.join(top, "column")


def peak_flags(facts: DataFrame) -> DataFrame:
    """``is_bimodal`` / ``is_multimodal`` from the three greatest counts."""
    first, second = F.col("f1") / F.col("f2"), F.col("f2") / F.col("f3")
    known = F.col("f3").isNotNull()
    return facts.withColumns({
        "is_bimodal": F.coalesce(known & (first > 0.5) & (first < 2.0) & (second > 2.0), F.lit(False)),
        "is_multimodal": F.coalesce(known & (first > 0.3) & (first < 3.0) & (second > 0.3) & (second < 3.0), F.lit(False)),
    })


def frequency_peaks(df: DataFrame, columns: list[str]) -> DataFrame:
    return peak_flags(frequency_facts(df, columns)).select("column", "f1", "f2", "f3", "is_bimodal", "is_multimodal")


def null_info(df: DataFrame) -> DataFrame:
    """Per column: non-null, null, type."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count_if(missing(df, c)).alias(f"null_count__{i}") for i, c in enumerate(cols)])
    wide = wide.select("*", *[(F.col("rows") - F.col(f"null_count__{i}")).alias(f"non_null_count__{i}") for i in range(len(cols))],
                       *[F.lit(df.schema[c].dataType.simpleString()).alias(f"dtype__{i}") for i, c in enumerate(cols)])
    return spread_row(wide, cols, {"non_null_count": "long", "null_count": "long", "dtype": "string"})


def missing_ratio(df: DataFrame) -> DataFrame:
    """Missing share per column and, as ``_table``, over all cells."""
    cols = df.columns
    shares = [F.avg(missing(df, c).cast("double")) for c in cols]
    total = sum(shares[1:], shares[0]) / len(cols)
    wide = df.agg(*[s.alias(f"missing_ratio__{i}") for i, s in enumerate([*shares, total])])
    return spread_row(wide, [*cols, "_table"], {"missing_ratio": "double"})


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row: count and share. Copies are merged before the shuffle."""
    copies = df.groupBy(*[at(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"),
                      F.coalesce(F.sum("_copies"), F.lit(0)).alias("n")).select(
        "duplicates", F.coalesce(F.try_divide(F.col("duplicates").cast("double"), F.col("n")), F.lit(0.0)).alias("duplicate_ratio"))


def distinct_count(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct non-missing values per column and their ratio to all rows."""
    cols = columns or df.columns
    if approximate:
        wide = df.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(value_text(df, c)).alias(f"u{i}") for i, c in enumerate(cols)])
        wide = wide.select(*[F.col(f"u{i}").alias(f"unique_count__{i}") for i in range(len(cols))],
                           *[(F.col(f"u{i}") / F.col("n")).alias(f"unique_ratio__{i}") for i in range(len(cols))])
        return spread_row(wide, cols, {"unique_count": "long", "unique_ratio": "double"})
    counts = frequencies(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    base = spread_row(df.agg(*[F.count(F.lit(1)).alias(f"rows__{i}") for i in range(len(cols))]), cols, {"rows": "long"})
    unique = F.coalesce("unique_count", F.lit(0))
    return base.join(counts, "column", "left").select("column", unique.alias("unique_count"), F.try_divide(unique.cast("double"), F.col("rows")).alias("unique_ratio"))


def column_info(df: DataFrame) -> DataFrame:
    """Type, distinct, missing, min, max, mean per column (numbers only for the last three)."""
    cols, numeric = df.columns, set(numeric_columns(df))
    aggs = []
    for i, c in enumerate(cols):
        v = number(df, c) if c in numeric else F.lit(None).cast("double")
        aggs += [F.count_if(missing(df, c)).alias(f"missing_count__{i}"), F.min(v).alias(f"min__{i}"),
                 F.max(v).alias(f"max__{i}"), F.avg(v).alias(f"mean__{i}")]
    basics = spread_row(df.agg(*aggs), cols, {"missing_count": "long", "min": "double", "max": "double", "mean": "double"})
    kinds = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(df.schema[c].dataType.simpleString()))])
    return (basics.join(distinct_count(df).select("column", "unique_count"), "column")
            .select("column", kinds[F.col("column")].alias("dtype"), "unique_count", "missing_count", "min", "max", "mean"))


# ---- numbers ------------------------------------------------------------------------

def sample_skew(g1: Column, n: Column) -> Column:
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(g2: Column, n: Column) -> Column:
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def basics(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, dict]]:
    """Row count and per column n, mean, min, max: one pass of cheap sums."""
    slim = df.selectExpr(*[f"{number_sql(df, c)} AS x{i}" for i, c in enumerate(columns)])
    row = slim.selectExpr("count(*) AS rows", *[f"{f}(x{i}) AS {k}{i}" for i in range(len(columns)) for k, f in
                                                (("n", "count"), ("mean", "avg"), ("min", "min"), ("max", "max"))]).first()
    return row["rows"], {c: {k: row[f"{k}{i}"] for k in ("n", "mean", "min", "max")} for i, c in enumerate(columns)}


def centred(df: DataFrame, columns: list[str], base: dict[str, dict], fence: dict[str, tuple] | None = None) -> dict[str, dict]:
    """Second pass: central moments about the known mean, and values beyond the fences.

    Central sums about the exact mean are stable and far lighter than one moment buffer per statistic."""
    known = [c for c in columns if base[c]["n"]]
    slim = df.selectExpr(*[x for i, c in enumerate(known) for x in (
        f"{number_sql(df, c)} AS x{i}", f"{number_sql(df, c)} - {double_sql(base[c]['mean'])} AS d{i}")]) if known else df
    aggs = []
    for i, c in enumerate(known):
        aggs += [f"sum(d{i} * d{i}) AS s{i}", f"sum(d{i} * d{i} * d{i}) AS t{i}", f"sum(d{i} * d{i} * d{i} * d{i}) AS u{i}"]
        if fence:
            aggs.append(f"count_if(x{i} < {double_sql(fence[c][2])} OR x{i} > {double_sql(fence[c][3])}) AS o{i}")
    row = slim.selectExpr(*aggs).first() if known else {}
    out = {}
    for c in columns:
        n = base[c]["n"]
        stats = {"std": None, "skew": None, "kurt": None, "outlier_ratio": None}
        if c in known:
            i = known.index(c)
            m2, m3, m4 = row[f"s{i}"] / n, row[f"t{i}"] / n, row[f"u{i}"] / n
            stats["std"] = (row[f"s{i}"] / (n - 1)) ** 0.5 if n > 1 else None
            g1, g2 = (m3 / m2 ** 1.5, m4 / m2 ** 2 - 3) if m2 > 0 else (0.0, 0.0)
            if n > 2:
                stats["skew"] = g1 * (n * (n - 1)) ** 0.5 / (n - 2)
            if n > 3:
                stats["kurt"] = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) if m2 > 0 else 0.0
            if fence:
                stats["outlier_ratio"] = row[f"o{i}"] / n
        out[c] = stats
    return out


def moments(df: DataFrame, columns: list[str]) -> list[dict]:
    """Per column: rows, n, mean, std, sample skew and kurtosis, min, max."""
    rows, base = basics(df, columns)
    shape = centred(df, columns, base)
    return [{"column": c, "rows": rows, **base[c], **shape[c]} for c in columns]


def fences(df: DataFrame, columns: list[str], sizes: dict[str, int] | None = None) -> dict[str, tuple]:
    """(q1, q3, low fence, high fence) per column."""
    q = quantiles(df, columns, [0.25, 0.75], sizes=sizes)
    out = {}
    for c, (q1, q3) in q.items():
        reach = None if q1 is None else 1.5 * (q3 - q1)
        out[c] = (q1, q3, None, None) if q1 is None else (q1, q3, q1 - reach, q3 + reach)
    return out


def beyond(v: Column, fence: tuple) -> Column:
    """Value outside the fences (null if missing)."""
    if fence[2] is None:
        return F.lit(None).cast("boolean")
    return (v < F.lit(fence[2])) | (v > F.lit(fence[3]))


def outlier_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values outside the fences: count and percent of all rows, columns without any left out."""
    f = fences(df, columns)
    wide = df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count_if(beyond(number(df, c), f[c])).alias(f"outliers__{i}") for i, c in enumerate(columns)])
    wide = wide.select("*", *[F.try_divide(F.col(f"outliers__{i}") * 100.0, F.col("rows")).alias(f"percent__{i}") for i in range(len(columns))])
    return spread_row(wide, columns, {"outliers": "long", "percent": "double"}).where("outliers > 0")


def literal_rows(spark, rows: list[dict], schema: str) -> DataFrame:
    """A local table with one row per column of the profiled table."""
    names = [f.name for f in T.StructType.fromDDL(schema)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


NUMBER_PROFILE = ("column string, n double, rows double, missing_ratio double, mean double, std double, cv double, skew double,"
                  " kurt double, min double, q1 double, q3 double, max double, outlier_ratio double")


def number_profile(df: DataFrame, columns: list[str] | None = None, signed_cv: bool = False) -> DataFrame:
    """Moments, quartiles and outlier share per numeric column, in three passes over the table."""
    cols = columns if columns is not None else numeric_columns(df)
    if not cols:
        return literal_rows(df.sparkSession, [], NUMBER_PROFILE)
    total, base = basics(df, cols)
    f = fences(df, cols, {c: base[c]["n"] for c in cols})
    shape = centred(df, cols, base, f)
    rows = []
    for c in cols:
        n, mean, std = base[c]["n"], base[c]["mean"], shape[c]["std"]
        cv = None if mean is None or std is None else (float("inf") if mean == 0 else std / mean)
        if cv is not None and not signed_cv:
            cv = abs(cv)
        rows.append({"column": c, **base[c], **shape[c], "n": float(n), "rows": float(total), "cv": cv, "q1": f[c][0], "q3": f[c][1],
                     "missing_ratio": 1 - n / total if total else 0.0})
    return literal_rows(df.sparkSession, rows, NUMBER_PROFILE)


def distribution_profile(df: DataFrame, columns: list[str] | None = None, signed_cv: bool = False) -> DataFrame:
    """Shape of every numeric column with the normal, uniform, bimodal and multimodal flags."""
    cols = columns if columns is not None else numeric_columns(df)
    base = number_profile(df, cols, signed_cv)
    facts = peak_flags(frequency_facts(df, cols)) if cols else None
    if facts is None:
        facts = df.sparkSession.createDataFrame([], "column string, unique_count long, is_bimodal boolean, is_multimodal boolean")
    joined = base.join(F.broadcast(facts.select("column", "unique_count", "is_bimodal", "is_multimodal")), "column", "left")
    ratio = F.try_divide(F.col("unique_count").cast("double"), F.col("n"))
    return joined.select(
        "column", "n", "rows", "missing_ratio", "mean", "std", "cv", "skew", "kurt", "min", "q1", "q3", "max", "outlier_ratio",
        F.coalesce("unique_count", F.lit(0)).cast("long").alias("unique_count"), F.coalesce(ratio, F.lit(0.0)).alias("unique_ratio"),
        F.coalesce((F.abs("skew") < 0.5) & (F.abs("kurt") < 1), F.lit(False)).alias("is_normal"),
        F.coalesce(ratio > 0.8, F.lit(False)).alias("is_uniform"),
        F.coalesce("is_bimodal", F.lit(False)).alias("is_bimodal"), F.coalesce("is_multimodal", F.lit(False)).alias("is_multimodal"))


def range_iqr(df: DataFrame, columns: list[str]) -> DataFrame:
    return number_profile(df, columns).select("column", (F.col("max") - F.col("min")).alias("range"),
                                               (F.col("q3") - F.col("q1")).alias("iqr"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max per column."""
    basic = moments(df, columns)
    q = quantiles(df, columns, [0.25, 0.5, 0.75], sizes={b["column"]: b["n"] for b in basic})
    rows = [{**b, "count": b["n"], "q25": q[b["column"]][0], "q50": q[b["column"]][1], "q75": q[b["column"]][2]} for b in basic]
    return literal_rows(df.sparkSession, rows, "column string, count long, mean double, std double, min double,"
                                               " q25 double, q50 double, q75 double, max double")


def skew_population(df: DataFrame, columns: list[str]) -> DataFrame:
    """Biased skew; direction only beyond 1 either way."""
    wide = df.agg(*[F.skewness(number(df, c)).alias(f"skew__{i}") for i, c in enumerate(columns)])
    s = F.col("skew")
    return spread_row(wide, columns, {"skew": "double"}).withColumn(
        "direction", F.when(s > 1, "right").when(s < -1, "left"))


def categorical_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values, most frequent value with its count, missing count."""
    facts = frequency_facts(df, columns).select("column", "unique_count", "mode", F.col("f1").alias("mode_count"))
    nulls = null_info(df.select(*[at(c) for c in columns])).select("column", F.col("null_count").alias("missing_count"))
    return (nulls.join(facts, "column", "left")
            .select("column", F.coalesce("unique_count", F.lit(0)).alias("unique_count"), "mode",
                    F.coalesce("mode_count", F.lit(0)).alias("mode_count"), "missing_count"))


def dominant_value(df: DataFrame, columns: list[str], limit: float = 0.7) -> DataFrame:
    """Share of the most frequent value among non-missing values."""
    counts = frequencies(df, columns)
    per = counts.groupBy("column").agg(F.max(F.struct(F.col("n"), F.lit(0))).getField("n").alias("f1"), F.sum("n").alias("total"))
    share = F.col("f1") / F.col("total")
    return per.select("column", share.alias("share"), (share > limit).alias("dominant"))


def class_balance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Least to greatest count, and whether the top two are more than ten to one apart."""
    facts = frequency_facts(df, columns)
    return facts.select("column", (F.col("least") / F.col("f1")).alias("balance_ratio"),
                        F.coalesce((F.col("unique_count") < 10) & (F.col("f1") / F.col("f2") > 10), F.lit(False)).alias("imbalanced"))


def data_quality(df: DataFrame) -> DataFrame:
    """Missing and duplicate percent of the table with the list of issues."""
    cells = sum((F.sum(missing(df, c).cast("long")) for c in df.columns[1:]), F.sum(missing(df, df.columns[0]).cast("long")))
    miss = df.agg(cells.alias("cells"), F.count(F.lit(1)).alias("rows")).first()
    dup = duplicate_count(df).first()
    percent = 100.0 * (miss["cells"] or 0) / (miss["rows"] * len(df.columns)) if miss["rows"] else 0.0
    rows = [{"missing_percent": percent, "duplicate_percent": 100.0 * dup["duplicate_ratio"]}]
    facts = literal_rows(df.sparkSession, rows, "missing_percent double, duplicate_percent double")
    return facts.withColumn("issues", quality_issues(F.col("missing_percent"), F.col("duplicate_percent")))


def quality_issues(miss: Column, dup: Column) -> Column:
    return F.array_compact(F.array(F.when(miss > 10, F.lit("missing_above_10_percent")),
                                   F.when(dup > 5, F.lit("duplicates_above_5_percent"))))


def zero_ratio(df: DataFrame) -> DataFrame:
    """Share of zeros over all numeric cells."""
    cols = numeric_columns(df)
    zeros = sum((F.count_if(number(df, c) == 0) for c in cols[1:]), F.count_if(number(df, cols[0]) == 0))
    share = F.try_divide(zeros.cast("double"), F.count(F.lit(1)) * len(cols))
    return df.agg(share.alias("zero_ratio")).withColumn("sparse", F.col("zero_ratio") > 0.8)


def text_length_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    aggs = []
    for i, c in enumerate(columns):
        size = F.length(at(c))
        aggs += [F.avg(size).alias(f"mean_length__{i}"), F.max(size).alias(f"max_length__{i}"),
                 F.min(size).alias(f"min_length__{i}"), F.stddev_samp(size).alias(f"std_length__{i}")]
    return spread_row(df.agg(*aggs), columns, {"mean_length": "double", "max_length": "long", "min_length": "long", "std_length": "double"})


def length_consistency(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = columns if columns is not None else text_columns(df)
    ratio = F.try_divide(F.col("std_length"), F.col("mean_length"))
    return text_length_stats(df, cols).select("column", ratio.alias("length_cv"), F.coalesce(ratio > 0.5, F.lit(False)).alias("inconsistent"))


# ---- dates --------------------------------------------------------------------------

def datetime_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Span in days, distinct years, months, days and hours, and the share of values that parse."""
    from ..functions.dates import parse_datetime
    aggs = []
    for i, c in enumerate(columns):
        t = at(c).cast("timestamp_ntz") if isinstance(df.schema[c].dataType, DATE_TYPES) else parse_datetime(at(c))
        aggs += [F.min(t).alias(f"first__{i}"), F.max(t).alias(f"last__{i}"), F.count(t).alias(f"parsed__{i}"),
                 F.count(F.lit(1)).alias(f"rows__{i}")]
        # value sets of bounded size: months, days and hours have at most 12, 31 and 24 values
        aggs += [F.array_size(F.collect_set(part(t))).alias(f"unique_{name}__{i}")
                 for name, part in (("years", F.year), ("months", F.month), ("days", F.dayofmonth), ("hours", F.hour))]
    fields = {"first": "timestamp_ntz", "last": "timestamp_ntz", "parsed": "long", "rows": "long", "unique_years": "long",
              "unique_months": "long", "unique_days": "long", "unique_hours": "long"}
    long = spread_row(df.agg(*aggs), columns, fields)
    # whole days between the ends, as a time difference
    days = F.expr("timestampdiff(DAY, first, last)")
    return long.select("column", days.alias("date_range_days"), "unique_years", "unique_months", "unique_days", "unique_hours",
                       F.coalesce(days > 30, F.lit(False)).alias("is_timeseries"), (F.col("unique_hours") > 1).alias("has_time_component"),
                       F.try_divide(F.col("parsed").cast("double"), F.col("rows")).alias("success_rate"))


# ---- relations ----------------------------------------------------------------------

def column_pairs(columns: list[str]) -> list[tuple[str, str]]:
    """Every pair of columns once, in schema order."""
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]


def _pair_corr(df: DataFrame, a: str, b: str) -> Column:
    """Pearson r over rows where both are present; null when either is constant."""
    x, y = number(df, a), number(df, b)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    # not F.corr: under ANSI rules it fails on a constant column, where r is missing
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    r = F.nullif(r, F.lit(float("nan")))
    # merged means of a constant may differ in the last bit, so constancy is told by the ends
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies & r.isNotNull(), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))


def _pairs_at_once(df: DataFrame, pairs: list[tuple[int, str, str]]) -> DataFrame:
    """(pair, left, right, r) by one aggregate."""
    wide = df.agg(*[_pair_corr(df, a, b).alias(f"r{i}") for i, a, b in pairs])
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"r{i}").alias("r")) for i, a, b in pairs])
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def corr_pairs(df: DataFrame, columns: list[str] | None = None, per_pass: int = 400) -> DataFrame:
    """(pair, left, right, r) for every pair of columns.

    Up to ``per_pass`` pairs are one aggregate. More are products of whole blocks of rows, one pass whatever their
    number; pairs that these products leave in doubt (nearly constant, beyond doubles) go through aggregates again."""
    spark, cols = df.sparkSession, columns if columns is not None else numeric_columns(df)
    pairs = [(i, a, b) for i, (a, b) in enumerate(column_pairs(cols))]
    schema = "pair int, left string, right string, r double"
    if not pairs:
        return spark.createDataFrame([], schema)
    if len(pairs) <= per_pass:
        return _pairs_at_once(df, pairs)
    r, unsure = correlations(pair_sums(df, cols))
    upper = np.triu_indices(len(cols), 1)                       # the order of column_pairs
    doubt, value = unsure[upper], r[upper]
    sure = [(i, a, b, None if np.isnan(v) else float(v)) for (i, a, b), v, d in zip(pairs, value, doubt) if not d]
    out = spark.createDataFrame(sure, schema)
    again = [p for p, d in zip(pairs, doubt) if d]
    for start in range(0, len(again), per_pass):
        out = out.unionByName(_pairs_at_once(df, again[start:start + per_pass]))
    return out


def corr_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Long Pearson matrix, both triangles and the diagonal."""
    cols = columns if columns is not None else numeric_columns(df)
    pairs = corr_pairs(df, cols).select("left", "right", "r")
    both = pairs.select(F.explode(F.array(F.struct("left", "right", "r"),
                                          F.struct(F.col("right").alias("left"), F.col("left").alias("right"), "r"))).alias("p")).select("p.*")
    own = df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "left string, right string, r double")
    return both.unionByName(own)


def corr_high_pairs(df: DataFrame, limit: float, columns: list[str] | None = None) -> DataFrame:
    return corr_pairs(df, columns).where(F.abs("r") > limit)


def corr_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(_pair_corr(df, x, y).alias("r"))


def corr_dayofyear(before: DataFrame, after: DataFrame, date: str, value: str) -> DataFrame:
    """r between day of year and a value in two tables."""
    def one(df, name):
        return df.agg(F.corr(F.dayofyear(at(date)).cast("double"), number(df, value)).alias("r")).select(F.lit(name).alias("side"), "r")
    return one(before, "before").unionByName(one(after, "after"))


def group_mean(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(at(group).alias("category")).agg(F.avg(number(df, value)).alias("mean"))
