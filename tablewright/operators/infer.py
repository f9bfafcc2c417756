"""What a column really holds: semantic types, date tests, table context.

"First N" samples are the first N non-missing values by ``keys``; they are ranked per
column and cut before the shuffle, so no column is ever sorted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import (at, categorical_columns as non_numeric, date_columns, is_integral, missing, name_has, number,
                                 numeric_columns, text_columns, valid)
from ..functions.dates import (DATE_WORDS, SERIES_WORDS, matches_datetime, matches_datetime_prefix, parse_datetime)
from .profile import (frequency_facts, literal_rows, number_profile, spread_row, value_text, zero_ratio)

# Fixed values
ORDINAL_WORDS = ["low", "medium", "high", "small", "large"]
ID_WORDS = ["id", "key", "index", "idx"]
CATEGORY_WORDS = ["id", "code", "type", "category"]
TIME_MARKS = ["202", "201", "200", "199", "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
              "월", "화", "수", "목", "금", "토", "일", "am", "pm", "오전", "오후", ":", "-", "/", "\\"]
THRESHOLDS = {"missing_low": 0.05, "missing_medium": 0.15, "missing_high": 0.40, "skewness_moderate": 1.0, "skewness_high": 2.0,
              "kurtosis_high": 7.0, "cv_low": 0.1, "cv_high": 1.0, "correlation_high": 0.8, "correlation_very_high": 0.95,
              "unique_ratio_low": 0.01, "unique_ratio_high": 0.8, "outlier_ratio_threshold": 0.05}
CONTEXT_CHANGES = {"high_dimensional": {"missing_high": 0.20, "correlation_high": 0.7}, "imbalanced": {"missing_medium": 0.10},
                   "sparse": {"missing_high": 0.60}}
CONTEXTS = ["timeseries", "high_dimensional", "sparse", "imbalanced", "general"]


def first_values(df: DataFrame, columns: list[str], keys: list[str], n: int) -> DataFrame:
    """(column, place, value as text): the first ``n`` non-missing values of each column by ``keys``."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), value_text(df, c).alias("value")) for c in columns])
    rows = (df.select(*[at(k).alias(f"k{i}") for i, k in enumerate(keys)], F.explode(cells).alias("cell"))
            .select("cell.column", "cell.value", *[f"k{i}" for i in range(len(keys))]).where(F.col("value").isNotNull()))
    order = Window.partitionBy("column").orderBy(*[f"k{i}" for i in range(len(keys))])
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("column", "place", "value")


def all_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value as text) of every non-missing cell; aggregated by column before any shuffle."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), value_text(df, c).alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("cell")).select("cell.column", "cell.value").where(F.col("value").isNotNull())


def _values(df: DataFrame, columns: list[str], keys: list[str], sample: int | None) -> DataFrame:
    return all_values(df, columns) if sample is None else first_values(df, columns, keys, sample)


def _all_columns(df: DataFrame, result: DataFrame, columns: list[str], flag: str) -> DataFrame:
    """A column without any value is answered ``false``."""
    base = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return base.join(F.broadcast(result), "column", "left").select("column", F.coalesce(flag, F.lit(False)).alias(flag))


def is_datetime_by_sample10(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """At least half of the first ten values are wholly a date or time."""
    share = F.avg(matches_datetime(F.col("value")).cast("double"))
    found = first_values(df, columns, keys, 10).groupBy("column").agg((share >= 0.5).alias("is_datetime"))
    return _all_columns(df, found, columns, "is_datetime")


def is_datetime_text(df: DataFrame, columns: list[str], keys: list[str] = (), sample: int | None = None) -> DataFrame:
    """The name says so, or over 70 % of the texts start like a date, or all of them parse; all rows unless ``sample`` is given."""
    named = F.lit(False)
    for c in columns:
        if name_has(c, DATE_WORDS):
            named = named | (F.col("column") == F.lit(c))
    texts = [c for c in columns if c in text_columns(df)]
    if texts:
        value = F.trim("value")
        tested = value != ""
        share = F.try_divide(F.count_if(tested & matches_datetime_prefix(value)).cast("double"), F.count_if(tested))
        found = _values(df, texts, keys, sample).groupBy("column").agg(
            (F.coalesce(share > 0.7, F.lit(False)) | F.bool_and(parse_datetime(value).isNotNull())).alias("is_datetime"))
    else:
        found = df.sparkSession.createDataFrame([], "column string, is_datetime boolean")
    return _all_columns(df, found, columns, "is_datetime").select("column", (named | F.col("is_datetime")).alias("is_datetime"))


def is_datetime_by_sample100(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """:func:`is_datetime_text` on the first hundred texts."""
    return is_datetime_text(df, columns, keys, 100)


def detect_date_columns(df: DataFrame, keys: list[str] = (), sample: int | None = None) -> DataFrame:
    """Columns named like a date, or of whose values at least half are or parse as one (text and date columns only)."""
    dates, named = date_columns(df), [c for c in df.columns if name_has(c, SERIES_WORDS)]
    texts = [c for c in text_columns(df) if c not in named]
    sure = df.sparkSession.createDataFrame([(c,) for c in df.columns if c in dates or c in named], "column string")
    if not texts:
        return sure
    share = F.avg(parse_datetime(F.col("value")).isNotNull().cast("double"))
    tested = _values(df, texts, keys, sample).groupBy("column").agg(share.alias("share")).where("share >= 0.5").select("column")
    return sure.unionByName(tested)


def is_timeseries_text(df: DataFrame, columns: list[str], keys: list[str] = (), sample: int | None = None) -> DataFrame:
    """Date or time marks in any value, or mostly digits with over ten distinct values."""
    value = F.lower("value")
    marked = F.lit(False)
    for m in TIME_MARKS:
        marked = marked | F.contains(value, F.lit(m))
    digits = F.regexp_replace(F.trim("value"), "[.-]", "").rlike("^[0-9]+$")
    found = _values(df, columns, keys, sample).groupBy("column").agg(
        (F.bool_or(marked) | ((F.avg(digits.cast("double")) > 0.8) & (F.count_distinct(F.trim("value")) > 10))).alias("is_timeseries"))
    return _all_columns(df, found, columns, "is_timeseries")


def is_categorical_number(df: DataFrame, columns: list[str], keys: list[str] = (), sample: int | None = None) -> DataFrame:
    """Label-like numbers: few distinct values in a short range."""
    v = F.col("value").cast("double")
    stats = _values(df, columns, keys, sample).groupBy("column").agg(
        F.count_distinct("value").alias("u"), F.min(v).alias("low"), F.max(v).alias("high"))
    few = (F.col("u") <= 20) & (((F.col("low") == 0) & (F.col("high") == 1)) | ((F.col("u") <= 10) & (F.col("high") - F.col("low") <= 20)))
    return _all_columns(df, stats.select("column", few.alias("is_categorical")), columns, "is_categorical")


def categorical_columns(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Texts that are not time-like, plus label-like numbers."""
    texts, numbers = text_columns(df), numeric_columns(df)
    out = df.sparkSession.createDataFrame([], "column string")
    if texts:
        out = out.unionByName(is_timeseries_text(df, texts, keys).where(~F.col("is_timeseries")).select("column"))
    if numbers:
        out = out.unionByName(is_categorical_number(df, numbers, keys).where("is_categorical").select("column"))
    return out


# ---- facts and types ----------------------------------------------------------------

def column_facts(df: DataFrame, words: list[str] = ORDINAL_WORDS, columns: list[str] | None = None) -> DataFrame:
    """One row per column: kind, counts, missing share, distinct values, text lengths, listed values present."""
    cols = columns if columns is not None else df.columns
    numeric, dates = set(numeric_columns(df)), set(date_columns(df))
    aggs = []
    for i, c in enumerate(cols):
        v = valid(df, c)
        text = v.cast("string")
        zero_one = number(df, c).isin(0.0, 1.0) if c in numeric else F.lit(str(df.schema[c].dataType) == "BooleanType()")
        # only listed words are collected, so the set cannot outgrow the list
        hits = F.collect_set(F.when(F.lower(text).isin(words), F.lower(text)))
        exact = F.collect_set(F.when(text.isin(words), text))
        aggs += [F.count(F.lit(1)).alias(f"rows__{i}"), F.count(v).alias(f"valid__{i}"), F.avg(F.length(text)).alias(f"mean_length__{i}"),
                 F.bool_and(zero_one | v.isNull()).alias(f"zero_one__{i}"), hits.alias(f"known_values__{i}"), exact.alias(f"exact_values__{i}")]
    base = spread_row(df.agg(*aggs), cols, {"rows": "double", "valid": "double", "mean_length": "double", "zero_one": "boolean",
                                            "known_values": "array<string>", "exact_values": "array<string>"})
    kinds = {c: "number" if c in numeric else "date" if c in dates else
             "bool" if str(df.schema[c].dataType) == "BooleanType()" else "text" for c in cols}
    static = literal_rows(df.sparkSession, [
        {"column": c, "kind": kinds[c], "integral": c in numeric and is_integral(df, c)} for c in cols],
        "column string, kind string, integral boolean")
    facts = frequency_facts(df, cols).select("column", "unique_count", "least", "f1", "f2")
    return (base.join(F.broadcast(static), "column").join(facts, "column", "left")
            .withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))
            .withColumn("missing_ratio", F.coalesce(F.try_divide(F.col("rows") - F.col("valid"), F.col("rows")), F.lit(0.0)))
            .withColumn("unique_ratio", F.coalesce(F.try_divide(F.col("unique_count").cast("double"), F.col("rows")), F.lit(0.0)))
            .withColumn("balance_ratio", F.coalesce(F.try_divide(F.col("least").cast("double"), F.col("f1")), F.lit(1.0))))


def _named(words: list[str]) -> Column:
    name = F.lower("column")
    out = F.lit(False)
    for w in words:
        out = out | F.contains(name, F.lit(w))
    return out


def id_like() -> Column:
    """Over column facts: an id word in the name, or nearly all values distinct."""
    return _named(ID_WORDS) | (F.col("unique_ratio") > 0.95)


def is_id_like(df: DataFrame) -> DataFrame:
    return column_facts(df).select("column", id_like().alias("is_id_like"))


def semantic(facts: DataFrame) -> DataFrame:
    """Add ``semantic_type`` to column facts; the first matching class wins."""
    number_like = F.col("kind") == "number"
    text = F.col("kind") == "text"
    kind = (F.when(id_like(), "id")
            .when((F.col("valid") == 0) | F.col("zero_one"), "boolean")
            .when((F.col("kind") == "date") | _named(["date", "time"]), "datetime")
            .when(number_like & F.col("integral") & (F.col("unique_count") <= 20), "numeric_discrete")
            .when(number_like, "numeric_continuous")
            .when(text & (F.col("mean_length") > 50), "text")
            .when(text & (F.col("unique_count") <= 50) & (F.size("exact_values") > 0), "categorical_ordinal")
            .otherwise("categorical_nominal"))
    return facts.withColumn("semantic_type", kind)


def semantic_type(df: DataFrame) -> DataFrame:
    return semantic(column_facts(df)).select("column", "semantic_type")


def smart_types(df: DataFrame) -> DataFrame:
    """``numeric`` or ``categorical`` by name words, few distinct values or a low distinct share."""
    few = (F.col("unique_count") <= 20) | (F.col("unique_ratio") < 0.05)
    kind = F.when(_named(CATEGORY_WORDS) | (F.col("kind") != "number") | few, "categorical").otherwise("numeric")
    return column_facts(df).select("column", kind.alias("smart_type"))


def target_is_class_like(df: DataFrame, column: str) -> DataFrame:
    """Text targets always; numbers when {0, 1} or at most twenty distinct values."""
    if column in non_numeric(df):
        return df.sparkSession.createDataFrame([(column, True)], "column string, class_like boolean")
    facts = column_facts(df, columns=[column])
    return facts.select("column", (F.col("zero_one") | (F.col("unique_count") <= 20)).alias("class_like"))


def context_of(df: DataFrame, facts: DataFrame | None = None) -> str:
    """Table context by the first test that holds."""
    if date_columns(df) or any(name_has(c, ["date", "time"]) for c in df.columns):
        return "timeseries"
    if len(df.columns) > 100:
        return "high_dimensional"
    if numeric_columns(df) and (zero_ratio(df).first()["sparse"] or False):
        return "sparse"
    facts = column_facts(df) if facts is None else facts
    skewed = facts.where("kind = 'text' and unique_count < 10 and f1 / f2 > 10").limit(1).count()
    return "imbalanced" if skewed else "general"


def data_context(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(context_of(df),)], "context string")


def thresholds_for(context: str) -> dict[str, float]:
    return {**THRESHOLDS, **CONTEXT_CHANGES.get(context, {})}


def context_thresholds(df: DataFrame) -> DataFrame:
    """The thirteen thresholds as adjusted for the table's context."""
    context = context_of(df)
    rows = [(context, k, v) for k, v in thresholds_for(context).items()]
    return df.sparkSession.createDataFrame(rows, "context string, name string, threshold double")


def typed_profile(df: DataFrame) -> DataFrame:
    """Column facts with semantic type, number moments and the class flags the type rules use."""
    facts = semantic(column_facts(df))
    numbers = number_profile(df).select("column", "mean", "std", "cv", "skew", "kurt", "outlier_ratio")
    t = F.col("semantic_type")
    return (facts.join(F.broadcast(numbers), "column", "left")
            .withColumn("numeric", t.isin("numeric_continuous", "numeric_discrete"))
            .withColumn("categorical", t.isin("categorical_nominal", "categorical_ordinal"))
            .withColumn("plain", (t != "id") & (F.col("unique_count") > 1)))


def missing_cells(df: DataFrame) -> int:
    cells = sum((F.count_if(missing(df, c)) for c in df.columns[1:]), F.count_if(missing(df, df.columns[0])))
    return df.agg(cells.alias("n")).first()["n"]
