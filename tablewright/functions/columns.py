"""Schema questions and missing-value rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def at(name: str) -> Column:
    """Column by exact name, dots included."""
    return F.col(quoted(name))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, DATE_TYPES)]


def categorical_columns(df: DataFrame) -> list[str]:
    numeric = set(numeric_columns(df))
    return [c for c in df.columns if c not in numeric]


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def is_integral(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.IntegralType)


def missing(df: DataFrame, name: str) -> Column:
    """Null or NaN."""
    c = at(name)
    return c.isNull() | F.isnan(c) if is_float(df, name) else c.isNull()


def valid(df: DataFrame, name: str) -> Column:
    """The value with NaN turned into null."""
    c = at(name)
    return F.when(~F.isnan(c), c) if is_float(df, name) else c


def number(df: DataFrame, name: str) -> Column:
    """The value as double with NaN turned into null."""
    return valid(df, name).cast("double")


def number_sql(df: DataFrame, name: str) -> str:
    """``number`` as SQL text; wide aggregates are built from text, which plans much faster."""
    q = quoted(name)
    return f"CASE WHEN NOT isnan({q}) THEN CAST({q} AS DOUBLE) END" if is_float(df, name) else f"CAST({q} AS DOUBLE)"


def double_sql(value: float) -> str:
    if value in (float("inf"), float("-inf")):
        return f"CAST('{value}' AS DOUBLE)"
    return f"{value!r}D"


def name_has(name: str, words: list[str]) -> bool:
    """Case-blind test whether a column name holds one of the words."""
    return any(w.lower() in name.lower() for w in words)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; no negative zero."""
    return df.select(*[
        (F.round(at(f.name), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else at(f.name)
        for f in df.schema
    ])
