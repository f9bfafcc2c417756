"""Joins on keys, sets and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import at
from ..plans.positions import ordered_positions


def join_meta_labels(meta: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Inner join on the key, which is then dropped. Spark picks the strategy from sizes at run time."""
    return meta.join(labels, key, "inner").drop(key)


def semi_isin(df: DataFrame, column: str, chosen: DataFrame, key: str) -> DataFrame:
    """Rows whose value is in the chosen set."""
    return df.join(chosen.select(at(key).alias("_k")), at(column) == F.col("_k"), "left_semi")


def join_feature_intersection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Entries of ``left`` also chosen by ``right``."""
    return left.join(right.select(at(key)), key, "left_semi")


def join_category_counts(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Counts per category in both tables, missing ones 0."""
    def counts(df, name):
        return df.where(at(column).isNotNull()).groupBy(at(column).cast("string").alias("category")).agg(F.count(F.lit(1)).alias(name))
    return counts(before, "original").join(counts(after, "augmented"), "category", "full_outer").na.fill(0, ["original", "augmented"])


def align_before_after(before: DataFrame, after: DataFrame, column: str, before_keys: list[str], after_keys: list[str]) -> DataFrame:
    """One column of two tables side by side by row position (in key order)."""
    def numbered(df, keys, name):
        rows, _ = ordered_positions(df.select(*dict.fromkeys([*keys, column])), keys)
        return rows.select(F.col("_pos").alias("pos"), at(column).alias(name))
    return numbered(before, before_keys, "original").join(numbered(after, after_keys, "augmented"), "pos", "full_outer")
