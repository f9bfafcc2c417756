"""Connected components of a link table by alternating stars, entirely as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.session import written


def _star(links: DataFrame) -> DataFrame:
    """Hang the larger neighbours of every node on its least neighbour, then the smaller ones."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    root = large.groupBy("hi").agg(F.min("lo").alias("root"))
    small = large.join(root, "hi").where("lo <> root").select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
    return small.unionByName(root.select("hi", F.col("root").alias("lo"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``, the component being its least node.

    Ends of a link may come in any order, more than once or equal; links with a null end are ignored. No links: no rows.
    Rounds grow with the logarithm of the longest chain; each is written to the shared folder, so a lost executor costs
    one round at most.
    """
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first())

    seen = mark(now)
    while seen[0]:
        after = written(_star(now))
        now, last = after, seen
        seen = mark(now)
        if seen == last:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
