"""Row positions and neighbourhoods of a whole table without a single-task window.

* ``shuffled_positions`` numbers rows in digest order. Digests spread evenly, so a digest
  prefix cuts the order into even buckets whatever the data looks like.
* ``hash_cut`` picks the first ``m`` rows of that order, per group if wanted; only the one small bucket
  that straddles a group's cut is ever ranked, all others are decided by a comparison.
* ``ordered_positions`` numbers rows by columns: range partitions, a written copy, and
  offsets per partition.
* ``in_blocks`` puts numbered rows into blocks of bounded size, with as many neighbours
  copied along as a window frame needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import at
from ..functions.draws import digest
from ..session import written

PREFIX = 4                   # hex digits of a digest: 65,536 even buckets
BLOCK = 50_000
BLOCKS = 20_000              # number of blocks stays near this for large tables


def _with_offsets(df: DataFrame, bucket: str, within: Column, groups: list[str]) -> DataFrame:
    """Add ``_pos``: rows in earlier buckets plus the place within the bucket."""
    sizes = df.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # at most 65,536 buckets (or the partition count) per group
    offsets = sizes.select(*groups, bucket, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    if not groups:
        offsets = F.broadcast(offsets)
    return (df.withColumn("_place", within).join(offsets, [*groups, bucket])
            .withColumn("_pos", F.col("_offset") + F.col("_place")).drop("_place", "_offset", bucket))


def shuffled_positions(df: DataFrame, keys: list[str], seed: int, groups: list[str] | None = None) -> DataFrame:
    """Add ``_pos`` (0-based) in digest order, per group if groups are given. ``keys`` must be unique."""
    groups = groups or []
    tagged = df.withColumn("_h", digest(keys, seed, "order")).withColumn("_b", F.substring("_h", 1, PREFIX))
    order = Window.partitionBy(*groups, "_b").orderBy("_h", *[at(k) for k in keys])
    return _with_offsets(tagged, "_b", F.row_number().over(order) - 1, groups).drop("_h")


def _edge(sizes: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """(by, bucket, rest): of buckets in order, the one in which a group's ``_m``-th row lies, and how many rows it still gives."""
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)     # at most 65,536 buckets per group
    seen = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return seen.where((F.col("_before") < F.col("_m")) & (F.col("_before") + F.col("_n") >= F.col("_m"))).select(*by, bucket, (F.col("_m") - F.col("_before")).alias("_rest"))


def hash_cut(df: DataFrame, keys: list[str], seed: int, m: int | dict | DataFrame, group: str | None = None) -> DataFrame:
    """Add boolean ``_first``: the row is among the first ``m`` in digest order.

    With ``group``, ``m`` is a table ``(_g, _m)`` from group value to count, or a dict of the same; rows of other groups get
    false. Any number of groups: counts travel as joins. The bucket at a group's edge is cut again by the next digits, so
    what is ranked in one task is a four-billionth of a group.
    """
    spark = df.sparkSession
    if group is None:
        wanted = spark.createDataFrame([(0, int(m))], "_g int, _m long")
        tagged = df.withColumn("_g", F.lit(0))
    else:
        kind = df.select(at(group).alias("_g")).schema[0].dataType.simpleString()
        wanted = m.select("_g", F.col("_m").cast("long").alias("_m")) if isinstance(m, DataFrame) else spark.createDataFrame([(g, int(n)) for g, n in m.items()], f"_g {kind}, _m long")
        tagged = df.withColumn("_g", at(group))
    tagged = tagged.withColumn("_h", digest(keys, seed, "order")).withColumn("_b", F.substring("_h", 1, PREFIX)).withColumn("_b2", F.substring("_h", PREFIX + 1, PREFIX))
    sizes = tagged.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n")).join(wanted, "_g")
    totals = sizes.groupBy("_g").agg(F.sum("_n").alias("_all"), F.max("_m").alias("_m"))
    edge = _edge(sizes, ["_g"], "_b")
    inner = (tagged.join(edge.withColumnRenamed("_rest", "_m"), ["_g", "_b"]).groupBy("_g", "_b", "_b2").agg(F.count(F.lit(1)).alias("_n"), F.max("_m").alias("_m")))
    inner = _edge(inner, ["_g", "_b"], "_b2").withColumnRenamed("_b2", "_e2")
    # one row per wanted group: all of it, or the two prefixes and the rest of the inner bucket
    cut = (totals.join(inner.withColumnRenamed("_b", "_e"), "_g", "left")
           .select("_g", (F.col("_all") <= F.col("_m")).alias("_whole"), "_e", "_e2", "_rest"))
    marked = tagged.join(cut, "_g", "left")
    where = F.struct("_b", "_b2")
    at_edge = F.coalesce(~F.col("_whole") & (where == F.struct(F.col("_e").alias("_b"), F.col("_e2").alias("_b2"))), F.lit(False))
    clear = F.coalesce(F.col("_whole") | (where < F.struct(F.col("_e").alias("_b"), F.col("_e2").alias("_b2"))), F.lit(False))
    order = Window.partitionBy("_g", "_b", "_b2").orderBy("_h", *[at(k) for k in keys])
    sure = marked.where(~at_edge).withColumn("_first", clear)
    tied = marked.where(at_edge).withColumn("_first", F.row_number().over(order) <= F.col("_rest"))
    return sure.unionByName(tied).drop("_g", "_h", "_b", "_b2", "_whole", "_e", "_e2", "_rest")


def ordered_positions(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with ``_pos`` (0-based, by the order columns) and the row count.

    ``order`` should end in a unique key so that the order is total. Rows are range
    partitioned, so a repeated leading value is split by the columns after it.
    """
    cols = [at(c) for c in order]
    spread = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    fixed = written(spread.withColumn("_m", F.monotonically_increasing_id()))
    fixed = fixed.withColumn("_part", F.shiftright("_m", 33)).withColumn("_in_part", F.col("_m").bitwiseAND((1 << 33) - 1))
    sizes = fixed.groupBy("_part").count().orderBy("_part").collect()   # one row per partition
    offsets, total = [], 0
    for row in sizes:
        offsets.append((row["_part"], total))
        total += row["count"]
    if not offsets:
        return fixed.withColumn("_pos", F.lit(0).cast("long")).drop("_m", "_part", "_in_part"), 0
    table = df.sparkSession.createDataFrame(offsets, "_part long, _offset long")
    numbered = (fixed.join(F.broadcast(table), "_part")
                .withColumn("_pos", F.col("_offset") + F.col("_in_part")).drop("_m", "_part", "_in_part", "_offset"))
    return numbered, total


def block_size(total: int) -> int:
    return max(BLOCK, total // BLOCKS)


def in_blocks(df: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """Add ``_block``; rows needed by a frame of ``before``/``after`` rows in another block are copied there.
    ``_own`` marks the row in its own block."""
    pos = F.col("_pos")
    first = F.greatest(F.lit(0), F.expr(f"(_pos - {after}) div {size}"))
    last = F.expr(f"(_pos + {before}) div {size}")
    return (df.withColumn("_block", F.explode(F.sequence(first, last)))
            .withColumn("_own", F.expr(f"_pos div {size}") == F.col("_block")))
