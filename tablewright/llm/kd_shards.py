"""Sharding by a k-d tree over metadata: DataFrame functions only.

Rows with equal texts form one group and stay together. A group has a weight (its bytes) and four coordinates: length
of the text, first id, first source and first language. Starting from one cell that holds all groups, every cell is
split in two halves of equal bytes at the weighted median of its widest dimension, until there are as many leaves as
shards. Medians are found by histograms: a cell's interval is cut into bins, the bin holding the median is cut again, and
so on; what comes back to the driver is a fixed number of bins per cell, whatever the number of rows.

The law is ``bytes``: shard sizes are as near to equal as whole groups allow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.plans.positions import ordered_positions
from tablewright.session import written

SHARDS = 16
BINS = 1024
#: Bits of an order key: a coordinate's 24 bits and 38 bits of a digest, so that equal coordinates can be parted too.
COORDINATE_BITS, TIE_BITS = 24, 38
#: Rows that are numbered in one task.
NUMBERED = 20_000
#: Distinct sources or languages that are sent to all tasks; more, or longer ones, are joined by shuffle.
BROADCAST_VALUES, BROADCAST_BYTES = 10_000, 4 << 20


def _scaled(value: Column, low, high) -> Column:
    """``value`` on 24 bits of its range; nulls and a range of one value are 0."""
    top = (1 << COORDINATE_BITS) - 1
    if low is None or high is None or high <= low:
        return F.lit(0).cast("long")
    part = (value.cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low))
    return F.coalesce(F.least(F.lit(top), F.greatest(F.lit(0), F.floor(part * F.lit(top)))), F.lit(0)).cast("long")


def text_groups(docs: DataFrame) -> DataFrame:
    """One row per distinct text (null is one too): digest ``g``, weight and coordinates.

    Source and language count by their place among the distinct ones in order, whatever their length; null is empty.
    """
    kind = {c: F.coalesce((docs[c] if c in docs.columns else F.lit(None)).cast("string"), F.lit("")) for c in ("source", "lang")}
    rows = docs.select(_digest().alias("g"), _size().alias("size"), F.col("doc_id").cast("long").alias("id"), kind["source"].alias("source"), kind["lang"].alias("lang"))
    groups = written(rows.groupBy("g").agg(F.sum("size").alias("weight"), F.min("size").alias("c0"), F.min("id").alias("c1"), F.min("source").alias("source"), F.min("lang").alias("lang")))
    return _placed(_placed(groups, "source", "c2"), "lang", "c3")


def _placed(groups: DataFrame, column: str, name: str) -> DataFrame:
    """``column`` replaced by the place of its value among the distinct ones, in ``name``."""
    ranked, n = ordered_positions(groups.select(column).distinct(), [column])
    ranked = ranked.select(column, F.col("_pos").alias(name))
    if n <= BROADCAST_VALUES:                       # few: large groups of one value are not dealt by it
        most = ranked.agg(F.coalesce(F.max(F.octet_length(column)), F.lit(0))).first()[0]
        ranked = F.broadcast(ranked) if n * most <= BROADCAST_BYTES else ranked
    return groups.join(ranked, column).drop(column)


def _digest() -> Column:
    return F.md5(F.encode(F.coalesce(F.concat(F.lit("t"), F.col("text")), F.lit("")), "UTF-8"))


def _size() -> Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


def _pick(column: Column, table: dict[int, str]) -> Column:
    """A literal per cell: at most as many cases as there are cells (fewer than the shards)."""
    return reduce(lambda so_far, item: so_far.when(column == item[0], item[1]), table.items(), F.when(F.lit(False), F.lit(None)))


def _medians(groups: DataFrame, dimension: dict[int, int], goals: dict[int, float]) -> dict[int, int]:
    """For each cell the order key below which about the share ``goals`` of its bytes lies, by repeated histograms."""
    interval = {cell: (0, 1 << (COORDINATE_BITS + TIE_BITS)) for cell in dimension}
    below = dict.fromkeys(dimension, 0)
    total: dict[int, int] = {}
    key = _pick(F.col("cell"), {cell: F.col(f"k{d}") for cell, d in dimension.items()})
    answer: dict[int, int] = {}
    while interval:
        width = {cell: -(-(b - a) // BINS) for cell, (a, b) in interval.items()}
        low = _pick(F.col("cell"), {cell: F.lit(a) for cell, (a, _) in interval.items()})
        high = _pick(F.col("cell"), {cell: F.lit(b) for cell, (_, b) in interval.items()})
        step = _pick(F.col("cell"), {cell: F.lit(w) for cell, w in width.items()})
        inside = groups.select("cell", "weight", key.alias("key"), low.alias("low"), high.alias("high"), step.alias("step")).where("key >= low and key < high")
        found: dict[int, list[tuple[int, int, int]]] = {cell: [] for cell in interval}
        for r in inside.groupBy("cell", F.expr("(key - low) div step").alias("bin")).agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).collect():
            found[r.cell].append((r.bin, r.weight, r.n))
        after = {}
        for cell, bins in found.items():
            bins.sort()
            total.setdefault(cell, sum(w for _, w, _ in bins))
            want, sum_, a = goals[cell] * total[cell], below[cell], interval[cell][0]
            for b, w, n in bins:
                if sum_ + w > want:
                    break
                sum_ += w
            else:
                answer[cell] = interval[cell][1]
                continue
            left, right = a + b * width[cell], a + (b + 1) * width[cell]
            if n == 1 or width[cell] == 1 or w <= total[cell] // 100_000:
                answer[cell] = left if want - sum_ < sum_ + w - want else right
            else:
                after[cell], below[cell] = (left, min(right, interval[cell][1])), sum_
        interval = after
    return answer


def kd_leaves(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(g, shard)`` for every group of ``groups(g, weight, c0, c1, ...)``.

    A cell that stands for n shards is split so that its halves stand for n // 2 and the rest, by bytes in that
    proportion; with 2^k shards all halves are equal. A cell's widest dimension is the one with the largest scaled
    spread; of equal ones the first.
    """
    dims = [c for c in groups.columns if c.startswith("c") and c[1:].isdigit()]
    ends = groups.agg(*[f(c).alias(f"{n}{c}") for c in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    tie = F.conv(F.substring("g", 1, 9), 16, 10).cast("long")
    keys = [(F.shiftleft(_scaled(F.col(c), ends[f"lo{c}"], ends[f"hi{c}"]), TIE_BITS) + tie * F.lit(1 << (TIE_BITS - 36))).alias(f"k{i}") for i, c in enumerate(dims)]
    now = written(groups.select("g", "weight", F.lit(0).alias("cell"), *keys))
    parts = {0: (0, shards)}                        # cell -> its first shard and how many it stands for
    cells = now
    while any(n > 1 for _, n in parts.values()):
        open_ = [cell for cell, (_, n) in parts.items() if n > 1]
        spread = cells.where(F.col("cell").isin(open_)).groupBy("cell").agg(*[(F.shiftright(F.max(f"k{i}"), TIE_BITS) - F.shiftright(F.min(f"k{i}"), TIE_BITS)).alias(f"w{i}") for i in range(len(dims))]).collect()
        widest = {r.cell: max(range(len(dims)), key=lambda i: (r[f"w{i}"], -i)) for r in spread}
        if not widest:                              # no rows at all
            break
        goals = {cell: (parts[cell][1] // 2) / parts[cell][1] for cell in widest}
        cut = _medians(cells, widest, goals)
        new_parts, left, right = {}, {}, {}
        for cell, (first, n) in parts.items():
            if n == 1 or cell not in widest:        # an empty cell keeps its first shard; nothing lies in it
                new_parts[cell] = (first, 1)
                continue
            left[cell], right[cell] = 2 * shards + 2 * cell + 1, 2 * shards + 2 * cell + 2
            new_parts[left[cell]], new_parts[right[cell]] = (first, n // 2), (first + n // 2, n - n // 2)
        key = _pick(F.col("cell"), {cell: F.col(f"k{d}") for cell, d in widest.items()})
        limit = _pick(F.col("cell"), {cell: F.lit(at) for cell, at in cut.items()})
        moved = F.when(key < limit, _pick(F.col("cell"), {c: F.lit(x) for c, x in left.items()})).otherwise(_pick(F.col("cell"), {c: F.lit(x) for c, x in right.items()}))
        number = {cell: i for i, cell in enumerate(sorted(new_parts))}        # small cell numbers again
        cells = cells.select("g", "weight", F.coalesce(moved, F.col("cell")).alias("cell"), *[f"k{i}" for i in range(len(dims))])
        # written at every level: nested choices would be multiplied out by the optimiser
        cells = written(cells.withColumn("cell", _pick(F.col("cell"), {c: F.lit(i) for c, i in number.items()})))
        parts = {number[cell]: part for cell, part in new_parts.items()}
    return cells.select("g", _pick(F.col("cell"), {cell: F.lit(first) for cell, (first, _) in parts.items()}).alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``slot`` numbers the rows of a shard from 0 without gaps; null text has size 1 and the checksum of no bytes, 0. Rows
    with equal texts share a shard; repeated rows and null ids are rows like any other; no rows give no rows; further
    columns are ignored. ``grown_shard`` is null, as the law is ``bytes``.
    """
    leaves = written(kd_leaves(text_groups(docs), shards))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _size().alias("size"), F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"), _digest().alias("g"))
    placed = written(rows.join(leaves, "g"))
    lots = max(1, -(-placed.count() // (shards * NUMBERED)))
    lot = F.pmod(F.xxhash64("doc_id", "g"), F.lit(lots)).cast("int")
    placed = placed.withColumn("lot", lot)
    counts = placed.groupBy("shard", "lot").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)      # one row per lot
    before = counts.select("shard", "lot", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "lot").orderBy("doc_id", "g")).cast("long") - 1
    numbered = placed.withColumn("own", own).join(before, ["shard", "lot"]).withColumn("slot", F.col("own") + F.col("before"))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

