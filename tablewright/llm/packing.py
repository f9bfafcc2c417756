"""Best-fit packing of documents into fixed-length sequences, with conflicts.

A sequence (bin) may hold no two documents of one duplicate cluster and, by default, no two of one source. Documents
longer than a sequence are cut; their full pieces are sequences of their own, and only the rest is packed.

Documents are dealt by a hash of their row into packing groups of a bounded size, equal rows by the number of the copy
as well; each group is packed on its own by best-fit decreasing. Open bins are kept in the order of their remaining room; every bin carries a bitmap of its sources
and one of its clusters. From the tightest bin that is large enough the search walks to the next roomier one until the
bitmaps allow it; only when none does, a new bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import written
from .scratch import map_groups

CAPACITY = 8192                    # characters and end marks in a sequence
GROUP = 2048                       # documents packed together, on average
COPIES = 1024                      # equal rows numbered by one task in a go

PACKED = "bin string, doc_id long, piece long, start long, length long, size long, place long, source string, cluster long, room long"


def best_fit(size: np.ndarray, sources: list, clusters: list, capacity: int, apart: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bin and starting place of every item, items given largest first.

    Sources and clusters may be None: such an item is in conflict with nothing on that account.
    """
    bit_of: tuple[dict, dict] = ({}, {})

    def bit(which: int, value) -> int:
        return 0 if value is None else 1 << bit_of[which].setdefault(value, len(bit_of[which]))

    rooms: list[tuple[int, int]] = []              # (room left, bin), ascending
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    bins, place = np.empty(len(size), dtype=np.int64), np.empty(len(size), dtype=np.int64)
    for i, need in enumerate(size.tolist()):
        s = bit(0, sources[i]) if apart else 0
        c = bit(1, clusters[i])
        at = bisect_left(rooms, (need, -1))
        while at < len(rooms) and (source_bits[rooms[at][1]] & s or cluster_bits[rooms[at][1]] & c):
            at += 1
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[b] |= s
        cluster_bits[b] |= c
        bins[i], place[i] = b, capacity - room
        if room > need:
            insort(rooms, (room - need, b))
    return bins, place


def _numbered(items: DataFrame, clusters: DataFrame | None) -> DataFrame:
    """Every row again, with its cluster and a number for each of its copies. Equal rows are counted, not sorted; many
    copies of one row are numbered by several tasks."""
    counted = written(items.groupBy(*items.columns).agg(F.count("*").alias("copies")))
    if clusters is not None:
        given = clusters.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("cluster").cast("long").alias("cluster"))
        joined = counted.where("doc_id IS NOT NULL").join(given, "doc_id", "left")
        counted = joined.unionByName(counted.where("doc_id IS NULL"), allowMissingColumns=True)
    else:
        counted = counted.withColumn("cluster", F.lit(None).cast("long"))
    counted = counted.withColumn("cluster", F.coalesce("cluster", "digest"))
    few = counted.where(F.col("copies") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    many = counted.where(F.col("copies") > COPIES).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    spread = many.repartition("digest", "chunk").withColumn("first", F.col("chunk") * COPIES)
    number = F.sequence("first", F.least("copies", F.col("first") + COPIES) - 1)
    return few.unionByName(spread.withColumn("copy", F.explode(number)).drop("chunk", "first")).drop("copies")


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, apart: bool = True, clusters: DataFrame | None = None) -> DataFrame:
    """One row per piece of a document: its bin, the characters ``[start, start + length)`` it holds, its place there.

    ``size`` is ``length`` plus one end mark for a document's last piece; sizes in a bin add up to ``capacity`` at most
    and ``room`` is what the bin has left. ``clusters`` is a table (doc_id, cluster) with one row for an id, the number
    of its duplicate cluster; without it, or for ids that are not in it, the cluster is a digest of the text. Texts that are null or empty have one
    piece of size 1. A null source is in conflict with nothing. Repeated rows are packed each, in different bins as
    they are copies, and are spread over the packing groups; a null id is packed too. No rows give no rows; further
    columns are ignored.
    """
    long = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    items = _numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), long.alias("n"), digest.alias("digest")), clusters)
    groups = max(1, -(-docs.count() // group))
    items = items.withColumn("dealt", F.pmod(F.xxhash64("doc_id", "digest", "n", "source", "copy"), F.lit(groups)))
    full = F.floor(F.col("n") / F.lit(capacity))   # pieces that fill a bin alone; the end mark always follows
    rest = items.withColumn("full", full)
    whole = (rest.where("full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
             .select(F.concat_ws(":", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("source", F.lit("")), F.col("digest").cast("string"), F.col("copy").cast("string"), F.col("piece").cast("string")).alias("bin"), "doc_id", "piece",
                     (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), F.lit(capacity).cast("long").alias("size"), F.lit(0).cast("long").alias("place"), "source", "cluster", F.lit(0).cast("long").alias("room")))
    last = rest.select("dealt", "doc_id", "source", "cluster", F.col("full").alias("piece"), (F.col("n") - F.col("full") * capacity).alias("length"))

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((table.column("cluster").to_numpy(), table.column("doc_id").fill_null(-1).to_numpy(), -table.column("length").to_numpy()))
        table = table.take(pa.array(order))
        size = table.column("length").to_numpy() + 1
        cluster = table.column("cluster")
        bins, place = best_fit(size, table.column("source").to_pylist(), cluster.to_pylist(), capacity, apart)
        room = capacity - np.bincount(bins, weights=size).astype(np.int64)
        name = f"{table.column('dealt')[0].as_py()}:"
        piece = table.column("piece").to_numpy()
        columns = [pa.array([name + str(b) for b in bins.tolist()]), table.column("doc_id"), pa.array(piece), pa.array(piece * capacity), pa.array(size - 1), pa.array(size), pa.array(place), table.column("source"), cluster, pa.array(room[bins])]
        yield from pa.Table.from_arrays(columns, names=["bin", "doc_id", "piece", "start", "length", "size", "place", "source", "cluster", "room"]).combine_chunks().to_batches()

    return whole.unionByName(map_groups(last, ["dealt"], run, PACKED))
