"""Hard negatives by Fagin's threshold algorithm over integer vectors.

Every row lies in one block of bounded size. In a task a block has one list per dimension, sorted by that dimension's
value. An anchor reads the lists from the end its own component's sign asks for, step by step; rows met for the first
time are scored at random access by their exact integer product; and it stops once no row still unmet can reach what it
holds: the threshold (the product with the last values read) is strictly below each window's k-th score, strictly
because equal scores go to the smaller id.
"""

from __future__ import annotations

from decimal import Decimal
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.session import written

CELLS = 1 << 20             # components of a block
BLOCK = (64, 16_384)        # least and most rows of a block, but for what one range of digests holds more
CHUNK = 512                 # anchors that visit a block together
DIGITS = 10 ** 38 - 1       # greatest score that is told from greater ones
STEP = 32                   # first stretch of sorted access; each next one is twice as long


def _usable(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * 256)).alias("q"))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows padded with zeros to ``dims``."""
    column = column.combine_chunks()
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles while every product of two rows stays below 2^53, whole Python numbers beyond."""
    most = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    kind = float if most(a) * most(b) * max(a.shape[1], 1) < 1 << 53 else object
    return a.astype(kind), b.astype(kind)


class Lists:
    """The sorted lists of one block."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        self.order = np.ascontiguousarray(x.argsort(axis=0, kind="stable").T)          # D x n, ascending
        self.value = np.ascontiguousarray(np.take_along_axis(x, self.order.T, axis=0).T)

    def best(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per window (low, high): rows and scores of the first ``k`` allowed rows with a score inside it."""
        n = len(self.x)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        met, rows, scores = np.zeros(n, dtype=bool), np.empty(0, dtype=np.int64), np.empty(0, dtype=anchor.dtype)
        done, step = 0, STEP
        while done < n:
            to = min(n, done + step) if len(up) + len(down) else n          # an anchor of zeros scores all rows alike
            now = np.zeros(n, dtype=bool)
            now[self.order[up, n - to:n - done].ravel()] = True             # sorted access, from the top or the bottom
            now[self.order[down, done:to].ravel()] = True
            fresh = np.flatnonzero((now if to < n else True) & ~met)
            met[fresh] = True
            fresh = fresh[allowed[fresh]]
            rows, scores = np.concatenate([rows, fresh]), np.concatenate([scores, self.x[fresh] @ anchor])
            done, step = to, 2 * step
            threshold = anchor[up] @ self.value[up, n - to] + anchor[down] @ self.value[down, to - 1]
            if all(threshold < self._floor(scores, low, high, k) for low, high in windows):
                break
        out = []
        for low, high in windows:
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            inside = inside[np.lexsort((self.ids[rows[inside]], -scores[inside]))[:k]]
            out.append((rows[inside], scores[inside]))
        return out

    @staticmethod
    def _floor(scores: np.ndarray, low, high, k: int):
        """What an unmet row must reach: the k-th score held, or the window's lower end while fewer are held."""
        held = scores[(scores >= low) & (scores <= high)]
        return np.sort(held)[-k] if len(held) >= k else low


def _visits(rows: DataFrame, anchors: DataFrame, k: int, same: bool, span) -> DataFrame:
    """(a, anchor_id, w, given, other, score): per anchor, window and block the first ``k`` rows of the same or of other labels.

    ``rows`` and ``anchors`` hold the block and the chunk in which they meet; an anchor's ``windows`` are structs (w, given)
    and ``span(given)`` is the least and the greatest score of one.
    """
    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("a", "anchor_id", "w", "given", "other", "score")}
        sizes = [np.diff(c.column("q").combine_chunks().offsets.to_numpy()).max(initial=0) for c in (left, right)]
        x, qs = _exact(_matrix(left.column("q"), max(sizes)), _matrix(right.column("q"), max(sizes)))
        ids, labels = left.column("vec_id").to_numpy(), left.column("label").to_numpy()
        lists = Lists(x, ids) if len(x) else None
        for q, a, anchor_id, label, windows in zip(qs, *(right.column(c).to_pylist() for c in ("a", "anchor_id", "label", "windows"))):
            allowed = (labels == label) & (ids != anchor_id) if same else labels != label
            if lists is None or not allowed.any():
                continue
            for w, (at, scores) in zip(windows, lists.best(q, allowed, [span(int(w["given"])) for w in windows], k)):
                for c, v in (("a", a), ("anchor_id", anchor_id), ("w", w["w"]), ("given", w["given"])):
                    out[c] += [v] * len(at)
                out["other"] += ids[at].tolist()
                out["score"] += [Decimal(max(-DIGITS, min(DIGITS, int(s)))) for s in scores]
        return pa.table({c: pa.array(v, pa.decimal128(38, 0) if c in ("given", "score") else pa.int64()) for c, v in out.items()})

    keys = ["block", "chunk"]
    rows, anchors = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (rows, anchors))     # both may come from one table
    return rows.groupBy(*keys).cogroup(anchors.groupBy(*keys)).applyInArrow(meet, "a long, anchor_id long, w long, given decimal(38,0), other long, score decimal(38,0)")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of every window over all blocks, in ``rank``."""
    order = Window.partitionBy("a", "w").orderBy(F.desc("score"), "other")          # k rows from each block at most
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` out of ``vec_id, label, embedding``.

    Components become ``floor(256 * x)`` and scores are exact inner products of these whole numbers. An anchor (``anchor``
    holds; ids divisible by 100 if not given) has as positives its first ``positives`` rows of the same label and another
    id, by score, then id; per positive the first ``negatives`` rows of other labels follow whose score is ``low`` to
    ``high`` percent of the positive's, both ends included.

    Rows without id, label or vector, or with a null or non-finite component, take no part. Shorter vectors count as
    padded with zeros, an empty one as zeros. Repeated rows are candidates each on their own, so an id can appear twice
    in a ranking; anchors that are wholly equal are one, and an id with two vectors or labels is two anchors. Whole
    numbers beyond 64 bits become the nearest one inside; scores are compared exactly up to 38 digits and returned as the
    nearest 64-bit number. An anchor without positives, or without
    rows inside its windows, gives no rows. Further columns are ignored; an empty table gives an empty result.

    Blocks are ranges of (label, digest), so positives are sought only in blocks that hold the label, and a label of any
    size is spread over many. A task holds one block and up to 512 anchors.
    """
    usable = _usable(vectors)
    n, dims = usable.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    size = min(BLOCK[1], max(BLOCK[0], CELLS // max(dims, 1)))
    dealt = usable.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(max(1, ceil(n / size)), "label", F.xxhash64("vec_id", "salt"))
    rows = written(dealt.select("vec_id", "label", "q", F.spark_partition_id().cast("long").alias("block")))
    chosen = rows.where(anchor if anchor is not None else F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("anchor_id"), "label", "q").distinct()
    anchors = written(chosen.withColumn("a", F.monotonically_increasing_id()))
    blocks = (rows.agg(F.max("block")).first()[0] or 0) + 1
    chunks = max(1, ceil(anchors.count() / CHUNK))
    anchors = anchors.withColumn("chunk", F.pmod(F.xxhash64("a"), F.lit(chunks)))

    zero = F.lit(0).cast("long")
    at_home = anchors.join(rows.select("block", "label").distinct(), "label").withColumn("windows", F.array(F.struct(zero.alias("w"), zero.cast("decimal(38,0)").alias("given"))))
    near = _visits(rows.join(at_home.select("block", "chunk").distinct(), "block"), at_home, positives, True, lambda given: (-float("inf"), float("inf")))
    near = written(_first(near, positives).withColumnRenamed("other", "positive_id").where("score >= 0"))      # no score lies between 0.3 and 0.9 of a negative one

    windows = near.groupBy("a").agg(F.collect_list(F.struct(F.col("rank").cast("long").alias("w"), F.col("score").alias("given"))).alias("windows"))   # ``positives`` at most
    abroad = anchors.join(windows, "a").withColumn("block", F.explode(F.sequence(zero, F.lit(blocks - 1).cast("long"))))
    dealt = rows.withColumn("chunk", F.explode(F.sequence(zero, F.lit(chunks - 1).cast("long"))))
    far = _first(_visits(dealt, abroad, negatives, False, lambda given: (-(-low * given // 100), high * given // 100)), negatives)
    named = near.select("a", F.col("rank").cast("long").alias("w"), "positive_id")
    long = lambda c: F.greatest(F.lit(-(1 << 63)), F.least(F.lit((1 << 63) - 1), c)).cast("long")
    return far.join(named, ["a", "w"]).select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), long("given").alias("positive_score"), long("score").alias("negative_score"))
