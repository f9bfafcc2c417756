"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word 5-grams. Sets that are equal form one class; classes are joined when their Jaccard similarity
reaches the threshold. Candidates come from bands of MinHash values. Two candidates' values are compared a step at a
time, and a pair is dropped as soon as the posterior probability (uniform prior) that its similarity reaches the
threshold falls below a tolerance. What is left is verified exactly on the n-gram sets.

With 32 bands of 4 values a pair at similarity 0.8 misses every band with probability 5e-8; the tolerance adds at most
about 1e-6 for every step.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.session import written

from .components import components
from .scratch import map_groups
from .words import Slice, first_of_runs, mix, slices

WORDS = 5
THRESHOLD = 0.8
VALUES = 128                       # MinHash values of 16 bits
BAND = 4                           # values in a band: one 64-bit key
STEP = 16                          # values compared between two looks at the posterior
TOLERANCE = 1e-6
BLOCK = 256                        # members that meet in one task at a time

_DRAW = np.random.default_rng(20240611)
_FACTORS = _DRAW.integers(1, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIPS = _DRAW.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def shingles(part: Slice, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct word n-gram of each row, sorted; a shorter text is one n-gram of all its words."""
    first, value = part.windows(size)
    row = part.row[first]
    count = np.bincount(part.row, minlength=part.rows)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        words, start = part.word_hashes(), np.concatenate([[0], np.cumsum(count)])
        whole = np.zeros(len(short), dtype=np.uint64)
        for k in range(size - 1):
            there = count[short] > k
            whole[there] = (whole[there] + words[start[short[there]] + k]) * np.uint64(0x9FB21C651E98DF25)
        row, value = np.concatenate([row, short]), np.concatenate([value, mix(whole, 77)])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = first_of_runs(row, value)
    return row[new], value[new]


def sketch(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row: number of n-grams, two 64-bit digests of the set, and its MinHash values (rows x VALUES, 16 bits)."""
    row, value = shingles(part)
    n = np.bincount(row, minlength=part.rows)
    sums = np.zeros((2, part.rows), dtype=np.uint64)
    least = np.zeros((part.rows, VALUES), dtype=np.uint16)
    some = np.flatnonzero(n)
    if len(some):
        at = np.concatenate([[0], np.cumsum(n[some])[:-1]])
        for k in range(2):
            sums[k, some] = np.add.reduceat(mix(value, 1000 + k), at)
        small = (value >> np.uint64(32)).astype(np.uint32)
        for k in range(VALUES):
            low = np.minimum.reduceat((small ^ _FLIPS[k]) * _FACTORS[k], at)
            least[some, k] = (mix(low.astype(np.uint64), k) >> np.uint64(48)).astype(np.uint16)
    return n, sums[0].view(np.int64), sums[1].view(np.int64), least


def fewest_equal(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """``(n, m)``: after ``n`` values a pair goes on only with at least ``m`` of them equal.

    With ``m`` of ``n`` equal and a uniform prior, P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    steps = []
    for n in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        steps.append((n, m))
    return steps


def survivors(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Positions of the pairs ``(a[left], b[right])`` that are never dropped."""
    alive = np.arange(len(left))
    equal = np.zeros(len(left), dtype=np.int64)
    done = 0
    for n, m in steps:
        equal[alive] += (a[left[alive], done:n] == b[right[alive], done:n]).sum(axis=1)
        alive = alive[equal[alive] >= m]
        done = n
        if not len(alive):
            break
    return alive


def forest(left: np.ndarray, right: np.ndarray, size: int) -> list[tuple[int, int]]:
    """A spanning forest of links between ``size`` things: at most ``size - 1`` of them."""
    root = list(range(size))
    kept = []
    for i, j in zip(left.tolist(), right.tolist()):
        a, b = i, j
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append((i, j))
    return kept


def _pairs(side: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs inside one block, or between the two blocks of a group, as a stream of at most BLOCK^2."""
    if same:
        return np.triu_indices(len(side), 1)
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return np.repeat(one, len(two)), np.tile(two, len(one))


def blocks(df: DataFrame, group: str, member: str, size: int = BLOCK) -> DataFrame:
    """Cut large groups: adds ``bi <= bj`` and ``side``, so that any two members of a group meet in one ``(group, bi, bj)``.

    A group of n members becomes k = n / ``size`` blocks and k(k + 1)/2 tasks of two blocks; rows with a group of up to
    ``size`` members are not repeated.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    k = F.ceil(F.col("_n") / F.lit(size)).cast("int")
    dealt = df.join(sizes, group).withColumn("_k", k).withColumn("_b", F.pmod(F.xxhash64(member), F.col("_k").cast("long")).cast("int"))
    other = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return other.select("*", F.least("_b", "_o").alias("bi"), F.greatest("_b", "_o").alias("bj"), (F.col("_b") > F.col("_o")).cast("int").alias("side")).drop("_n", "_k", "_b", "_o")


def _signed(docs: DataFrame, text: bool = False) -> DataFrame:
    """``doc_id, n, d1, d2, keys``: how many n-grams, 128 bits of their set, the bands; with ``text`` also that."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), 1 << 19):
                n, one, two, least = sketch(part)
                keys = pa.array(least.view(np.uint64).view(np.int64).reshape(-1))
                bands = VALUES // BAND
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, (part.rows + 1) * bands, bands, dtype=np.int32)), keys)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.rows), pa.array(n.astype(np.int64)), pa.array(one), pa.array(two), listed, *([batch.column(1).slice(part.first, part.rows)] if text else [])],
                                                     names=["doc_id", "n", "d1", "d2", "keys", *(["text"] if text else [])])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, keys array<long>" + (", text string" if text else ""))


def _values(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.view(np.uint16).reshape(-1, VALUES)


def _candidates(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Links between classes that share a band and outlive the pruning, as spanning forests of what meets."""
    bands = classes.select("rep", F.posexplode("keys").alias("band", "key"))
    met = bands.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("who"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("n > 1")
    # the same members meet in many bands: once is enough
    once = met.groupBy("n", "who", "lo", "hi").agg(F.min(F.struct("band", "key")).alias("at")).select("n", "lo", "hi", "at.band", "at.key")
    once = written(once)
    two = once.where("n = 2").select("band", "key", F.explode(F.array("lo", "hi")).alias("rep"))
    more = bands.join(once.where("n > 2").select("band", "key"), ["band", "key"]).select("band", "key", "rep")
    meeting = two.unionByName(more).select(F.struct("band", "key").alias("at"), "rep").join(classes.select("rep", "keys"), "rep")
    dealt = blocks(meeting, "at", "rep").select(F.col("at.band").alias("band"), F.col("at.key").alias("key"), "bi", "bj", "side", "rep", "keys")
    steps = fewest_equal(threshold, tolerance)

    def compare(group: pa.Table) -> Iterator[pa.RecordBatch]:
        rep = group.column("rep").to_numpy()
        value = _values(group.column("keys"))
        left, right = _pairs(group.column("side").to_numpy(), group.column("bi")[0].as_py() == group.column("bj")[0].as_py())
        alive = survivors(value, value, left, right, steps)
        links = forest(left[alive], right[alive], len(rep))
        if links:
            at = np.array(links)
            yield pa.RecordBatch.from_arrays([pa.array(rep[at[:, 0]]), pa.array(rep[at[:, 1]])], names=["a", "b"])

    return map_groups(dealt, ["band", "key", "bi", "bj"], compare, "a long, b long")


def _texts_of(docs: DataFrame, wanted: DataFrame, often: DataFrame) -> DataFrame:
    """``wanted(rep, component, size, first, d1, d2)`` with one text of each class.

    A class is found by its least id. Where several rows have that id (``often``), their texts are signed again and one
    with the class's own n-grams is taken.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("first"), "text")
    if often.isEmpty():
        return given.join(wanted.hint("shuffle_hash"), "first")
    single = given.join(wanted.join(often, "first", "left_anti").hint("shuffle_hash"), "first")
    several = _signed(given.join(often, "first", "left_semi").withColumnRenamed("first", "doc_id"), text=True)
    own = several.select(F.col("doc_id").alias("first"), "d1", "d2", "text").groupBy("first", "d1", "d2").agg(F.min("text").alias("text"))
    return single.unionByName(own.join(wanted, ["first", "d1", "d2"]).select(*single.columns))


def _verified(docs: DataFrame, classes: DataFrame, often: DataFrame, families: DataFrame, threshold: float) -> DataFrame:
    """Exact comparison inside every family of candidates: rows ``(a, b, links)``.

    ``b`` null: class ``a`` gains ``links`` documents; otherwise a link of the spanning forest.
    """
    wanted = families.join(classes, families.node == F.col("rep")).select("rep", "component", "size", "first", "d1", "d2")
    texts = _texts_of(docs, wanted, often)
    dealt = blocks(texts.select("component", "rep", "size", "text"), "component", "rep").select("component", "bi", "bj", "side", "rep", "size", "text")

    def verify(group: pa.Table) -> Iterator[pa.RecordBatch]:
        rep, size = group.column("rep").to_numpy(), group.column("size").to_numpy()
        side, same = group.column("side").to_numpy(), group.column("bi")[0].as_py() == group.column("bj")[0].as_py()
        rows, values = [], []
        for part in slices(group.column("text")):
            row, value = shingles(part)
            rows.append(row + part.first)
            values.append(value)
        row, value = np.concatenate(rows), np.concatenate(values)
        n = np.bincount(row, minlength=len(rep))
        common = intersections(row, value, len(rep))
        alike = common >= threshold * (n[:, None] + n[None, :] - common) - 1e-9
        alike &= (common > 0) & (rep[:, None] != rep[None, :])
        if not same:
            alike &= side[:, None] != side[None, :]
        left, right = np.nonzero(np.triu(alike, 1))
        gained = alike.astype(np.int64) @ size
        some = np.flatnonzero(gained)
        links = np.array(forest(left, right, len(rep)), dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([rep[some], rep[links[:, 0]]])),
            pa.array(np.concatenate([np.zeros(len(some), dtype=np.int64), rep[links[:, 1]]]), mask=np.arange(len(some) + len(links)) < len(some)),
            pa.array(np.concatenate([gained[some], np.zeros(len(links), dtype=np.int64)])),
        ], names=["a", "b", "links"])

    return map_groups(dealt, ["component", "bi", "bj"], verify, "a long, b long, links long")


def intersections(row: np.ndarray, value: np.ndarray, size: int, width: int = 4096) -> np.ndarray:
    """How many values every two rows share, as exact products of 0/1 matrices of ``width`` shared values at a time."""
    _, where, count = np.unique(value, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared)[where] - 1
    keep = shared[where]
    row, column = row[keep], column[keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((size, size), dtype=np.float64)
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        table = np.zeros((size, width), dtype=np.float32)
        table[row[a:b], column[a:b] - low] = 1
        total += table @ table.T
    own = np.arange(size)
    total[own, own] = 0
    return total.astype(np.int64)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (its equal n-gram sets), ``n_links``, ``component_id``, ``kept``.

    ``class_id`` and ``component_id`` are the least ids of documents with the same n-grams, and of those reachable by
    links; ``n_links`` counts the other documents linked directly, copies included; ``kept`` is true for the least id.
    A text without words (or null) links with nothing, not even with another such text, and is kept. Texts under five
    words are one n-gram. A row without id is returned with nulls and no links and is kept. Rows that share an id
    are documents of their own, each with the links of its text; rows equal in id and text are copies of each other. No
    rows give no rows; further columns are ignored.
    """
    signed = written(_signed(docs))
    real = signed.where("doc_id is not null and n > 0")
    # two classes can have the same least id, so that a class has a number of its own
    counted = real.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("size"), F.first("keys").alias("keys"))
    classes = written(counted.withColumn("rep", F.monotonically_increasing_id()))
    families = components(_candidates(classes, threshold, tolerance))
    often = written(signed.where("doc_id is not null").groupBy(F.col("doc_id").alias("first")).agg(F.count("*").alias("n")).where("n > 1").select("first"))
    checked = written(_verified(docs, classes, often, families, threshold))
    groups = components(checked.where("b is not null").select("a", "b"))
    gained = checked.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    placed = groups.join(classes.select(F.col("rep").alias("node"), "first"), "node")
    least = placed.groupBy("component").agg(F.min("first").alias("least"))
    found = (classes.select("d1", "d2", "rep", "first", "size").join(gained, F.col("rep") == F.col("a"), "left")
             .join(groups.join(least, "component").select("node", "least"), F.col("rep") == F.col("node"), "left").select("d1", "d2", "first", "size", "links", "least"))
    sizes = real.select("doc_id", "d1", "d2")
    inside = sizes.join(found, ["d1", "d2"]).select(
        "doc_id", F.col("first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links"),
        F.coalesce("least", "first").alias("component_id"))
    alone = signed.where("doc_id is null or n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return inside.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``docs`` without those that :func:`near_duplicates` does not keep; columns unchanged.

    Rows that share an id count as one document and stay or go together.
    """
    gone = near_duplicates(docs, threshold, tolerance).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
