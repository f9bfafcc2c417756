"""Ranked lexical search: exact inner products of sparse vectors, sought in ball trees.

A document's vector has one whole number for each sought term it holds: the term's weight times the saturated frequency.
An item's vector is one for each of its terms. So a score is the inner product of the two, and inside a ball with centre
c and radius r no document's exceeds ``item . c + |item| r``, where only terms that some document of the ball holds count.
A task reads its documents in blocks, builds a tree over each and searches it best-first for every item, with the scores
found so far carried from block to block; leaves are scored in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush, heappushpop
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablewright.session import written

from .terms import Terms, batches_of, heads, term_set, term_slices

LEAF = 64                    # documents of a leaf; a ball of equal vectors is a leaf whatever its size
BLOCK = 4096                 # documents of a tree
POSTINGS = 1 << 21           # postings of a tree, but for one larger document
BATCH = 1 << 20              # terms of the items that are sought in one pass over the documents
SLACK = 2.0 ** -48           # of sums in double precision, for each term added


# ---- counting ------------------------------------------------------------------------------------------------------

def _tokenised(items: DataFrame) -> DataFrame:
    """(item_id, hashes, firsts): the distinct terms of each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in term_slices(batch.column("text")):
                h, f = part.word_hashes(), heads(part)
                order = np.lexsort((f, h, part.row))
                row, h, f = part.row[order], h[order], f[order]
                new = np.ones(len(row), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1]) | (f[1:] != f[:-1])
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=part.rows))]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v[new].view(np.int64))) for v in (h, f)]
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(part.first, part.rows), *lists], ["item_id", "hashes", "firsts"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, hashes array<long>, firsts array<long>")


def _counted(docs: DataFrame, terms: Terms) -> DataFrame:
    """(doc_id, n, terms, tfs): all terms of a document with repeats, and how often it holds each sought one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(1, len(terms))
        for batch in batches:
            for part in term_slices(batch.column("text")):
                at = terms.find(part.word_hashes(), heads(part))
                hit = at >= 0
                keys, tf = np.unique(part.row[hit] * width + at[hit], return_counts=True)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(keys // width, minlength=part.rows))]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part.first, part.rows), pa.array(np.bincount(part.row, minlength=part.rows), pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array(keys % width, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))],
                    ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


# ---- trees ---------------------------------------------------------------------------------------------------------

def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of ranges, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


class Tree:
    """Ball tree over sparse vectors of positive whole numbers: document ``i`` holds ``value`` at ``term`` in ``at[i]:at[i + 1]``."""

    def __init__(self, at: np.ndarray, term: np.ndarray, value: np.ndarray, dims: int):
        self.at, self.term, self.value, self.x = at, term, value, value.astype(float)
        size = np.diff(at)
        self.square = np.add.reduceat(self.x * self.x, at[:-1])
        self.radius: list[float] = []
        self.children: list[tuple[int, int] | None] = []
        self.leaves: dict[int, tuple] = {}
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        todo = [(np.arange(len(size)), self._new())]
        while todo:
            docs, node = todo.pop()
            here = _spread(at[docs], size[docs])
            t, x, first = term[here], self.x[here], np.cumsum(size[docs]) - size[docs]

            def from_(dense: np.ndarray, square: float) -> np.ndarray:
                """Squared distances of the node's documents to a point, rounded up."""
                exact = self.square[docs] + square - 2 * np.add.reduceat(x * dense[t], first)
                return np.maximum(0, exact) + (self.square[docs] + square) * (size[docs] + len(docs) + 16) * SLACK

            centre = np.bincount(t, weights=x, minlength=dims) / len(docs)
            there = np.flatnonzero(centre)
            held.append((node, there, centre[there]))
            away = from_(centre, float(centre @ centre))
            self.radius[node] = float(np.sqrt(away.max())) * (1 + SLACK)
            one = len(docs) <= LEAF or self._equal(docs)
            if one:
                order = np.argsort(t, kind="stable")
                self.leaves[node] = docs, t[order], np.repeat(np.arange(len(docs)), size[docs])[order], value[here][order]
                continue
            # two documents far apart; every other one goes to the nearer half
            a = self._from(docs[int(away.argmax())], dims, from_)
            b = self._from(docs[int(a.argmax())], dims, from_)
            order = np.argsort(a - b, kind="stable")
            halves = docs[np.sort(order[:len(docs) // 2])], docs[np.sort(order[len(docs) // 2:])]
            self.children[node] = self._new(), self._new()
            todo += list(zip(halves, self.children[node]))
        nodes = np.repeat([n for n, _, _ in held], [len(t) for _, t, _ in held])
        terms = np.concatenate([t for _, t, _ in held])
        order = np.argsort(terms, kind="stable")
        self.node_of, self.centre = nodes[order], np.concatenate([c for _, _, c in held])[order]
        self.term_at = np.searchsorted(terms[order], np.arange(dims + 1))
        self.radii = np.array(self.radius)

    def _new(self) -> int:
        self.radius.append(0.0)
        self.children.append(None)
        return len(self.radius) - 1

    def _equal(self, docs: np.ndarray) -> bool:
        first = slice(self.at[docs[0]], self.at[docs[0] + 1])
        sizes = self.at[docs + 1] - self.at[docs]
        if (sizes != sizes[0]).any():
            return False
        here = _spread(self.at[docs], sizes)
        return bool((self.term[here].reshape(len(docs), -1) == self.term[first]).all() and (self.value[here].reshape(len(docs), -1) == self.value[first]).all())

    def _from(self, doc: int, dims: int, distances) -> np.ndarray:
        dense = np.zeros(dims)
        dense[self.term[self.at[doc]:self.at[doc + 1]]] = self.x[self.at[doc]:self.at[doc + 1]]
        return distances(dense, float(self.square[doc]))

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """For each node, what no inner product inside it exceeds, rounded up."""
        sizes = self.term_at[terms + 1] - self.term_at[terms]
        here = _spread(self.term_at[terms], sizes)
        inner = np.bincount(self.node_of[here], weights=self.centre[here], minlength=len(self.radii))
        shared = np.bincount(self.node_of[here], minlength=len(self.radii))
        return np.where(shared > 0, (inner + np.sqrt(shared) * self.radii) * (1 + (len(terms) + 16) * SLACK) + 1, 0)

    def scores(self, leaf: int, terms: np.ndarray) -> np.ndarray:
        """Exact inner products of the leaf's documents."""
        docs, term, owner, value = self.leaves[leaf]
        low, high = np.searchsorted(term, terms), np.searchsorted(term, terms, side="right")
        here = _spread(low, high - low)
        out = np.zeros(len(docs), dtype=np.int64)
        np.add.at(out, owner[here], value[here])
        return out

    def search(self, terms: np.ndarray, best: list[tuple], k: int, names: list[tuple]) -> int:
        """Merge this tree's documents into ``best``, a heap of the ``k`` first (score, name); returns the leaves scored."""
        bound, scored = self.bounds(terms), 0
        queue = [(-bound[0], 0)]
        while queue:
            most, node = heappop(queue)
            if most == 0 or len(best) == k and -most < best[0][0]:       # an equal score may still go to a smaller id
                break
            if self.children[node]:
                for child in self.children[node]:
                    heappush(queue, (max(most, -bound[child]), child))
                continue
            scored += 1
            found = self.scores(node, terms)
            docs = self.leaves[node][0]
            for i in np.flatnonzero(found >= max(1, best[0][0] if len(best) == k else 1)):
                entry = (int(found[i]), *names[docs[i]])
                if len(best) < k:
                    heappush(best, entry)
                else:
                    heappushpop(best, entry)
        return scored


def _trees(batches: Iterator[pa.RecordBatch], weight: np.ndarray, n_docs: int, n_terms: int) -> Iterator[tuple[Tree, np.ndarray, list[tuple]]]:
    """(tree, its terms, names of its documents) for block after block of documents."""
    def block(parts: list) -> tuple[Tree, np.ndarray, list[tuple]]:
        ids, n, sizes, term, tf = (pa.concat_arrays([p[i] for p in parts]) for i in range(5))
        size, term, tf = sizes.to_numpy(), term.to_numpy().astype(np.int64), tf.to_numpy().astype(np.int64)
        n = n.to_numpy()
        if 50 * int(n.max()) * n_docs >= 1 << 63:
            n = n.astype(object)
        m = 50 + (50 * n * n_docs // n_terms).astype(np.int64)
        value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, size)))
        used, local = np.unique(term, return_inverse=True)
        # names order equal scores: a smaller id is better, no id is last
        names = [(0, 0) if i is None else (1, -i) for i in ids.to_pylist()]
        return Tree(np.concatenate([[0], np.cumsum(size)]), local, value, len(used)), used, names

    parts, docs, postings = [], 0, 0
    for batch in batches:
        lists, tfs = batch.column("terms"), batch.column("tfs")
        size = np.diff(lists.offsets.to_numpy())
        total = np.concatenate([[0], np.cumsum(size)])
        first = 0
        while first < len(size):
            room = int(np.searchsorted(total, total[first] + POSTINGS - postings, side="right")) - 1
            last = max(min(len(size), first + BLOCK - docs, room), first + (docs == 0))
            if last > first:
                piece = slice(first, last)
                parts.append((batch.column("doc_id")[piece], batch.column("n")[piece], pa.array(size[piece]), lists[piece].flatten(), tfs[piece].flatten()))
                docs, postings, first = docs + last - first, postings + int(total[last] - total[first]), last
            if first < len(size):
                yield block(parts)
                parts, docs, postings = [], 0, 0
    if parts:
        yield block(parts)


# ---- search --------------------------------------------------------------------------------------------------------

def _search_batch(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, score, no): the first ``k`` of every item, ``no`` parting items of one id."""
    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.where(F.size("hashes") > 0).collect()          # about BATCH terms at most
    sizes = [len(r["hashes"]) for r in rows]
    flat = lambda c: np.array([v for r in rows for v in r[c]], dtype=np.int64).view(np.uint64)
    terms, places = term_set(flat("hashes"), flat("firsts"))
    wanted = np.split(places, np.cumsum(sizes)[:-1])
    ids = [r["item_id"] for r in rows]

    counted = written(_counted(docs, terms))
    n_docs, n_terms = counted.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), dtype=np.int64)
    for term, count in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():      # one row a sought term
        df[term] = count
    weight = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * c + 1))) for c in df.tolist()], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in wanted]
        for tree, used, names in _trees(batches, weight, n_docs, n_terms):
            local = np.full(len(weight), -1)
            local[used] = np.arange(len(used))
            for heap, item in zip(best, wanted):
                here = local[item]
                here = here[here >= 0]
                if len(here):
                    tree.search(here, heap, k, names)
        found = [(no, *entry) for no, heap in enumerate(best) for entry in heap]
        out = {"no": [f[0] for f in found], "doc_id": [-f[3] if f[2] else None for f in found], "score": [f[1] for f in found]}
        yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})

    found = counted.where(F.size("terms") > 0).mapInArrow(run, "no long, doc_id long, score long")
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))        # k rows from each task at most
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame(list(enumerate(ids)), f"no long, item_id {kind}")
    return ranked.join(names, "no").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents (``doc_id, text``) of highest score above 0 for each item (``item_id, text``).

    Terms, weights and scores are those of the contract of ``op12``, in whole numbers; equal scores are ranked by ascending
    ``doc_id``, no id last. Null and empty texts hold no terms: such documents count in no statistic and such items give no
    rows. Rows of documents that are equal or share an id are documents of their own. Wholly equal items are one; items
    that share an id are ranked apart, so that ranks of this id repeat. Empty tables give an empty result; further columns
    are ignored. Frequencies come from all documents.

    Items of about a million terms in all are sought in one pass over the documents; more items take more passes. Each task
    returns ``k`` rows an item at most.
    """
    given = written(_tokenised(items.select("item_id", "text").distinct()))
    out = None
    for batch in batches_of(given, F.size("hashes"), BATCH):
        found = _search_batch(docs, batch, k)
        out = found if out is None else out.unionByName(found)
    return out
