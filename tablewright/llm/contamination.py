"""Benchmark decontamination as a prefix-filtered join of shingle sets.

An item's windows are the records of the join, their shingles (runs of three words) the tokens. Shingles are ordered by
how often all documents hold them. A window must occur whole, so one token is a sufficient prefix: its rarest shingle.
Documents meet windows by that token only; the place of the shingle in the window says where the window would begin, so
candidates that stick out of the document fall at once; the rest are compared shingle by shingle, rarest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.session import written

from .ball_tree import _spread as spread
from .terms import Terms, batches_of, heads, term_set, term_slices

WINDOW = 10
SHINGLE = 3
BATCH = 1 << 20            # words of the items that are sought in one pass over the documents
SPANS = "array<struct<begin:int,end:int>>"


def _tokenised(items: DataFrame) -> DataFrame:
    """(item_id, hashes, firsts): the words of each item in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in term_slices(batch.column("text")):
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(part.row, minlength=part.rows))]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v.view(np.int64))) for v in (part.word_hashes(), heads(part))]
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(part.first, part.rows), *lists], ["item_id", "hashes", "firsts"])

    return items.select("item_id", "text").mapInArrow(run, "item_id string, hashes array<long>, firsts array<long>")


class Windows:
    """Distinct windows of a batch of items: their shingles, and the items that hold each."""

    def __init__(self, items: list[tuple[str, np.ndarray, np.ndarray]], size: int):
        sizes = np.array([len(h) for _, h, _ in items], dtype=np.int64)
        flat = lambda i: np.concatenate([np.empty(0, dtype=np.uint64), *[item[i] for item in items]])
        self.terms, word = term_set(flat(1), flat(2))
        # shingles are numbers made of word numbers, so that equal numbers mean equal words
        self.width = max(1, len(self.terms))
        self.run = SHINGLE if self.width ** SHINGLE < 1 << 63 else 2
        self.ids = sorted({i for i, _, _ in items})
        names = {v: n for n, v in enumerate(self.ids)}
        owner = np.array([names[i] for i, _, _ in items], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        #: per window length: (shingle words, windows x shingles, CSR of items)
        self.kinds: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        for length in sorted({min(size, int(s)) for s in sizes if s}):
            mine = np.flatnonzero(np.minimum(size, sizes) == length)
            count = sizes[mine] - length + 1
            begin = spread(first[mine], count)
            words = word[begin[:, None] + np.arange(length)]
            distinct, which = np.unique(words, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.repeat(owner[mine], count)], axis=1), axis=0)
            run = min(self.run, length)
            keys = np.zeros((len(distinct), length - run + 1), dtype=np.int64)
            for j in range(run):
                keys = keys * self.width + distinct[:, j:j + length - run + 1]
            self.kinds.append((length, run, keys, np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1]))
        #: shingles by length of their own, sorted, numbered through
        self.shingles = {run: np.unique(np.concatenate([k.ravel() for _, r, k, _, _ in self.kinds if r == run])) for run in sorted({r for _, r, _, _, _ in self.kinds})}
        self.offset = dict(zip(self.shingles, np.cumsum([0, *map(len, self.shingles.values())]).tolist()))

    def found_in(self, part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, shingle) of every shingle of a slice of texts that some window holds; places count words in the row."""
        at = self.terms.find(part.word_hashes(), heads(part))
        place = np.arange(len(at)) - np.searchsorted(part.row, part.row)
        out = []
        for run, table in self.shingles.items():
            n = len(at) - run + 1
            if n <= 0:
                continue
            key, fine = np.zeros(n, dtype=np.int64), part.row[:n] == part.row[run - 1:]
            for j in range(run):
                fine &= at[j:j + n] >= 0
            here = np.flatnonzero(fine)
            key = np.zeros(len(here), dtype=np.int64)
            for j in range(run):
                key = key * self.width + at[here + j]
            spot = np.minimum(np.searchsorted(table, key), len(table) - 1)
            same = table[spot] == key
            out.append((part.row[here[same]], place[here[same]], spot[same] + self.offset[run]))
        row, place, shingle = (np.concatenate([np.empty(0, dtype=np.int64), *[o[i] for o in out]]) for i in range(3))
        order = np.lexsort((shingle, place, row))
        return row[order], place[order], shingle[order]


class Join:
    """Windows filed under their prefix token, given how often documents hold each shingle."""

    def __init__(self, windows: Windows, counts: np.ndarray):
        self.kinds = []
        for length, run, keys, item_at, items in windows.kinds:
            number = np.searchsorted(windows.shingles[run], keys) + windows.offset[run]
            by_rarity = np.argsort(counts[number], axis=1, kind="stable")       # places of the shingles, rarest first
            prefix = np.take_along_axis(number, by_rarity[:, :1], axis=1).ravel()
            order = np.argsort(prefix, kind="stable")
            self.kinds.append((length, number, by_rarity, order, prefix[order], item_at, items))

    def matches(self, n_words: np.ndarray, row: np.ndarray, place: np.ndarray, shingle: np.ndarray) -> Iterator[tuple]:
        """Per kind of window (length, row, begin, window, items' CSR) of all occurrences; shingles come by row and place."""
        if not len(row):
            return
        wide = int(place.max()) + WINDOW + 2
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length, number, by_rarity, order, prefix, item_at, items in self.kinds:
            low, high = np.searchsorted(prefix, shingle), np.searchsorted(prefix, shingle, side="right")
            hit = np.flatnonzero(high > low)
            here, window = np.repeat(hit, high[hit] - low[hit]), order[spread(low[hit], (high - low)[hit])]
            begin = place[here] - by_rarity[window, 0]
            inside = (begin >= 0) & (begin + length <= n_words[row[here]])       # positional and length bounds
            r, begin, window = row[here][inside], begin[inside], window[inside]
            span = number.shape[1]
            if span not in known:                     # places of shingles of this window's kind only
                kind = np.flatnonzero((shingle >= number.min()) & (shingle <= number.max()))
                known[span] = row[kind] * wide + place[kind], shingle[kind]
            spots, tokens = known[span]
            for j in range(1, span):
                offset = by_rarity[window, j]
                want = r * wide + begin + offset
                at = np.minimum(np.searchsorted(spots, want), len(spots) - 1)
                same = (spots[at] == want) & (tokens[at] == number[window, offset])
                r, begin, window = r[same], begin[same], window[same]
            yield length, r, begin, window, item_at, items


def _merged(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching ranges, per row."""
    if not len(row):
        return row, begin, end
    order = np.lexsort((end, begin, row))
    row, begin, end = row[order], begin[order], end[order]
    wide = int(end.max()) + 2
    reach = np.maximum.accumulate(row * wide + end)
    new = np.ones(len(row), dtype=bool)
    new[1:] = row[1:] * wide + begin[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return row[first], begin[first], reach[np.concatenate([first[1:], [len(row)]]) - 1] - row[first] * wide


def _lists(row: np.ndarray, values: pa.Array, rows: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]), pa.int32()), values)


def _pass(docs: DataFrame, items: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """(keep, n_words, spans, items) of every document, for one batch of items."""
    rows = items.where(F.size("hashes") > 0).collect()             # about BATCH words at most
    windows = Windows([(r["item_id"], *(np.array(r[c], dtype=np.int64).view(np.uint64) for c in ("hashes", "firsts"))) for r in rows], size)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in term_slices(batch.column("text")):
                row, place, shingle = windows.found_in(part)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(part.first, part.rows) for c in keep], pa.array(np.bincount(part.row, minlength=part.rows), pa.int64()),
                     _lists(row, pa.array(place, pa.int32()), part.rows), _lists(row, pa.array(shingle, pa.int32()), part.rows)], [*keep, "n_words", "places", "shingles"])

    held = written(docs.select(*keep, "text").mapInArrow(tokens, f"{kept}, n_words long, places array<int>, shingles array<int>"))
    counts = np.zeros(sum(map(len, windows.shingles.values())), dtype=np.int64)
    for shingle, count in held.select(F.explode("shingles").alias("s")).groupBy("s").count().collect():        # one row a sought shingle
        counts[shingle] = count
    join, ids = Join(windows, counts), pa.array(windows.ids, pa.string())

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            rows, n_words = batch.num_rows, batch.column("n_words").to_numpy()
            row = np.repeat(np.arange(rows), np.diff(lists.offsets.to_numpy()))
            hits, owners = [], []
            for length, r, begin, window, item_at, items_of in join.matches(n_words, row, batch.column("places").flatten().to_numpy(), lists.flatten().to_numpy()):
                hits.append((r, begin, begin + length))
                pairs = np.unique(np.stack([r, window], axis=1), axis=0)
                sizes = item_at[pairs[:, 1] + 1] - item_at[pairs[:, 1]]
                owners.append(np.stack([np.repeat(pairs[:, 0], sizes), items_of[spread(item_at[pairs[:, 1]], sizes)]], axis=1))
            r, begin, end = _merged(*(np.concatenate([np.empty(0, dtype=np.int64), *[h[i] for h in hits]]) for i in range(3)))
            own = np.unique(np.concatenate([np.empty((0, 2), dtype=np.int64), *owners]), axis=0)
            ranges = pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32())], ["begin", "end"])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], batch.column("n_words"), _lists(r, ranges, rows), _lists(own[:, 0], ids.take(pa.array(own[:, 1])), rows)],
                                             [*keep, "n_words", "spans", "items"])

    return held.mapInArrow(verified, f"{kept}, n_words long, spans {SPANS}, items array<string>")


def _union(spans):
    """Ranges of several passes as one sorted list without overlaps."""
    start = F.array().cast(SPANS)
    last = lambda acc: F.element_at(acc, -1)
    widened = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["begin"].alias("begin"), F.greatest(last(acc)["end"], x["end"]).alias("end"))))
    return F.aggregate(F.array_sort(spans), start, lambda acc, x: F.when((F.size(acc) > 0) & (x["begin"] <= F.try_element_at(acc, F.lit(-1))["end"]), widened(acc, x)).otherwise(F.concat(acc, F.array(x))))


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document (``doc_id, text``): ``doc_id, n_words, spans, items`` for the benchmark ``items`` (``item_id, text``).

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A to Z lower-cased. A window is ``window``
    consecutive words of an item, or all words of a shorter one. ``spans`` are the word ranges (begin included, end not)
    of the document that some window's occurrence covers, disjoint and in order; ``items`` are the sorted ids, as strings, of items with
    an occurring window. Null and empty texts hold no words and no windows. Documents may repeat, each row is judged on
    its own; items that share an id are one item with the windows of both; an item without id marks spans under the empty name.
    Empty tables: no documents give no rows, no items no spans. Further columns are ignored.

    Items of about a million words in all are sought in one pass over the documents; more take further passes, united by row.
    """
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct()
    batches = list(batches_of(written(_tokenised(named)), F.size("hashes"), BATCH))
    if len(batches) == 1:
        return _pass(docs, batches[0], window, ["doc_id"])
    docs = written(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")))
    every = None
    for batch in batches:
        found = _pass(docs, batch, window, ["row", "doc_id"])
        every = found if every is None else every.unionByName(found)
    # one row for each pass and document
    both = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
                                    F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return both.select("doc_id", "n_words", _union(F.col("spans")).alias("spans"), "items")


def digests(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` (and ``spans``) of what ``find`` returns."""
    found = find(docs, items, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
