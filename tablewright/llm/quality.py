"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Both sides are multinomials over hashed byte n-grams. The raw side counts every document; the target side counts a
bounded sample of documents labelled good. A document's score is its summed log ratio divided by its number of n-grams,
and one threshold, fitted on held-out labelled documents, decides every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import lowest
from .words import Slice, first_of_runs, mix, slices

BUCKETS = 1 << 16
SIZES = (3, 4)
#: Most labelled rows used to fit: half of them make the target counts, half the threshold.
LABELLED = 20_000
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def base_figures(part: Slice) -> dict[str, np.ndarray]:
    """Words, their code points, symbols, repeated lines and words in repeated 8-word windows of each row."""
    rows, n = part.rows, len(part.begin)
    n_words = np.bincount(part.row, minlength=rows)
    head = (part.buf & 0xC0) != 0x80
    figures = {"n_words": n_words, "word_chars": part.per_row(part.solid & head), "n_symbols": part.per_row(_SYMBOL[part.buf])}

    # lines: cut at every \n and at the ends of texts
    breaks = np.flatnonzero(part.buf == 10)
    begin = np.union1d(part.at[:-1], breaks + 1)
    begin = begin[begin < len(part.buf)]
    row = part.row_of(begin)
    end = np.empty_like(begin)
    if len(begin):
        end[:-1], end[-1] = begin[1:], len(part.buf)
        end = np.minimum(end, part.at[row + 1])
        cut = (end > begin) & (part.buf[end - 1] == 10)
        end = end - cut
    wordy = np.searchsorted(part.begin, end) > np.searchsorted(part.begin, begin)
    begin, end, row = begin[wordy], end[wordy], row[wordy]
    key = part.hashes(begin, end)
    order = np.lexsort((key, row))
    new = first_of_runs(row[order], key[order])
    figures["n_dup_lines"] = np.bincount(row, minlength=rows) - np.bincount(row[order][new], minlength=rows)

    first, key = part.windows(8)
    covered = np.zeros(n + 1, dtype=np.int64)
    if len(first):
        row = part.row[first]
        order = np.lexsort((key, row))
        new = first_of_runs(row[order], key[order])
        run = np.cumsum(new) - 1
        twice = np.bincount(run)[run] > 1
        hit = first[order][twice]
        np.add.at(covered, hit, 1)
        np.subtract.at(covered, hit + 8, 1)
    inside = np.cumsum(covered)[:n] > 0
    figures["n_repeat_words"] = np.bincount(part.row[inside], minlength=rows)
    return figures


def grams(part: Slice, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every hashed byte n-gram that lies in one text."""
    found_rows, found = [], []
    owner = np.repeat(np.arange(part.rows), np.diff(part.at))
    data = part.buf.astype(np.uint64)
    for size in SIZES:
        n = len(data) - size + 1
        if n <= 0:
            continue
        value = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            value = (value << np.uint64(8)) | data[k:k + n]
        same = owner[:n] == owner[size - 1:]
        found.append((mix(value, size)[same] & np.uint64(buckets - 1)).astype(np.int64))
        found_rows.append(owner[:n][same])
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(found_rows), np.concatenate(found)


def _scores(part: Slice, ratio: np.ndarray) -> np.ndarray:
    row, bucket = grams(part, len(ratio))
    total = np.bincount(row, weights=ratio[bucket], minlength=part.rows)
    return total / np.maximum(1, np.bincount(row, minlength=part.rows))


def corpus_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, raw, target)``: n-gram counts over every row, and over those with ``trusted`` true."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            trusted = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            for part in slices(batch.column(0)):
                row, bucket = grams(part, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[trusted[part.first:part.last][row]], minlength=buckets)
        seen = np.flatnonzero(raw)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])

    per_task = docs.select("text", "trusted").mapInArrow(count, "bucket long, raw long, target long")
    return per_task.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def labelled_sample(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """At most ``most`` labelled ids with their half of the sample; an id with several labels is good only if all are."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    draw = F.xxhash64(F.col("doc_id"), F.lit("quality"))
    return lowest(one.select("doc_id", "quality", draw.alias("draw")), F.col("draw"), labels.count(), most).select("doc_id", "quality", (F.pmod("draw", F.lit(2)) == 0).alias("fits"))


def best_threshold(scores: np.ndarray, good: np.ndarray, cost: float = 5.0) -> float:
    """The cut with least ``cost`` * lost good + kept bad; of equal cuts the lowest. No bad rows: nothing is cut."""
    if good.all() or not len(scores):
        return float("-inf")
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)]) * cost                   # cutting below position i loses these
    kept_bad = (~g).sum() - np.concatenate([[0], np.cumsum(~g)])
    loss = (lost + kept_bad).astype(float)
    loss[1:-1][s[1:] == s[:-1]] = np.inf                                # a cut never parts equal scores
    i = int(np.argmin(loss))
    if i == 0:
        return float("-inf")
    return float(s[i - 1] + s[i]) / 2 if i < len(s) else float(np.nextafter(s[-1], np.inf))


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED, buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    """Log ratios of all buckets and the threshold.

    The sample of labels (``most`` rows at most) goes to the driver and from there to the tasks; the corpus is counted
    where it lies, and ``buckets`` sums come back. Without any good label every ratio is 0 and nothing is cut.
    """
    spark = docs.sparkSession
    sample = labelled_sample(labels, most).collect()
    rows = spark.createDataFrame([(r.doc_id, int(r.quality), r.fits) for r in sample], "doc_id long, quality int, fits boolean")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id", "left")
    counts = corpus_counts(keyed.select("text", (F.col("fits") & (F.col("quality") == 1)).alias("trusted")), buckets).collect()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if target.sum() == 0:
        return np.zeros(buckets), float("-inf")
    ratio = np.log((target + 0.5) / (target.sum() + 0.5 * buckets)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * buckets))
    held = keyed.where("not fits").select("quality", "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_scores(part, ratio) for part in slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.empty(0), *got]))], names=["quality", "score"])

    # equal texts have equal scores and count once, so at most one row per sampled label comes back
    scored = held.mapInArrow(score, "quality int, score double").distinct().collect()
    scores = np.array([r.score for r in scored])
    good = np.array([r.quality == 1 for r in scored], dtype=bool)
    return ratio, best_threshold(scores, good)


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, labels: DataFrame, most: int = LABELLED, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: base figures, ``score``, ``base_failed`` and ``kept``.

    Null text counts as no text (0 words, fails the base rule). Repeated rows and null ids are judged like any other
    row; an empty table gives no rows; further columns are ignored. Without labels only the base rule decides.
    """
    ratio, cut = fit(docs, labels, most, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                got = base_figures(part)
                score = _scores(part, ratio)
                failed = (got["n_words"] < 20) | (100 * got["n_repeat_words"] > 30 * got["n_words"])
                columns = [batch.column(0).slice(part.first, part.rows), *(pa.array(got[k].astype(np.int64)) for k in FIGURES), pa.array(score), pa.array(failed), pa.array(~failed & (score >= cut))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *FIGURES, "score", "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in FIGURES) + ", score double, base_failed boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, most: int = LABELLED, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that :func:`judge` keeps; the verdict is taken where the row lies."""
    ratio, cut = fit(docs, labels, most, buckets)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for part in slices(batch.column(place)):
                got = base_figures(part)
                failed = (got["n_words"] < 20) | (100 * got["n_repeat_words"] > 30 * got["n_words"])
                keep[part.first:part.last] = ~failed & (_scores(part, ratio) >= cut)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
