"""Token counts kept up to date by signed deltas.

A ledger is a folder with one sub-folder per committed batch. A batch of events (insert, revise, delete) is turned into
signed rows: what a document counted before goes out with -1, what it counts now comes in with +1. Totals by source,
language and tokenizer version are sums of signed rows, so every batch adds its own small table of deltas to the totals
before it. A batch counts once, however often it is sent: a sub-folder is complete when Spark's success mark is there,
and a batch whose mark is there is not written again; one that broke off is written over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

KEY = ["doc_id", "version"]
BY = ["source", "lang", "version"]
ROWS = "doc_id long, version string, source string, lang string, tokens long, sign long"
SUMS = "source string, lang string, version string, documents long, tokens long"


class Ledger:
    """Signed token counts in ``folder`` (any file system Spark writes to)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, part: str, batch: str) -> str:
        return f"{self.folder}/{part}/{batch}"

    def _there(self, path: str) -> bool:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def batches(self) -> list[str]:
        """Committed batches, in the order of their names."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/rows")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(place):
            return []
        return sorted(s.getPath().getName() for s in files.listStatus(place) if self._there(s.getPath().toString()))

    def _read(self, part: str, schema: str) -> DataFrame:
        names = [b for b in self.batches() if part == "rows" or self._there(self._path(part, b))]
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._path(part, b) for b in names])

    def state(self) -> DataFrame:
        """What every document counts now, by tokenizer version: ``doc_id, version, source, lang, tokens``."""
        rows = self._read("rows", ROWS)
        return rows.groupBy(*KEY, "source", "lang", "tokens").agg(F.sum("sign").alias("n")).where("n > 0").drop("n")

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Apply ``events(doc_id, version, action, source, lang, tokens)`` as batch ``batch``; False if it was applied before.

        ``insert`` and ``revise`` both set what a document counts (a second insert revises); ``delete`` takes it out, and
        a delete of what is not there does nothing. Several events for one document and version in a batch: a delete
        wins over others, of others that with the most tokens, then the last source and language. Null source or
        language is a group of its own; null tokens count 0; events with a null id or version are ignored.
        """
        if not batch or "/" in batch or batch.startswith((".", "_")):
            raise ValueError(f"not a batch name: {batch!r}")
        path = self._path("rows", batch)
        if not self._there(path):
            order = F.struct((F.col("action") == "delete").alias("gone"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
            wanted = (events.where("doc_id is not null and version is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"), "version")
                      .agg(F.max(order).alias("new")))
            before = self.state().select(*KEY, F.struct("source", "lang", "tokens").alias("old"))
            met = wanted.join(before, KEY, "left")
            # old and new go out and in together unless nothing changed
            signed = met.select(*KEY, F.explode(F.filter(F.array(
                F.when(F.col("old").isNotNull(), F.struct(F.col("old.source").alias("source"), F.col("old.lang").alias("lang"), F.col("old.tokens").alias("tokens"), F.lit(-1).cast("long").alias("sign"))),
                F.when(~F.col("new.gone"), F.struct(F.col("new.source").alias("source"), F.col("new.lang").alias("lang"), F.col("new.tokens").alias("tokens"), F.lit(1).cast("long").alias("sign")))),
                lambda r: r.isNotNull())).alias("r")).select(*KEY, "r.*")
            signed.write.mode("overwrite").parquet(path)
            fresh = True
        else:
            fresh = False
        if not self._there(self._path("sums", batch)):  # also where a batch broke off between its two tables
            rows = self.spark.read.schema(ROWS).parquet(path)
            deltas = rows.groupBy(*BY).agg(F.sum("sign").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens")).where("documents <> 0 or tokens <> 0")
            deltas.write.mode("overwrite").parquet(self._path("sums", batch))
        return fresh

    def totals(self) -> DataFrame:
        """``source, lang, version, documents, tokens``: the sum of all batches' deltas; groups without documents are left out."""
        return self._read("sums", SUMS).groupBy(*BY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0")


def events(counts: DataFrame, version: str, action: str) -> DataFrame:
    """Events from ``counts(doc_id, source, lang, tokens)``; columns that are missing are null."""
    have = [F.col(c) if c in counts.columns else F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("lang", "string"), ("tokens", "long"))]
    return counts.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(version).alias("version"), F.lit(action).alias("action"), *have)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def corpus_totals(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """The life of a corpus as four batches, and the totals after them.

    Every document comes in with its number of words; then all are recounted with the tokenizer as a second version and
    their word counts are revised to count each run of punctuation as a word too; then copies of a text other than the
    one with the least id are deleted from both versions; and the recount is sent again, which changes nothing. An empty
    table gives no rows, a null text counts 0. Rows that share an id are one document: the one with the most tokens. Every
    row without an id is a document of its own, under a number that no id has.
    """
    from . import bpe
    from tablewright.session import written

    spark = docs.sparkSession
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    finer = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]+")).cast("long")
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("place"), "source", "lang", "text", F.md5(F.coalesce("text", F.lit(""))).alias("copy"), words.alias("words"), finer.alias("finer"))
    counted = written(bpe.count(rows, tokenizer))
    low, high = counted.agg(F.coalesce(F.min("doc_id"), F.lit(0)).cast("long"), F.coalesce(F.max("doc_id"), F.lit(0)).cast("long")).first()
    free = F.lit(high) + 1 + F.col("place") if high < 1 << 62 else F.lit(low) - 1 - F.col("place")
    counted = counted.withColumn("doc_id", F.when(F.col("doc_id").isNull(), free).otherwise(F.col("doc_id").cast("long")))
    ledger = Ledger(spark, folder)
    keep = ["doc_id", "source", "lang"]
    ledger.commit("1-load", events(counted.select(*keep, F.col("words").alias("tokens")), "words", "insert"))
    recount = union([events(counted.select(*keep, "tokens"), "byte_bpe_50k", "insert"), events(counted.select(*keep, F.col("finer").alias("tokens")), "words", "revise")])
    ledger.commit("2-recount", recount)
    first = counted.groupBy("copy").agg(F.min("doc_id").alias("first"))
    copies = counted.join(first, "copy").where("doc_id <> first").select("doc_id")
    ledger.commit("3-copies", union([events(copies, version, "delete") for version in ("words", "byte_bpe_50k")]))
    ledger.commit("2-recount", recount)
    return ledger.totals()
