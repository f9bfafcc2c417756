"""Structured Streaming jobs: the growing file catalogue and a resampled event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.catalog import file_catalog
from ..sources.files import listed

# what the binary-file stream delivers; contents are never read
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def catalog_stream(spark: SparkSession, root: str, out: str, checkpoint: str, batch_size: int = 1000, pattern: str | None = None):
    """Describe files below ``root`` as they appear, ``batch_size`` per step, appending to ``out``.

    Runs until all present files are done and stops; started again with the same checkpoint it
    takes only new files. Each step is written under its own batch id, so a repeated step replaces itself."""
    reader = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True)
              .option("maxFilesPerTrigger", batch_size if batch_size > 0 else 1000))
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = file_catalog(listed(reader.load(root)))

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch_id={batch_id}")

    query = rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def progress_log(spark: SparkSession, out: str, total: int, step: int = 10) -> DataFrame:
    """One row each time another ``step`` percent of ``total`` files is done, from what the catalogue stream wrote to ``out``.

    Counts come from the written steps (one small row per step), so every step of a long run counts, also after a restart."""
    written = spark.read.option("basePath", out).parquet(out).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).orderBy("batch_id").collect()
    rows, done, mark = [], 0, 0
    for r in written:
        done += r["n"]
        percent = 100.0 * done / total if total else 100.0
        if percent >= mark + step or percent >= 99.9:
            rows.append((int(r["batch_id"]), done, percent))
            mark = int(percent)
    return spark.createDataFrame(rows, "batch_id long, files long, percent double")


def resample_stream(spark: SparkSession, folder: str, pattern: str, schema: StructType, date: str, value: str, out: str, checkpoint: str, window: str = "1 day"):
    """Sums and counts per time window of a file stream, one partial row per window and step, under the step's id.

    Nothing waits for a watermark and nothing is late: a window's mean is the sum of its partial rows (``resampled``), and
    a repeated step replaces its own rows. Rows without a time are left out."""
    events = (spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", pattern).load(folder)
              .select(F.col(date).cast("timestamp").alias("_t"), F.col(value).cast("double").alias("_v")).where("_t is not null"))

    def store(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy(F.window("_t", window).alias("w")).agg(F.sum("_v").alias("total"), F.count("_v").alias("known"), F.count(F.lit(1)).alias("n"))
        sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total", "known", "n").write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch_id={batch_id}")

    query = events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def resampled(spark: SparkSession, out: str, value: str) -> DataFrame:
    """``start, end, <value>, n``: the mean and number of rows of every window written so far."""
    parts = spark.read.schema("start timestamp, end timestamp, total double, known long, n long").option("basePath", out).parquet(out)
    return parts.groupBy("start", "end").agg(F.try_divide(F.sum("total"), F.sum("known")).alias(value), F.sum("n").alias("n"))
