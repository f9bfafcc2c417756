"""File listings and images. Listings never read file contents."""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import chain, islice

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.util import inheritable_thread_target

from ..session import like, scratch_dir

IMAGE_FIELDS = "origin string, height int, width int, nChannels int, mode int, data binary"
BATCH = 50_000      # images whose names and sizes the driver holds at a time


def scan_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(full_path, file_size) of all files below ``root``; ``pattern`` is a glob on file names."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return listed(reader.load(root))


def scan_files_glob(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return scan_files(spark, root, pattern)


def listed(df: DataFrame) -> DataFrame:
    return df.select(F.regexp_replace("path", "^file:/*", "/").alias("full_path"), F.col("length").alias("file_size"))


def _skipped(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return (name.startswith(("_", ".")) and not (name.startswith("_") and "=" in name) or name.endswith("._COPYING_")) and not name.startswith(("_metadata", "_common_metadata"))


def _local_files(folder: str) -> Iterator[str]:
    with os.scandir(folder) as entries:
        for entry in entries:
            if not _skipped(entry.name):
                if entry.is_dir():
                    yield from _local_files(entry.path)
                elif entry.is_file():
                    yield f"file:{entry.path}"


def _stored_files(store, folder) -> Iterator[str]:
    entries = store.listStatusIterator(folder)
    while entries.hasNext():
        entry = entries.next()
        path = entry.getPath()
        if not _skipped(path.getName()):
            if entry.isDirectory():
                yield from _stored_files(store, path)
            else:
                yield path.toString()


def file_batches(spark: SparkSession, root: str, most: int) -> Iterator[list[str]]:
    """The files below ``root`` by at most ``most``, as Spark's readers name them, if there are more than that; else nothing.

    Folders are walked as they are read; no list of all files is held. Patterns are left to the reader."""
    if re.search(r"[{}\[\]*?\\]", root):
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    path = store.makeQualified(path)
    uri = path.toUri()
    if uri.getScheme() == "file":
        names = _local_files(uri.getPath()) if os.path.isdir(uri.getPath()) else iter(())
    else:               # a call for every file: only where the store has counted more than fit
        many = store.exists(path) and store.getContentSummary(path).getFileCount() > most
        names = _stored_files(store, path) if many else iter(())
    first = list(islice(names, most + 1))
    if len(first) > most:
        names = chain(first, names)
        del first
        while batch := list(islice(names, most)):
            yield batch


def scan_images(spark: SparkSession, root: str, drop_invalid: bool = True) -> DataFrame:
    """Decoded images as columns (bytes in blue, green, red order); unreadable files are left out, or kept with sizes of -1.

    Every file is decoded once, here, into a written table. Spark's reader makes a new encoder for each file: in a session
    where encoders are not compiled this costs a fraction, and small files share a task by the hundred. It also lists all its
    files in the driver before it reads one: more than ``BATCH`` files are handed to it in batches, appended to the table."""
    quick = like(spark, {"spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.files.openCostInBytes": "64k",
                         "spark.sql.hive.manageFilesourcePartitions": "false",             # keeps no lists
                         "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64"})
    reader = quick.read.format("image").option("dropInvalid", drop_invalid).option("recursiveFileLookup", True)
    path, schema, ahead = scratch_dir(spark), None, None

    def listed_one_by_one(batch: list[str]) -> DataFrame:
        # one call for all names, which are no patterns; a zero byte is in none
        names = spark._jvm.org.apache.hadoop.util.StringUtils.getStrings("\0".join(batch), "\0")
        return DataFrame(reader.option("__globPaths__", "false")._jreader.load(names), quick).select("image.*")

    with ThreadPoolExecutor(1) as pool:             # a batch is listed while the one before it is read
        for batch in chain(file_batches(spark, root, BATCH), [None]):
            df, ahead = ahead and ahead.result(), batch and pool.submit(inheritable_thread_target(spark)(listed_one_by_one), batch)
            if df:
                df.write.mode("append").option("compression", "zstd").parquet(path)
                schema = df.schema
                df = None
                gc.collect()                        # the driver's JVM keeps a batch's list while Python holds its table
    if schema is None:
        df = reader.load(root).select("image.*")
        df.write.option("compression", "zstd").parquet(path)
        schema = df.schema
    return spark.read.schema(schema).parquet(path)
