"""File catalogue: metadata columns and summaries over a listing (full_path, file_size)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import CATEGORIES, IMAGES, data_category, file_uuid, human_size, human_size_whole, path_parts
from ..sources.files import scan_files
from ..sources.tables import sink_table_append, sink_table_replace

TABLE = "TB_meta_info"


def file_catalog(files: DataFrame, categories: list[str] = CATEGORIES, random_ids: bool = False) -> DataFrame:
    """full_path, file_id, folder_name, file_size, readable size, type and category; a narrow projection."""
    path = F.col("full_path")
    parts = path_parts(path)
    return files.select("full_path", file_uuid(path, random_ids).alias("file_id"), parts["folder_name"].alias("folder_name"), "file_size",
                        human_size_whole(F.col("file_size")).alias("file_size_readable"), parts["file_type"].alias("file_type"),
                        data_category(path, categories).alias("data_category"))


def catalog_build(spark: SparkSession, root: str, table: str = TABLE, path: str | None = None, append: bool = False) -> DataFrame:
    """List, describe and store all files below ``root`` in one job; returns the totals."""
    files = scan_files(spark, root)
    if files.isEmpty():
        raise ValueError(f"no files below {root}")
    rows = file_catalog(files)
    if append:
        sink_table_append(rows, table)
    else:
        sink_table_replace(rows, table, path)
    return file_totals(spark.table(table))


def file_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes")).withColumn(
        "total_size", human_size(F.col("bytes")))


def file_type_counts(files: DataFrame) -> DataFrame:
    suffix = path_parts(F.col("full_path"))["file_type"]
    return files.agg(F.count_if(suffix == ".png").alias("png"), F.count_if(suffix.isin(".jpg", ".jpeg")).alias("jpg"),
                     F.count_if(~suffix.isin(".png", ".jpg", ".jpeg")).alias("other"))


def _parent(path):
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def directory_summary(files: DataFrame, root: str) -> DataFrame:
    """Folders below the root that hold files somewhere, and files."""
    rest = F.substr(F.col("full_path"), F.lit(len(root.rstrip("/")) + 2))
    steps = F.split(rest, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    folders = files.where(F.size(steps) > 1).select(F.explode(prefixes).alias("folder")).distinct().agg(F.count(F.lit(1)).alias("folders"))
    return folders.withColumn("files", F.lit(files.count()))


def directory_rollup(files: DataFrame, root: str, depth: int | None = None, names: int = 10) -> DataFrame:
    """Per folder (down to ``depth`` if given): files and bytes directly in it, child folders, the first ``names`` file names.

    Names are ranked and cut before the shuffle, so a folder of a billion files costs its first ten."""
    base = root.rstrip("/")
    rest = F.substr(F.col("full_path"), F.lit(len(base) + 2))
    steps = F.split(rest, "/")
    rows = files.select("file_size", steps.alias("s")).select("file_size", "s", (F.size("s") - 1).alias("level"), F.element_at("s", -1).alias("name"),
                                                              F.array_join(F.slice("s", 1, F.size("s") - 1), "/").alias("folder"))
    direct = rows if depth is None else rows.where(F.col("level") <= depth)
    sums = direct.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"))
    order = Window.partitionBy("folder").orderBy("name")
    first = (direct.select("folder", "name").withColumn("r", F.row_number().over(order)).where(F.col("r") <= names)
             .groupBy("folder").agg(F.sort_array(F.collect_list("name")).alias("first_names")))
    levels = F.sequence(F.lit(1), F.col("level") if depth is None else F.least(F.col("level"), F.lit(depth + 1)))
    links = rows.where(F.col("level") > 0).select(F.explode(F.transform(levels, lambda i: F.struct(
        F.array_join(F.slice("s", 1, i - 1), "/").alias("folder"), F.get("s", i - 1).alias("child")))).alias("e")).select("e.*").distinct()
    children = links.groupBy("folder").agg(F.count(F.lit(1)).alias("child_folders"))
    return (sums.join(children, "folder", "full_outer").join(first, "folder", "left")
            .select("folder", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"),
                    F.coalesce("child_folders", F.lit(0)).alias("child_folders"), F.coalesce("first_names", F.array().cast("array<string>")).alias("first_names")))


def folder_stats(files: DataFrame) -> DataFrame:
    """Files, images, MB to two places and image suffixes."""
    suffix = path_parts(F.col("full_path"))["file_type"]
    image = suffix.isin(IMAGES)
    return files.agg(F.count(F.lit(1)).alias("total_files"), F.count_if(image).alias("image_files"),
                     F.round(F.sum("file_size") / F.lit(1048576.0), 2).alias("total_size_mb"),
                     F.sort_array(F.collect_set(F.when(image, suffix))).alias("image_extensions"))   # a handful of suffixes
