"""Scalar expressions on sizes, paths and labels, and the same as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

# File-size classes in MB with their log level.
SIZE_CLASSES = [("small", 0, 10, "info"), ("medium", 10, 50, "warning"), ("large", 50, 100, "warning"),
                ("very_large", 100, None, "error")]
# Path words that name a data category.
CATEGORIES = ["cctv_data", "sand_data"]
# Supported and image suffixes.
SUPPORTED = [".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".gif", ".csv", ".txt", ".json", ".xml", ".zip"]
IMAGES = [".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif"]
# Processing limits.
LIMITS = {"file_count_limit": 10000, "memory_limit_mb": 2048}

KB, MB, GB, TB = 1024, 1024 ** 2, 1024 ** 3, 1024 ** 4


def human_size(size: Column) -> Column:
    """Bytes with one decimal (exact halves to even), B to TB."""
    def shown(unit, name):
        return F.format_string(f"%.1f {name}", F.bround(size.cast("double") / F.lit(float(unit)), 1))
    return (F.when(size < KB, shown(1, "B")).when(size < MB, shown(KB, "KB")).when(size < GB, shown(MB, "MB"))
            .when(size < TB, shown(GB, "GB")).otherwise(shown(TB, "TB")))


def human_size_whole(size: Column) -> Column:
    """As ``human_size`` but whole bytes below 1 KB and nothing above GB."""
    def shown(unit, name):
        return F.format_string(f"%.1f {name}", F.bround(size.cast("double") / F.lit(float(unit)), 1))
    return (F.when(size < KB, F.format_string("%d B", size.cast("long"))).when(size < MB, shown(KB, "KB"))
            .when(size < GB, shown(MB, "MB")).otherwise(shown(GB, "GB")))


def path_parts(path: Column) -> dict[str, Column]:
    """Parent folder name, file name, stem and lower-case suffix (with its dot)."""
    clean = F.regexp_replace(path, "/+$", "")
    name = F.regexp_extract(clean, "([^/]*)$", 1)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return {"folder_name": F.regexp_extract(clean, "([^/]*)/[^/]*$", 1), "file_name": name,
            "stem": F.left(name, F.length(name) - F.length(suffix)), "file_type": F.lower(suffix)}


def data_category(path: Column, words: list[str] = CATEGORIES) -> Column:
    """First listed word found in the path, else ``other``."""
    found = F.lit("other")
    for word in reversed(words):
        found = F.when(F.contains(path, F.lit(word)), F.lit(word)).otherwise(found)
    return found


def file_uuid(path: Column, random: bool = False) -> Column:
    """UUID-shaped id from the path digest, the same on every run; ``random=True`` gives new ones."""
    if random:
        return F.uuid()
    return F.regexp_replace(F.md5(path), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def size_range(mb: Column) -> Column:
    """Class name and level of a size in MB."""
    out = F.lit(None).cast("struct<range_name:string,level:string>")
    for name, low, high, level in reversed(SIZE_CLASSES):
        test = mb >= low if high is None else (mb >= low) & (mb < high)
        out = F.when(test, F.struct(F.lit(name).alias("range_name"), F.lit(level).alias("level"))).otherwise(out)
    return out


def processed_name(name: Column, save_format: str) -> Column:
    """``stem_processed`` with the suffix of the format (PNG, JPEG) or the original one."""
    parts = path_parts(name)
    own = F.regexp_extract(parts["file_name"], r"^.+(\.[^.]+)$", 1)
    suffix = {"png": F.lit(".png"), "jpeg": F.lit(".jpg")}.get(save_format.lower(), own)
    return F.concat(parts["stem"], F.lit("_processed"), suffix)


def label_text(value: Column) -> Column:
    """Whole numbers without decimals, all else as is."""
    number = value.try_cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) < 9e15)
    return F.when(whole, number.cast("long").cast("string")).otherwise(value.cast("string"))


def ratio_change(before: Column, after: Column) -> tuple[Column, Column]:
    """Change and percent change, null where the base is zero."""
    change = after - before
    return change, F.try_divide(change.cast("double"), before) * 100


def register_functions(spark: SparkSession) -> None:
    """Size, path and label helpers as temporary SQL functions (plain SQL bodies, so they are optimised like any expression)."""
    bodies = {
        "tw_human_size(size BIGINT)": ("STRING",
            "CASE WHEN size < 1024 THEN format_string('%.1f B', double(size))"
            " WHEN size < 1048576 THEN format_string('%.1f KB', bround(size / 1024.0D, 1))"
            " WHEN size < 1073741824 THEN format_string('%.1f MB', bround(size / 1048576.0D, 1))"
            " WHEN size < 1099511627776 THEN format_string('%.1f GB', bround(size / 1073741824.0D, 1))"
            " ELSE format_string('%.1f TB', bround(size / 1099511627776.0D, 1)) END"),
        "tw_suffix(path STRING)": ("STRING", r"lower(regexp_extract(path, r'^(?:.*/)?[^/]+(\.[^./]+)$', 1))"),
        "tw_folder(path STRING)": ("STRING", r"regexp_extract(path, r'([^/]*)/[^/]*$', 1)"),
        "tw_category(path STRING)": ("STRING",
            "CASE WHEN contains(path, 'cctv_data') THEN 'cctv_data' WHEN contains(path, 'sand_data') THEN 'sand_data' ELSE 'other' END"),
        "tw_label(value STRING)": ("STRING",
            "CASE WHEN try_cast(value AS DOUBLE) = floor(try_cast(value AS DOUBLE)) THEN cast(cast(try_cast(value AS DOUBLE) AS BIGINT) AS STRING) ELSE value END"),
    }
    for head, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
