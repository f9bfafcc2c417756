"""Queries on readers, sinks, the file catalogue, images and streams."""

from __future__ import annotations

import re
from uuid import uuid4

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import catalog, images
from ..session import scratch_dir
from ..sources import files, tables
from ..streaming import jobs
from .base import query, table
from .profiling import HOLED_EVENTS_SQL, holed_events


@query("scan_csv", "SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part")
def _(spark, sf):
    path = scratch_dir(spark)
    table(spark, sf, "part").withColumnRenamed("p_name", " p_name ").write.option("header", True).csv(path)
    return tables.scan_csv(spark, path)


@query("scan_csv_na", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS event_type FROM events")
def _(spark, sf):
    path = scratch_dir(spark)
    raw = table(spark, sf, "events").selectExpr("event_id", "CASE WHEN event_id % 6 = 0 THEN 'N/A' WHEN event_id % 3 = 0 THEN '' ELSE cast(value as string) END AS value",
                                                "CASE WHEN event_id % 8 = 0 THEN 'NULL' WHEN event_id % 4 = 0 THEN 'n/a' ELSE event_type END AS event_type")
    raw.write.option("header", True).csv(path)
    return tables.scan_csv(spark, path)


@query("scan_json_frame", "SELECT event_id, value, event_type FROM events")
def _(spark, sf):
    # one column-oriented text per hundred events
    entry = lambda c: F.map_from_entries(F.collect_list(F.struct(F.col("event_id").cast("string"), F.col(c).cast("string"))))
    texts = (table(spark, sf, "events").groupBy(F.expr("event_id div 100").alias("part")).agg(entry("value").alias("value"), entry("event_type").alias("event_type"))
             .select("part", F.to_json(F.struct("value", "event_type")).alias("text")))
    rows = tables.scan_json_frame(texts, "text")
    return rows.select(F.col("index").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"), "event_type")


@query("scan_json_flatten", "SELECT event_id AS id, (props->>'$.k')::BIGINT AS \"image.size.k\", value AS \"image.value\" FROM events")
def _(spark, sf):
    path = scratch_dir(spark)
    size = F.struct(F.from_json("props", "k long").alias("size"), "value")
    table(spark, sf, "events").select(F.col("event_id").alias("id"), size.alias("image")).write.json(path)
    return tables.scan_json_flatten(spark, path, multi_line=False).select("id", F.col("`image.size.k`"), F.col("`image.value`"))


@query("scan_files")
def _(spark, sf):
    return files.scan_files(spark, sf)


@query("scan_files_glob")
def _(spark, sf):
    return files.scan_files_glob(spark, sf, "*o*.parquet")


def text_images(spark, sf):
    """Images whose pixels are the bytes of the documents: 16 pixels wide, as high as the text needs."""
    data = F.encode("text", "UTF-8")
    height = F.greatest(F.ceil(F.octet_length("text") / F.lit(48)), F.lit(1)).cast("int")
    pad = F.expr("rpad(encode(text, 'UTF-8'), cast(greatest(ceil(octet_length(text) / 48.0), 1) * 48 as int), X'00')")
    return table(spark, sf, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".txt")).alias("origin"), height.alias("height"), F.lit(16).alias("width"),
                                                F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), pad.alias("data"))


@query("scan_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, sf):
    name = f"tw_nation_{uuid4().hex}"
    tables.sink_table_replace(table(spark, sf, "nation"), name, scratch_dir(spark))
    return tables.scan_table(spark, name)


@query("sink_table_replace", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0")
def _(spark, sf):
    name, o = f"tw_orders_{uuid4().hex}", table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    tables.sink_table_replace(o, name, scratch_dir(spark))
    tables.sink_table_replace(o.where("o_orderkey % 2 = 0"), name, scratch_dir(spark))
    return spark.table(name)


@query("sink_table_append", "SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0")
def _(spark, sf):
    name, o = f"tw_orders_{uuid4().hex}", table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    tables.sink_table_replace(o, name, scratch_dir(spark))
    tables.sink_table_append(o.where("o_orderkey % 2 = 0"), name)
    return spark.table(name)


@query("sink_csv", "SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::BIGINT AS \"index\", p_partkey, p_brand FROM part")
def _(spark, sf):
    path = tables.sink_csv(table(spark, sf, "part").select("p_partkey", "p_brand"), scratch_dir(spark), ["p_partkey"])
    return tables.scan_csv(spark, path)


@query("sink_json_records", HOLED_EVENTS_SQL)
def _(spark, sf):
    path = tables.sink_json_records(holed_events(spark, sf), scratch_dir(spark))
    return spark.read.schema("event_id long, user_id long, value double, event_type string").json(path)


@query("sink_images")
def _(spark, sf):
    return images.sink_images(text_images(spark, sf), scratch_dir(spark))


# ---- catalogue ----------------------------------------------------------------------

ROOT = "/data"
LISTING_SQL = ("(SELECT '/data/' || CASE page_id % 3 WHEN 0 THEN 'cctv_data/a/' WHEN 1 THEN 'sand_data/' ELSE '' END || CASE WHEN page_id % 7 = 0 THEN 'deep/er/still/more/and/more/' ELSE '' END"
               " || page_id || CASE page_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.csv' ELSE '' END AS full_path, length(html)::BIGINT AS file_size FROM pages)")


def listing(spark, sf):
    """A file listing derived from ``pages``: three top folders, some deep ones, five kinds of suffix."""
    path = F.expr("concat('/data/', CASE page_id % 3 WHEN 0 THEN 'cctv_data/a/' WHEN 1 THEN 'sand_data/' ELSE '' END, CASE WHEN page_id % 7 = 0 THEN 'deep/er/still/more/and/more/' ELSE '' END,"
                  " page_id, CASE page_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.csv' ELSE '' END)")
    return table(spark, sf, "pages").select(path.alias("full_path"), F.length("html").cast("long").alias("file_size"))


TYPE_SQL = "lower(regexp_extract(full_path, '[^/]([.][^./]+)$', 1))"


@query("file_catalog", f"SELECT full_path, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS file_id, regexp_extract(full_path, '([^/]*)/[^/]*$', 1) AS folder_name, file_size,"
       f" CASE WHEN file_size < 1024 THEN printf('%d B', file_size) ELSE printf('%.1f KB', file_size / 1024.0::DOUBLE) END AS file_size_readable, {TYPE_SQL} AS file_type,"
       f" CASE WHEN contains(full_path, 'cctv_data') THEN 'cctv_data' WHEN contains(full_path, 'sand_data') THEN 'sand_data' ELSE 'other' END AS data_category FROM (SELECT *, md5(full_path) AS h FROM {LISTING_SQL})")
def _(spark, sf):
    return catalog.file_catalog(listing(spark, sf))


@query("file_totals", f"SELECT count(*) AS files, sum(file_size)::BIGINT AS bytes, CASE WHEN sum(file_size) < 1048576 THEN printf('%.1f KB', sum(file_size) / 1024.0::DOUBLE) ELSE printf('%.1f MB', sum(file_size) / 1048576.0::DOUBLE) END AS total_size FROM {LISTING_SQL}")
def _(spark, sf):
    return catalog.file_totals(listing(spark, sf))


@query("file_type_counts", f"SELECT count(*) FILTER ({TYPE_SQL} = '.png') AS png, count(*) FILTER ({TYPE_SQL} IN ('.jpg', '.jpeg')) AS jpg, count(*) FILTER ({TYPE_SQL} NOT IN ('.png', '.jpg', '.jpeg')) AS other FROM {LISTING_SQL}")
def _(spark, sf):
    return catalog.file_type_counts(listing(spark, sf))


STEPS_SQL = f"(SELECT string_split(substr(full_path, 7), '/') AS s, file_size FROM {LISTING_SQL})"


@query("directory_summary", f"SELECT count(DISTINCT array_to_string(s[1:i], '/')) AS folders, (SELECT count(*) FROM pages)::INT AS files FROM (SELECT s, unnest(generate_series(1, len(s) - 1)) AS i FROM {STEPS_SQL})")
def _(spark, sf):
    return catalog.directory_summary(listing(spark, sf), ROOT)


@query("directory_rollup", f"WITH r AS (SELECT array_to_string(s[1:len(s) - 1], '/') AS folder, len(s) - 1 AS level, s[len(s)] AS name, file_size, s FROM {STEPS_SQL}),"
       " d AS (SELECT folder, count(*) AS files, sum(file_size)::BIGINT AS bytes, list(name ORDER BY name)[1:10] AS first_names FROM r GROUP BY 1),"
       " c AS (SELECT folder, count(*) AS child_folders FROM (SELECT DISTINCT array_to_string(s[1:i - 1], '/') AS folder, s[i] AS child FROM (SELECT s, unnest(generate_series(1, level)) AS i FROM r)) GROUP BY 1)"
       " SELECT folder, coalesce(files, 0) AS files, coalesce(bytes, 0) AS bytes, coalesce(child_folders, 0) AS child_folders, coalesce(first_names, []) AS first_names FROM d FULL JOIN c USING (folder)")
def _(spark, sf):
    return catalog.directory_rollup(listing(spark, sf), ROOT)


@query("folder_stats", f"SELECT count(*) AS total_files, count(*) FILTER ({TYPE_SQL} IN ('.png', '.jpg', '.jpeg')) AS image_files, round(sum(file_size) / 1048576.0::DOUBLE, 2) AS total_size_mb, list_sort(list(DISTINCT {TYPE_SQL}) FILTER ({TYPE_SQL} IN ('.png', '.jpg', '.jpeg'))) AS image_extensions FROM {LISTING_SQL}")
def _(spark, sf):
    return catalog.folder_stats(listing(spark, sf))


@query("catalog_build")
def _(spark, sf):
    return catalog.catalog_build(spark, sf, f"tw_meta_{uuid4().hex}", scratch_dir(spark))


# ---- streams ------------------------------------------------------------------------

@query("catalog_stream")
def _(spark, sf):
    out = scratch_dir(spark)
    jobs.catalog_stream(spark, sf, out, scratch_dir(spark), 5)
    return spark.read.parquet(out).drop("batch_id")


@query("progress_log")
def _(spark, sf):
    out = scratch_dir(spark)
    jobs.catalog_stream(spark, sf, out, scratch_dir(spark), 2)
    return jobs.progress_log(spark, out, files.scan_files(spark, sf).count())


@query("resample_stream", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, (date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP AS \"end\", round(avg(value), 6) AS value, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    schema, out = table(spark, sf, "events").schema, scratch_dir(spark)
    jobs.resample_stream(spark, sf, "events.parquet", schema, "ts", "value", out, scratch_dir(spark))
    return rounded(jobs.resampled(spark, out, "value").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}))


# ---- images -------------------------------------------------------------------------

def _image_query(name: str, run):
    @query(name)
    def _(spark, sf):
        return run(text_images(spark, sf)).select("origin", "height", "width", F.md5("data").alias("digest"))


_image_query("image_rotate", lambda df: images.image_rotate(df, 30))
_image_query("image_flip", images.image_flip)
_image_query("image_brightness", lambda df: images.image_brightness(df, 1.3))
_image_query("image_contrast", lambda df: images.image_contrast(df, 0.6))
_image_query("image_saturation", lambda df: images.image_saturation(df, 1.5))
_image_query("image_noise", lambda df: images.image_noise(df, 20))
_image_query("image_augment", lambda df: images.image_augment(df, rotation=15, flip=True, brightness=1.2, noise_intensity=5, contrast=0.9, hue=1.1))


@query("image_histogram")
def _(spark, sf):
    return images.image_histogram(text_images(spark, sf))


IMAGE_FOLDERS = 64


def write_bitmaps(spark, sf) -> str:
    """One uncompressed bitmap file per document, written by the tasks to the shared folder: the text's bytes as grey rows of 16 pixels.

    Files are dealt by name over sub-folders, which Spark lists side by side."""
    import struct
    from zlib import crc32
    path = scratch_dir(spark)
    uri = re.sub("^file:/+", "file:///", path)

    def write(batches):
        from pyarrow.fs import FileSystem
        store, base = FileSystem.from_uri(uri)      # local, HDFS or object store, as the shared folder is
        made = set()
        store.create_dir(base, recursive=True)
        for b in batches:
            for r in b.itertuples(index=False):
                rows = [r.data[i:i + 48] for i in range(0, len(r.data), 48)]
                body = b"".join(reversed(rows))
                head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(body), 0, 0, 54, 40, 16, len(rows), 1, 24, 0, len(body), 2835, 2835, 0, 0)
                name = r.origin.split("/")[-1].replace(".txt", ".bmp")
                folder = f"{base}/{crc32(name.encode()) % IMAGE_FOLDERS}"
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{folder}/{name}") as f:
                    f.write(head + body)
            yield b[["origin"]]
    text_images(spark, sf).mapInPandas(write, "origin string").count()
    return path


@query("scan_images", "SELECT doc_id || '.bmp' AS name, greatest(ceil(strlen(text) / 48.0), 1)::INT AS height, 16 AS width, 3 AS \"nChannels\" FROM documents")
def _(spark, sf):
    read = files.scan_images(spark, write_bitmaps(spark, sf))
    return read.select(F.regexp_extract("origin", "([^/]+)$", 1).alias("name"), "height", "width", "nChannels")


@query("image_resolutions", "SELECT 'docs/' || doc_id || '.txt' AS full_path, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 16 END AS width, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE greatest(ceil(strlen(text) / 48.0), 1)::INT END AS height FROM documents")
def _(spark, sf):
    all_files = text_images(spark, sf).select(F.col("origin").alias("full_path"))
    readable = text_images(spark, sf).where("NOT origin rlike '0[.]txt$'")
    return images.image_resolutions(all_files, readable)


@query("image_batch", "SELECT 'ok' AS status, count(*) AS n FROM documents")
def _(spark, sf):
    return images.image_batch(text_images(spark, sf), scratch_dir(spark), "PNG", brightness=1.1, contrast=0.9)
