"""Images read from many small files."""

import os
import struct
import zlib

from tablewright.queries import QUERIES
from tablewright.queries.filing import IMAGE_FOLDERS, write_bitmaps
from tablewright.sources import files

CODEGEN, OPEN_COST = "spark.sql.codegen.factoryMode", "spark.sql.files.openCostInBytes"


def bitmap(pixels: list[bytes]) -> bytes:
    rows = [p * 4 for p in pixels]
    body = b"".join(reversed(rows))
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(body), 0, 0, 54, 40, 4, len(rows), 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def png(red: int, green: int, blue: int) -> bytes:
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return (b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0))
            + part(b"IDAT", zlib.compress(bytes([0, red, green, blue]))) + part(b"IEND", b""))


def test_small_files_share_tasks_and_rows_stay(spark, tmp_path):
    """400 small files were 13 partitions with an encoder compiled for every file."""
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for i in range(400):
        (tmp_path / ("deep/er" if i % 2 else "deep") / f"{i}.bmp").write_bytes(bitmap([bytes([i % 256, 1, 2])] * (1 + i % 3)))
    (tmp_path / "one.png").write_bytes(png(10, 20, 30))
    (tmp_path / "none.jpg").write_bytes(b"no image")
    before = spark.conf.getAll
    for drop in (True, False):
        plain = spark.read.format("image").option("dropInvalid", drop).option("recursiveFileLookup", True).load(str(tmp_path)).select("image.*")
        found = files.scan_images(spark, str(tmp_path), drop)
        assert found.schema == plain.schema and sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
        assert found.count() == (401 if drop else 402) and found.rdd.getNumPartitions() <= 4 < plain.rdd.getNumPartitions()
        assert found.sparkSession is spark
    one = found.where("origin LIKE '%one.png'").first()
    assert bytes(one["data"]) == bytes([30, 20, 10])
    assert spark.conf.getAll == before


def test_files_are_read_with_the_settings_of_the_session(spark, tmp_path, monkeypatch):
    """Encoders are not compiled for each file; what the caller has set holds too, and nothing of it changes."""
    seen, old = [], files.like
    monkeypatch.setattr(files, "like", lambda *a: seen.append(old(*a)) or seen[-1])
    (tmp_path / "a.bmp").write_bytes(bitmap([b"abc"]))
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    assert files.scan_images(own, str(tmp_path)).sparkSession is own
    assert seen[0].conf.get(CODEGEN) == "NO_CODEGEN" and seen[0].conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    assert own.conf.get(CODEGEN) != "NO_CODEGEN" and own.conf.get(OPEN_COST) == spark.conf.get(OPEN_COST) != seen[0].conf.get(OPEN_COST)


def test_a_folder_without_images_gives_no_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"text")
    assert files.scan_images(spark, str(tmp_path)).collect() == []


def test_query_gives_one_row_per_document_from_many_folders(spark, tmp_path):
    texts = ["", "a", "b" * 48, "c" * 49, "é" * 60] * 60
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["name"], r["height"], r["width"], r["nChannels"]) for r in QUERIES["scan_images"](spark, str(tmp_path)).collect()}
    assert got == {(f"{i}.bmp", max(1, -(-len(t.encode()) // 48)), 16, 3) for i, t in enumerate(texts)}
    folders = os.listdir(write_bitmaps(spark, str(tmp_path)).removeprefix("file:"))
    assert 32 < len(folders) <= IMAGE_FOLDERS
