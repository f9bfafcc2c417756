"""What the findings of round four asked for."""

from __future__ import annotations

import struct
from collections import Counter
from math import dist

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from tablewright.operators import models, neighbours, trees
from tablewright.queries import QUERIES
from tablewright.sources import files


# ---- radius join --------------------------------------------------------------------

def test_radius_join_query_pairs_all_rows(spark, tmp_path):
    """Parts at one place were paired with their least key only, and so was every part near them."""
    rows = [(1, 5, 40.0), (2, 5, 40.0), (3, 5, 40.0), (4, 6, 40.0), (5, 6, 40.0), (6, 50, 900.0)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted((r["left"], r["right"], r["distance"]) for r in QUERIES["eps_join"](spark, str(tmp_path)).collect())
    assert got == [(a, b, 0.2 if a < 4 <= b else 0.0) for a in range(1, 6) for b in range(a + 1, 6)]


def test_radius_join_deals_rows_of_one_place_over_shares(spark, monkeypatch):
    """Rows of a place meet by shares; rows that repeat their id, or have none, are as in a join of rows."""
    monkeypatch.setattr(neighbours, "SHARE", 4)
    places = [(0.0, 0.0)] * 30 + [(0.5, 0.0)] * 9 + [(0.0, 0.25), (7.0, 7.0)]
    for ids in ([(7 * i) % 41 for i in range(41)], [None if i % 8 == 0 else i % 13 for i in range(41)]):
        rows = [(i, list(p)) for i, p in zip(ids, places)]
        want = Counter((a, b, round(dist(x, y), 6)) for a, x in rows for b, y in rows if a is not None and b is not None and a < b and dist(x, y) <= 0.5)
        found = neighbours.eps_join(spark.createDataFrame(rows, "id long, x array<double>"), 0.5, digits=6)
        assert Counter((r.left, r.right, r.distance) for r in found.collect()) == want


# ---- images in batches --------------------------------------------------------------

def bitmap(height: int) -> bytes:
    body = bytes([height]) * (48 * height)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(body), 0, 0, 54, 40, 16, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def image_folder(root):
    """22 images under odd names, a file that is no image, and names that Spark's readers pass over."""
    for i, folder in enumerate(["", "a", "a/b=1", "c d", "_e=2"]):
        (root / folder).mkdir(parents=True, exist_ok=True)
        for j, name in enumerate(["1.bmp", "x y.bmp", "p%20q.bmp", "[z].bmp"]):
            (root / folder / name).write_bytes(bitmap(1 + 4 * i + j))
    for name in ("_metadata.bmp", "_k=3.bmp", "é,;.bmp", "none.png"):
        (root / name).write_bytes(b"no image" if name == "none.png" else bitmap(60))
    for name in ("_left/1.bmp", ".left/1.bmp", "_left.bmp", ".left.bmp", "left.bmp._COPYING_"):
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(bitmap(99))
    (root / "gone.bmp").symlink_to(root / "nowhere.bmp")


@pytest.mark.parametrize("drop", [True, False])
def test_images_are_read_in_batches(spark, tmp_path, monkeypatch, drop):
    """The driver listed all files at once."""
    image_folder(tmp_path)
    monkeypatch.setattr(files, "BATCH", 5, raising=False)
    plain = spark.read.format("image").option("dropInvalid", drop).option("recursiveFileLookup", True).load(str(tmp_path)).select("image.*")
    found = files.scan_images(spark, str(tmp_path), drop)
    assert found.schema == plain.schema and found.sparkSession is spark
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) and found.count() == (22 if drop else 23)
    batches = list(files.file_batches(spark, str(tmp_path), 5))
    assert [len(b) for b in batches] == [5, 5, 5, 5, 4] and len({f for b in batches for f in b}) == 24


def test_few_files_patterns_and_single_files_are_one_read(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.bmp").write_bytes(bitmap(1 + i))
    assert list(files.file_batches(spark, str(tmp_path), 3)) == [] and len(list(files.file_batches(spark, str(tmp_path), 2))) == 2
    for root in (f"{tmp_path}/*", f"{tmp_path}/1.bmp", f"{tmp_path}/none"):
        assert list(files.file_batches(spark, root, 1)) == []
    assert files.scan_images(spark, f"{tmp_path}/[12].bmp").count() == 2


def test_images_of_a_store_that_only_spark_reads(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    image_folder(tmp_path / "in")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.round5.link./in", f"file://{tmp_path}/in")
    root = "viewfs://round5/in"
    plain = sorted(map(tuple, spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(root).select("image.*").collect()))
    assert len(plain) == 22 and list(files.file_batches(spark, root, 100)) == []
    monkeypatch.setattr(files, "BATCH", 10, raising=False)
    assert sorted(map(tuple, files.scan_images(spark, root).collect())) == plain
    assert [len(b) for b in files.file_batches(spark, root, 10)] == [10, 10, 4]


# ---- random cuts in all columns -----------------------------------------------------

def test_random_cuts_in_all_columns_take_many_rows_at_once(spark, monkeypatch):
    """Rows met their nodes a handful at a time, whatever their number; labels are whole, so that sums do not depend on the pieces."""
    rng = np.random.default_rng(3)
    data = [(int(i % 3), float(rng.integers(0, 50)), [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(900, 6)).round(2))]
    rows = spark.createDataFrame(data, "fold int, label double, x array<double>").coalesce(1).localCheckpoint()
    calls = spark.sparkContext.accumulator(0)

    class Watched(trees.Forest):
        def leaves(self, x, chosen):
            calls.add(1)
            return super().leaves(x, chosen)

    monkeypatch.setattr(trees, "Forest", Watched)
    grown = {}
    for piece in (1 << 21, 1 << 9):
        monkeypatch.setattr(trees, "PIECE", piece)
        before = calls.value
        found = trees.random_cuts(rows, [0, 1], 6, 0, 4, 2, 6, 7)
        grown[piece] = {(m, path, int(found.feature[n]), float(found.cut[n]), round(float(found.value[n, 0]), 9)) for m in range(8) for path, n in nodes_of(found, m)}
        passes = calls.value - before
    assert grown[1 << 21] == grown[1 << 9] and len(grown[1 << 9]) > 40
    assert passes <= 100            # 60, and 360 with a handful of rows at a time


def nodes_of(forest, root):
    open_ = [("", root)]
    while open_:
        path, n = open_.pop()
        yield path, n
        if forest.child[n] >= 0:
            open_ += [(path + "l", forest.child[n]), (path + "r", forest.child[n] + 1)]


# ---- deep trees ---------------------------------------------------------------------

@pytest.mark.parametrize("name, kind", [("decision_tree", "DecisionTreeRegressor"), ("randomforest", "RandomForestRegressor")])
def test_deep_trees_are_fitted_by_as_many_tasks_as_cores(spark, monkeypatch, name, kind):
    """Each of a table's tasks sent statistics of all open nodes."""
    rows = spark.range(0, 60, 1, 23).selectExpr("id", "double(id % 7) AS label", "array(double(id % 7), double(id % 3)) AS x")
    train = rows.select("id", "label", array_to_vector("x").alias("features"))
    parts, real = [], getattr(models.mr, kind).fit
    monkeypatch.setattr(getattr(models.mr, kind), "fit", lambda self, df: parts.append(df.rdd.getNumPartitions()) or real(self, df))
    found = models.regressors(trees=3)[name](train, None).predict(train).collect()
    assert parts == [spark.sparkContext.defaultParallelism] and len(found) == 60
    if name == "decision_tree":
        assert all(r["prediction"] == r["label"] for r in found)
