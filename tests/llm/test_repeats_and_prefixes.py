"""Repeated rows in links, formulas and objects in pages, rows without id in the rollup, long common prefixes in shards."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tablewright.llm import html_crf, kd_shards, ngram_join, packing, queries, rollup, secret_scan


def brute_links(rows, threshold=0.8, n=5):
    """(doc_id, n_links, component) of every row; rows are documents of their own whatever their ids."""
    def grams(text):
        w = (text or "").split()
        return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = collections.Counter()
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((doc, links[i], least[find(i)]) for i, (doc, _) in enumerate(rows))


def linked(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((r.doc_id, r.n_links, r.component_id) for r in ngram_join.near_duplicates(docs).collect())


def sentence(seed, n=60):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randint(0, 10 ** 6)}" for _ in range(n))


def test_repeated_rows_inside_a_link(spark):
    a = sentence(1)
    for ids in ((1, 1, 2), (1, 3, 2), (5, 5, 5)):
        rows = [(ids[0], a), (ids[1], a), (ids[2], a + " more")]
        assert linked(spark, rows) == brute_links(rows)
        assert [r[1] for r in linked(spark, rows)] == [2, 2, 2]


def test_one_id_for_several_texts(spark):
    a, b, c = sentence(1), sentence(2), sentence(3)
    rows = [(1, a), (1, b), (1, None), (2, a + " x"), (3, b + " y"), (4, b + " y"), (0, c), (1, c + " z"), (7, a), (7, a), (9, c + " q r"), (1, a)]
    assert linked(spark, rows) == brute_links(rows)


def test_many_rows_of_one_id(spark):
    draw = random.Random(4)
    base = [sentence(i) for i in range(6)]
    rows = [(draw.choice([1, 1, 1, draw.randint(2, 40)]), draw.choice(base) + " extra" * draw.randint(0, 3)) for _ in range(150)]
    assert linked(spark, rows) == brute_links(rows)


def test_formulas_and_fallback_text_stay():
    page = "<body><article><p>Let <math display='block'><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation encoding='tex'>x=1/2</annotation></math> hold for all.</p>" \
           "<object data='a.swf'><p>The film shows a bridge.</p></object><canvas>A chart of rainfall.</canvas><script>var a = 1;</script></article></body>"
    assert [b[0] for b in html_crf.leaf_blocks(page)] == ["Let x=12 hold for all.", "The film shows a bridge.", "A chart of rainfall."]


def test_rows_without_id_are_counted(spark, tmp_path):
    schema = "doc_id long, text string, source string, lang string"
    for top in (2, (1 << 63) - 1):
        docs = spark.createDataFrame([(1, "one two", "a", "en"), (None, "three four five", "a", "en"), (None, "six", "a", "en"), (top, "seven eight", "a", "en")], schema)
        got = {r.version: (r.documents, r.tokens) for r in rollup.corpus_totals(docs, str(tmp_path / f"{top}"), queries.vocabulary()).collect()}
        assert got["words"] == (4, 8) and got["byte_bpe_50k"][0] == 4


@pytest.mark.parametrize("few", [10_000, 1])
def test_sources_with_a_long_common_prefix_are_told_apart(spark, monkeypatch, few):
    monkeypatch.setattr(kd_shards, "BROADCAST_VALUES", few)
    prefix = "common_crawl_segment_of_the_year_"
    docs = spark.createDataFrame([(5, f"text number {100 + i}", f"{prefix}{i % 7}", None if i == 0 else "en") for i in range(210)], "doc_id long, text string, source string, lang string")
    groups = kd_shards.text_groups(docs)
    assert {r.c2 for r in groups.select("c2").distinct().collect()} == set(range(7)) and {r.c3 for r in groups.select("c3").distinct().collect()} == {0, 1}
    got = kd_shards.shard(docs, 4)
    assert got.count() == 210
    # ids and lengths are all the same, and all but one text have one language: sources are what parts the rest
    by_shard = got.join(docs.select(F.crc32(F.encode("text", "UTF-8")).cast("long").alias("text_crc32"), "source"), "text_crc32").groupBy("shard").agg(F.count_distinct("source").alias("n")).collect()
    assert len(by_shard) == 4 and min(r.n for r in by_shard) < 7


# ---- packing -------------------------------------------------------------------------------------------------------

def test_equal_rows_are_spread_over_packing_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 64)
    docs = spark.createDataFrame([(None, "s", "same text")] * 2000 + [(i, f"s{i % 7}", "word " * (i % 9)) for i in range(200)] + [(7, "long", "y" * 250)] * 3,
                                 "doc_id long, source string, text string")
    rows = packing.pack(docs, capacity=100, group=100).collect()
    assert len(rows) == 2000 + 200 + 3 * 3
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.bin].append(r)
    assert all(sum(r.size for r in inside) + inside[0].room == 100 for inside in bins.values())
    assert all(len({r.cluster for r in inside}) == len(inside) for inside in bins.values())
    groups = collections.Counter(r.bin.split(":")[0] for r in rows if r.doc_id is None)
    assert len(groups) > 15 and max(groups.values()) < 200


def test_given_clusters_are_kept_apart(spark):
    docs = spark.createDataFrame([(i, f"s{i}", f"text {i}") for i in range(5)] + [(None, "s9", "text 9")], "doc_id long, source string, text string")
    rows = packing.pack(docs, capacity=100, clusters=docs.where("doc_id < 5").selectExpr("doc_id", "doc_id % 2 AS cluster")).collect()
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.bin].append(r.cluster)
    assert len(rows) == 6 and len(bins) == 3 and all(len(set(c)) == len(c) for c in bins.values())


# ---- positions in rewritten layers ---------------------------------------------------------------------------------

def test_runs_map_as_single_positions_do():
    draw = random.Random(3)
    for _ in range(200):
        runs, each = secret_scan.Runs(), []
        at = 0
        for _ in range(draw.randint(1, 12)):
            n, width = draw.choice([(draw.randint(0, 5), 1), (1, 3), (1, 6)])
            runs.add(n, at, width)
            each += [(at + i, at + i + width) for i in range(n)]
            at += n * width + draw.choice([0, 0, 4])
        assert runs.size == len(each) and [runs.origin(i) for i in range(len(each))] == each
        a = draw.randint(0, len(each))
        b = draw.randint(a, len(each))
        assert [(p + i, p + i + w) for n, p, w in (runs.part(a, b) if a < b else ()) for i in range(n)] == each[a:b]


def test_one_escape_in_a_long_text_takes_three_runs():
    layer = secret_scan._rewritten(secret_scan.Layer(b"plain words " * 100_000 + b"%41" + b" more words" * 100_000), secret_scan._URL, secret_scan._url)
    assert len(layer.begin.start) == 3 and layer.span(1_200_000, 1_200_001) == (1_200_000, 1_200_003) and layer.span(5, 1_200_002) == (5, 1_200_004)
    text = "x " * 50_000 + "%74oken=%61bcdef%312" + " y" * 50_000
    assert secret_scan.scan(text)[1] == [(100_000, "assign", 100_020)]
