"""Embedding dedup, archives, HTML extraction and the pipeline against brute force."""

import base64
import collections
import hashlib
import itertools
import math
import random

import duckdb
import numpy as np
import pytest

import check_queries as check
from tablewright.llm import archives, html_crf, pq_dedup, queries
from tablewright.llm.components import components
from tablewright.llm.html_labelled import labelled_pages

SF = "/root/testdata/sf0.001"


# ---- components ----------------------------------------------------------------------------------------------------

def test_components(spark):
    draw = random.Random(3)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(draw.randint(0, 60), draw.randint(0, 60)) for _ in range(40)] + [(7, 7), (None, 3)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {a: find(a) for a in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- embeddings ----------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, rep long, home string, links string"


def brute_vectors(rows, threshold):
    def usable(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links, root = collections.Counter(), {r[0]: r[0] for r in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(rows, 2):
        if None not in (a[0], b[0]) and a[2] is not None and a[2] == b[2] and usable(a[1]) and usable(b[1]) and len(a[1]) == len(b[1]):
            x, y = np.array(a[1], dtype=float), np.array(b[1], dtype=float)
            if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                links[a[0]] += 1
                links[b[0]] += 1
                p, q = find(a[0]), find(b[0])
                root[max(p, q)] = min(p, q)
    return {r[0]: (links[r[0]], find(r[0])) for r in rows if r[0] is not None}


def noisy_vectors(n=300, dims=24):
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(20, dims))
    rows = [(i, (centres[i % 20] + draw.normal(size=dims) * draw.choice([0.02, 0.08, 0.14, 0.2])).astype(np.float32).tolist(), int(i % 3 == 0)) for i in range(n)]
    return rows + [(n + k, (np.array(rows[k][1]) * 2).tolist(), rows[k][2]) for k in range(10)] + [(n + 20 + k, rows[0][1], 1) for k in range(5)]


def test_all_links_are_found(spark):
    rows = noisy_vectors()
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 24, 1), (903, [float("nan")] + [1.0] * 23, 1), (904, [None] + [1.0] * 23, 1), (905, rows[0][1], None), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (908, [float("inf")] * 24, 1), (909, [1e-30] * 24, 0), (910, [1e30] * 24, 0)]
    frame = spark.createDataFrame([(*r, 5, "x", "y") for r in [*rows, (None, rows[0][1], 1)]], VECTORS).repartition(4)
    got = pq_dedup.near_duplicates(frame).collect()
    assert len(got) == len(rows) + 1
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == brute_vectors(rows, 0.98)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_large_lists_are_cut(spark):
    draw = np.random.default_rng(8)
    n = pq_dedup.BLOCK + 90
    rows = [(i, (np.ones(8) + draw.normal(size=8) * 0.12).astype(np.float32).tolist(), 1) for i in range(n)]
    got = {r.vec_id: r.n_links for r in pq_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    x = np.array([r[1] for r in rows], dtype=float)
    x /= np.sqrt((x ** 2).sum(1, keepdims=True))
    assert [got[i] for i in range(n)] == ((x @ x.T >= 0.98).sum(1) - 1).tolist()


def test_table_distances_bound_true_distances():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(500, 30))
    x /= np.sqrt((x ** 2).sum(1, keepdims=True))
    model = pq_dedup.Model(x[:200], 16)
    x = model.padded(x)
    home, _ = model.visits(x, 0.1)
    codes, error = model.code(x, home)
    for here in range(4):
        m = np.flatnonzero(home == here)
        far = np.sqrt(model.table_distances(x, here, codes[m]))
        true = np.sqrt(((x[:, None] - x[m][None]) ** 2).sum(2))
        assert (np.abs(far - true) <= error[m][None] + 1e-9).all()


def test_no_vectors(spark):
    assert pq_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    only = spark.createDataFrame([(1, None, 1, 0, "", "")], VECTORS)
    assert [tuple(r)[:4] for r in pq_dedup.near_duplicates(only).collect()] == [(1, 0, 1, True)]


# ---- archives ------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string, archive string"


def test_arc_header_layouts():
    for version in (1, 2):
        data = archives.arc_head("x.arc", version) + archives.arc_record("http://a/b c", b"HTTP/1.0 200 OK\r\n\r\nbody\n\nmore", version) + archives.arc_record(None, b"", version) + b"\n\n"
        got = list(archives.read_arc(data))
        assert [(r["URL"], r["Archive-length"], block) for r, _, block in got] == [("http://a/b%20c", "29", b"HTTP/1.0 200 OK\r\n\r\nbody\n\nmore"), ("-", "0", b"")]
        assert ("Result-code" in got[0][0]) == (version == 2)
        with pytest.raises(ValueError, match="declares"):
            list(archives.read_arc(data.replace(b" 29\n", b" 9999\n")))
    with pytest.raises(ValueError, match="version block"):
        list(archives.read_arc(b"http://a 0.0.0.0 20240101000000 text/html 0\n\n"))
    assert archives.iso_date("20240506070809") == "2024-05-06T07:08:09Z" and archives.iso_date("202405060708") == "2024-05-06T07:08:00Z"


def test_warc_records():
    fields = {"URL": "http://a/", "IP-address": "1.2.3.4", "Archive-date": "20240506070809", "Content-type": "text/html", "Archive-length": "27"}
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\nbody"
    full = archives.warc_record(fields, "a.arc", 5, block, None)
    again = archives.warc_record(fields, "b.arc", 9, block, archives.record_id("a.arc", 5))
    got = list(archives.read_warc(full + b"\r\n\r\n" + again + b"\r\n\r\n"))
    assert [h["warc-type"] for h, _ in got] == ["response", "revisit"] and got[0][1] == block and got[1][1] == block[:-4]
    assert got[1][0]["warc-refers-to"] == got[0][0]["warc-record-id"] and got[0][0]["warc-ip-address"] == "1.2.3.4"
    want = "sha1:" + base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    assert all(h["warc-payload-digest"] == want for h, _ in got) and got[0][0]["warc-block-digest"] != got[1][0]["warc-block-digest"]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(archives, "ARCHIVE_BYTES", 500)
    pages = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "http://a b/\n4", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 50), (6, "u", "x" * 200_000), (None, "u", "same"), (None, "u", "own"), (7, "u", "twice"), (7, "u", "twice")]
    frame = spark.createDataFrame([(*p, "d", "a") for p in pages], PAGES).repartition(3)
    got = archives.round_trip(frame).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == collections.Counter((p, len((t or "").encode()), digest(t)) for p, _, t in pages)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert {(2, "response", None), (1, "revisit", 2), (None, "revisit", 2), (4, "response", None), (3, "revisit", 4), (None, "response", None), (7, "response", None), (7, "revisit", 7)} <= kinds
    assert all(r.record_type == "response" for r in archives.round_trip(frame, smallest=6).collect() if r.payload_bytes < 6)
    assert archives.round_trip(frame.limit(0)).count() == 0


# ---- HTML ----------------------------------------------------------------------------------------------------------

WORDS = [f"word{i}" for i in range(300)] + ["the", "of.", "and,", "é&<>", "BIG"]


@pytest.fixture(scope="module")
def model():
    return html_crf.train(html_crf.examples(labelled_pages(WORDS, html_crf.LABELLED)))


def test_held_out_layouts(model):
    wrong = total = 0
    for rows, gold in html_crf.examples(labelled_pages(WORDS, 200, first=10_000)):
        wrong += sum(a != b for a, b in zip(model.label(rows), gold))
        total += len(gold)
    assert wrong < 0.02 * total


def test_viterbi_is_the_best_labelling():
    draw = np.random.default_rng(1)
    for n in range(1, 7):
        model = html_crf.Model(draw.normal(size=html_crf.SLOTS), draw.normal(size=2), draw.normal(size=(2, 2)))
        rows = [draw.integers(0, html_crf.SLOTS, 5).tolist() for _ in range(n)]

        def score(labels):
            return model.start[labels[0]] + sum(model.weight[r].sum() * y for r, y in zip(rows, labels)) + sum(model.step[a, b] for a, b in zip(labels, labels[1:]))

        assert tuple(model.label(rows)) == max(itertools.product((0, 1), repeat=n), key=score)


def test_training_climbs_the_likelihood():
    draw = random.Random(1)
    pages = [([[draw.randint(0, 30)] for _ in range(6)], [draw.randint(0, 1) for _ in range(6)]) for _ in range(8)]

    def likelihood(m):
        total = 0
        for rows, gold in pages:
            def score(y):
                return m.start[y[0]] + sum(m.weight[r].sum() * v for r, v in zip(rows, y)) + sum(m.step[a, b] for a, b in zip(y, y[1:]))

            total += score(gold) - np.logaddexp.reduce([score(y) for y in itertools.product((0, 1), repeat=len(rows))])
        return total

    first, more, most = (likelihood(html_crf.train(pages, rounds=r, rate=0.1)) for r in (1, 20, 200))
    assert first < more < most


def test_leaf_blocks():
    html = """<html><head><title>t</title></head><body><!-- a > b --><nav><ul><li>one<li><a href='>'>two</a></ul></nav><script>if (a < b) "</p>"</script><div class="ad">buy &amp; sell</div>
    <article><h1>Head&nbsp;line</h1><p>First <b>bold<br>line<p>Second &#233;<table><tr><td>x<td>y</table>tail < end"""
    got = html_crf.leaf_blocks(html)
    assert [b[0] for b in got] == ["one", "two", "buy & sell", "Head line", "First bold line", "Second é", "x", "y", "tail < end"]
    assert [b[2] for b in got] == ["li", "li", "div", "h1", "p", "p", "td", "td", "article"] and got[1][3] == 3
    assert html_crf.leaf_blocks("") == [] and html_crf.leaf_blocks("<p") and [b[0] for b in html_crf.leaf_blocks("plain")] == ["plain"]


def test_pages(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_crf.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = r.html[r.html.index("<article>"):].split("</article>")[0]
        assert r.text == "\n\n".join(b[0] for b in html_crf.leaf_blocks(inner)) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None, "d", "a"), (None, "u", "", "d", "a"), (2, "u", "<article><p>" + "Many words here. " * 50_000, "d", "a"), (2, "u", "<nav>menu</nav>", "d", "a")], PAGES)
    got = html_crf.extract(odd, model).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 0), (2, 0), (2, 849_999)]
    assert html_crf.extract(odd.limit(0)).count() == 0


# ---- queries and pipeline ------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert check.compare(spark, con, name, queries.QUERIES[name], queries.SQL[name], SF)[0] == "ok"


def test_pipeline(spark):
    import corpus_pipeline
    from tablewright.llm import ngram_join, quality, secret_scan

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == docs.columns and after.schema["text"].dataType == docs.schema["text"].dataType
        before, rows = {r.doc_id: r for r in now.collect()}, {r.doc_id: r for r in after.collect()}
        assert set(rows) <= set(before)
        if name == "quality_rules":
            assert set(rows) == {r.doc_id for r in quality.judge(now, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.kept}
        elif name == "near_duplicates":
            assert set(rows) == {r.doc_id for r in ngram_join.near_duplicates(now).collect() if r.kept}
        else:
            assert set(rows) == set(before) and all(r.text == secret_scan.masked(before[i].text) and r.n_chars == len(r.text) for i, r in rows.items())
            assert all(not secret_scan.scan(r.text)[1] for r in rows.values())
        now = spark.createDataFrame(after.collect(), docs.schema)
    packed = corpus_pipeline.run(spark, SF).collect()
    assert sum(r.length for r in packed) == sum(r.n_chars for r in now.collect()) and {r.doc_id for r in packed} == {r.doc_id for r in now.collect()}
