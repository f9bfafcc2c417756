"""Hard negatives, ranked search and decontamination against brute force and their SQL twins."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import check_queries as check
from tablewright.llm import ball_tree, contamination, hard_negatives, queries, terms

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_ranked_search", "op13_decontamination"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert check.compare(spark, con, name, queries.QUERIES[name], queries.SQL[name], SF)[0] == "ok"


# ---- hard negatives ------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, a long, block string, score string"


def brute_negatives(rows, anchor, positives=5, negatives=10, low=30, high=90):
    fine = [(i, label, tuple(math.floor(256 * v) for v in x)) for i, x, label, *_ in rows
            if i is not None and label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    product = lambda p, q: sum(a * b for a, b in zip(p, q))
    out = []
    for a, own, q in sorted({r for r in fine if anchor(r[0])}):
        near = sorted((-product(q, x), i) for i, label, x in fine if label == own and i != a)[:positives]
        for ps, p in near:
            far = sorted((-product(q, x), i) for i, label, x in fine if label != own and low * -ps <= 100 * product(q, x) <= high * -ps)[:negatives]
            out += [(a, p, k + 1, n, -ps, -ns) for k, (ns, n) in enumerate(far)]
    return sorted(out)


def negatives(spark, rows, **parameters):
    got = hard_negatives.mine(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], VECTORS), **parameters)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("few", [False, True])
def test_negatives_equal_brute_force(spark, monkeypatch, few):
    if few:                                             # many blocks, many chunks, many stretches of sorted access
        monkeypatch.setattr(hard_negatives, "CELLS", 512)
        monkeypatch.setattr(hard_negatives, "BLOCK", (32, 64))
        monkeypatch.setattr(hard_negatives, "CHUNK", 2)
        monkeypatch.setattr(hard_negatives, "STEP", 1)
    draw = np.random.default_rng(5)
    centre = draw.normal(size=(6, 8))
    rows = [(int(i), (centre[i % 6] + 0.5 * draw.normal(size=8)).round(1).tolist(), int(draw.choice(4, p=[0.4, 0.3, 0.2, 0.1]))) for i in range(400)]
    rows += [(1000 + i, rows[i % 3][1], rows[i % 3][2]) for i in range(60)]                  # ties
    got = negatives(spark, rows)
    assert got == brute_negatives(rows, lambda i: i % 100 == 0) and len(got) > 50


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.5, 1.0], 2), (3, [], 2), (4, [0.9], 2), (5, [1.0, 0.5, 9.0], 2), (6, None, 2), (7, [None, 1.0], 2),
            (8, [math.nan, 1.0], 1), (9, [math.inf, 1.0], 1), (10, [1.0, 2.0], None), (None, [1.0, 2.0], 1), (100, [], 1), (100, [0.0, 0.0], 3), (200, [-1.0, 0.0], 1), (0, [1.0, 2.0], 1),
            (300, [2.0, 1.0], 5), (400, [-3.0, -3.0], 1)]
    assert negatives(spark, rows) == brute_negatives(rows, lambda i: i % 100 == 0)
    assert negatives(spark, []) == [] and negatives(spark, [(1, [1.0], 1)]) == [] and negatives(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []
    assert negatives(spark, [(6, None, 1), (None, None, None)]) == []
    huge = [(0, [1e12, 1.0], 1), (1, [1e12, 3.0], 1), (2, [5e11, 2.0], 2), (3, [4e11, -1e12], 2), (4, [1e30, 1.0], 3)]
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = [(*r[:4], clip(r[4]), clip(r[5])) for r in brute_negatives([(i, [min(v, (1 << 55) - 1.0) for v in x], y) for i, x, y in huge], lambda i: i % 100 == 0)]
    assert negatives(spark, huge) == want and want


def test_a_label_of_a_third_and_one_repeated_row_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CELLS", 512)
    monkeypatch.setattr(hard_negatives, "BLOCK", (32, 64))
    rows = [(7, [1.0, 0.0], 1)] * 300 + [(100 * i, [1.0, i / 10], i % 3) for i in range(20)]
    assert negatives(spark, rows) == brute_negatives(rows, lambda i: i % 100 == 0)


# ---- ranked search -------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def brute_search(docs, items, k):
    texts = [(i, words(t)) for i, t in docs]
    texts = [(i, w) for i, w in texts if w]
    n_docs, total = len(texts), sum(len(w) for _, w in texts)
    df, out = Counter(t for _, w in texts for t in set(w)), []
    for item, text in {(i, t) for i, t in items}:
        scored = []
        for doc, w in texts:
            tf, m = Counter(w), 50 + 50 * len(w) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(words(text)))
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def searched(spark, docs, items, k):
    left = spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id long, text string, item_id string, n int")
    right = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    return sorted((tuple(r) for r in ball_tree.search(left, right, k).collect()), key=repr)


@pytest.mark.parametrize("few", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, few):
    if few:                                              # many trees, many leaves, many passes
        for name, value in (("LEAF", 3), ("BLOCK", 40), ("POSTINGS", 300), ("BATCH", 25)):
            monkeypatch.setattr(ball_tree, name, value)
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "x" * 30, "x" * 30 + "y", "12", "don"]
    text = lambda n: " ".join(vocabulary[min(len(vocabulary) - 1, int(draw.expovariate(0.12)))] for _ in range(n))
    docs = [(i, text(draw.randint(1, 40))) for i in range(300)] + [(1000 + i, "w1 w2 w3, W1-w60 12") for i in range(30)] + [(5000, None), (5001, ""), (5002, " .,"), (None, "w1 w9"), (3, "w4 w4"), (3, "w4 w4")]
    docs.append((9000, " ".join(f"z{i} w{i % 50}" for i in range(5000))))
    items = [(i, text(8)) for i in range(6)] + [(50, None), (51, ""), (52, "nowhere"), (53, "W1, w1 ÜNÏ Ünï " + "x" * 30), (0, "w7"), (54, "w3 w3 w3"), (54, "w3 w3 w3"), (None, "w5")]
    got = searched(spark, docs, items, 12)
    assert got == brute_search(docs, items, 12) and len(got) > 60


def test_search_of_empty_tables(spark):
    assert searched(spark, [], [(1, "a")], 5) == [] and searched(spark, [(1, "a")], [], 5) == [] and searched(spark, [(1, None)], [(1, "a")], 5) == []


def test_bounds_hold_in_every_ball(spark):
    draw = np.random.default_rng(3)
    for _ in range(20):
        sizes, dims = draw.integers(1, 9, 300), 40
        at = np.concatenate([[0], np.cumsum(sizes)])
        term = np.concatenate([np.sort(draw.choice(dims, s, replace=False)) for s in sizes])
        value = draw.integers(1, 3 * 10 ** 10, at[-1])
        tree = ball_tree.Tree(at, term, value, dims)
        dense = np.zeros((300, dims), dtype=np.int64)
        dense[np.repeat(np.arange(300), sizes), term] = value
        assert sorted(np.concatenate([leaf[0] for leaf in tree.leaves.values()]).tolist()) == list(range(300))
        item = draw.choice(dims, 6, replace=False)
        bound, exact = tree.bounds(item), dense[:, item].sum(1)

        def under(node):
            return tree.leaves[node][0].tolist() if tree.children[node] is None else [d for c in tree.children[node] for d in under(c)]
        for node in range(len(bound)):
            assert exact[under(node)].max() <= bound[node]
        for leaf in tree.leaves:
            assert (tree.scores(leaf, item) == exact[tree.leaves[leaf][0]]).all()


def test_search_leaves_far_balls_alone():
    at = np.arange(0, 2 * 1000 + 1, 2)
    group = np.repeat(np.arange(10), 100)
    term = np.stack([2 * group, 2 * group + 1], axis=1).ravel()
    tree = ball_tree.Tree(at, term, np.tile([1000, 1], 1000), 20)
    best = []
    assert tree.search(np.array([4, 5]), best, 50, [(1, -i) for i in range(1000)]) < len(tree.leaves) / 2
    assert sorted(-e[2] for e in best) == list(range(200, 250))


def test_terms_of_one_hash_are_parted():
    known = terms.Terms(np.array([5, 5, 9], dtype=np.uint64), np.array([1, 2, 3], dtype=np.uint64))
    assert known.find(np.array([5, 5, 5, 9, 10], dtype=np.uint64), np.array([2, 1, 7, 3, 3], dtype=np.uint64)).tolist() == [1, 0, -1, 2, -1]


# ---- decontamination -----------------------------------------------------------------------------------------------

def brute_hits(docs, items, size):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(0, len(w) - size) + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for length in {len(x) for x in windows}:
            for p in range(len(w) - length + 1):
                own = windows.get(tuple(w[p:p + length]))
                if own:
                    hit |= set(range(p, p + length))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def contaminated(spark, docs, items, size=10):
    left = spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id long, text string, items string, row int")
    right = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, spans string")
    return sorted((tuple(r) for r in contamination.digests(left, right, size).collect()), key=repr)


@pytest.mark.parametrize("most", [1 << 20, 30])
@pytest.mark.parametrize("size", [10, 4, 2, 1])
def test_hits_equal_brute_force(spark, monkeypatch, most, size):
    monkeypatch.setattr(contamination, "BATCH", most)
    draw = random.Random(size)
    text = lambda n, of: " ".join(f"w{min(of, int(draw.expovariate(0.3)))}" for _ in range(n))
    items = [(i, text(draw.randint(1, 30), 12)) for i in range(8)] + [(20, None), (21, ""), (22, "w1"), (23, "W1, w2"), (24, "w0 w0 w0 w0 w0 w0 w0 w0 w0 w0 w0 w0"), (24, "ä ö Ü"), (None, "zz yy"), (3, "only here")]
    docs = [(i, text(draw.randint(0, 60), 12)) for i in range(60)] + [(100 + i, f"{text(5, 9)} {items[i % 8][1].upper()}! {text(5, 9)}") for i in range(24)]
    docs += [(200, None), (201, ""), (202, "w0 " * 4000), (203, "ä ö ü ä ö Ü"), (204, "zz-yy"), (205, "w1"), (None, items[1][1]), (7, items[2][1]), (7, items[2][1])]
    got = contaminated(spark, docs, items, size)
    assert got == brute_hits(docs, items, size) and any(r[5] for r in got) and (not all(r[5] for r in got))


def test_spans_and_names(spark):
    docs = spark.createDataFrame([(1, "a b c d x a b c"), (2, "b")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "a b c"), (9, "b c d"), (11, "c x")], "item_id long, text string")
    got = {r.doc_id: r for r in contamination.find(docs, items, 3).collect()}
    assert [tuple(s) for s in got[1].spans] == [(0, 4), (5, 8)] and got[1]["items"] == ["10", "9"] and got[2].spans == []


def test_hits_of_empty_tables(spark):
    assert contaminated(spark, [], [(1, "a")]) == []
    none = hashlib.sha256(b"").hexdigest()
    assert contaminated(spark, [(1, "a b")], []) == [(1, 2, 0, 0, none, False)] == contaminated(spark, [(1, "a b")], [(5, None)])
