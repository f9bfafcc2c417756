"""The registered queries of this package, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.queries.base import table
from tablewright.session import scratch_dir

from . import archives, ball_tree, bpe, contamination, hard_negatives, html_crf, kd_shards, ngram_join, packing, pq_dedup, quality, rollup, secret_scan

def vocabulary() -> str:
    """The public byte-level vocabulary of 50,257 tokens; operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


@query("op4_ngram_jaccard_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find(table(spark, sf_dir, "documents"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    linked = ngram_join.near_duplicates(docs).where("doc_id IS NOT NULL")
    clusters = linked.groupBy("doc_id").agg(F.min("component_id").alias("cluster"))    # one cluster where an id stands in several rows
    return packing.pack(docs, clusters=clusters)


@query("op10_kd_tree_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard(table(spark, sf_dir, "documents"))


#: Exact pairs and a walk along them; the test tables are small enough for it.
OP1_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links,
  coalesce(least(v.vec_id, (SELECT min(b) FROM reach WHERE reach.a = v.vec_id)), v.vec_id) AS component_id,
  v.vec_id = coalesce(least(v.vec_id, (SELECT min(b) FROM reach WHERE reach.a = v.vec_id)), v.vec_id) AS kept, v.label
FROM embeddings v
"""


@query("op1_embedding_near_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


#: Digest in base32: every 5 hexadecimal digits are 4 letters.
OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex FROM p),
n AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS INT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM n
"""


@query("op3_warc_from_arc", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(table(spark, sf_dir, "pages"))


@query("op2_bpe_round_trip")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


@query("op5_token_rollup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.corpus_totals(table(spark, sf_dir, "documents"), scratch_dir(spark), vocabulary())


@query("op7_html_main_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


#: The whole score matrix of anchors; the test tables are small enough for it.
OP11_SQL = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
score AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS s FROM fine a JOIN fine b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
near AS (SELECT anchor_id, other AS positive_id, s AS positive_score FROM score WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, other)::INT AS rank, other AS negative_id, positive_score, s AS negative_score
FROM near JOIN score USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s AND 100 * s <= 90 * positive_score
QUALIFY rank <= 10
"""


@query("op11_hard_negatives", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved))


OP12_SQL = r"""
WITH words AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
docs AS (SELECT d, doc_id, len(ws) AS n, ws FROM words WHERE len(ws) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM docs),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t FROM benchmark),
tf AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(ws) AS t FROM docs) WHERE t IN (SELECT t FROM items) GROUP BY ALL),
weight AS (SELECT t, floor(1000 * ln((2 * (SELECT docs FROM total) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY t),
part AS (SELECT d, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * total.docs) // total.terms))) AS s FROM tf JOIN weight USING (t) JOIN docs USING (d) CROSS JOIN total),
score AS (SELECT item_id, doc_id, sum(s)::BIGINT AS score FROM items JOIN part USING (t) JOIN docs USING (d) GROUP BY item_id, d, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM score WHERE score > 0 QUALIFY rank <= 50
"""


@query("op12_ranked_search", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark),
cut AS (SELECT item_id, ws, least(10, len(ws)) AS size, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS w FROM cut),
places AS (SELECT d, ws, size, unnest(range(1, greatest(0, len(ws) - size + 1) + 1)) AS p FROM docs, (SELECT DISTINCT size FROM windows)),
hits AS (SELECT d, p, size, item_id FROM (SELECT d, p, size, array_to_string(ws[p:p + size - 1], ' ') AS w FROM places) JOIN windows USING (size, w)),
words AS (SELECT d, count(DISTINCT spot) AS n_hit FROM (SELECT d, unnest(range(p, p + size)) AS spot FROM hits) GROUP BY d),
held AS (SELECT d, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT d, item_id FROM hits) GROUP BY d)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN words USING (d) LEFT JOIN held USING (d)
"""


@query("op13_decontamination", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
