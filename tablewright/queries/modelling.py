"""Queries on model and cluster comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import clusters, models
from .base import order_sql, query, table

DIMS = 64                      # all dimensions of the vectors
COLS = [f"e{i}" for i in range(DIMS)]
WIDE_SQL = "(SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(DIMS)) + " FROM embeddings)"
X_SQL = "[" + ", ".join(COLS) + "]"


def embedded(spark, sf):
    """Vectors as columns with their class."""
    return table(spark, sf, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(DIMS)])


def quality(spark, sf):
    """A binary target with text measures as features."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.size(F.split("text", r"\s+")).alias("words"), F.size(F.split("text", "\n")).alias("lines"),
                                             F.length(F.regexp_replace("text", "[^0-9]", "")).alias("digits"))
    return d.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


TEST = "id % 4 = 0"


@query("folds", f"SELECT event_id, event_type, (row_number() OVER (PARTITION BY event_type ORDER BY {order_sql('event_id', 42)}, event_id) - 1)::INT % 3 AS fold FROM events")
def _(spark, sf):
    return models.folds(table(spark, sf, "events").select("event_id", "event_type"), ["event_id"], 3, "event_type")


def _classify(key: str, name: str, binary: bool = False, sql: str | None = None, **parameters):
    @query(key, sql)
    def _(spark, sf):
        df, target, row = (quality(spark, sf), "quality", "doc_id") if binary else (embedded(spark, sf), "label", "vec_id")
        return models.predictions(df, target, row, name, F.expr(TEST), **parameters)


KNN_BASE = f"(SELECT a.vec_id AS id, b.label AS l, b.e0 AS y, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance({{x}}), b.vec_id) AS r FROM {WIDE_SQL} a, {WIDE_SQL} b WHERE a.vec_id % 4 = 0 AND b.vec_id % 4 <> 0)"
NEAR_SQL = KNN_BASE.format(x=", ".join("[" + ", ".join(f"{s}.{c}" for c in COLS) + "]" for s in "ab"))
NEAR_REG_SQL = KNN_BASE.format(x=", ".join("[" + ", ".join(f"{s}.{c}" for c in COLS[1:]) + "]" for s in "ab"))
RANKED_SQL = f"(SELECT vec_id AS id, (dense_rank() OVER (ORDER BY label) - 1)::DOUBLE AS label, label AS raw FROM {WIDE_SQL})"

_classify("clf_random_forest", "randomforest")
_classify("clf_adaboost", "adaboost")
_classify("clf_gradient_boost", "gradientboost", binary=True)
_classify("clf_knn", "KNeighbors", sql=f"SELECT t.id, t.label, v.label AS prediction FROM {RANKED_SQL} t JOIN (SELECT id, l FROM (SELECT id, l, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, l) AS k FROM {NEAR_SQL} WHERE r <= 5 GROUP BY id, l) WHERE k = 1) n ON t.id = n.id"
          f" JOIN (SELECT DISTINCT raw, label FROM {RANKED_SQL}) v ON v.raw = n.l")
_classify("clf_gaussian_nb", "GaussianNB")
_classify("clf_svm_rbf", "svm", binary=True)
_classify("clf_logistic", "logistic_regression")
_classify("clf_decision_tree", "decision_tree")
_classify("clf_extra_trees", "extra_trees")
_classify("clf_mlp", "mlp")
_classify("clf_lda", "lda")
_classify("clf_qda", "qda")


def _regress(key: str, name: str, sql: str | None = None, digits: int | None = None):
    @query(key, sql)
    def _(spark, sf):
        out = models.predictions(embedded(spark, sf).drop("label"), "e0", "vec_id", name, F.expr(TEST), classify=False)
        return rounded(out, digits) if digits else out


_regress("reg_knn", "KNeighbors", f"SELECT id, round(e0, 6) + 0.0 AS label, round(avg(y), 6) + 0.0 AS prediction FROM {NEAR_REG_SQL} n JOIN {WIDE_SQL} w ON w.vec_id = n.id WHERE r <= 5 GROUP BY id, e0", 6)
for _key, _name in [("reg_random_forest", "randomforest"), ("reg_gradient_boost", "gradientboost"), ("reg_decision_tree", "decision_tree"), ("reg_adaboost", "adaboost"),
                    ("reg_svr_rbf", "svr"), ("reg_linear", "linear"), ("reg_ridge", "ridge"), ("reg_lasso", "lasso"), ("reg_elastic_net", "elastic_net"), ("reg_extra_trees", "extra_trees")]:
    _regress(_key, _name)


@query("compare_classifiers")
def _(spark, sf):
    return models.compare_classifiers(quality(spark, sf), "quality", "doc_id")


@query("compare_regressors")
def _(spark, sf):
    return models.compare_regressors(embedded(spark, sf).drop("label"), "e0", "vec_id")


@query("split_evaluate")
def _(spark, sf):
    return models.split_evaluate(quality(spark, sf), "quality", "doc_id", "decision_tree")


@query("tune_random")
def _(spark, sf):
    return models.tune_random(quality(spark, sf), "quality", "doc_id", "decision_tree", {"depth": [2, 4, 6, 8, 10]})


@query("strategy_search")
def _(spark, sf):
    return models.strategy_search(quality(spark, sf), "quality", "doc_id")


@query("label_feature_selection")
def _(spark, sf):
    return models.label_feature_selection(embedded(spark, sf), "label", "vec_id")


# ---- clusters -----------------------------------------------------------------------

SCALED_SQL = "(SELECT vec_id, label, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in COLS) + f" FROM {WIDE_SQL})"


def prepared(spark, sf):
    return clusters.cluster_prepare(embedded(spark, sf), "vec_id", COLS)


@query("cluster_count", "SELECT CASE WHEN n < 10 THEN least(3, n - 1) ELSE greatest(2, least(10, n // 2)) END AS clusters FROM (SELECT count(*) AS n FROM embeddings)")
def _(spark, sf):
    k = clusters.cluster_count(table(spark, sf, "embeddings").count())
    return spark.createDataFrame([(k,)], "clusters long")


@query("cluster_prepare", "SELECT vec_id, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in COLS) + f" FROM {SCALED_SQL}")
def _(spark, sf):
    return rounded(prepared(spark, sf))


@query("cluster_kmeans")
def _(spark, sf):
    return clusters.cluster_kmeans(clusters.points(prepared(spark, sf), "vec_id"), 10)


@query("cluster_hierarchical")
def _(spark, sf):
    return clusters.cluster_hierarchical(clusters.points(prepared(spark, sf), "vec_id"), 10)


@query("cluster_gmm")
def _(spark, sf):
    return clusters.cluster_gmm(clusters.points(prepared(spark, sf), "vec_id"), 5)


@query("cluster_spectral")
def _(spark, sf):
    return clusters.cluster_spectral(clusters.points(prepared(spark, sf), "vec_id"), 5, 0.1)


# customers on a plane: balance and place in the segment; some dense spots, some noise
SPOT_SQL = "(SELECT c_custkey AS id, c_acctbal / 100.0::DOUBLE AS x, ((c_custkey * 7919) % 1009) / 10.0::DOUBLE AS y FROM customer)"
EPS, LEAST = 2.0, 4


@query("cluster_dbscan", f"WITH RECURSIVE p AS {SPOT_SQL}, pairs AS (SELECT a.id AS a, b.id AS b FROM p a, p b WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {EPS}),"
       f" core AS (SELECT a AS id FROM pairs GROUP BY a HAVING count(*) >= {LEAST}), links AS (SELECT a, b FROM pairs WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),"
       " reach AS (SELECT id, id AS other FROM core UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a), labels AS (SELECT id, min(other) AS label FROM reach GROUP BY 1),"
       " every AS (SELECT id, label FROM labels UNION ALL SELECT p.a, min(l.label) FROM pairs p JOIN labels l ON l.id = p.b WHERE p.a NOT IN (SELECT id FROM core) GROUP BY 1),"
       " ranks AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS cluster FROM (SELECT DISTINCT label FROM every))"
       " SELECT p.id, coalesce(r.cluster, -1) AS cluster FROM p LEFT JOIN every e USING (id) LEFT JOIN ranks r USING (label)")
def _(spark, sf):
    spots = table(spark, sf, "customer").selectExpr("c_custkey AS id", "array(c_acctbal / 100.0D, ((c_custkey * 7919) % 1009) / 10.0D) AS x")
    return clusters.cluster_dbscan(spots, EPS, LEAST)


@query("cluster_scores", f"WITH p AS (SELECT vec_id AS id, label AS c, {X_SQL} AS x FROM {WIDE_SQL}), sizes AS (SELECT c, count(*) AS n FROM p GROUP BY 1),"
       " d AS (SELECT a.id, a.c, b.c AS o, sum(list_distance(a.x, b.x) * list_distance(a.x, b.x)) AS s FROM p a, p b GROUP BY ALL), m AS (SELECT d.id, max(CASE WHEN d.c = d.o THEN s / (n - 1) END) AS a, min(CASE WHEN d.c <> d.o THEN s / n END) AS b FROM d JOIN sizes z ON z.c = d.o GROUP BY 1),"
       " ctr AS (SELECT c, count(*) AS n, [" + ", ".join(f"avg(x[{i + 1}])" for i in range(DIMS)) + "] AS m FROM p GROUP BY 1), whole AS (SELECT [" + ", ".join(f"avg(x[{i + 1}])" for i in range(DIMS)) + "] AS w FROM p),"
       " sp AS (SELECT p.c, avg(list_distance(x, m)) AS s, sum(list_distance(x, m) * list_distance(x, m)) AS ss FROM p JOIN ctr USING (c) GROUP BY 1),"
       " db AS (SELECT a.c, max((sa.s + sb.s) / list_distance(a.m, b.m)) AS r FROM ctr a JOIN ctr b ON a.c <> b.c JOIN sp sa ON sa.c = a.c JOIN sp sb ON sb.c = b.c GROUP BY 1)"
       " SELECT round((SELECT avg((b - a) / greatest(a, b)) FROM m), 6) AS silhouette, round((SELECT sum(n * list_distance(m, w) * list_distance(m, w)) FROM ctr, whole) / (SELECT sum(ss) FROM sp) * ((SELECT count(*) FROM p) - (SELECT count(*) FROM ctr)) / ((SELECT count(*) FROM ctr) - 1), 6) AS calinski_harabasz,"
       " round((SELECT avg(r) FROM db), 6) AS davies_bouldin, (SELECT count(*) FROM ctr) AS n_clusters, 'squared' AS silhouette_kind")
def _(spark, sf):
    df = embedded(spark, sf)
    pts = df.select(F.col("vec_id").alias("id"), F.array(*COLS).alias("x"))
    return rounded(clusters.cluster_scores(pts, df.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))))


@query("compare_clusters")
def _(spark, sf):
    return clusters.compare_clusters(embedded(spark, sf).drop("label"), "vec_id", COLS)
