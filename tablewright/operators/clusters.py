"""Clustering and its scores, on scaled numeric columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import clustering as mk
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import at, number, numeric_columns
from ..plans.positions import ordered_positions
from ..session import written
from .grid import border, core_ids, core_labels, grid_of
from .neighbours import STRIP, _blocks, _merged, _together, _within, candidates, eps_counts, grow, knn_join, meetings, members_of, nothing
from .neighbours import _vectors as coordinates
from .prep import impute_median, scale_standard
from .profile import basics, centred, literal_rows
from .select import inf_to_null
from .spectral import leading_vectors, normalised
from .ward import MOST, ward

SEED = 42


def cluster_count(n: int, most: int = 10) -> int:
    """Clusters tried for a table of ``n`` rows."""
    if n < 10:
        return min(3, n - 1)
    return max(2, min(most, n // 2))


def cluster_prepare(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """(key, columns): numbers only, infinite to missing, median fill, standard scale."""
    cols = columns or [c for c in numeric_columns(df) if c != key]
    return scale_standard(impute_median(inf_to_null(df.select(at(key), *[number(df, c).alias(c) for c in cols])), cols), cols)


def points(prepared: DataFrame, key: str) -> DataFrame:
    """(id, x) of a prepared table."""
    return prepared.select(at(key).alias("id"), F.array(*[at(c) for c in prepared.columns if c != key]).alias("x"))


def _vectors(pts: DataFrame) -> DataFrame:
    return pts.select("id", array_to_vector("x").alias("features"))


def cluster_kmeans(pts: DataFrame, k: int, starts: int = 10) -> DataFrame:
    """(id, cluster): the start of least cost."""
    data = written(_vectors(pts))
    models = [mk.KMeans(k=k, seed=SEED + s).fit(data) for s in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(data).select("id", F.col("prediction").alias("cluster"))


def cluster_hierarchical(pts: DataFrame, k: int, most: int = MOST) -> DataFrame:
    """Ward's hierarchy cut at ``k``: exact up to ``most`` different rows, over merged cluster features beyond."""
    return ward(pts, k, most)


def cluster_gmm(pts: DataFrame, k: int) -> DataFrame:
    data = written(_vectors(pts))
    return mk.GaussianMixture(k=k, seed=SEED).fit(data).transform(data).select("id", F.col("prediction").alias("cluster"))


def cluster_spectral(pts: DataFrame, k: int, gamma: float = 1.0, neighbours: int = 10, starts: int = 10) -> DataFrame:
    """k-means over the ``k`` leading eigenvectors of the normalised RBF affinities of each row's nearest rows, every
    row's vector scaled to length one. A row without affinities (all too far for a number above 0) has a zero vector."""
    pts = written(pts)
    near = knn_join(pts, pts, neighbours, exclude_self=True)
    edges = near.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"),
                        F.exp(-gamma * F.col("distance") * F.col("distance")).alias("weight")).distinct().where("weight > 0")
    vectors, _ = leading_vectors(pts, normalised(written(edges)), k)
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    unit = vectors.select("id", F.when(length > 0, F.transform("x", lambda v: v / length)).otherwise(F.col("x")).alias("x"))
    return cluster_kmeans(unit, k, starts)


def dbscan_parameters(prepared: DataFrame, key: str) -> tuple[float, int]:
    """Half the 75th percentile of the column deviations, and one percent of the rows (at least 2)."""
    cols = [c for c in prepared.columns if c != key]
    n, base = basics(prepared, cols)
    shape = centred(prepared, cols, base)
    return 0.5 * float(np.percentile([shape[c]["std"] or 0.0 for c in cols], 75)), max(2, n // 100)


def _core_links(core: DataFrame, eps: float) -> DataFrame:
    """Edges that join the same rows as all pairs within ``eps`` do: each task sends a spanning forest of its block only,
    found a strip of distances at a time."""
    tree = grow(core)
    dealt, spread = meetings(_merged(core), tree, ["vid", "x"], radius=eps)

    def forest(key, left, right):
        if left.empty or right.empty:
            return nothing(a=object, b=object)
        x, other, a, b, out = coordinates(left["x"]), coordinates(right["x"]), left["vid"].to_numpy(), right["vid"].to_numpy(), []
        part, step = np.arange(len(b)), max(1, STRIP // len(b))         # which right vectors are joined so far
        for i in range(0, len(x), step):
            for root, near in zip(a[i:i + step], _within(x[i:i + step], other, eps)):
                cols = np.flatnonzero(near)
                hit = np.full(len(b), -1)
                hit[part[cols]] = cols
                met = np.flatnonzero(hit >= 0)
                out += [(root, v) for v in b[hit[met]]]
                if len(met) > 1:
                    to = np.arange(len(b))
                    to[met] = met[0]
                    part = to[part]
        return pd.DataFrame({"a": np.array([e[0] for e in out], dtype=object), "b": np.array([e[1] for e in out], dtype=object)})

    return _together(dealt, spread, forest, "a string, b string").where("a <> b")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): least node of the connected component. Least labels travel along edges and then jump to their
    own label, so the number of rounds grows with the logarithm of the longest chain. Every round is written."""
    state = written(nodes.select("node", F.col("node").alias("label")))
    both = written(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    while True:
        heard = (both.join(state.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("heard")))
        moved = state.join(heard, "node", "left").select("node", F.least("label", F.coalesce("heard", "label")).alias("label"), F.col("label").alias("old"))
        moved = written(moved)
        jump = moved.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = written(moved.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old"))
        changed = new.where("label <> old").limit(1).count()
        state = new.select("node", "label")
        if not changed:
            return state


def cluster_dbscan(pts: DataFrame, eps: float, min_points: int) -> DataFrame:
    """(id, cluster): -1 is noise; clusters are numbered by their least core id. A border row joins the
    first-numbered cluster with a core row within ``eps``. Few dimensions go over a grid, others over the metric tree."""
    pts = written(pts)
    grid = grid_of(pts, eps, min_points)
    ids = core_ids(pts, grid, min_points) if grid else eps_counts(pts, eps).where(F.col("neighbours") >= min_points).select("id")
    core = written(pts.join(ids, "id", "left_semi"))
    rest = pts.join(core.select("id"), "id", "left_anti")
    if core.isEmpty():
        return pts.select("id", F.lit(-1).cast("long").alias("cluster"))
    if grid:
        labelled = core_labels(core, grid, components)
        core_rows = written(written(grid.rows(core)).join(labelled.select(*grid.x, "label"), grid.x).select("id", "label"))
        near = written(border(rest, labelled, grid))
    else:
        by_vector = _vector_labels(core, eps)
        labelled, core_rows = by_vector, members_of(core).join(by_vector, "vid").select("id", "label")
        near = _border(rest, core, by_vector, eps)
    ranked, _ = ordered_positions(labelled.select("label").distinct(), ["label"])
    found = core_rows.unionByName(near).join(ranked, "label").select("id", F.col("_pos").alias("cluster"))
    return pts.select("id").join(found, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))


def _vector_labels(core: DataFrame, eps: float) -> DataFrame:
    """(vid, label) of the vectors of core rows: the least id of all rows that links join."""
    named = written(members_of(core).groupBy("vid").agg(F.min("id").alias("node")))     # equal vectors are one node
    links = _core_links(core, eps)
    edges = (links.join(named.select(F.col("vid").alias("a"), F.col("node").alias("na")), "a")
             .join(named.select(F.col("vid").alias("b"), F.col("node").alias("nb")), "b").select(F.col("na").alias("a"), F.col("nb").alias("b")))
    return written(named.join(components(named.select("node"), edges), "node").select("vid", "label"))


def _border(rest: DataFrame, core: DataFrame, by_vector: DataFrame, eps: float) -> DataFrame:
    """(id, label) of non-core rows near a core row: the least label; one row per query leaves a task."""
    tree = grow(core)
    dealt, spread = _blocks(candidates(_merged(rest), tree, radius=eps).select("vid", "x", "cell"), tree.leaves.join(by_vector, "vid").select("cell", "vid", "x", "label"), tree.block, stored=True)
    kind = by_vector.schema["label"].dataType.simpleString()

    def least(key, left, right):
        if left.empty or right.empty:
            return nothing(vid=object, label="int64")
        right = right.sort_values("label", kind="stable")
        x, other, vid, lab, rows, cols = coordinates(left["x"]), coordinates(right["x"]), left["vid"].to_numpy(), right["label"].to_numpy(), [], []
        step = max(1, STRIP // len(lab))
        for i in range(0, len(x), step):
            near = _within(x[i:i + step], other, eps)
            held = np.flatnonzero(near.any(axis=1))
            rows.append(held + i)
            cols.append(near[held].argmax(axis=1))              # the first is the least label
        return pd.DataFrame({"vid": vid[np.concatenate(rows)], "label": lab[np.concatenate(cols)]})

    labels = _together(dealt, spread, least, f"vid string, label {kind}").groupBy("vid").agg(F.min("label").alias("label"))
    return members_of(rest).join(labels, "vid").select("id", "label")


# ---- scores -------------------------------------------------------------------------

def cluster_scores(pts: DataFrame, labels: DataFrame) -> DataFrame:
    """silhouette, Calinski-Harabasz, Davies-Bouldin and cluster count without noise rows.

    The silhouette is that of squared distances at every size: it follows from per-cluster sums, one pass over the rows
    (``silhouette_kind`` says so)."""
    spark = pts.sparkSession
    schema = "silhouette double, calinski_harabasz double, davies_bouldin double, n_clusters long, silhouette_kind string"
    none = {"silhouette": 0.0, "calinski_harabasz": 0.0, "davies_bouldin": float("inf"), "n_clusters": 0, "silhouette_kind": "none"}
    data = written(pts.join(labels.select("id", F.col("cluster").cast("long").alias("cluster")), "id").where("cluster <> -1"))
    dims = data.select(F.size("x").alias("d")).first()
    if dims is None:
        return literal_rows(spark, [none], schema)
    d = dims["d"]
    mean = lambda: [F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(d)]
    centres = data.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *mean()).collect()     # one row per cluster
    n, k = sum(c["n"] for c in centres), len(centres)
    if k < 2:
        return literal_rows(spark, [none], schema)
    centre = {c["cluster"]: np.array([c[f"m{i}"] for i in range(d)]) for c in centres}
    whole = sum(c["n"] * centre[c["cluster"]] for c in centres) / n
    table = spark.createDataFrame([(int(c), [float(v) for v in m]) for c, m in centre.items()], "cluster long, centre array<double>")
    gap = F.aggregate(F.zip_with("x", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    spread = {r["cluster"]: r for r in data.join(F.broadcast(table), "cluster").withColumn("g", gap).groupBy("cluster")
              .agg(F.sum("g").alias("ss"), F.avg(F.sqrt("g")).alias("s")).collect()}
    within = sum(r["ss"] for r in spread.values())
    between = sum(c["n"] * float(((centre[c["cluster"]] - whole) ** 2).sum()) for c in centres)
    ids = list(centre)
    worst = [max((spread[i]["s"] + spread[j]["s"]) / float(np.linalg.norm(centre[i] - centre[j])) if np.any(centre[i] != centre[j]) else 0.0 for j in ids if j != i) for i in ids]
    vec = data.select(array_to_vector("x").alias("features"), F.col("cluster").cast("double").alias("prediction"))
    silhouette, kind = ClusteringEvaluator().evaluate(vec), "squared"
    return literal_rows(spark, [{"silhouette": float(silhouette), "calinski_harabasz": 1.0 if within == 0 else between / within * (n - k) / (k - 1) if n > k else 0.0,
                                 "davies_bouldin": float(np.mean(worst)), "n_clusters": k, "silhouette_kind": kind}], schema)


def compare_clusters(df: DataFrame, key: str, columns: list[str] | None = None, starts: int = 10) -> DataFrame:
    """(model, metric, score, best) of five methods and three scores; Davies-Bouldin negated so that more is better."""
    prepared = written(cluster_prepare(df, key, columns))
    pts, n = points(prepared, key), prepared.count()
    k, (eps, least) = cluster_count(n), dbscan_parameters(prepared, key)
    runs = {"kmeans": lambda: cluster_kmeans(pts, k, starts), "dbscan": lambda: cluster_dbscan(pts, eps, least), "agglomerative": lambda: cluster_hierarchical(pts, k),
            "spectral": lambda: cluster_spectral(pts, k), "gaussian_mixture": lambda: cluster_gmm(pts, k)}
    rows = []
    for name, run in runs.items():
        s = cluster_scores(pts, run()).first() if k >= 2 else None
        # too few rows for two clusters: nothing to score
        found = {"silhouette": s["silhouette"], "calinski_harabasz": s["calinski_harabasz"], "davies_bouldin": -s["davies_bouldin"]} if s else dict.fromkeys(["silhouette", "calinski_harabasz", "davies_bouldin"], 0.0)
        rows += [{"model": name, "metric": m, "score": float(v)} for m, v in found.items()]
    long = literal_rows(df.sparkSession, rows, "model string, metric string, score double")
    return long.withColumn("best", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("score"), "model")) == 1)
