"""Queries on augmentation, rebalancing, time series, joins and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import augment, balance, compare, joins, neighbours, timeseries as ts
from .base import each, normal_sql, order_sql, query, table, uniform_sql
from .profiling import HOLED_EVENTS_SQL, holed_events


def small_events(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", "value")


STD_SQL = "(SELECT stddev_samp(value) AS s, avg(value) AS m, min(value) AS mn, max(value) AS mx, count(*) AS n FROM events)"
CLIPPED = "4"


def noise_sql(key: str, level: float, seed: int = 42) -> str:
    return f"value + {normal_sql(key, seed, 'noise:value')} * ({level} * s)"


@query("aug_noise", f"SELECT event_id, event_type, round({noise_sql('event_id', 0.01)}, 4) + 0.0 AS value FROM events, {STD_SQL}")
def _(spark, sf):
    return rounded(augment.aug_noise(small_events(spark, sf), ["event_id"]), 4)


@query("aug_duplicate", "SELECT event_id, event_type, value FROM events, range(3)")
def _(spark, sf):
    return augment.aug_duplicate(small_events(spark, sf), 3)


@query("aug_local_duplicate", "SELECT event_id, event_type, value FROM events, range(3)")
def _(spark, sf):
    return augment.aug_local_duplicate(small_events(spark, sf), 2.5)


@query("aug_drop", f"SELECT event_id, event_type, value FROM (SELECT *, row_number() OVER (ORDER BY {order_sql('event_id', 42)}, event_id) AS r, count(*) OVER () AS n FROM events) WHERE r > floor(n * 0.1)")
def _(spark, sf):
    return augment.aug_drop(small_events(spark, sf), ["event_id"])


NUMBERED_SQL = f"(SELECT *, row_number() OVER (ORDER BY {order_sql('event_id', 42)}, event_id) - 1 AS pos FROM events)"


def drawn_sql(count: str) -> str:
    return (f"(SELECT d.draw, e.* FROM (SELECT range AS draw, floor({uniform_sql('range', 42, 'pick')} * (SELECT count(*) FROM events))::BIGINT AS pos FROM range((SELECT {count} FROM events))) d"
            f" JOIN {NUMBERED_SQL} e USING (pos))")


@query("aug_general", "SELECT event_id, event_type, round(value, 4) AS value FROM events UNION ALL"
       f" SELECT event_id, event_type, round({noise_sql('draw', 0.05)}, 4) + 0.0 FROM {drawn_sql('(count(*) * 0.5)::BIGINT')}, {STD_SQL}")
def _(spark, sf):
    return rounded(augment.aug_general(small_events(spark, sf), ["event_id"]), 4)


U, Z, SIDE = uniform_sql("draw", 42, "value"), normal_sql("draw", 42, "value"), uniform_sql("draw", 42, "side")


@query("aug_feature", "SELECT event_id, event_type, round(value, 4) AS value FROM events UNION ALL"
       f" SELECT event_id, event_type, round(CASE draw % 3 WHEN 0 THEN m + {Z} * (0.5 * s) WHEN 1 THEN mn + {U} * (mx - mn) ELSE CASE WHEN {SIDE} > 0.5 THEN mn + {U} * (2.0 * s) ELSE mx - {U} * (2.0 * s) END END, 4) + 0.0"
       f" FROM {drawn_sql('floor(count(*) * 0.3)::BIGINT')}, {STD_SQL}")
def _(spark, sf):
    return rounded(augment.aug_feature(small_events(spark, sf), ["event_id"]), 4)


@query("aug_resize", f"SELECT event_id, event_type, value FROM {drawn_sql('(count(*) // 2 * 1.5)::BIGINT')}")
def _(spark, sf):
    e = small_events(spark, sf)
    return augment.aug_resize(e, ["event_id"], e.count() // 2, 0.5)


@query("aug_chain", f"SELECT event_id, event_type, round({noise_sql('event_id', 0.03)}, 4) + 0.0 AS value FROM events, {STD_SQL}, range(2)")
def _(spark, sf):
    out, _ = augment.aug_chain(small_events(spark, sf), ["event_id"], ["noise", "unknown", "smote", "duplicate"])
    return rounded(out, 4)


@query("aug_stats", "SELECT count(*) AS \"before\", count(*) + (count(*) FILTER (event_id % 10 = 0)) AS \"after\", count(*) FILTER (event_id % 10 = 0) AS increase,"
       " round((count(*) FILTER (event_id % 10 = 0)) * 100.0::DOUBLE / count(*), 6) AS percent, round((count(*) + (count(*) FILTER (event_id % 10 = 0)))::DOUBLE / count(*), 6) AS ratio FROM events")
def _(spark, sf):
    e = small_events(spark, sf)
    return rounded(augment.aug_stats(e, e.unionByName(e.where("event_id % 10 = 0"))))


@query("method_registry")
def _(spark, sf):
    # what each method makes of the table: rows before and after
    e = small_events(spark, sf)
    out = None
    for name, fn in augment.methods().items():
        made = fn(e, ["event_id"], target="event_type", method="RandomUnderSampler") if name == "smote" else fn(e, ["event_id"])
        row = augment.aug_stats(e, made).withColumn("method", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return augment.method_registry(spark).join(out, "method")


# ---- classes ------------------------------------------------------------------------

def labelled(spark, sf):
    """Documents with their quality label and numbers."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.length(F.regexp_replace("text", "[^ ]", "")).cast("double").alias("spaces"))
    return d.join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id")


LABELLED_SQL = "(SELECT doc_id, n_chars, length(regexp_replace(text, '[^ ]', '', 'g'))::DOUBLE AS spaces, quality, toxic FROM documents JOIN labels USING (doc_id))"


@query("undersample_random", f"SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {order_sql('event_id', 42)}, event_id) AS r FROM events) WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM events GROUP BY event_type))")
def _(spark, sf):
    return balance.undersample_random(small_events(spark, sf), "event_type", ["event_id"]).select("event_id", "event_type")


GROWN_SQL = (f"(SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {order_sql('event_id', 42)}, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS c FROM events)"
             ", (SELECT max(n) AS top FROM (SELECT count(*) AS n FROM events GROUP BY event_type))")


@query("oversample_random", "SELECT event_id, event_type FROM (SELECT *, unnest(generate_series(0, (top - c) // c + CASE WHEN r <= (top - c) % c THEN 1 ELSE 0 END)) AS copy FROM " + GROWN_SQL + ")")
def _(spark, sf):
    return balance.oversample_random(small_events(spark, sf), "event_type", ["event_id"]).select("event_id", "event_type")


@query("smote")
def _(spark, sf):
    return rounded(balance.smote(labelled(spark, sf), "quality", "doc_id"))


@query("rebalance", f"SELECT event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {order_sql('event_id', 42)}, event_id) AS r FROM events) WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM events GROUP BY event_type))")
def _(spark, sf):
    return balance.rebalance(small_events(spark, sf), ["event_id"], "event_type", "RandomUnderSampler")


@query("strategy_multiclass", "SELECT event_type AS label, count(*) AS n, floor(count(*) * 150.0 / 100)::BIGINT AS wanted FROM events GROUP BY 1")
def _(spark, sf):
    return balance.strategy_multiclass(table(spark, sf, "events"), "event_type", 150.0)


@query("strategy_binary", "SELECT arg_min(quality, n) AS label, min(n) AS n, floor(max(n) * 0.9)::BIGINT AS wanted FROM (SELECT quality, count(*) AS n FROM labels GROUP BY 1)")
def _(spark, sf):
    return balance.strategy_binary(table(spark, sf, "labels"), "quality", 0.9)


@query("strategy_levels", "WITH c AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1), s AS (SELECT max(n) AS t, avg(n) AS m, quantile_cont(n::DOUBLE, 0.5) AS d FROM c)"
       " SELECT 'max' AS strategy, label, n, t AS wanted FROM c, s UNION ALL SELECT 'mean', label, n, round_even(m, 0)::BIGINT FROM c, s WHERE n < m UNION ALL SELECT 'median', label, n, round_even(d, 0)::BIGINT FROM c, s WHERE n < d")
def _(spark, sf):
    return balance.strategy_levels(table(spark, sf, "events"), "event_type")


# ---- time series --------------------------------------------------------------------

def series(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "value")


@query("ts_noise", f"SELECT event_id, ts, round({noise_sql('event_id', 0.01)}, 4) + 0.0 AS value FROM events, {STD_SQL}")
def _(spark, sf):
    return rounded(ts.ts_noise(series(spark, sf), "ts", ["event_id"]), 4)


@query("ts_scale", "SELECT event_id, ts, round(value * 1.5, 6) AS value FROM events")
def _(spark, sf):
    return rounded(ts.ts_scale(series(spark, sf), "ts", ["event_id"], 1.5))


@query("ts_shift", "SELECT * FROM (SELECT event_id, ts, lag(value, 3) OVER (ORDER BY ts, event_id) AS value FROM events) WHERE value IS NOT NULL")
def _(spark, sf):
    return ts.ts_shift(series(spark, sf), "ts", ["event_id"], 3)


@query("ts_window_average", each("SELECT event_id, ts, round(a, 6) + 0.0 AS value FROM (SELECT event_id, ts, avg(value) OVER w AS a, count(value) OVER w AS c FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)) WHERE c = 4", ["x"]))
def _(spark, sf):
    return rounded(ts.ts_window_average(series(spark, sf), "ts", ["event_id"], 4))


@query("lag_features", "SELECT event_id, user_id, ts, value, lag(value, 1) OVER w AS value_lag_1, lag(value, 2) OVER w AS value_lag_2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return ts.lag_features(df, "ts", ["event_id"], "value", 2, ["user_id"])


@query("rolling_statistics", "SELECT event_id, ts, value, CASE WHEN c = 5 THEN round(a, 6) + 0.0 END AS value_rolling_mean, CASE WHEN c = 5 THEN round(s, 6) END AS value_rolling_std, CASE WHEN c = 5 THEN mn END AS value_rolling_min, CASE WHEN c = 5 THEN mx END AS value_rolling_max FROM ("
       "SELECT event_id, ts, value, count(value) OVER w AS c, avg(value) OVER w AS a, stddev_samp(value) OVER w AS s, min(value) OVER w AS mn, max(value) OVER w AS mx FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))")
def _(spark, sf):
    return rounded(ts.rolling_statistics(series(spark, sf), "ts", ["event_id"], "value", 5))


HOLES_SQL = "(SELECT event_id, ts, user_id, CASE WHEN event_id % 3 <> 1 THEN NULL ELSE value END AS value FROM events)"


def holes(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", "ts", "user_id", "CASE WHEN event_id % 3 <> 1 THEN NULL ELSE value END AS value")


@query("ffill", f"SELECT event_id, ts, user_id, last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM {HOLES_SQL}")
def _(spark, sf):
    return ts.ffill(holes(spark, sf), "ts", ["event_id"], ["value"])


@query("bfill", f"SELECT event_id, ts, user_id, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {HOLES_SQL}")
def _(spark, sf):
    return ts.bfill(holes(spark, sf), "ts", ["event_id"], ["value"], ["user_id"])


GAPS = "NOT (ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15')"


@query("ts_resample", "SELECT p.ts, round(avg(e.value), 6) + 0.0 AS value FROM (SELECT unnest(generate_series((SELECT min(date_trunc('week', ts)) FROM events) + INTERVAL 6 DAY, (SELECT max(date_trunc('week', ts)) FROM events) + INTERVAL 6 DAY, INTERVAL 7 DAY))::TIMESTAMP AS ts) p"
       f" LEFT JOIN (SELECT (date_trunc('week', ts) + INTERVAL 6 DAY)::TIMESTAMP AS ts, value FROM events WHERE {GAPS}) e USING (ts) GROUP BY 1")
def _(spark, sf):
    return rounded(ts.ts_resample(series(spark, sf).where(GAPS.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")), "ts", "W", ["value"]))


@query("ts_augment", "SELECT (last_day(o_orderdate))::TIMESTAMP AS o_orderdate, round(avg(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return rounded(ts.ts_augment(df, "o_orderdate", ["o_orderkey"], "resample", freq="M"), 4)


# ---- joins --------------------------------------------------------------------------

@query("join_meta_labels", "SELECT lang, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def _(spark, sf):
    return joins.join_meta_labels(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf, "labels"), "doc_id")


@query("join_category_counts", "SELECT category, coalesce(o, 0) AS original, coalesce(a, 0) AS augmented FROM (SELECT p_name AS category, count(*) AS o FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) FULL JOIN (SELECT p_name AS category, count(*) AS a FROM part WHERE p_size > 45 GROUP BY 1) USING (category)")
def _(spark, sf):
    p = table(spark, sf, "part")
    return joins.join_category_counts(p.where("p_partkey % 2 = 0"), p.where("p_size > 45"), "p_name")


@query("join_feature_intersection", "SELECT DISTINCT l_partkey AS feature FROM lineitem WHERE l_quantity > 49 AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_tax > 0.07)")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "feature")
    return joins.join_feature_intersection(li.where("l_quantity > 49").select("feature").distinct(), li.where("l_tax > 0.07"), "feature")


@query("semi_isin", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD')")
def _(spark, sf):
    return joins.semi_isin(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, sf, "customer").where("c_mktsegment = 'HOUSEHOLD'"), "c_custkey")


@query("align_before_after", "SELECT pos, original, augmented FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, value AS original FROM events WHERE event_id % 4 <> 0) FULL JOIN (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, value * 2 AS augmented FROM events) USING (pos)")
def _(spark, sf):
    e = small_events(spark, sf)
    return joins.align_before_after(e.where("event_id % 4 <> 0"), e.withColumn("value", F.col("value") * 2), "value", ["event_id"], ["event_id"])


KNN_SQL = ("SELECT id, neighbour, round(distance, 6) AS distance, rank::INT AS rank FROM (SELECT a.vec_id AS id, b.vec_id AS neighbour, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance,"
           " row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 5")


@query("knn_join", KNN_SQL)
def _(spark, sf):
    points = neighbours.vectors(table(spark, sf, "embeddings"), "vec_id", array="embedding")
    return rounded(neighbours.knn_join(points, points, 5, exclude_self=True))


PLACE_SQL = "(SELECT p_partkey AS id, p_size / 5.0::DOUBLE AS x, p_retailprice / 40.0::DOUBLE AS y FROM part)"


@query("eps_join", f'SELECT a.id AS "left", b.id AS "right", round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM {PLACE_SQL} a JOIN {PLACE_SQL} b ON a.id < b.id WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.33')
def _(spark, sf):
    points = table(spark, sf, "part").selectExpr("p_partkey AS id", "array(p_size / 5.0D, p_retailprice / 40.0D) AS x")
    return neighbours.eps_join(points, 0.33, digits=6)


# ---- comparison ---------------------------------------------------------------------

def halves(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.where("l_orderkey % 2 = 0"), li


@query("compare_numeric", "SELECT \"column\", statistic, round(b, 5) AS \"before\", round(a, 5) AS \"after\", round(a - b, 5) + 0.0 AS change FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{n}' AS statistic, {f}({c}) FILTER (l_orderkey % 2 = 0) AS b, {f}({c}) AS a FROM lineitem" for c in ("l_quantity", "l_extendedprice") for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + ")")
def _(spark, sf):
    return rounded(compare.compare_numeric(*halves(spark, sf), ["l_quantity", "l_extendedprice"]), 5)


@query("compare_relation", "SELECT measure, round(b, 5) AS \"before\", round(a, 5) AS \"after\", round(a - b, 5) + 0.0 AS change, round((a - b) / b * 100, 5) + 0.0 AS percent FROM ("
       "SELECT 'correlation' AS measure, corr(l_quantity, l_extendedprice) FILTER (l_orderkey % 2 = 0) AS b, corr(l_quantity, l_extendedprice) AS a FROM lineitem"
       " UNION ALL SELECT 'rows', (count(*) FILTER (l_orderkey % 2 = 0))::DOUBLE, count(*)::DOUBLE FROM lineitem)")
def _(spark, sf):
    return rounded(compare.compare_relation(*halves(spark, sf), "l_quantity", "l_extendedprice"), 5)


@query("compare_categories", "SELECT category, original, augmented, sb AS share_before, sa AS share_after, round(sa - sb, 2) + 0.0 AS share_change, g AS growth FROM (SELECT category, original, augmented, round(original * 100.0::DOUBLE / sum(original) OVER (), 2) AS sb,"
       " round(augmented * 100.0::DOUBLE / sum(augmented) OVER (), 2) AS sa, coalesce(round(CASE WHEN original > 0 THEN (augmented - original) * 100.0::DOUBLE / original END, 2), 0.0) AS g FROM (SELECT l_returnflag AS category, count(*) FILTER (l_orderkey % 2 = 0) AS original, count(*) AS augmented FROM lineitem GROUP BY 1))")
def _(spark, sf):
    return rounded(compare.compare_categories(*halves(spark, sf), "l_returnflag"))


DESCRIBE_SQL = ("SELECT 'l_quantity' AS \"column\", count(*) AS count, round(avg(l_quantity), 5) AS mean, round(stddev_samp(l_quantity), 5) AS std, min(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS q25,"
                " quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.75) AS q75, max(l_quantity) AS max, '{c}' AS side FROM lineitem WHERE '{c}' = 'after' OR l_orderkey % 2 = 0")


@query("compare_describe", each(DESCRIBE_SQL, ["before", "after"]))
def _(spark, sf):
    return rounded(compare.compare_describe(*halves(spark, sf), ["l_quantity"]), 5)


@query("compare_series", "SELECT min(o_orderdate) AS \"first\", max(o_orderdate) AS \"last\", round((count(*) FILTER (o_orderkey % 2 = 0) - count(*))::DOUBLE / count(*) * 100, 5) AS growth,"
       " round((avg(o_totalprice) FILTER (o_orderkey % 2 = 0) - avg(o_totalprice)) / avg(o_totalprice) * 100, 5) AS mean_change, round((stddev_samp(o_totalprice) FILTER (o_orderkey % 2 = 0) - stddev_samp(o_totalprice)) / stddev_samp(o_totalprice) * 100, 5) AS std_change FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return rounded(compare.compare_series(o, o.where("o_orderkey % 2 = 0"), "o_orderdate", "o_totalprice"), 5)


@query("growth", "SELECT count(*) FILTER (l_orderkey % 2 = 0) AS \"before\", count(*) AS \"after\", count(*) FILTER (l_orderkey % 2 <> 0) AS increase, round((count(*) FILTER (l_orderkey % 2 <> 0)) * 100.0::DOUBLE / (count(*) FILTER (l_orderkey % 2 = 0)), 6) AS percent,"
       " round(count(*)::DOUBLE / (count(*) FILTER (l_orderkey % 2 = 0)), 6) AS ratio FROM lineitem")
def _(spark, sf):
    return rounded(compare.growth(*halves(spark, sf)))


@query("histogram", each("SELECT '{c}' AS \"column\", bin, round(mn + bin * w, 6) + 0.0 AS start, count(*) AS n FROM (SELECT least(floor(({c} - mn) / w), 29)::INT AS bin, mn, w FROM lineitem, (SELECT min({c}) AS mn, (max({c}) - min({c})) / 30 AS w FROM lineitem)) GROUP BY ALL", ["l_quantity", "l_extendedprice"]))
def _(spark, sf):
    return rounded(compare.histogram(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query("box_stats", "SELECT category, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(v) AS min, max(v) AS max, min(v) FILTER (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS whisker_low,"
       " max(v) FILTER (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS whisker_high, count(*) AS n FROM (SELECT event_type AS category, value AS v FROM events) JOIN (SELECT event_type AS category, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) USING (category) GROUP BY ALL")
def _(spark, sf):
    return rounded(compare.box_stats(table(spark, sf, "events"), "value", "event_type"))


@query("scatter_points", f"SELECT event_id, user_id, value FROM (" + HOLED_EVENTS_SQL + f") WHERE value IS NOT NULL")
def _(spark, sf):
    return compare.scatter_points(holed_events(spark, sf), "user_id", "value", ["event_id"])


@query("category_shares", "SELECT event_type AS category, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM (" + HOLED_EVENTS_SQL + ") WHERE event_type IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return rounded(compare.category_shares(holed_events(spark, sf), "event_type"))
