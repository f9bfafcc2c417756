"""Queries on projections, filters, sorts, sets and preprocessing actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.draws import uniform
from ..operators import prep, select
from .base import PRICES, each, order_sql, query, table, uniform_sql
from .typing import PATH_SQL, paths
from .profiling import COPIED_EVENTS_SQL, HOLED_EVENTS_SQL, copied_events, holed_events


@query("drop_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, sf):
    return select.drop_columns(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"], ["o_totalprice"])


@query("drop_labels", "SELECT event_id, event_type FROM (" + HOLED_EVENTS_SQL + ") WHERE event_type NOT IN ('click', 'error') OR event_type IS NULL")
def _(spark, sf):
    return select.drop_labels(holed_events(spark, sf), "event_type", ["click", "error"]).select("event_id", "event_type")


@query("select_numeric", "SELECT p_partkey, p_size, p_retailprice FROM part")
def _(spark, sf):
    return select.select_numeric(table(spark, sf, "part"))


@query("select_categorical", "SELECT p_name, p_brand, p_type FROM part")
def _(spark, sf):
    return select.select_categorical(table(spark, sf, "part"))


@query("common_columns", "SELECT event_id, event_type, value FROM events")
def _(spark, sf):
    return select.common_columns(table(spark, sf, "events"), copied_events(spark, sf))


@query("rename_select_fields", "SELECT event_id AS id, (props->>'$.k')::BIGINT AS width FROM events")
def _(spark, sf):
    nested = table(spark, sf, "events").select("event_id", F.struct(F.from_json("props", "k long").alias("size")).alias("image"))
    return select.rename_select_fields(nested, {"event_id": "id", "image.size.k": "width"})


@query("strip_column_names", "SELECT n_name AS name, n_regionkey AS region FROM nation")
def _(spark, sf):
    return select.strip_column_names(table(spark, sf, "nation").select(F.col("n_name").alias("  name "), F.col("n_regionkey").alias("region  ")))


@query("filter_extension", f"SELECT page_id FROM {PATH_SQL} WHERE lower(regexp_extract(path, '^(?:.*/)?[^/]+([.][^./]+)$', 1)) IN ('.png', '.gz')")
def _(spark, sf):
    return select.filter_extension(paths(spark, sf), "path", [".png", ".gz", ".zip"]).select("page_id")


@query("filter_size_range", "SELECT page_id, length(html) / 20.0::DOUBLE AS mb FROM pages WHERE length(html) / 20.0::DOUBLE < 100")
def _(spark, sf):
    return select.filter_size_range(table(spark, sf, "pages").select("page_id", (F.length("html") / F.lit(20.0)).alias("mb")), "mb")


ODD_SPARK = "CASE event_id % 5 WHEN 0 THEN CAST('Infinity' AS DOUBLE) WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN CAST('-Infinity' AS DOUBLE) WHEN 3 THEN NULL ELSE value END"


@query("inf_to_null", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN value END AS v FROM events")
def _(spark, sf):
    return select.inf_to_null(table(spark, sf, "events").selectExpr("event_id", f"{ODD_SPARK} AS v"))


@query("drop_missing_rows", "SELECT * FROM (" + HOLED_EVENTS_SQL + ") WHERE value IS NOT NULL AND event_type IS NOT NULL")
def _(spark, sf):
    return select.drop_missing_rows(holed_events(spark, sf), check=True)


@query("assert_nonempty", "SELECT count(*) AS n FROM labels")
def _(spark, sf):
    return select.assert_nonempty(table(spark, sf, "labels")).agg(F.count(F.lit(1)).alias("n"))


@query("validate_target", "SELECT 'quality' AS target, 'classify' AS task, true AS valid, []::VARCHAR[] AS issues WHERE (SELECT count(DISTINCT quality) FROM labels) >= 2"
       " UNION ALL SELECT 'nothing', 'classify', false, ['target_not_found'] UNION ALL SELECT 'quality', 'regress', true, []::VARCHAR[]")
def _(spark, sf):
    df = table(spark, sf, "labels")
    return select.validate_target(df, "quality", "classify").unionByName(select.validate_target(df, "nothing", "classify")).unionByName(select.validate_target(df, "quality", "regress"))


@query("validate_limits", "SELECT count(*) AS file_count, round(sum(length(text)) * 4096 / 1048576.0::DOUBLE, 6) AS estimated_mb, list_filter([CASE WHEN count(*) > 10000 THEN 'file_count_above_limit' END,"
       " CASE WHEN sum(length(text)) * 4096 / 1048576.0::DOUBLE > 2048 THEN 'memory_above_limit' END], lambda x: x IS NOT NULL) AS issues, count(*) <= 10000 AND sum(length(text)) * 4096 / 1048576.0::DOUBLE <= 2048 AS valid FROM documents")
def _(spark, sf):
    return rounded(select.validate_limits(table(spark, sf, "documents").select((F.length("text") * 4096).alias("size")), "size"))


# ---- sorts, limits, sets ------------------------------------------------------------

@query("preview_head", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
def _(spark, sf):
    return select.preview_head(table(spark, sf, "orders"), ["o_orderkey"], 20)


@query("preview_sample", f"SELECT event_id, user_id, value FROM events ORDER BY {order_sql('event_id', 42)}, event_id LIMIT 100")
def _(spark, sf):
    return select.preview_sample(table(spark, sf, "events"), ["event_id"], 100).select("event_id", "user_id", "value")


@query("top_n_categories", each("(SELECT p_brand AS category, count(*) AS n, '{c}' AS side FROM part WHERE '{c}' = 'before' OR p_partkey % 3 <> 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)", ["before", "after"]))
def _(spark, sf):
    p = table(spark, sf, "part")
    return select.top_n_categories(p, p.where("p_partkey % 3 <> 0"), "p_brand", 5)


SORT_SPARK = "CASE WHEN p_partkey % 2 = 0 THEN cast(p_size as string) ELSE p_type END"


@query("sort_categories_numeric_aware", "SELECT category, n, row_number() OVER (ORDER BY try_cast(category AS DOUBLE) IS NULL, try_cast(category AS DOUBLE), category) AS place FROM ("
       "SELECT CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE p_type END AS category, count(*) AS n FROM part GROUP BY 1)")
def _(spark, sf):
    from pyspark.sql import Window
    counts = table(spark, sf, "part").groupBy(F.expr(SORT_SPARK).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(*select.numeric_aware("category"))     # one row per category
    return select.sort_categories_numeric_aware(counts.withColumn("place", F.row_number().over(order)), "category")


@query("sort_by_x", "SELECT p_size, p_retailprice, p_partkey FROM part ORDER BY p_size, p_partkey")
def _(spark, sf):
    return select.sort_by_x(table(spark, sf, "part").select("p_size", "p_retailprice", "p_partkey"), "p_size", "p_partkey")


SCORES_SQL = "(SELECT p_brand AS model, round(avg(p_retailprice), 4) AS score FROM part GROUP BY 1)"


def scores(spark, sf):
    return rounded(table(spark, sf, "part").groupBy(F.col("p_brand").alias("model")).agg(F.avg("p_retailprice").alias("score")), 4)


@query("best_model", f"SELECT model, score FROM {SCORES_SQL} ORDER BY score DESC, model DESC LIMIT 1")
def _(spark, sf):
    return select.best_model(scores(spark, sf))


@query("model_rank", f"SELECT model, score, row_number() OVER (ORDER BY score DESC, model) AS rank, row_number() OVER (ORDER BY score DESC, model) = 1 AS best FROM {SCORES_SQL}")
def _(spark, sf):
    return select.model_rank(scores(spark, sf))


LONG_SQL = "(SELECT p_brand AS model, p_type AS metric, round(avg(p_retailprice), 4) AS score FROM part WHERE p_brand <> 'Brand#2' OR p_type <> 'ECONOMY' GROUP BY 1, 2)"
METRICS = ["ECONOMY", "SMALL", "STANDARD"]


@query("metrics_wide", "SELECT model, " + ", ".join(f"coalesce(max(CASE WHEN metric = '{m}' THEN score END), 0.0) AS \"{m}\"" for m in METRICS) + f" FROM {LONG_SQL} GROUP BY 1")
def _(spark, sf):
    long = rounded(table(spark, sf, "part").where("p_brand <> 'Brand#2' OR p_type <> 'ECONOMY'").groupBy(F.col("p_brand").alias("model"), F.col("p_type").alias("metric"))
                   .agg(F.avg("p_retailprice").alias("score")), 4)
    return select.metrics_wide(long, METRICS)


@query("metrics_long", each("SELECT p_brand AS model, '{c}' AS metric, round({c}(p_retailprice), 4)::DOUBLE AS score FROM part GROUP BY 1", ["avg", "min", "max"]))
def _(spark, sf):
    wide = table(spark, sf, "part").groupBy(F.col("p_brand").alias("model")).agg(F.avg("p_retailprice").alias("avg"), F.min("p_retailprice").alias("min"), F.max("p_retailprice").alias("max"))
    return rounded(select.metrics_long(wide, ["avg", "min", "max"]), 4)


@query("trials_table", "SELECT event_id AS number, value, props->>'$.k' AS k, NULL::VARCHAR AS depth FROM events")
def _(spark, sf):
    return select.trials_table(table(spark, sf, "events").select(F.col("event_id").alias("number"), "value", F.col("props").alias("params")), ["k", "depth"])


@query("union_rows", COPIED_EVENTS_SQL)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    return select.union_rows(e, e.where("event_id % 10 = 0"))


@query("intersect_features", "SELECT l_partkey AS feature FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return select.intersect_features(li.where("l_quantity > 49").select(F.col("l_partkey").alias("feature")), li.where("l_discount > 0.09").select(F.col("l_partkey").alias("feature")))


@query("union_categories", "SELECT p_brand AS category FROM part WHERE p_partkey % 2 = 0 UNION SELECT p_brand FROM part WHERE p_size > 40")
def _(spark, sf):
    p = table(spark, sf, "part")
    return select.union_categories(p.where("p_partkey % 2 = 0"), p.where("p_size > 40"), "p_brand")


@query("remove_duplicates", "SELECT DISTINCT * FROM (" + COPIED_EVENTS_SQL + ")")
def _(spark, sf):
    return select.remove_duplicates(copied_events(spark, sf))


# ---- actions ------------------------------------------------------------------------

SIGNED_SQL = "(SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value - 20 END AS x FROM events)"


def signed(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value - 20 END AS x")


def _action(name: str, sql: str, run, digits: int = 6):
    @query(name, sql)
    def _(spark, sf):
        return rounded(run(signed(spark, sf)), digits)


_action("log_transform", f"SELECT event_id, round(ln(x - m + 1), 6) + 0.0 AS x FROM {SIGNED_SQL}, (SELECT min(x) AS m FROM {SIGNED_SQL})", lambda df: prep.log_transform(df, "x"))
_action("sqrt_transform", f"SELECT event_id, round(sqrt(x - m), 6) AS x FROM {SIGNED_SQL}, (SELECT min(x) AS m FROM {SIGNED_SQL})", lambda df: prep.sqrt_transform(df, "x"))
_action("log_shifted", f"SELECT event_id, round(ln(m - x + 1), 6) + 0.0 AS x FROM {SIGNED_SQL}, (SELECT max(x) AS m FROM {SIGNED_SQL})", lambda df: prep.log_shifted(df, "x"))


@query("logit_transform", "SELECT l_orderkey, l_linenumber, round(ln(p / (1 - p)), 6) + 0.0 AS l_discount FROM (SELECT *, least(greatest(l_discount, 1e-6), 1 - 1e-6) AS p FROM lineitem)")
def _(spark, sf):
    return rounded(prep.logit_transform(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), "l_discount"))


@query("arcsin_transform", "SELECT l_orderkey, l_linenumber, round(asin(sqrt(l_tax)), 6) AS l_tax FROM lineitem")
def _(spark, sf):
    return rounded(prep.arcsin_transform(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax"), "l_tax"))


@query("yeo_johnson")
def _(spark, sf):
    df, lam = prep.yeo_johnson(signed(spark, sf), "x")
    return rounded(df.withColumn("power", F.lit(lam)))


@query("box_cox")
def _(spark, sf):
    df, lam = prep.box_cox(signed(spark, sf), "x")
    return rounded(df.withColumn("power", F.lit(lam)))


CUTS_SQL = f"(SELECT max(CASE WHEN r = floor(0.05 * n) THEN x END) AS a, max(CASE WHEN r = n - 1 - floor(0.05 * n) THEN x END) AS b FROM (SELECT x, row_number() OVER (ORDER BY x) - 1 AS r, count(*) OVER () AS n FROM {SIGNED_SQL} WHERE x IS NOT NULL))"
_action("winsorize", f"SELECT event_id, round(CASE WHEN x IS NOT NULL THEN least(greatest(x, a), b) END, 6) + 0.0 AS x FROM {SIGNED_SQL}, {CUTS_SQL}", lambda df: prep.winsorize(df, "x"))
Q_SQL = f"(SELECT quantile_cont(x::DOUBLE, 0.25) AS q1, quantile_cont(x::DOUBLE, 0.5) AS q2, quantile_cont(x::DOUBLE, 0.75) AS q3, quantile_cont(x::DOUBLE, 0.01) AS low, quantile_cont(x::DOUBLE, 0.99) AS high, avg(x) AS m, stddev_pop(x) AS s, min(x) AS mn, max(x) AS mx FROM {SIGNED_SQL})"
_action("clip_quantiles", f"SELECT event_id, round(CASE WHEN x IS NOT NULL THEN least(greatest(x, low), high) END, 6) + 0.0 AS x FROM {SIGNED_SQL}, {Q_SQL}", lambda df: prep.clip_quantiles(df, ["x"]))
_action("outlier_iqr", f"SELECT event_id, round(x, 6) AS x, coalesce(x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1), false) AS outlier FROM {SIGNED_SQL}, {Q_SQL}", lambda df: prep.outlier_iqr(df, "x"))
_action("outlier_zscore", f"SELECT event_id, round(x, 6) AS x, coalesce(abs(x - m) / s > 3, false) AS outlier FROM {SIGNED_SQL}, {Q_SQL}", lambda df: prep.outlier_zscore(df, "x"))
_action("scale_robust", f"SELECT event_id, round((x - q2) / (q3 - q1), 6) + 0.0 AS x FROM {SIGNED_SQL}, {Q_SQL}", lambda df: prep.scale_robust(df, ["x"]))
_action("scale_standard", f"SELECT event_id, round((x - m) / s, 6) + 0.0 AS x FROM {SIGNED_SQL}, {Q_SQL}", lambda df: prep.scale_standard(df, ["x"]))
_action("scale_minmax", f"SELECT event_id, round((x - mn) / (mx - mn), 6) + 0.0 AS x FROM {SIGNED_SQL}, {Q_SQL}", lambda df: prep.scale_minmax(df, ["x"]))
_action("impute_mean", f"SELECT event_id, round(coalesce(x, m), 6) + 0.0 AS x FROM {SIGNED_SQL}, {Q_SQL}", lambda df: prep.impute_mean(df, ["x"]))
_action("impute_median", f"SELECT event_id, round(coalesce(x, q2), 6) + 0.0 AS x FROM {SIGNED_SQL}, {Q_SQL}", lambda df: prep.impute_median(df, ["x"]))


@query("impute_mode", "SELECT event_id, coalesce(event_type, (SELECT event_type FROM (" + HOLED_EVENTS_SQL + ") WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type FROM (" + HOLED_EVENTS_SQL + ")")
def _(spark, sf):
    return prep.impute_mode(holed_events(spark, sf).select("event_id", "event_type"), ["event_type"])


@query("impute_iterative")
def _(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity", "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice", "l_tax")
    return rounded(prep.impute_iterative(df, ["l_quantity", "l_extendedprice", "l_tax"]), 4)


@query("encode_binary", "SELECT l_orderkey, l_linenumber, l_linestatus, CASE l_linestatus WHEN (SELECT min(l_linestatus) FROM lineitem) THEN 0 ELSE 1 END AS l_linestatus_binary FROM lineitem")
def _(spark, sf):
    return prep.encode_binary(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus"), "l_linestatus")


@query("encode_onehot", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"(l_returnflag = '{v}')::INT AS l_returnflag_{v}" for v in "ANR") + " FROM lineitem")
def _(spark, sf):
    return prep.encode_onehot(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag")


@query("encode_ordinal", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_name) - 1)::DOUBLE AS p_name FROM part")
def _(spark, sf):
    return prep.encode_ordinal(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name")


@query("encode_label", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS o_orderpriority FROM orders")
def _(spark, sf):
    return prep.encode_label(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query("encode_target", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 4) AS o_orderpriority FROM orders")
def _(spark, sf):
    return rounded(prep.encode_target(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice").select("o_orderkey", "o_orderpriority"), 4)


@query("lookup_encode", "SELECT c_custkey, n_name AS c_nationkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf):
    return prep.lookup_encode(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", table(spark, sf, "nation"), "n_nationkey", "n_name")


@query("encode_hash")
def _(spark, sf):
    return prep.encode_hash(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", 16)


@query("drop_constant", "SELECT event_id, value FROM events")
def _(spark, sf):
    return prep.drop_constant(table(spark, sf, "events").selectExpr("event_id", "value", "1.0D AS one", "100 + (event_id % 2) * 0.01D AS near", "'a' AS letter"), 0.02)


@query("select_low_variance", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(spark, sf):
    return prep.select_low_variance(table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax"), ["l_quantity", "l_discount", "l_tax"])


@query("drop_missing_columns", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS some FROM events")
def _(spark, sf):
    return prep.drop_missing_columns(table(spark, sf, "events").selectExpr("event_id", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS some", "CASE WHEN event_id % 5 = 0 THEN value END AS most"))


@query("drop_collinear", "SELECT l_orderkey, l_quantity, l_tax FROM lineitem")
def _(spark, sf):
    return prep.drop_collinear(table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_quantity", "l_tax", "l_quantity * 2 + l_tax AS twice"))


@query("apply_advice", f"SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) + 0.0 AS l_quantity, round(sqrt(l_extendedprice), 6) AS l_extendedprice, "
       + ", ".join(f"(l_returnflag = '{v}')::INT AS l_returnflag_{v}" for v in "ANR") + " FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_tax")
    out, _ = prep.apply_advice(df, [("l_quantity", "standard_scaler"), ("l_extendedprice", "sqrt_transform"), ("l_returnflag", "one_hot_encode"), ("l_tax", "drop_column"), ("l_tax", "log_transform"), ("l_quantity", "kde_estimation")])
    return rounded(out)


@query("clean_features", "SELECT event_id, round(CASE WHEN event_id % 5 = 4 THEN value ELSE (SELECT avg(value) FROM events WHERE event_id % 5 = 4) END, 6) AS v FROM events")
def _(spark, sf):
    return rounded(prep.impute_mean(select.inf_to_null(table(spark, sf, "events").selectExpr("event_id", f"{ODD_SPARK} AS v")), ["v"]))


@query("isolation_forest")
def _(spark, sf):
    from ..operators.isolation import isolation_forest
    return rounded(isolation_forest(table(spark, sf, "events").select("event_id", "user_id", "value"), ["event_id"]))


PART_SQL = "(SELECT p_partkey, p_size::DOUBLE AS p_size, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice, sqrt((p_partkey * 7919 % 10007)::DOUBLE) AS lot FROM part)"
UNIT_SQL = f"(SELECT p_partkey, p_retailprice, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS x, (lot - avg(lot) OVER ()) / stddev_pop(lot) OVER () AS y FROM {PART_SQL})"


@query("impute_knn", f"SELECT p.p_partkey, p.p_size, round(coalesce(p.p_retailprice, n.m), 4) AS p_retailprice, round(p.lot, 4) AS lot FROM {PART_SQL} p LEFT JOIN (SELECT id, avg(v) AS m FROM (SELECT a.p_partkey AS id, b.p_retailprice AS v,"
       f" row_number() OVER (PARTITION BY a.p_partkey ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.p_partkey) AS r FROM {UNIT_SQL} a, {UNIT_SQL} b WHERE a.p_retailprice IS NULL AND b.p_retailprice IS NOT NULL) WHERE r <= 5 GROUP BY id) n ON n.id = p.p_partkey")
def _(spark, sf):
    from ..operators.neighbours import impute_knn
    df = table(spark, sf, "part").selectExpr("p_partkey", "cast(p_size as double) AS p_size", "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice", "sqrt(cast(p_partkey * 7919 % 10007 as double)) AS lot")
    return rounded(impute_knn(df, "p_partkey", ["p_size", "p_retailprice", "lot"]), 4)
