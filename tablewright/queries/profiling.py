"""Queries on counts, statistics and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import profile as p
from .base import PRICES, each, query, table

# Missing values and copies injected the same way on both sides.
HOLED_EVENTS_SQL = ("SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,"
                    " CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS event_type FROM events")
COPIED_EVENTS_SQL = ("SELECT event_id, event_type, value FROM events UNION ALL"
                     " SELECT event_id, event_type, value FROM events WHERE event_id % 10 = 0")


def holed_events(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "user_id", F.expr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END").alias("value"),
        F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END").alias("event_type"))


def copied_events(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    return e.unionByName(e.where("event_id % 10 = 0"))


@query("value_counts", "SELECT event_type AS value, count(*) AS n FROM (" + HOLED_EVENTS_SQL + ") WHERE event_type IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return p.value_counts(holed_events(spark, sf), "event_type")


@query("null_info", each("SELECT '{c}' AS \"column\", count({c}) AS non_null_count, count(*) - count({c}) AS null_count,"
                         " CASE '{c}' WHEN 'value' THEN 'double' WHEN 'event_type' THEN 'string' ELSE 'bigint' END AS dtype"
                         " FROM (" + HOLED_EVENTS_SQL + ")", ["event_id", "user_id", "value", "event_type"]))
def _(spark, sf):
    return p.null_info(holed_events(spark, sf))


@query("missing_ratio", each("SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_ratio"
                             " FROM (" + HOLED_EVENTS_SQL + ")", ["event_id", "user_id", "value", "event_type"])
       + " UNION ALL SELECT '_table', round((avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) + avg(CASE WHEN event_type IS NULL THEN 1.0 ELSE 0.0 END)) / 4, 6)"
       " FROM (" + HOLED_EVENTS_SQL + ")")
def _(spark, sf):
    return rounded(p.missing_ratio(holed_events(spark, sf)))


@query("duplicate_count", "SELECT (n - d)::BIGINT AS duplicates, round((n - d) / n, 6) AS duplicate_ratio FROM (SELECT (SELECT count(*) FROM ("
       + COPIED_EVENTS_SQL + "))::DOUBLE AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM (" + COPIED_EVENTS_SQL + ")))::DOUBLE AS d)")
def _(spark, sf):
    return rounded(p.duplicate_count(copied_events(spark, sf)))


@query("distinct_count", each("SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c})::DOUBLE / count(*), 6) AS unique_ratio"
                              " FROM (" + HOLED_EVENTS_SQL + ")", ["event_id", "user_id", "value", "event_type"]))
def _(spark, sf):
    return rounded(p.distinct_count(holed_events(spark, sf)))


@query("column_info", each("SELECT '{c}' AS \"column\", CASE '{c}' WHEN 'value' THEN 'double' ELSE 'bigint' END AS dtype, count(DISTINCT {c}) AS unique_count,"
                           " count(*) - count({c}) AS missing_count, round(min({c}), 6)::DOUBLE AS min, round(max({c}), 6)::DOUBLE AS max, round(avg({c}), 6) AS mean"
                           " FROM (" + HOLED_EVENTS_SQL + ")", ["event_id", "user_id", "value"])
       + " UNION ALL SELECT 'event_type', 'string', count(DISTINCT event_type), count(*) - count(event_type), NULL, NULL, NULL FROM (" + HOLED_EVENTS_SQL + ")")
def _(spark, sf):
    return rounded(p.column_info(holed_events(spark, sf)))


@query("describe", each("SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 7) AS mean, round(stddev_samp({c}), 7) AS std, round(min({c}), 7) AS min,"
                        " round(quantile_cont({c}, 0.25), 7) AS q25, round(quantile_cont({c}, 0.5), 7) AS q50, round(quantile_cont({c}, 0.75), 7) AS q75,"
                        " round(max({c}), 7) AS max FROM lineitem", PRICES))
def _(spark, sf):
    return rounded(p.describe(table(spark, sf, "lineitem"), PRICES), 7)


@query("categorical_summary", each(
    "SELECT '{c}' AS \"column\", (SELECT count(DISTINCT {c}) FROM orders) AS unique_count, m.v AS mode, m.n AS mode_count,"
    " (SELECT count(*) - count({c}) FROM orders) AS missing_count FROM (SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS r"
    " FROM orders GROUP BY {c}) m WHERE r = 1", ["o_orderstatus", "o_orderpriority"]))
def _(spark, sf):
    return p.categorical_summary(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


SHAPE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def shape_sql(source: str, columns: list[str]) -> str:
    """Facts of ``distribution_profile`` per column."""
    return each(
        "SELECT '{c}' AS \"column\", s.n, s.rows, s.missing_ratio, s.mean, s.std, CASE WHEN s.mean = 0 THEN 'Infinity'::DOUBLE ELSE abs(s.std / s.mean) END AS cv,"
        " s.skew, s.kurt, s.mn AS min, s.q1, s.q3, s.mx AS max,"
        " (SELECT avg(CASE WHEN {c} < s.q1 - 1.5 * (s.q3 - s.q1) OR {c} > s.q3 + 1.5 * (s.q3 - s.q1) THEN 1.0 ELSE 0.0 END) FROM " + source + " WHERE {c} IS NOT NULL) AS outlier_ratio,"
        " s.u AS unique_count, s.u::DOUBLE / s.n AS unique_ratio, abs(s.skew) < 0.5 AND abs(s.kurt) < 1 AS is_normal, s.u::DOUBLE / s.n > 0.8 AS is_uniform,"
        " coalesce(f.f1 / f.f2 > 0.5 AND f.f1 / f.f2 < 2 AND f.f2 / f.f3 > 2, false) AS is_bimodal,"
        " coalesce(f.f1 / f.f2 > 0.3 AND f.f1 / f.f2 < 3 AND f.f2 / f.f3 > 0.3 AND f.f2 / f.f3 < 3, false) AS is_multimodal"
        " FROM (SELECT count({c})::DOUBLE AS n, count(*)::DOUBLE AS rows, 1 - count({c})::DOUBLE / count(*) AS missing_ratio, avg({c})::DOUBLE AS mean, stddev_samp({c})::DOUBLE AS std,"
        " skewness({c})::DOUBLE AS skew, kurtosis({c})::DOUBLE AS kurt, min({c})::DOUBLE AS mn, max({c})::DOUBLE AS mx, quantile_cont({c}::DOUBLE, 0.25) AS q1,"
        " quantile_cont({c}::DOUBLE, 0.75) AS q3, count(DISTINCT {c}) AS u FROM " + source + ") s,"
        " (SELECT max(CASE WHEN r = 1 THEN n END)::DOUBLE AS f1, max(CASE WHEN r = 2 THEN n END)::DOUBLE AS f2, max(CASE WHEN r = 3 THEN n END)::DOUBLE AS f3"
        " FROM (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC) AS r FROM " + source + " WHERE {c} IS NOT NULL GROUP BY {c})) f", columns)


def rounded_sql(inner: str, doubles: list[str], digits: int = 6) -> str:
    return "SELECT * REPLACE (" + ", ".join(f"round({d}, {digits}) AS {d}" for d in doubles) + ") FROM (" + inner + ")"


SHAPE_DOUBLES = ["n", "rows", "missing_ratio", "mean", "std", "cv", "skew", "kurt", "min", "q1", "q3", "max", "outlier_ratio", "unique_ratio"]


@query("distribution_profile", rounded_sql(shape_sql("lineitem", PRICES), SHAPE_DOUBLES, 7))
def _(spark, sf):
    return rounded(p.distribution_profile(table(spark, sf, "lineitem"), PRICES), 7)


@query("frequency_peaks", each(
    "SELECT '{c}' AS \"column\", f1, f2, f3, coalesce(f1::DOUBLE / f2 > 0.5 AND f1::DOUBLE / f2 < 2 AND f2::DOUBLE / f3 > 2, false) AS is_bimodal,"
    " coalesce(f1::DOUBLE / f2 > 0.3 AND f1::DOUBLE / f2 < 3 AND f2::DOUBLE / f3 > 0.3 AND f2::DOUBLE / f3 < 3, false) AS is_multimodal FROM ("
    "SELECT max(CASE WHEN r = 1 THEN n END) AS f1, max(CASE WHEN r = 2 THEN n END) AS f2, max(CASE WHEN r = 3 THEN n END) AS f3 FROM ("
    "SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC) AS r FROM lineitem GROUP BY {c}))",
    ["l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_suppkey"]))
def _(spark, sf):
    return p.frequency_peaks(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_suppkey"])


@query("range_iqr", each("SELECT '{c}' AS \"column\", round(max({c}) - min({c}), 6) AS range, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr FROM lineitem", PRICES))
def _(spark, sf):
    return rounded(p.range_iqr(table(spark, sf, "lineitem"), PRICES))


@query("skew_population", each(
    "SELECT '{c}' AS \"column\", round(g, 6) AS skew, CASE WHEN g > 1 THEN 'right' WHEN g < -1 THEN 'left' END AS direction FROM ("
    "SELECT skewness({c}) * (count(*) - 2) / sqrt(count(*)::DOUBLE * (count(*) - 1)) AS g FROM events)", ["value", "user_id"]))
def _(spark, sf):
    return rounded(p.skew_population(table(spark, sf, "events"), ["value", "user_id"]))


@query("outlier_counts", each(
    "SELECT '{c}' AS \"column\", n AS outliers, round(100.0::DOUBLE * n / t, 6) AS percent FROM (SELECT count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n,"
    " count(*) AS t FROM events, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM events)) WHERE n > 0", ["value", "user_id"]))
def _(spark, sf):
    return rounded(p.outlier_counts(table(spark, sf, "events"), ["value", "user_id"]))


@query("dominant_value", each("SELECT '{c}' AS \"column\", round(max(n)::DOUBLE / sum(n), 6) AS share, max(n)::DOUBLE / sum(n) > 0.7 AS dominant FROM (SELECT count(*) AS n FROM lineitem GROUP BY {c})",
                              ["l_returnflag", "l_linestatus", "l_linenumber"]))
def _(spark, sf):
    return rounded(p.dominant_value(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]))


@query("data_quality_summary",
       "SELECT round(m, 6) AS missing_percent, round(d, 6) AS duplicate_percent,"
       " list_filter([CASE WHEN m > 10 THEN 'missing_above_10_percent' END, CASE WHEN d > 5 THEN 'duplicates_above_5_percent' END], lambda x: x IS NOT NULL) AS issues FROM ("
       "SELECT 0.0::DOUBLE AS m, 100.0::DOUBLE * (n - u) / n AS d FROM (SELECT (SELECT count(*) FROM (" + COPIED_EVENTS_SQL + ")) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM (" + COPIED_EVENTS_SQL + "))) AS u))")
def _(spark, sf):
    return rounded(p.data_quality(copied_events(spark, sf)))


@query("corr_matrix", each("SELECT '{c}' AS \"left\", '{c}' AS \"right\", 1.0::DOUBLE AS r", PRICES) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT '{a}', '{b}', round(corr({a}, {b}), 6) + 0.0 FROM lineitem" for a in PRICES for b in PRICES if a != b))
def _(spark, sf):
    return rounded(p.corr_matrix(table(spark, sf, "lineitem"), PRICES))


@query("corr_high_pairs", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS pair, '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS r FROM lineitem" for i, (a, b) in enumerate(p.column_pairs(PRICES))) + ") WHERE abs(r) > 0.7")
def _(spark, sf):
    return rounded(p.corr_high_pairs(table(spark, sf, "lineitem"), 0.7, PRICES))


@query("column_pairs", " UNION ALL ".join(
    f"SELECT {i} AS pair, '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) + 0.0 AS r FROM part" for i, (a, b) in enumerate(p.column_pairs(["p_partkey", "p_size", "p_retailprice"]))))
def _(spark, sf):
    return rounded(p.corr_pairs(table(spark, sf, "part")))


@query("corr_embedding", "SELECT ((a * (127 - a)) // 2 + b - a - 1)::INT AS pair, 'e' || a AS \"left\", 'e' || b AS \"right\", round(corr(embedding[a + 1]::DOUBLE, embedding[b + 1]::DOUBLE), 6) + 0.0 AS r"
       " FROM embeddings, (SELECT unnest(range(64)) AS a), (SELECT unnest(range(64)) AS b) WHERE a < b GROUP BY a, b")
def _(spark, sf):
    names = [f"e{i}" for i in range(64)]
    return rounded(p.corr_pairs(table(spark, sf, "embeddings").select(*[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names)]), names))


@query("corr_pair", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def _(spark, sf):
    return rounded(p.corr_pair(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


@query("corr_dayofyear", "SELECT 'before' AS side, round(corr(dayofyear(o_orderdate), o_totalprice), 6) AS r FROM orders"
       " UNION ALL SELECT 'after', round(corr(dayofyear(o_orderdate), o_totalprice), 6) FROM orders WHERE o_orderkey % 3 <> 0")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return rounded(p.corr_dayofyear(o, o.where("o_orderkey % 3 <> 0"), "o_orderdate", "o_totalprice"))


@query("group_mean", "SELECT o_orderpriority AS category, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def _(spark, sf):
    return rounded(p.group_mean(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"), 4)


@query("class_balance", each("SELECT '{c}' AS \"column\", round(min(n)::DOUBLE / max(n), 6) AS balance_ratio,"
                             " coalesce(count(*) < 10 AND max(n)::DOUBLE / (array_agg(n ORDER BY n DESC))[2] > 10, false) AS imbalanced FROM (SELECT count(*) AS n FROM orders GROUP BY {c})",
                             ["o_orderstatus", "o_orderpriority", "o_custkey"]))
def _(spark, sf):
    return rounded(p.class_balance(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"]))


@query("zero_ratio", "SELECT round((sum((doc_id = 0)::INT) + sum((quality = 0)::INT) + sum((toxic = 0)::INT))::DOUBLE / (3 * count(*)), 6) AS zero_ratio,"
       " (sum((doc_id = 0)::INT) + sum((quality = 0)::INT) + sum((toxic = 0)::INT))::DOUBLE / (3 * count(*)) > 0.8 AS sparse FROM labels")
def _(spark, sf):
    return rounded(p.zero_ratio(table(spark, sf, "labels")))


@query("text_length_stats", each("SELECT '{c}' AS \"column\", round(avg(length({c})), 6) AS mean_length, max(length({c})) AS max_length, min(length({c})) AS min_length,"
                                 " round(stddev_samp(length({c})), 6) AS std_length FROM documents", ["text", "lang", "source"]))
def _(spark, sf):
    return rounded(p.text_length_stats(table(spark, sf, "documents"), ["text", "lang", "source"]))


@query("length_consistency", each("SELECT '{c}' AS \"column\", round(s / m, 6) AS length_cv, s / m > 0.5 AS inconsistent FROM (SELECT stddev_samp(length({c})) AS s, avg(length({c})) AS m FROM documents)",
                                  ["text", "lang", "source"]))
def _(spark, sf):
    return rounded(p.length_consistency(table(spark, sf, "documents"), ["text", "lang", "source"]))


def datetime_profile_sql(source: str, column: str, ts: str) -> str:
    return (f"SELECT '{column}' AS \"column\", date_diff('microsecond', min(t), max(t)) // 86400000000 AS date_range_days, count(DISTINCT year(t)) AS unique_years,"
            " count(DISTINCT month(t)) AS unique_months, count(DISTINCT day(t)) AS unique_days, count(DISTINCT hour(t)) AS unique_hours,"
            " date_diff('microsecond', min(t), max(t)) // 86400000000 > 30 AS is_timeseries, count(DISTINCT hour(t)) > 1 AS has_time_component,"
            f" round(count(t)::DOUBLE / count(*), 6) AS success_rate FROM (SELECT {ts} AS t FROM {source})")


@query("datetime_profile", datetime_profile_sql("events", "ts", "ts") + " UNION ALL "
       + datetime_profile_sql("events", "day", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE date_trunc('day', ts) END"))
def _(spark, sf):
    e = table(spark, sf, "events")
    day = F.expr("CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE date_format(ts, 'yyyy-MM-dd') END")
    return rounded(p.datetime_profile(e.select("ts", day.alias("day")), ["ts", "day"]))
