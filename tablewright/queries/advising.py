"""Queries on rule-driven advice."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import advice
from ..plans.rules import Section, rules_load, rules_table
from .base import PRICES, each, query, table
from .profiling import COPIED_EVENTS_SQL, copied_events, datetime_profile_sql, shape_sql
from .typing import (ID_SQL, MIXED_FACTS, MIXED_NUMBERS, MIXED_SQL, MIXED_TEXTS, SEMANTIC_SQL, facts_sql, mixed)


def duck(predicate: str) -> str:
    """A rule predicate in DuckDB's spelling."""
    out = predicate.replace("lower(column)", 'lower("column")')
    return re.sub(r"arrays_overlap\((\w+), array\(([^)]*)\)\)", r"list_has_any(\1, [\2])", out)


def outcomes_sql(section: Section) -> str:
    def found(rule):
        return "[" + ", ".join("{'action': '%s', 'why': '%s'}" % (a, rule.why) for a in rule.actions) + "]"
    if section.take == "first":
        return "CASE " + " ".join(f"WHEN {duck(r.when)} THEN {found(r)}" for r in section.rules) + " ELSE [] END"
    return "list_concat(" + ", ".join([f"CASE WHEN {duck(r.when)} THEN {found(r)} ELSE [] END" for r in section.rules] + ["[]"]) + ")"


def advice_sql(facts: str, sections, distinct: bool = False, keep: str = "") -> str:
    found = "list_concat(" + ", ".join([outcomes_sql(s) for s in sections] + ["[]"]) + ")"
    if distinct:
        found = f"list_filter({found}, lambda x, i: list_position(list_transform({found}, lambda y: y.action), x.action) = i)"
    return (f'SELECT "column", position::INT AS position, found[position].action AS action, found[position].why AS why{keep} FROM ('
            f'SELECT *, unnest(generate_series(1, len(found))) AS position FROM (SELECT *, {found} AS found FROM ({facts})))')


def pick(rules, group: str, *names: str):
    return tuple(s for s in rules[group] if s.name in names)


def only(rules, group: str, *names: str):
    return {group: pick(rules, group, *names)}


RULES, CHARTS = rules_load("preprocess"), rules_load("charts")

# Numbers of many shapes, derived from ``events``; holes of five sizes.
SHAPES = {
    "spend": "value", "spend_rate": "value * value * value", "flat": "1000 + (event_id % 2) * 10", "near_flat": "100 + (event_id % 5)", "serial": "event_id",
    "two_peaks": "CASE WHEN event_id % 20 < 9 THEN 1 WHEN event_id % 20 < 18 THEN 2 ELSE 3 END", "status_no": "user_id % 6", "signed": "(event_id % 201) - 100",
    "m60": "CASE WHEN event_id % 100 < 60 THEN NULL ELSE value END", "m40": "CASE WHEN event_id % 100 < 40 THEN NULL ELSE value END",
    "m20": "CASE WHEN event_id % 100 < 20 THEN NULL ELSE value END", "m10": "CASE WHEN event_id % 100 < 10 THEN NULL ELSE value END",
    "m2": "CASE WHEN event_id % 100 < 2 THEN NULL ELSE value END"}
SHAPES_SQL = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in SHAPES.items()) + " FROM events)"


def shapes(spark, sf):
    return table(spark, sf, "events").selectExpr(*[f"{e} AS {c}" for c, e in SHAPES.items()])


SHAPE_FACTS = f"(SELECT *, {len(SHAPES)} AS dimensions FROM (" + shape_sql(SHAPES_SQL, list(SHAPES)) + "))"
CATEGORY_FACTS = facts_sql(MIXED_SQL, MIXED_TEXTS[:5], [])


@query("rules_load", " UNION ALL ".join(
    f"SELECT '{g}' AS \"group\", '{s.name}' AS section, '{s.take}' AS take, {i + 1} AS position, length('{r.when.replace(chr(39), chr(39) * 2)}') AS size, {len(r.actions)} AS actions, '{r.why}' AS why, (SELECT count(*) FROM events) AS rows"
    for g, sections in RULES.items() for s in sections for i, r in enumerate(s.rules)))
def _(spark, sf):
    # each rule of the default set beside the size of the table it is to be used on
    rows = table(spark, sf, "events").agg(F.count(F.lit(1)).alias("rows")).first()["rows"]
    return rules_table(spark, rules_load("preprocess")).select("group", "section", "take", "position", F.length("when").alias("size"),
                                                              F.size("actions").alias("actions"), "why", F.lit(rows).alias("rows"))


def _number_query(name: str, *sections: str):
    @query(name, advice_sql(SHAPE_FACTS, pick(RULES, "numeric", *sections)))
    def _(spark, sf):
        return advice.advise_numbers(shapes(spark, sf), only(RULES, "numeric", *sections))


for _name, _sections in [("advise_missing_numeric", ["missing"]), ("advise_distribution", ["distribution"]), ("advise_variance", ["variance"]),
                         ("advise_outlier", ["outlier"]), ("advise_scaling", ["scaling"]), ("advise_domain_numeric", ["domain"])]:
    _number_query(_name, *_sections)


def _category_query(name: str, *sections: str):
    @query(name, advice_sql(CATEGORY_FACTS, pick(RULES, "categorical", *sections)))
    def _(spark, sf):
        return advice.advise_categories(mixed(spark, sf), only(RULES, "categorical", *sections), MIXED_TEXTS[:5])


for _name, _sections in [("advise_missing_categorical", ["missing"]), ("advise_encoding", ["encoding"]), ("advise_ordinal_values", ["ordinal_values"])]:
    _category_query(_name, *_sections)


NAMED_SQL = "(SELECT o_orderkey, o_orderpriority AS priority_desc, o_orderstatus AS status_code, o_orderpriority AS plain FROM orders)"


@query("advise_text_name", advice_sql(facts_sql(NAMED_SQL, ["priority_desc", "status_code", "plain"], []), pick(RULES, "categorical", "text_name")))
def _(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderpriority AS priority_desc", "o_orderstatus AS status_code", "o_orderpriority AS plain")
    return advice.advise_categories(df, only(RULES, "categorical", "text_name"), df.columns)


DATE_FACTS = datetime_profile_sql("events", "ts", "ts") + " UNION ALL " + datetime_profile_sql("events", "day", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE date_trunc('day', ts) END") \
    + " UNION ALL " + datetime_profile_sql("events", "late", "CASE WHEN event_id % 2 = 0 THEN ts ELSE ts + INTERVAL 800 DAY END")


def date_shapes(spark, sf):
    return table(spark, sf, "events").select(
        "ts", F.expr("CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE date_format(ts, 'yyyy-MM-dd') END").alias("day"),
        F.expr("CASE WHEN event_id % 2 = 0 THEN ts ELSE ts + INTERVAL 800 DAY END").alias("late"))


@query("advise_datetime", advice_sql(DATE_FACTS, RULES["datetime"]))
def _(spark, sf):
    return advice.advise_dates(date_shapes(spark, sf), RULES, ["ts", "day", "late"])


TRIPLED_SQL = "(SELECT source, text, lang FROM documents UNION ALL SELECT source, text, lang FROM documents WHERE doc_id % 5 = 0)"


@query("advise_quality", f"SELECT '_data_quality' AS \"column\", row_number() OVER ()::INT AS position, action, why FROM ("
       f"SELECT 'remove_duplicates' AS action, 'high_duplicate_ratio' AS why WHERE (SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {TRIPLED_SQL})))::DOUBLE / count(*) FROM {TRIPLED_SQL}) > 0.1 UNION ALL "
       + each("SELECT 'data_cleaning', 'inconsistent_data_patterns' WHERE (SELECT stddev_samp(length({c})) / avg(length({c})) > 0.5 FROM " + TRIPLED_SQL + ")", ["source", "text", "lang"]) + ")")
def _(spark, sf):
    d = table(spark, sf, "documents").select("source", "text", "lang", "doc_id")
    return advice.advise_quality(d.unionByName(d.where("doc_id % 5 = 0")).drop("doc_id"), RULES)


@query("advise_collinear", "SELECT '_feature_selection' AS \"column\", 1 AS position, 'remove_collinear' AS action, 'high_correlation_collinearity' AS why"
       " WHERE (SELECT greatest(abs(corr(p_partkey, p_retailprice)), abs(corr(p_partkey, p_size)), abs(corr(p_size, p_retailprice))) FROM part) > 0.95")
def _(spark, sf):
    return advice.advise_collinear(table(spark, sf, "part"), RULES)


MIXED_DATE_FACTS = datetime_profile_sql("orders", "order_date", "date_trunc('day', o_orderdate)::TIMESTAMP")
MIXED_SHAPES = "(SELECT *, 4 AS dimensions FROM (" + shape_sql(MIXED_SQL, MIXED_NUMBERS) + "))"
STRONGEST_SQL = "(SELECT max(abs(r)) FROM (" + " UNION ALL ".join(
    f"SELECT corr({a}, {b}) AS r FROM {MIXED_SQL}" for i, a in enumerate(MIXED_NUMBERS) for b in MIXED_NUMBERS[i + 1:]) + "))"
UNEVEN_SQL = " UNION ALL ".join(f"SELECT 'data_cleaning' AS action, 'inconsistent_data_patterns' AS why WHERE (SELECT stddev_samp(length({c})) / avg(length({c})) > 0.5 FROM {MIXED_SQL})" for c in MIXED_TEXTS)

PREPROCESSING_SQL = (
    advice_sql(MIXED_SHAPES, RULES["numeric"]) + " UNION ALL " + advice_sql(facts_sql(MIXED_SQL, MIXED_TEXTS[:5], []), RULES["categorical"])
    + " UNION ALL " + advice_sql(MIXED_DATE_FACTS, RULES["datetime"])
    + f" UNION ALL SELECT '_feature_selection', 1, 'remove_collinear', 'high_correlation_collinearity' WHERE {STRONGEST_SQL} > 0.95"
    + f" UNION ALL SELECT '_data_quality', row_number() OVER ()::INT, action, why FROM (SELECT 'remove_duplicates' AS action, 'high_duplicate_ratio' AS why WHERE false UNION ALL {UNEVEN_SQL})")


@query("advise_preprocessing", PREPROCESSING_SQL)
def _(spark, sf):
    return advice.advise_preprocessing(mixed(spark, sf), ["price", "serial"])


# ---- charts -------------------------------------------------------------------------

def named_sql(facts: str) -> str:
    words = [r.when for s in CHARTS["numeric"] if s.name == "domain" for r in s.rules]
    return f"(SELECT *, {' OR '.join(duck(w) for w in words)} AS named FROM {facts})"


@query("chart_numeric", advice_sql(named_sql(SHAPE_FACTS), CHARTS["numeric"], distinct=True))
def _(spark, sf):
    return advice.chart_numeric(shapes(spark, sf))


@query("chart_categorical", advice_sql(CATEGORY_FACTS, CHARTS["categorical"]))
def _(spark, sf):
    return advice.chart_categorical(mixed(spark, sf), MIXED_TEXTS[:5])


@query("chart_datetime", advice_sql(DATE_FACTS, CHARTS["datetime"]))
def _(spark, sf):
    return advice.chart_datetime(date_shapes(spark, sf), ["ts", "day", "late"])


@query("chart_correlation", advice_sql("SELECT '_correlation' AS \"column\", greatest(abs(corr(p_partkey, p_retailprice)), abs(corr(p_partkey, p_size)), abs(corr(p_size, p_retailprice))) AS strongest, 3 AS dimensions FROM part", CHARTS["correlation"]))
def _(spark, sf):
    return advice.chart_correlation(table(spark, sf, "part"))


@query("chart_distribution", advice_sql("SELECT '_distribution' AS \"column\", count(*) AS rows, 8 AS dimensions FROM lineitem", CHARTS["distribution"]))
def _(spark, sf):
    return advice.chart_distribution(table(spark, sf, "lineitem"))


CHARTS_SQL = (advice_sql(named_sql(MIXED_SHAPES), CHARTS["numeric"], distinct=True) + " UNION ALL " + advice_sql(facts_sql(MIXED_SQL, MIXED_TEXTS[:5], []), CHARTS["categorical"])
              + " UNION ALL " + advice_sql(MIXED_DATE_FACTS, CHARTS["datetime"])
              + " UNION ALL " + advice_sql(f"SELECT '_correlation' AS \"column\", {STRONGEST_SQL} AS strongest, 4 AS dimensions", CHARTS["correlation"])
              + " UNION ALL " + advice_sql("SELECT '_distribution' AS \"column\", count(*) AS rows, 4 AS dimensions FROM orders", CHARTS["distribution"]))


@query("advise_charts", CHARTS_SQL)
def _(spark, sf):
    return advice.advise_charts(mixed(spark, sf), ["price", "serial"])


TABLE_SQL = ("SELECT \"column\", a[1] AS \"primary\", coalesce(a[2], '-') AS secondary, CASE WHEN len(a) > 2 THEN array_to_string(a[3:], ', ') ELSE 'None' END AS additional FROM ("
             "SELECT \"column\", list(action ORDER BY position) AS a FROM (" + advice_sql(SHAPE_FACTS, RULES["numeric"]) + ") GROUP BY 1)")


@query("advice_table", TABLE_SQL)
def _(spark, sf):
    return advice.advice_table(advice.advise_numbers(shapes(spark, sf), RULES))


@query("advice_final", "SELECT (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY avg(o_totalprice) DESC, 1 DESC LIMIT 1) AS model,"
       " (SELECT action FROM (" + advice_sql(SHAPE_FACTS, RULES["numeric"]) + ") WHERE position = 1 AND \"column\" = 'spend') AS preprocessing,"
       " (SELECT action FROM (" + advice_sql(named_sql(SHAPE_FACTS), CHARTS["numeric"], distinct=True) + ") WHERE position = 1 AND \"column\" = 'spend') AS chart")
def _(spark, sf):
    scores = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.avg("o_totalprice").alias("score"))
    df = shapes(spark, sf)
    return advice.advice_final(scores, advice.advise_numbers(df, RULES), advice.chart_numeric(df), df.columns)


FIRST, IMPROVED, SIMPLE, TYPED = rules_load("first"), rules_load("improved"), rules_load("simple"), rules_load("by_type")


LOPSIDED = ["spend", "spend_rate", "two_peaks", "m60", "m40", "m20", "m10", "m2"]   # clearly skewed: no test at exactly zero


@query("advise_any_mode", advice_sql("(" + shape_sql(SHAPES_SQL, LOPSIDED) + ")", FIRST["numeric"]))
def _(spark, sf):
    return advice.advise_any_mode(shapes(spark, sf).select(*LOPSIDED), FIRST)


# without the evenly split flag: its skew is exactly zero, which is the limit of the any-of rules
@query("custom_rules", advice_sql("(" + shape_sql(MIXED_SQL, ["price", "rank_no", "cust_id"]) + ")", IMPROVED["numeric"]) + " UNION ALL " + advice_sql(facts_sql(MIXED_SQL, MIXED_TEXTS, []), IMPROVED["categorical"]))
def _(spark, sf):
    return advice.advise_any_mode(mixed(spark, sf).drop("flag"), rules_load("improved"))


@query("advise_simple", advice_sql(
    f"SELECT f.*, s.strongest FROM {MIXED_SHAPES} f LEFT JOIN (SELECT \"column\", max(abs(r)) AS strongest FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS \"column\", corr({a}, {b}) AS r FROM {MIXED_SQL}" for a in MIXED_NUMBERS for b in MIXED_NUMBERS if a != b) + ") GROUP BY 1) s USING (\"column\")", SIMPLE["numeric"], distinct=True)
    + " UNION ALL " + advice_sql(facts_sql(MIXED_SQL, MIXED_TEXTS, []), SIMPLE["categorical"]))
def _(spark, sf):
    return advice.advise_simple(mixed(spark, sf))


def typed_sql(context: str) -> str:
    from ..operators.infer import thresholds_for
    limits = ", ".join(f"{v}::DOUBLE AS {k}" for k, v in thresholds_for(context).items())
    return (f"SELECT *, semantic_type IN ('numeric_continuous', 'numeric_discrete') AS numeric, semantic_type IN ('categorical_nominal', 'categorical_ordinal') AS categorical, semantic_type <> 'id' AND unique_count > 1 AS plain,"
            f" '{context}' AS context, {limits}, CASE WHEN unique_count <= 1 OR missing_ratio > missing_high THEN 'high' WHEN missing_ratio > missing_medium THEN 'medium' ELSE 'low' END AS priority FROM ("
            f"SELECT t.*, s.cv, s.skew, s.kurt, s.outlier_ratio FROM (SELECT *, {SEMANTIC_SQL} AS semantic_type FROM {MIXED_FACTS}) t LEFT JOIN (SELECT \"column\", cv, skew, kurt, outlier_ratio FROM {MIXED_SHAPES}) s USING (\"column\"))")


TYPED_SQL = typed_sql("timeseries")
BY_TYPE_SQL = f'SELECT "column", position, action, semantic_type, priority, context FROM ({advice_sql(TYPED_SQL, TYPED["column"], keep=", semantic_type, priority, context")})'


@query("advise_by_type", BY_TYPE_SQL)
def _(spark, sf):
    return advice.advise_by_type(mixed(spark, sf))


@query("advise_global", "SELECT '_global' AS \"column\", 1 AS position, 'multicollinearity_detection_vif' AS action, 'correlation' AS why"
       " WHERE (SELECT greatest(abs(corr(p_partkey, p_retailprice)), abs(corr(p_partkey, p_size)), abs(corr(p_size, p_retailprice))) FROM part) > 0.95")
def _(spark, sf):
    return advice.advise_global(table(spark, sf, "part"))


@query("advice_priority", f'SELECT "column", priority FROM ({TYPED_SQL})')
def _(spark, sf):
    return advice.advice_priority(mixed(spark, sf))


@query("advice_summary", f"SELECT 10 AS total_columns, count(DISTINCT \"column\") FILTER (priority = 'high') AS high, count(DISTINCT \"column\") FILTER (priority = 'medium') AS medium, count(DISTINCT \"column\") FILTER (priority = 'low') AS low, []::VARCHAR[] AS high_priority FROM ({BY_TYPE_SQL})")
def _(spark, sf):
    return advice.advice_summary(mixed(spark, sf))


@query("advice_sorted", f"SELECT \"column\", position, action, priority, CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS priority_order FROM ({BY_TYPE_SQL})")
def _(spark, sf):
    return advice.advice_sorted(mixed(spark, sf))


@query("charts_univariate", advice_sql(TYPED_SQL, TYPED["univariate"]))
def _(spark, sf):
    return advice.charts_univariate(mixed(spark, sf))


PAIR_FACTS = ("SELECT 'size / price' AS \"column\", 1 AS pair, 'numeric_numeric' AS relation, true AS few, corr(p_size, p_size * 2.0::DOUBLE + p_partkey % 7) AS r FROM part UNION ALL "
              + " UNION ALL ".join(f"SELECT '{g} / {n}', {2 + 2 * i + j}, 'categorical_numeric', count(DISTINCT {g}) <= 10, NULL FROM (SELECT p_brand AS brand, p_type AS type, p_name AS item FROM part)"
                                   for i, g in enumerate(["brand", "type", "item"]) for j, n in enumerate(["size", "price"]))
              + " UNION ALL " + " UNION ALL ".join(f"SELECT '{a} / {b}', {8 + i}, 'categorical_categorical', count(DISTINCT {a}) <= 10 AND count(DISTINCT {b}) <= 10, NULL FROM (SELECT p_brand AS brand, p_type AS type, p_name AS item FROM part)"
                                                    for i, (a, b) in enumerate([("brand", "type"), ("brand", "item"), ("type", "item")])))


@query("charts_bivariate", f"SELECT \"column\", position, action AS chart, pair, relation, round(r, 6) AS r FROM ({advice_sql(PAIR_FACTS, TYPED['bivariate'], keep=', pair, relation, r')})")
def _(spark, sf):
    df = table(spark, sf, "part").selectExpr("cast(p_size as double) AS size", "p_size * 2.0D + p_partkey % 7 AS price", "p_brand AS brand", "p_type AS type", "p_name AS item")
    return rounded(advice.charts_bivariate(df))


@query("top_pairs", "SELECT \"left\", \"right\", round(r, 6) AS r FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS pair, '{a}' AS \"left\", '{b}' AS \"right\", corr({a}, {b}) AS r FROM lineitem" for i, (a, b) in enumerate(
        (a, b) for i, a in enumerate(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *PRICES]) for b in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *PRICES][i + 1:])) + ") ORDER BY abs(r) DESC, pair LIMIT 10")
def _(spark, sf):
    from ..operators.profile import corr_pairs
    return rounded(corr_pairs(table(spark, sf, "lineitem")).orderBy(F.abs("r").desc(), "pair").limit(10).select("left", "right", "r"))


@query("charts_multivariate", advice_sql(f"SELECT '_multivariate' AS \"column\", count(*) FILTER (numeric) AS numbers, 'timeseries' AS context FROM ({TYPED_SQL})", TYPED["multivariate"]))
def _(spark, sf):
    return advice.charts_multivariate(mixed(spark, sf))


@query("charts_quality", advice_sql(f"SELECT '_data_quality' AS \"column\", count(*) FILTER (numeric) AS numbers, max(missing_ratio) AS missing_cells, 0 AS duplicates FROM ({TYPED_SQL})", TYPED["quality"]))
def _(spark, sf):
    return advice.charts_quality(mixed(spark, sf))


@query("insight_report", "SELECT 1::INT AS quality_issues, o::INT AS outlier_columns, s::INT AS shape_notes, list_filter(['review_missing_value_handling', 'compare_imputation_with_row_removal',"
       " CASE WHEN o > 0 THEN 'analyse_outlier_causes' END, CASE WHEN o > 0 THEN 'review_data_collection' END, CASE WHEN s > 0 THEN 'consider_transformation' END, CASE WHEN s > 0 THEN 'try_log_or_normalisation' END], lambda x: x IS NOT NULL) AS steps FROM ("
       "SELECT (SELECT count(*) FROM (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events), LATERAL (SELECT count(*) AS n FROM events WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) WHERE n > 0) AS o,"
       " (SELECT count(*) FROM (SELECT skewness(value) * (count(*) - 2) / sqrt(count(*)::DOUBLE * (count(*) - 1)) AS g FROM events) WHERE abs(g) > 1)"
       " + (SELECT count(*) FROM (SELECT max(n)::DOUBLE / sum(n) AS share FROM (SELECT count(*) AS n FROM events GROUP BY event_type)) WHERE share > 0.7) AS s)")
def _(spark, sf):
    return advice.insight_report(copied_and_back(spark, sf), ["value"], ["event_type"])


def copied_and_back(spark, sf):
    """``events`` with a column that is missing throughout, so that missing cells exceed ten percent."""
    return table(spark, sf, "events").select("event_id", "value", "event_type", F.lit(None).cast("string").alias("blank"))
