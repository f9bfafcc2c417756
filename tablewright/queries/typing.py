"""Queries on scalar functions and on what columns hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, scalars
from ..functions.columns import name_has, rounded
from ..operators import infer, profile
from .base import each, query, table
from .profiling import HOLED_EVENTS_SQL, holed_events

SIZE = "(n_chars * n_chars * 40000)"
SIZE_SQL = ("CASE WHEN s < 1024 THEN printf('%.1f B', s::DOUBLE) WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0::DOUBLE) WHEN s < 1073741824 THEN printf('%.1f MB', s / 1048576.0::DOUBLE)"
            " WHEN s < 1099511627776 THEN printf('%.1f GB', s / 1073741824.0::DOUBLE) ELSE printf('%.1f TB', s / 1099511627776.0::DOUBLE) END")


def sizes(spark, sf):
    """Sizes from bytes to terabytes, spread by the document length."""
    return table(spark, sf, "documents").select("doc_id", F.expr("n_chars * power(10, doc_id % 9)").cast("long").alias("s"))


SIZES_SQL = "(SELECT doc_id, (n_chars * power(10, doc_id % 9))::BIGINT AS s FROM documents)"


@query("human_size", f"SELECT doc_id, {SIZE_SQL} AS size_text, CASE WHEN s < 1024 THEN printf('%d B', s) WHEN s >= 1099511627776 THEN printf('%.1f GB', s / 1073741824.0::DOUBLE) ELSE {SIZE_SQL} END AS size_whole FROM {SIZES_SQL}")
def _(spark, sf):
    return sizes(spark, sf).select("doc_id", scalars.human_size(F.col("s")).alias("size_text"), scalars.human_size_whole(F.col("s")).alias("size_whole"))


PATH_SQL = "(SELECT page_id, regexp_replace(url, '[?].*$', '') || CASE page_id % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '' ELSE '/sand_data/x.zip' END AS path FROM pages)"


def paths(spark, sf):
    tail = F.expr("CASE page_id % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '' ELSE '/sand_data/x.zip' END")
    return table(spark, sf, "pages").select("page_id", F.concat(F.regexp_replace("url", "[?].*$", ""), tail).alias("path"))


NAME_SQL = "regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1)"
SUFFIX_SQL = f"regexp_extract({NAME_SQL}, '^.+([.][^.]+)$', 1)"


@query("path_parts", f"SELECT page_id, regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)/[^/]*$', 1) AS folder_name, {NAME_SQL} AS file_name,"
       f" left({NAME_SQL}, length({NAME_SQL}) - length({SUFFIX_SQL})) AS stem, lower({SUFFIX_SQL}) AS file_type FROM {PATH_SQL}")
def _(spark, sf):
    return paths(spark, sf).select("page_id", *[e.alias(n) for n, e in scalars.path_parts(F.col("path")).items()])


@query("data_category", f"SELECT page_id, CASE WHEN contains(path, 'cctv_data') THEN 'cctv_data' WHEN contains(path, 'sand_data') THEN 'sand_data' ELSE 'other' END AS data_category FROM {PATH_SQL}")
def _(spark, sf):
    return paths(spark, sf).select("page_id", scalars.data_category(F.col("path")).alias("data_category"))


@query("file_uuid", f"SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS file_id FROM (SELECT page_id, md5(path) AS h FROM {PATH_SQL})")
def _(spark, sf):
    return paths(spark, sf).select("page_id", scalars.file_uuid(F.col("path")).alias("file_id"))


@query("size_range", "SELECT page_id, CASE WHEN mb < 10 THEN 'small' WHEN mb < 50 THEN 'medium' WHEN mb < 100 THEN 'large' ELSE 'very_large' END AS range_name,"
       " CASE WHEN mb < 10 THEN 'info' WHEN mb < 100 THEN 'warning' ELSE 'error' END AS level FROM (SELECT page_id, length(html) / 40.0::DOUBLE AS mb FROM pages)")
def _(spark, sf):
    mb = F.length("html") / F.lit(40.0)
    return table(spark, sf, "pages").select("page_id", scalars.size_range(mb).alias("r")).select("page_id", "r.range_name", "r.level")


@query("processed_name", f"SELECT page_id, stem || '_processed.png' AS png, stem || '_processed.jpg' AS jpeg, stem || '_processed' || suffix AS other FROM (SELECT page_id, left({NAME_SQL}, length({NAME_SQL}) - length({SUFFIX_SQL})) AS stem, {SUFFIX_SQL} AS suffix FROM {PATH_SQL})")
def _(spark, sf):
    p = F.col("path")
    return paths(spark, sf).select("page_id", scalars.processed_name(p, "PNG").alias("png"), scalars.processed_name(p, "JPEG").alias("jpeg"), scalars.processed_name(p, "BMP").alias("other"))


DATE_TEXT = {
    "spark": "CASE event_id % 9 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd') WHEN 1 THEN date_format(ts, 'yyyy/MM/dd HH:mm:ss') WHEN 2 THEN date_format(ts, 'MM/dd/yyyy')"
             " WHEN 3 THEN date_format(ts, 'yyyyMMdd') WHEN 4 THEN date_format(ts, 'HH:mm') WHEN 5 THEN date_format(ts, 'yyyy.MM.dd') WHEN 6 THEN concat(date_format(ts, 'yyyy-MM-dd'), 'x')"
             " WHEN 7 THEN concat(' ', date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' ') ELSE event_type END",
    "duck": "CASE event_id % 9 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y/%m/%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%m/%d/%Y')"
            " WHEN 3 THEN strftime(ts, '%Y%m%d') WHEN 4 THEN strftime(ts, '%H:%M') WHEN 5 THEN strftime(ts, '%Y.%m.%d') WHEN 6 THEN strftime(ts, '%Y-%m-%d') || 'x'"
            " WHEN 7 THEN ' ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' ELSE event_type END"}


def dated(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", F.expr(DATE_TEXT["spark"]).alias("d"))


DATED_SQL = f"(SELECT event_id, ts, {DATE_TEXT['duck']} AS d FROM events)"


@query("matches_datetime", f"SELECT event_id, event_id % 9 IN (0, 1, 2, 3, 4, 5, 7) AS hit FROM {DATED_SQL}")
def _(spark, sf):
    return dated(spark, sf).select("event_id", dates.matches_datetime(F.col("d")).alias("hit"))


@query("matches_datetime_prefix", f"SELECT event_id, event_id % 9 IN (0, 1, 2, 3, 6, 7) AS hit FROM {DATED_SQL}")
def _(spark, sf):
    return dated(spark, sf).select("event_id", dates.matches_datetime_prefix(F.col("d")).alias("hit"))


@query("parse_datetime", "SELECT event_id, CASE event_id % 9 WHEN 1 THEN date_trunc('second', ts) WHEN 7 THEN date_trunc('second', ts) WHEN 4 THEN NULL WHEN 6 THEN NULL WHEN 8 THEN NULL ELSE date_trunc('day', ts)::TIMESTAMP END AS t FROM events")
def _(spark, sf):
    return dated(spark, sf).select("event_id", dates.parse_datetime(F.col("d")).alias("t"))


@query("datetime_parts", "SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS weekday, quarter(ts)::INT AS quarter,"
       " isodow(ts) >= 6 AS is_weekend, CASE WHEN month(ts) IN (3, 4, 5) THEN 'spring' WHEN month(ts) IN (6, 7, 8) THEN 'summer' WHEN month(ts) IN (9, 10, 11) THEN 'autumn' ELSE 'winter' END AS season FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", *[e.alias(n) for n, e in dates.datetime_parts(F.col("ts")).items()])


@query("cyclical_encode", "SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_cos,"
       " round(sin(2 * pi() * month(ts) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * month(ts) / 12), 6) + 0.0 AS month_cos FROM events")
def _(spark, sf):
    h = dates.cyclical_encode(F.hour("ts"), dates.PERIODS["hour"])
    m = dates.cyclical_encode(F.month("ts"), dates.PERIODS["month"])
    return rounded(table(spark, sf, "events").select("event_id", h[0].alias("hour_sin"), h[1].alias("hour_cos"), m[0].alias("month_sin"), m[1].alias("month_cos")))


@query("label_text", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN event_type ELSE (event_id // 3)::VARCHAR || '.5' END AS label FROM events")
def _(spark, sf):
    raw = F.expr("CASE event_id % 3 WHEN 0 THEN concat(event_id, '.0') WHEN 1 THEN event_type ELSE concat(event_id div 3, '.5') END")
    return table(spark, sf, "events").select("event_id", scalars.label_text(raw).alias("label"))


@query("name_contains", each("SELECT '{c}' AS \"column\", contains('{c}', 'key') OR contains('{c}', 'price') AS hit, count(*) AS n FROM lineitem", ["l_orderkey", "l_extendedprice", "l_tax"]))
def _(spark, sf):
    cols = ["l_orderkey", "l_extendedprice", "l_tax"]
    wide = table(spark, sf, "lineitem").agg(*[F.lit(name_has(c, ["Key", "Price"])).alias(f"hit__{i}") for i, c in enumerate(cols)],
                                            *[F.count(F.lit(1)).alias(f"n__{i}") for i in range(len(cols))])
    return profile.spread_row(wide, cols, {"hit": "boolean", "n": "long"})


@query("ratio_change", "SELECT o_orderpriority, round(b - a, 4) AS change, round(CASE WHEN a = 0 THEN NULL ELSE (b - a) / a * 100 END, 4) AS percent FROM (SELECT o_orderpriority,"
       " sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS a, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS b FROM orders GROUP BY 1)")
def _(spark, sf):
    s = lambda k: F.sum(F.when(F.col("o_orderstatus") == k, F.col("o_totalprice")).otherwise(0.0))
    change, percent = scalars.ratio_change(F.col("a"), F.col("b"))
    return rounded(table(spark, sf, "orders").groupBy("o_orderpriority").agg(s("F").alias("a"), s("O").alias("b"))
                   .select("o_orderpriority", change.alias("change"), percent.alias("percent")), 4)


@query("scalar_udfs", f"SELECT page_id, CASE WHEN s < 1024 THEN printf('%.1f B', s::DOUBLE) ELSE printf('%.1f KB', s / 1024.0::DOUBLE) END AS size_text, lower({SUFFIX_SQL}) AS suffix,"
       f" CASE WHEN contains(path, 'sand_data') THEN 'sand_data' ELSE 'other' END AS category, page_id::VARCHAR AS label FROM (SELECT page_id, path, length(html) AS s FROM {PATH_SQL} JOIN pages USING (page_id))")
def _(spark, sf):
    scalars.register_functions(spark)
    base = paths(spark, sf).join(table(spark, sf, "pages").select("page_id", F.length("html").alias("s")), "page_id")
    return base.selectExpr("page_id", "tw_human_size(s) AS size_text", "tw_suffix(path) AS suffix", "tw_category(path) AS category", "tw_label(concat(page_id, '.0')) AS label")


# ---- types --------------------------------------------------------------------------

def facts_sql(source: str, texts: list[str], numbers: list[str], integral: list[str] = ()) -> str:
    """Column facts the type rules need, in one row per column."""
    def one(c, kind):
        zero_one = f"bool_and({c} IN (0, 1) OR {c} IS NULL)" if kind == "number" else "false"
        length = f"avg(length({c}))" if kind == "text" else "0.0"
        return (f"SELECT '{c}' AS \"column\", '{kind}' AS kind, {str(c in integral).lower()} AS integral, count(*)::DOUBLE AS rows, count({c})::DOUBLE AS valid, {length} AS mean_length,"
                f" {zero_one} AS zero_one, count(DISTINCT {c}) AS unique_count, (count(*) - count({c}))::DOUBLE / count(*) AS missing_ratio, count(DISTINCT {c})::DOUBLE / count(*) AS unique_ratio,"
                f" list(DISTINCT lower({c}::VARCHAR)) FILTER (lower({c}::VARCHAR) IN ('low', 'medium', 'high', 'small', 'large')) AS known_values,"
                f" (SELECT min(n)::DOUBLE / max(n) FROM (SELECT count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c})) AS balance_ratio FROM {source}")
    return " UNION ALL ".join([one(c, "text") for c in texts] + [one(c, "number") for c in numbers])


MIXED_SPARK = {
    "price": "o_totalprice", "flag": "o_orderkey % 2", "rank_no": "cast(o_orderkey % 7 as int)", "grade": "CASE o_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END",
    "status": "o_orderstatus", "label": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END", "note": "concat(repeat(o_orderpriority, 9), o_custkey)",
    "serial": "concat('n', o_orderkey)", "cust_id": "o_custkey", "order_date": "date_format(o_orderdate, 'yyyy-MM-dd')"}
MIXED_DUCK = {**MIXED_SPARK, "rank_no": "(o_orderkey % 7)::INT", "note": "repeat(o_orderpriority, 9) || o_custkey", "serial": "'n' || o_orderkey", "order_date": "strftime(o_orderdate, '%Y-%m-%d')"}
MIXED_SQL = "(SELECT o_orderkey, " + ", ".join(f"{e} AS {c}" for c, e in MIXED_DUCK.items()) + " FROM orders)"
MIXED_TEXTS = ["grade", "status", "label", "note", "serial", "order_date"]
MIXED_NUMBERS = ["price", "flag", "rank_no", "cust_id"]


def mixed(spark, sf, key: bool = False):
    """Ten columns of every type, derived from ``orders``."""
    return table(spark, sf, "orders").selectExpr(*(["o_orderkey"] if key else []), *[f"{e} AS {c}" for c, e in MIXED_SPARK.items()])


MIXED_FACTS = "(" + facts_sql(MIXED_SQL, MIXED_TEXTS, MIXED_NUMBERS, ["flag", "rank_no", "cust_id"]) + ")"
ID_SQL = "(contains(\"column\", 'id') OR contains(\"column\", 'key') OR contains(\"column\", 'index') OR contains(\"column\", 'idx') OR unique_ratio > 0.95)"
SEMANTIC_SQL = (f"CASE WHEN {ID_SQL} THEN 'id' WHEN valid = 0 OR zero_one THEN 'boolean' WHEN contains(\"column\", 'date') OR contains(\"column\", 'time') THEN 'datetime'"
                " WHEN kind = 'number' AND integral AND unique_count <= 20 THEN 'numeric_discrete' WHEN kind = 'number' THEN 'numeric_continuous' WHEN mean_length > 50 THEN 'text'"
                " WHEN unique_count <= 50 AND known_values IS NOT NULL THEN 'categorical_ordinal' ELSE 'categorical_nominal' END")


@query("semantic_type", f'SELECT "column", {SEMANTIC_SQL} AS semantic_type FROM {MIXED_FACTS}')
def _(spark, sf):
    return infer.semantic_type(mixed(spark, sf))


@query("is_id_like", f'SELECT "column", {ID_SQL} AS is_id_like FROM {MIXED_FACTS}')
def _(spark, sf):
    return infer.is_id_like(mixed(spark, sf))


@query("smart_types", f"SELECT \"column\", CASE WHEN contains(\"column\", 'id') OR contains(\"column\", 'code') OR contains(\"column\", 'type') OR contains(\"column\", 'category') OR kind <> 'number' OR unique_count <= 20 OR unique_ratio < 0.05"
       f" THEN 'categorical' ELSE 'numeric' END AS smart_type FROM {MIXED_FACTS}")
def _(spark, sf):
    return infer.smart_types(mixed(spark, sf))


def first_sql(source: str, columns: list[str], n: int) -> str:
    return each(f"(SELECT '{{c}}' AS \"column\", {{c}}::VARCHAR AS v FROM {source} WHERE {{c}} IS NOT NULL ORDER BY o_orderkey LIMIT {n})", columns)


def values_sql(source: str, columns: list[str]) -> str:
    return each(f"(SELECT '{{c}}' AS \"column\", {{c}}::VARCHAR AS v FROM {source} WHERE {{c}} IS NOT NULL)", columns)


WHOLE_SQL = "regexp_matches(trim(v), '" + "|".join(f"({p})" for p in dates.WHOLE_PATTERNS) + "')"
LEADING_SQL = "regexp_matches(trim(v), '^(" + "|".join(dates.LEADING_PATTERNS) + ")')"


@query("is_datetime_by_sample10", f"SELECT \"column\", avg(CASE WHEN {WHOLE_SQL} THEN 1.0 ELSE 0.0 END) >= 0.5 AS is_datetime FROM ({first_sql(MIXED_SQL, ['order_date', 'status', 'label'], 10)}) GROUP BY 1")
def _(spark, sf):
    return infer.is_datetime_by_sample10(mixed(spark, sf, True), ["order_date", "status", "label"], ["o_orderkey"])


@query("is_datetime_by_sample100", f"SELECT \"column\", contains(\"column\", 'date') OR avg(CASE WHEN {LEADING_SQL} THEN 1.0 ELSE 0.0 END) > 0.7 AS is_datetime FROM ({first_sql(MIXED_SQL, ['order_date', 'status', 'serial'], 100)}) GROUP BY 1")
def _(spark, sf):
    return infer.is_datetime_by_sample100(mixed(spark, sf, True), ["order_date", "status", "serial"], ["o_orderkey"])


@query("detect_date_columns", f"SELECT 'order_date' AS \"column\" UNION ALL SELECT 'o_orderdate' UNION ALL SELECT \"column\" FROM ({values_sql('(SELECT o_orderkey, o_orderstatus AS s, strftime(o_orderdate, ' + chr(39) + '%Y/%m/%d' + chr(39) + ') AS shipped FROM orders)', ['s', 'shipped'])}) GROUP BY 1 HAVING avg(CASE WHEN {LEADING_SQL} THEN 1.0 ELSE 0.0 END) >= 0.5")
def _(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderdate", "o_orderstatus AS s", "date_format(o_orderdate, 'yyyy/MM/dd') AS shipped", "o_custkey AS order_date")
    return infer.detect_date_columns(df)


MARKS_SQL = " OR ".join(f"contains(lower(v), '{m}')" for m in infer.TIME_MARKS)


@query("is_timeseries_text", f"SELECT \"column\", bool_or({MARKS_SQL}) OR (avg(CASE WHEN regexp_matches(regexp_replace(trim(v), '[.-]', '', 'g'), '^[0-9]+$') THEN 1.0 ELSE 0.0 END) > 0.8 AND count(DISTINCT v) > 10) AS is_timeseries"
       f" FROM ({values_sql(MIXED_SQL, ['grade', 'status', 'order_date', 'cust_text']).replace('cust_text::VARCHAR', 'cust_id::VARCHAR').replace('cust_text IS', 'cust_id IS')}) GROUP BY 1")
def _(spark, sf):
    df = mixed(spark, sf, True).withColumn("cust_text", F.col("cust_id").cast("string"))
    return infer.is_timeseries_text(df, ["grade", "status", "order_date", "cust_text"])


FEW_SQL = "count(DISTINCT v) <= 20 AND ((min(v::DOUBLE) = 0 AND max(v::DOUBLE) = 1) OR (count(DISTINCT v) <= 10 AND max(v::DOUBLE) - min(v::DOUBLE) <= 20))"


@query("is_categorical_number", f"SELECT \"column\", {FEW_SQL} AS is_categorical FROM ({values_sql(MIXED_SQL, MIXED_NUMBERS)}) GROUP BY 1")
def _(spark, sf):
    return infer.is_categorical_number(mixed(spark, sf, True), MIXED_NUMBERS)


@query("categorical_columns", f"SELECT \"column\" FROM ({values_sql(MIXED_SQL, MIXED_NUMBERS)}) GROUP BY 1 HAVING {FEW_SQL} UNION ALL"
       f" SELECT \"column\" FROM ({values_sql(MIXED_SQL, ['grade', 'status', 'note', 'order_date'])}) GROUP BY 1 HAVING NOT (bool_or({MARKS_SQL}) OR (avg(CASE WHEN regexp_matches(regexp_replace(trim(v), '[.-]', '', 'g'), '^[0-9]+$') THEN 1.0 ELSE 0.0 END) > 0.8 AND count(DISTINCT v) > 10))")
def _(spark, sf):
    return infer.categorical_columns(mixed(spark, sf, True).drop("label", "serial")).where("column <> 'o_orderkey'")


@query("target_is_class_like", "SELECT 'flag' AS \"column\", true AS class_like UNION ALL SELECT 'price', count(DISTINCT o_totalprice) <= 20 FROM orders UNION ALL SELECT 'rank_no', count(DISTINCT o_orderkey % 7) <= 20 FROM orders")
def _(spark, sf):
    df = mixed(spark, sf)
    out = infer.target_is_class_like(df, "flag")
    return out.unionByName(infer.target_is_class_like(df, "price")).unionByName(infer.target_is_class_like(df, "rank_no"))


@query("data_context", "SELECT CASE WHEN sum((doc_id = 0)::INT + (quality = 0)::INT + (toxic = 0)::INT)::DOUBLE / (3 * count(*)) > 0.8 THEN 'sparse' ELSE 'general' END AS context FROM labels")
def _(spark, sf):
    return infer.data_context(table(spark, sf, "labels"))


def threshold_rows_sql(context: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in infer.thresholds_for(context).items()) + ") t(name, threshold)"


RARE_SQL = "(SELECT (row_number() OVER (ORDER BY count(*) DESC)) AS r, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 20 = 0 THEN 'rare' ELSE 'usual' END AS k FROM orders) GROUP BY k)"


@query("context_thresholds", f"SELECT c.context, t.name, t.threshold FROM (SELECT CASE WHEN (SELECT n FROM {RARE_SQL} WHERE r = 1)::DOUBLE / (SELECT n FROM {RARE_SQL} WHERE r = 2) > 10 THEN 'imbalanced' ELSE 'general' END AS context) c"
       f" JOIN (SELECT 'imbalanced' AS context, * FROM ({threshold_rows_sql('imbalanced')}) UNION ALL SELECT 'general', * FROM ({threshold_rows_sql('general')})) t USING (context)")
def _(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_totalprice AS price", "CASE WHEN o_orderkey % 20 = 0 THEN 'rare' ELSE 'usual' END AS k")
    return infer.context_thresholds(df)
