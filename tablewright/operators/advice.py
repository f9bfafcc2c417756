"""Preprocessing and chart advice: facts from the profile, outcomes from the rule files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import date_columns, numeric_columns, text_columns
from ..plans.rules import RuleSet, advise, known_words, outcomes, rules_load
from ..session import side_by_side, written
from . import infer
from .profile import (column_pairs, corr_pairs, datetime_profile, distribution_profile, duplicate_count, length_consistency, literal_rows)

RESULT = "column string, position int, action string, why string"


def nothing(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], RESULT)


def number_facts(df: DataFrame, columns: list[str] | None = None, compat: bool = False) -> DataFrame:
    """Distribution facts with ``dimensions`` (numeric columns; rows if ``compat``)."""
    cols = columns if columns is not None else numeric_columns(df)
    facts = distribution_profile(df, cols, signed_cv=compat)
    return facts.withColumn("dimensions", F.col("n") if compat else F.lit(len(numeric_columns(df))))


def split_texts(df: DataFrame, keys: list[str]) -> tuple[list[str], list[str]]:
    """Text columns as (categories, dates)."""
    texts = text_columns(df)
    if not texts:
        return [], []
    dated = {r["column"] for r in infer.is_datetime_text(df, texts).where("is_datetime").collect()}     # one row per column
    return [c for c in texts if c not in dated], [c for c in texts if c in dated]


def strongest_correlation(df: DataFrame) -> float | None:
    if len(numeric_columns(df)) < 2:
        return None
    return corr_pairs(df).agg(F.max(F.abs("r")).alias("r")).first()["r"]


def advise_numbers(df: DataFrame, rules: RuleSet, columns=None, compat: bool = False) -> DataFrame:
    return advise(number_facts(df, columns, compat), rules["numeric"])


def advise_categories(df: DataFrame, rules: RuleSet, columns: list[str]) -> DataFrame:
    if not columns:
        return nothing(df)
    facts = infer.column_facts(df, known_words(rules) or infer.ORDINAL_WORDS, columns)
    return advise(facts, rules["categorical"])


def advise_dates(df: DataFrame, rules: RuleSet, columns: list[str]) -> DataFrame:
    if not columns or "datetime" not in rules:
        return nothing(df)
    return advise(datetime_profile(df, columns), rules["datetime"])


def advise_quality(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Duplicate advice, then one cleaning entry per text column of uneven length."""
    ratio = duplicate_count(df).first()["duplicate_ratio"]
    texts = text_columns(df)
    uneven = length_consistency(df, texts).where("inconsistent").count() if texts else 0
    facts = literal_rows(df.sparkSession, [{"column": "_data_quality", "duplicate_ratio": ratio, "inconsistent_columns": uneven, "inconsistent_ratio": uneven / len(texts) if texts else 0.0}],
                         "column string, duplicate_ratio double, inconsistent_columns int, inconsistent_ratio double")
    found = F.concat(*[outcomes(s) for s in rules["data_quality"]],
                     F.array_repeat(F.struct(F.lit("data_cleaning").alias("action"), F.lit("inconsistent_data_patterns").alias("why")),
                                    F.col("inconsistent_columns")))
    return (facts.select("column", F.posexplode(found).alias("place", "rule"))
            .select("column", (F.col("place") + 1).alias("position"), "rule.action", "rule.why"))


def advise_collinear(df: DataFrame, rules: RuleSet) -> DataFrame:
    facts = literal_rows(df.sparkSession, [{"column": "_feature_selection", "strongest": strongest_correlation(df)}],
                         "column string, strongest double")
    return advise(facts, rules["feature_selection"])


def advise_preprocessing(df: DataFrame, keys: list[str], rules: RuleSet | None = None, compat: bool = False) -> DataFrame:
    """All preprocessing advice for a table: (column, position, action, why)."""
    rules = rules or rules_load("preprocess")
    routed, numbers = _routed(df, keys, lambda c: advise_categories(df, rules, c), lambda d: advise_dates(df, rules, d)), numeric_columns(df)
    jobs = [(True, routed), (bool(numbers), lambda: advise_numbers(df, rules, compat=compat)), ("data_quality" in rules, lambda: advise_quality(df, rules)),
            ("feature_selection" in rules, lambda: advise_collinear(df, rules))]
    return _together([job for wanted, job in jobs if wanted])


def _routed(df: DataFrame, keys: list[str], categories, dates):
    """Advice on text columns by what they hold, and on date columns."""
    def job() -> DataFrame:
        texts, dated = split_texts(df, keys)
        return _together([lambda: categories(texts), lambda: dates([*dated, *date_columns(df)])])
    return job


def _together(jobs: list) -> DataFrame:
    """The jobs' advice as one table. They pass over the table side by side, and each part is written, so that no part
    waits for another or is worked out twice."""
    out = None
    for part in side_by_side([lambda job=job: written(job()) for job in jobs]):
        out = part if out is None else out.unionByName(part)
    return out


# ---- charts -------------------------------------------------------------------------

def chart_numeric(df: DataFrame, rules: RuleSet | None = None, columns: list[str] | None = None) -> DataFrame:
    """Charts per number, first mention kept."""
    rules = rules or rules_load("charts")
    domain = [r.when for s in rules["numeric"] if s.name.startswith("domain") for r in s.rules]
    named = F.expr(" or ".join(f"({w})" for w in domain)) if domain else F.lit(False)
    facts = number_facts(df, columns).withColumn("named", named)
    return advise(facts, rules["numeric"], distinct=True)


def chart_categorical(df: DataFrame, columns: list[str], rules: RuleSet | None = None) -> DataFrame:
    return advise_categories(df, rules or rules_load("charts"), columns)


def chart_datetime(df: DataFrame, columns: list[str], rules: RuleSet | None = None) -> DataFrame:
    return advise_dates(df, rules or rules_load("charts"), columns)


def chart_correlation(df: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    facts = literal_rows(df.sparkSession, [{"column": "_correlation", "strongest": strongest_correlation(df), "dimensions": len(numeric_columns(df))}],
                         "column string, strongest double, dimensions int")
    return advise(facts, (rules or rules_load("charts"))["correlation"])


def chart_distribution(df: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    facts = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("_distribution").alias("column"), "rows", F.lit(len(numeric_columns(df))).alias("dimensions"))
    return advise(facts, (rules or rules_load("charts"))["distribution"])


def advise_charts(df: DataFrame, keys: list[str], rules: RuleSet | None = None) -> DataFrame:
    """All chart advice for a table."""
    rules = rules or rules_load("charts")
    routed = _routed(df, keys, lambda c: chart_categorical(df, c, rules), lambda d: chart_datetime(df, d, rules))
    numbers = [lambda: chart_numeric(df, rules)] if numeric_columns(df) else []
    return _together([routed, *numbers, lambda: chart_correlation(df, rules), lambda: chart_distribution(df, rules)])


# ---- presentation -------------------------------------------------------------------

def advice_table(advice: DataFrame) -> DataFrame:
    """First, second and the remaining actions per column."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("position", "action"))), lambda x: x["action"])
    packed = advice.groupBy("column").agg(ordered.alias("a"))   # a handful of actions per column
    rest = F.slice("a", 3, F.greatest(F.size("a") - 2, F.lit(0)))
    return packed.select("column", F.get("a", F.lit(0)).alias("primary"), F.coalesce(F.get("a", F.lit(1)), F.lit("-")).alias("secondary"),
                         F.when(F.size("a") > 2, F.array_join(rest, ", ")).otherwise("None").alias("additional"))


def advice_final(scores: DataFrame, preprocessing: DataFrame, charts: DataFrame, order: list[str]) -> DataFrame:
    """Best model with the first preprocessing action and the first chart of the first advised column.

    ``scores`` has (model, score); ``order`` lists the table's columns."""
    best = scores.agg(F.max_by("model", F.struct("score", "model")).alias("m")).first()["m"]
    rank = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("column"))

    def lead(advice):
        row = advice.where("position = 1").where(rank > 0).agg(F.min_by("action", rank).alias("a")).first()
        return (row["a"] if row else None) or "N/A"
    return literal_rows(scores.sparkSession, [{"model": best, "preprocessing": lead(preprocessing), "chart": lead(charts)}],
                        "model string, preprocessing string, chart string")


# ---- older engines ------------------------------------------------------------------

def advise_any_mode(df: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Numbers and texts under a rule set in the older any-of reading."""
    rules = rules or rules_load("first")
    out = advise_numbers(df, rules)
    texts = text_columns(df)
    return out.unionByName(advise_categories(df, rules, texts)) if texts else out


def advise_simple(df: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Fixed-threshold advice, with each number's strongest correlation to any other number."""
    rules = rules or rules_load("simple")
    cols = numeric_columns(df)
    pairs = corr_pairs(df, cols)
    both = pairs.select(F.col("left").alias("column"), "r").unionByName(pairs.select(F.col("right").alias("column"), "r"))
    strongest = both.groupBy("column").agg(F.max(F.abs("r")).alias("strongest"))
    facts = number_facts(df, cols).join(F.broadcast(strongest), "column", "left")
    out = advise(facts, rules["numeric"], distinct=True)
    texts = text_columns(df)
    return out.unionByName(advise_categories(df, rules, texts)) if texts else out


def typed_facts(df: DataFrame) -> tuple[DataFrame, str]:
    """Typed profile with the context and its thresholds as columns."""
    context = infer.context_of(df)
    facts = infer.typed_profile(df).withColumn("context", F.lit(context))
    return facts.withColumns({k: F.lit(v) for k, v in infer.thresholds_for(context).items()}), context


def advice_priority(df: DataFrame) -> DataFrame:
    """high: constant or mostly missing; medium: much missing; else low."""
    facts, _ = typed_facts(df)
    return facts.select("column", _priority().alias("priority"))


def _priority():
    return (F.when((F.col("unique_count") <= 1) | (F.col("missing_ratio") > F.col("missing_high")), "high")
            .when(F.col("missing_ratio") > F.col("missing_medium"), "medium").otherwise("low"))


def advise_by_type(df: DataFrame) -> DataFrame:
    """Advice by semantic type: (column, position, action, semantic_type, priority, context)."""
    facts, _ = typed_facts(df)
    extra = facts.select("column", "semantic_type", _priority().alias("priority"), "context")
    return advise(facts, rules_load("by_type")["column"]).drop("why").join(F.broadcast(extra), "column")


def advise_global(df: DataFrame) -> DataFrame:
    context = infer.context_of(df)
    limits = infer.thresholds_for(context)
    facts = literal_rows(df.sparkSession, [{"column": "_global", "strongest": strongest_correlation(df), "context": context,
                                            "correlation_very_high": limits["correlation_very_high"]}],
                         "column string, strongest double, context string, correlation_very_high double")
    return advise(facts, rules_load("by_type")["global"])


def advice_summary(df: DataFrame) -> DataFrame:
    """Column count, columns per priority, and all high-priority columns with their first two actions."""
    advice = advise_by_type(df)
    per = advice.groupBy("column", "priority").agg(
        F.slice(F.transform(F.sort_array(F.collect_list(F.struct("position", "action"))), lambda x: x["action"]), 1, 2).alias("a"))
    ids = F.array(*[F.lit(c) for c in df.columns])
    text = F.struct(F.array_position(ids, F.col("column")).alias("i"), F.concat(F.col("column"), F.lit(": "), F.array_join("a", ", ")).alias("t"))
    high = F.transform(F.sort_array(F.collect_list(F.when(F.col("priority") == "high", text))), lambda x: x["t"])
    return per.agg(F.lit(len(df.columns)).alias("total_columns"), *[F.count_if(F.col("priority") == p).alias(p) for p in ("high", "medium", "low")],
                   high.alias("high_priority"))


def advice_sorted(df: DataFrame) -> DataFrame:
    """One row per action, high priority first."""
    order = F.array_position(F.array(*[F.lit(p) for p in ("high", "medium", "low")]), F.col("priority")) - 1
    columns = F.array_position(F.array(*[F.lit(c) for c in df.columns]), F.col("column"))
    return (advise_by_type(df).select("column", "position", "action", "priority", order.alias("priority_order"))
            .orderBy("priority_order", columns, "position"))


def charts_univariate(df: DataFrame) -> DataFrame:
    facts, _ = typed_facts(df)
    return advise(facts, rules_load("by_type")["univariate"])


def charts_bivariate(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Charts per pair of columns, numbered: number pairs, category-number pairs, category pairs; all, or the first ``limit``."""
    facts, _ = typed_facts(df)
    rows = {r["column"]: r for r in facts.select("column", "numeric", "categorical", "unique_count").collect()}
    numbers = [c for c in df.columns if rows[c]["numeric"]]
    groups = [c for c in df.columns if rows[c]["categorical"]]
    few = lambda *cs: all(rows[c]["unique_count"] <= 10 for c in cs)
    wanted = ([(a, b, "numeric_numeric", True) for a, b in column_pairs(numbers)]
              + [(g, n, "categorical_numeric", few(g)) for g in groups for n in numbers]
              + [(a, b, "categorical_categorical", few(a, b)) for a, b in column_pairs(groups)])[:limit]
    used = list(dict.fromkeys(c for a, b, rel, _ in wanted if rel == "numeric_numeric" for c in (a, b)))
    r = {(x["left"], x["right"]): x["r"] for x in corr_pairs(df, used).collect()} if used else {}
    pairs = literal_rows(df.sparkSession, [
        {"column": f"{a} / {b}", "pair": i + 1, "relation": rel, "few": f, "r": r.get((a, b))} for i, (a, b, rel, f) in enumerate(wanted)],
        "column string, pair int, relation string, few boolean, r double")
    charts = advise(pairs, rules_load("by_type")["bivariate"]).drop("why").withColumnRenamed("action", "chart")
    return charts.join(F.broadcast(pairs.select("column", "pair", "relation", "r")), "column")


def charts_multivariate(df: DataFrame) -> DataFrame:
    facts, context = typed_facts(df)
    row = facts.agg(F.lit("_multivariate").alias("column"), F.count_if(F.col("numeric")).alias("numbers")).withColumn("context", F.lit(context))
    return advise(row, rules_load("by_type")["multivariate"])


def charts_quality(df: DataFrame) -> DataFrame:
    facts, _ = typed_facts(df)
    duplicates = duplicate_count(df).first()["duplicates"]
    row = facts.agg(F.lit("_data_quality").alias("column"), F.count_if(F.col("numeric")).alias("numbers"),
                    F.max("missing_ratio").alias("missing_cells")).withColumn("duplicates", F.lit(duplicates))
    return advise(row, rules_load("by_type")["quality"])


def insight_report(df: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """Quality issues, outlier columns, skewed or dominated columns, and the steps they call for."""
    from .profile import data_quality, dominant_value, outlier_counts, skew_population
    issues = data_quality(df).select(F.array_size("issues").alias("n")).first()["n"]
    outliers = outlier_counts(df, numbers).count() if numbers else 0
    shapes = (skew_population(df, numbers).where("direction is not null").count() if numbers else 0) \
        + (dominant_value(df, categories).where("dominant").count() if categories else 0)
    facts = literal_rows(df.sparkSession, [{"quality_issues": issues, "outlier_columns": outliers, "shape_notes": shapes}],
                         "quality_issues int, outlier_columns int, shape_notes int")
    steps = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(s)) for c, s in [
        ("quality_issues", "review_missing_value_handling"), ("quality_issues", "compare_imputation_with_row_removal"),
        ("outlier_columns", "analyse_outlier_causes"), ("outlier_columns", "review_data_collection"),
        ("shape_notes", "consider_transformation"), ("shape_notes", "try_log_or_normalisation")]]))
    return facts.withColumn("steps", steps)
