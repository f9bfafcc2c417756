"""Rule files and their evaluation.

A rule file holds groups (``numeric``, ``categorical`` ...), each with sections in order.
A section takes the ``first`` rule that holds or ``every`` rule that holds. A rule is
``[condition, action or list of actions, reason]``; the condition is a SQL predicate over
the facts of a column, so all rules of a group become one expression.

Files that give conditions as maps (``{gt: 0.5, action: drop, why: ...}``) are read too.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, functions as F

RULESETS = Path(__file__).parent / "rulesets"
OUTCOME = "array<struct<action:string,why:string>>"


@dataclass(frozen=True)
class Rule:
    when: str
    actions: tuple[str, ...]
    why: str


@dataclass(frozen=True)
class Section:
    name: str
    take: str
    rules: tuple[Rule, ...]


RuleSet = dict[str, tuple[Section, ...]]

# What each key of a condition map means; {v} is its value, {m} the fact the section is about.
CONDITIONS = {
    "gt": "{m} > {v}", "lte": "{m} <= {v}", "skew": "abs(skew) > {v}", "skew_lt": "{s} < {v}", "kurt": "kurt > {v}", "kurt_lt": "kurt < {v}",
    "cv_gt": "cv > {v}", "cv_lt": "cv < {v}", "outlier_ratio_gt": "outlier_ratio > {v}", "outlier_ratio_lt": "outlier_ratio < {v}",
    "unique_ratio_gt": "unique_ratio > {v}", "unique_lt": "unique_count < {v}", "dimensions_gt": "dimensions > {v}",
    "is_bimodal": "is_bimodal", "is_multimodal": "is_multimodal", "is_normal": "is_normal", "is_uniform": "is_uniform",
    "balance_ratio_lt": "balance_ratio < {v}", "duplicate_ratio_gt": "duplicate_ratio > {v}", "inconsistent_ratio_gt": "inconsistent_ratio > {v}",
    "correlation_gt": "strongest > {v}", "data_size_gt": "rows > {v}", "feature_count_gt": "dimensions > {v}",
    "days_gt": "date_range_days > {v}", "hours_gt": "unique_hours > {v}",
}
SECTION_FACT = {"missing_ratio": "missing_ratio", "cardinality": "unique_count", "cardinality_strategy": "unique_count"}
EVERY = {"text_processing", "text_specific", "ordinal_analysis", "balance_analysis", "outlier_visualization", "data_size_analysis",
         "correlation_analysis", "distribution_shape", "data_quality", "feature_selection", "timeseries_analysis"}


def text_literal(value: str) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def condition_sql(section: str, condition: dict, join: str = "and") -> str:
    """Predicate of one condition map; ``join='or'`` gives the older any-of reading of skew and kurtosis."""
    fact = SECTION_FACT.get(section, section)
    parts = []
    for key, value in condition.items():
        if key == "name_contains":
            parts.append(f"contains(lower(column), {text_literal(str(value).lower())})")
        elif key == "values_contain":
            parts.append("arrays_overlap(known_values, array(" + ", ".join(text_literal(v) for v in value) + "))")
        elif key in CONDITIONS:
            signed = "skew" if isinstance(value, (int, float)) and value < 0 else "abs(skew)"
            parts.append(CONDITIONS[key].format(m=fact, v=value, s=signed))
        else:
            raise ValueError(f"section {section!r}: condition {key!r} is not known")
    if join == "or" and ("skew" in condition or "kurt" in condition):
        rest = {k: v for k, v in condition.items() if k not in ("skew", "kurt")}
        either = f"abs(skew) > {condition.get('skew', 0)} or kurt > {condition.get('kurt', 1e9)}"
        return f"({either}) and {condition_sql(section, rest)}" if rest else either
    return " and ".join(parts) or "true"


def _actions(value) -> tuple[str, ...]:
    return tuple(str(v) for v in value) if isinstance(value, list) else (str(value),)


def _section(name: str, body, join: str) -> Section:
    if isinstance(body, dict):
        rules = tuple(Rule(str(w).lower() if isinstance(w, bool) else w, _actions(a), str(why)) for w, a, why in body["rules"])
        return Section(name, body.get("take", "first"), rules)
    rules = []
    for item in body:
        outcome = [item[k] for k in ("action", "chart", "primary_chart", "secondary_chart") if k in item]
        test = {k: v for k, v in item.items() if k not in ("action", "chart", "primary_chart", "secondary_chart", "why")}
        rules.append(Rule(condition_sql(name, test, join), _actions(outcome), str(item["why"])))
    take = "every" if name in EVERY else "first"
    if "scaling" in name and rules:      # the last scaling rule is the fallback
        rules.append(Rule("true", rules[-1].actions, rules[-1].why))
    return Section(name, take, tuple(rules))


def rules_load(path: str | Path | None = None, join: str = "and") -> RuleSet:
    """Read a rule file; a bare name picks one of the shipped sets (default ``preprocess``)."""
    path = Path(path or "preprocess")
    if not path.exists():
        path = RULESETS / f"{path.name}.yaml"
    raw = yaml.safe_load(path.read_text(encoding="utf-8"))
    out: RuleSet = {}
    for group, body in raw.items():
        sections = body.items() if isinstance(body, dict) else [(group, body)]
        try:
            out[group] = tuple(_section(name, s, join) for name, s in sections
                               if isinstance(s, dict) or (isinstance(s, list) and s and isinstance(s[0], dict)))
        except ValueError as error:
            raise ValueError(f"{path}, group {group!r}, {error}") from error
    return out


def known_words(rules: RuleSet) -> list[str]:
    """Category values any rule asks about."""
    import re
    texts = [r.when for sections in rules.values() for s in sections for r in s.rules if "known_values" in r.when]
    return sorted({w for t in texts for w in re.findall(r"'([^']*)'", t.split("known_values", 1)[1])})


def outcomes(section: Section) -> Column:
    """The section's outcomes for one row of facts, in rule order."""
    def one(rule: Rule) -> Column:
        found = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(rule.why).alias("why")) for a in rule.actions])
        return F.when(F.expr(rule.when), found)
    none = F.array().cast(OUTCOME)
    if section.take == "first":
        return F.coalesce(*[one(r) for r in section.rules], none)
    return F.flatten(F.array_compact(F.array(*[one(r) for r in section.rules])))


def advise(facts: DataFrame, sections: tuple[Section, ...], distinct: bool = False) -> DataFrame:
    """(column, position, action, why) for every row of ``facts``; ``distinct`` keeps an action's first mention."""
    if not sections:
        return facts.sparkSession.createDataFrame([], "column string, position int, action string, why string")
    found = F.concat(*[outcomes(s) for s in sections])
    rows = facts.select("column", found.alias("found"))
    if distinct:
        names = F.transform("found", lambda x: x["action"])
        rows = rows.withColumn("found", F.filter("found", lambda x, i: F.array_position(names, x["action"]) == i + 1))
    return (rows.select("column", F.posexplode("found").alias("place", "rule"))
            .select("column", (F.col("place") + 1).alias("position"), "rule.action", "rule.why"))


def rules_table(spark, rules: RuleSet) -> DataFrame:
    rows = [(g, s.name, s.take, i + 1, r.when, list(r.actions), r.why)
            for g, sections in rules.items() for s in sections for i, r in enumerate(s.rules)]
    return spark.createDataFrame(rows, "group string, section string, take string, position int, when string, actions array<string>, why string")
