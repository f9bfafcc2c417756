"""Tabular augmentation. All draws are keyed by row, so results do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import at, number, numeric_columns
from ..functions.draws import normal, uniform
from ..plans.positions import hash_cut, shuffled_positions
from ..plans.quantiles import quantiles
from .profile import basics, centred

WIDE = 1000   # copies made of one row inside one task; more are spread first


def deviations(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Sample deviation per column (0 where undefined)."""
    _, base = basics(df, columns)
    shape = centred(df, columns, base)
    return {c: shape[c]["std"] or 0.0 for c in columns}


def features(df: DataFrame, keys: list[str]) -> list[str]:
    """Numeric columns that are not keys."""
    return [c for c in numeric_columns(df) if c not in keys]


def noisy(df: DataFrame, keys: list, level: float, seed: int, spread: dict[str, float]) -> DataFrame:
    """Add ``N(0, level · spread)`` to each column of ``spread``."""
    return df.select(*[
        (number(df, c) + normal(keys, seed, f"noise:{c}") * F.lit(level * spread[c])).alias(c) if c in spread else at(c) for c in df.columns])


def aug_noise(df: DataFrame, keys: list[str], level: float = 0.01, seed: int = 42) -> DataFrame:
    return noisy(df, keys, level, seed, deviations(df, features(df, keys)))


def aug_duplicate(df: DataFrame, times: int = 2) -> DataFrame:
    """The table ``times`` over."""
    return repeat_rows(df, F.lit(times), times)


def repeat_rows(df: DataFrame, copies, most: int, copy: str | None = None) -> DataFrame:
    """Each row ``copies`` times (``most`` bounds it). A row with very many copies is first split
    over several tasks, so that no task writes out one row's copies alone."""
    name = copy or "_copy"
    if most <= WIDE:
        out = df.withColumn(name, F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies.cast("int") - 1)).otherwise(F.array().cast("array<int>"))))
        out = out.withColumn(name, F.col(name).cast("long"))
    else:
        total = copies.cast("long")
        chunks = F.when(total > 0, F.sequence(F.lit(0).cast("long"), F.floor((total - 1) / F.lit(WIDE)))).otherwise(F.array().cast("array<bigint>"))
        split = df.withColumn("_total", total).withColumn("_chunk", F.explode(chunks)).repartition(F.col("_chunk"), *[at(c) for c in df.columns[:1]])
        first = F.col("_chunk") * WIDE
        last = F.least(first + WIDE, F.col("_total")) - 1
        out = split.withColumn(name, F.explode(F.sequence(first, last))).drop("_total", "_chunk")
    return out if copy else out.drop(name)


def aug_drop(df: DataFrame, keys: list[str], rate: float = 0.1, seed: int = 42) -> DataFrame:
    """Remove ``int(n · rate)`` rows."""
    gone = int(df.count() * rate)
    return hash_cut(df, keys, seed, gone).where(~F.col("_first")).drop("_first")


def drawn_rows(df: DataFrame, keys: list[str], n: int, draws: DataFrame, seed: int) -> DataFrame:
    """Rows drawn with replacement: ``draws`` has a unique long ``_draw``; each picks row ``int(u · n)`` of the digest order.

    Both sides of the join are evenly spread: picks are uniform and positions unique."""
    at_position = shuffled_positions(df, keys, seed)
    picks = draws.withColumn("_pos", F.floor(uniform([F.col("_draw")], seed, "pick") * n))
    return picks.join(at_position, "_pos").drop("_pos")


def aug_general(df: DataFrame, keys: list[str], ratio: float = 0.5, level: float = 0.05, seed: int = 42) -> DataFrame:
    """Append ``int(n · ratio)`` (at least one) rows drawn with replacement, with noise."""
    n = df.count()
    m = max(1, int(n * ratio))
    spread = deviations(df, features(df, keys))
    drawn = drawn_rows(df, keys, n, df.sparkSession.range(m).withColumnRenamed("id", "_draw"), seed)
    extra = noisy(drawn, [F.col("_draw")], level, seed, spread).select(*df.columns)
    return df.select(*[number(df, c).alias(c) if c in spread else at(c) for c in df.columns]).unionByName(extra)


def aug_feature(df: DataFrame, keys: list[str], share: float = 0.3, seed: int = 42) -> DataFrame:
    """For every number, ``int(share · n)`` drawn rows whose number is redrawn: around the mean,
    anywhere in range, or near an edge, in turn."""
    cols = features(df, keys)
    if not cols:
        return df
    n, base = basics(df, cols)
    shape = centred(df, cols, base)
    m = int(n * share)
    draws = (df.sparkSession.range(m * len(cols)).withColumnRenamed("id", "_draw")
             .withColumn("_col", F.expr(f"_draw div {max(m, 1)}")).withColumn("_i", F.col("_draw") % max(m, 1)))
    drawn = drawn_rows(df, keys, n, draws, seed)
    u, z = uniform([F.col("_draw")], seed, "value"), normal([F.col("_draw")], seed, "value")
    side = uniform([F.col("_draw")], seed, "side")
    out = {}
    for k, c in enumerate(cols):
        mean, std, low, high = base[c]["mean"], shape[c]["std"] or 0.0, base[c]["min"], base[c]["max"]
        if mean is None:
            continue
        edge = F.when(side > 0.5, F.lit(low) + u * (2.0 * std)).otherwise(F.lit(high) - u * (2.0 * std))
        fresh = (F.when(F.col("_i") % 3 == 0, F.lit(mean) + z * (0.5 * std))
                 .when(F.col("_i") % 3 == 1, F.lit(low) + u * (high - low)).otherwise(edge))
        out[c] = F.when(F.col("_col") == k, fresh).otherwise(number(df, c))
    extra = drawn.select(*[out[c].alias(c) if c in out else at(c) for c in df.columns])
    return df.select(*[number(df, c).alias(c) if c in out else at(c) for c in df.columns]).unionByName(extra)


def aug_resize(df: DataFrame, keys: list[str], original_rows: int, ratio: float = 0.5, seed: int = 42) -> DataFrame:
    """If longer than ``int(original · (1 + ratio))``, that many rows drawn with replacement. ``keys`` must be unique."""
    n, wanted = df.count(), int(original_rows * (1 + ratio))
    if n <= wanted:
        return df
    draws = df.sparkSession.range(wanted).withColumnRenamed("id", "_draw")
    return drawn_rows(df, keys, n, draws, seed).select(*df.columns)


def aug_local_duplicate(df: DataFrame, ratio: float) -> DataFrame:
    return aug_duplicate(df, max(2, int(ratio) + 1))


def aug_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after, increase and percent."""
    a = before.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("before"))
    b = after.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("after"))
    both = a.unionByName(b).agg(*[F.max(F.when(F.col("side") == s, F.col("n"))).alias(s) for s in ("before", "after")])
    gain = F.col("after") - F.col("before")
    return both.select("before", "after", gain.alias("increase"), F.try_divide(gain * 100.0, F.col("before")).alias("percent"),
                       F.try_divide(F.col("after").cast("double"), F.col("before")).alias("ratio"))


# ---- named methods ------------------------------------------------------------------

# Default parameters of the methods inside a chain.
CHAIN_DEFAULTS = {"noise": {"level": 0.03}, "duplicate": {"times": 2}, "drop": {"rate": 0.1}, "feature": {}, "smote": {"method": "SMOTE"},
                  "general": {"ratio": 0.5, "level": 0.05}}
# Names callers use for these parameters.
PARAMETERS = {"noise": {"noise_level": "level"}, "duplicate": {"dup_count": "times"}, "drop": {"drop_rate": "rate"}, "feature": {},
              "smote": {"target_col": "target", "imb_method": "method"}, "general": {"augmentation_ratio": "ratio", "noise_level": "level"}}
DESCRIPTIONS = {"noise": "random noise on numbers", "duplicate": "copies of the whole table", "drop": "random rows removed",
                "feature": "numbers redrawn from their distribution", "smote": "class rebalancing", "general": "random rows with noise appended"}


def methods() -> dict[str, Callable]:
    """Name to function ``(df, keys, **parameters)``."""
    from .balance import rebalance
    return {"noise": aug_noise, "duplicate": lambda df, keys, times=2: aug_duplicate(df, times), "drop": aug_drop, "feature": aug_feature,
            "smote": rebalance, "general": aug_general}


def method_registry(spark) -> DataFrame:
    """The methods with description and default parameters."""
    rows = [(n, DESCRIPTIONS[n], {k: str(v) for k, v in CHAIN_DEFAULTS[n].items()}) for n in methods()]
    return spark.createDataFrame(rows, "method string, description string, defaults map<string,string>")


def aug_chain(df: DataFrame, keys: list[str], names: list[str] = ("noise", "duplicate"), **options) -> tuple[DataFrame, list[str]]:
    """Methods in order, each on the result of the one before, with their own parameters.

    Unknown methods, ``smote`` without a target and failing methods are skipped. Copies made by
    ``duplicate`` share a key, so methods after it give copies the same draw.
    Returns the table and the methods applied."""
    known, applied = methods(), []
    for name in names:
        if name not in known:
            continue
        args = dict(CHAIN_DEFAULTS[name])
        args.update({inner: options[outer] for outer, inner in PARAMETERS[name].items() if outer in options})
        if name == "smote" and args.get("target") is None:
            continue
        try:
            df = known[name](df, keys, **args)
            applied.append(name)
        except Exception:   # one failing method does not stop the chain
            continue
    return df, applied
