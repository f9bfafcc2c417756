"""Class rebalancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import at, missing, number
from ..functions.draws import uniform
from ..plans.positions import hash_cut
from ..plans.quantiles import quantiles
from ..session import written
from .augment import features, repeat_rows
from .infer import target_is_class_like
from .neighbours import knn_join, vectors

def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(_g, n): rows per class; as many classes as there are."""
    return df.where(~missing(df, target)).groupBy(at(target).alias("_g")).agg(F.count(F.lit(1)).alias("n"))


def class_goals(df: DataFrame, target: str, wanted: dict | DataFrame | None) -> DataFrame:
    """(_g, n, wanted): the greatest class's size for all, or what ``wanted`` (dict or table ``(label, wanted)``) says; others keep theirs."""
    counts = class_counts(df, target)
    if wanted is None:
        return counts.join(F.broadcast(counts.agg(F.max("n").alias("wanted"))))     # one number beside every class
    if isinstance(wanted, dict):
        kind = counts.schema["_g"].dataType.simpleString()
        wanted = df.sparkSession.createDataFrame([(c, int(w)) for c, w in wanted.items()], f"label {kind}, wanted long")
    goals = wanted.select(F.col("label").alias("_g"), F.col("wanted").cast("long").alias("wanted"))
    return counts.join(goals, "_g", "left").withColumn("wanted", F.coalesce("wanted", "n"))


def undersample_random(df: DataFrame, target: str, keys: list[str], seed: int = 42) -> DataFrame:
    """Every class cut to the size of the least one."""
    counts = class_counts(df, target)
    least = counts.agg(F.min("n").alias("_m"))
    return hash_cut(df, keys, seed, counts.select("_g").join(F.broadcast(least)), target).where("_first").drop("_first")


def _copies(df: DataFrame, target: str, keys: list[str], goals: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """Rows of growing classes with ``_copies``: how many new rows each gives, evenly, the rest to the first in digest order;
    and the most copies of one row."""
    grow = goals.where(F.col("wanted") > F.col("n")).withColumn("_more", F.col("wanted") - F.col("n"))
    most = grow.agg(F.max(F.expr("_more div n")).alias("m")).first()["m"]
    if most is None:
        return df.withColumn("_copies", F.lit(0).cast("long")).limit(0), 0
    base = grow.select(F.col("_g").alias("_class"), F.expr("_more div n").alias("_base"))
    rows = hash_cut(df, keys, seed, grow.select("_g", (F.col("_more") % F.col("n")).alias("_m")), target)
    rows = rows.join(base, at(target) == F.col("_class")).withColumn("_copies", F.col("_base") + F.col("_first").cast("long"))
    return rows.where("_copies > 0").drop("_first", "_base", "_class"), most + 1


def oversample_random(df: DataFrame, target: str, keys: list[str], wanted: dict | DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Every class repeated up to the size of the greatest one (or to ``wanted``)."""
    rows, most = _copies(df, target, keys, class_goals(df, target, wanted), seed)
    return df.unionByName(repeat_rows(rows, F.col("_copies"), most).select(*df.columns))


def smote_rows(df: DataFrame, target: str, key: str, wanted: dict | DataFrame | None = None, k: int | None = None, seed: int = 42) -> DataFrame:
    """New rows only: each lies between a row and one of its ``k`` nearest rows of the same class.

    Non-numeric columns and the key come from the seed row. Neighbours of all growing classes are sought by the same
    jobs, each class being a group of the neighbour join."""
    goals = class_goals(df, target, wanted)
    least = goals.agg(F.min("n")).first()[0]
    cols = [c for c in features(df, [key]) if c != target]
    if least is None or not cols:
        return df.limit(0)
    k = k or max(1, min(3, least - 1))
    rows, most = _copies(df, target, [key], goals, seed)
    if not most:
        return df.limit(0)
    growing = goals.where(F.col("wanted") > F.col("n")).select("_g")
    members = df.join(growing, at(target) == F.col("_g"), "left_semi").na.fill(0.0, cols)
    part = written(vectors(members.withColumn("_g", F.md5(at(target).cast("string"))), key, cols, group="_g"))
    near = knn_join(part, part, k, exclude_self=True)
    found = near.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))), lambda x: x["neighbour"]).alias("near"))
    seeds = repeat_rows(rows, F.col("_copies"), most, "_copy").join(found.withColumnRenamed("id", "_id"), at(key) == F.col("_id"), "left")
    draw = [at(key), F.col("_copy")]
    pick = F.floor(uniform(draw, seed, "neighbour") * F.size("near")).cast("int")
    seeds = seeds.withColumn("_other", F.when(F.size("near") > 0, F.get("near", pick))).withColumn("_u", uniform(draw, seed, "place"))
    others = df.select(at(key).alias("_other"), *[number(df, c).alias(f"_o_{c}") for c in cols])
    mixed = seeds.join(others, "_other", "left")
    return mixed.select(*[
        (number(df, c) + F.col("_u") * (F.coalesce(F.col(f"_o_{c}"), number(df, c)) - number(df, c))).alias(c) if c in cols else at(c) for c in df.columns])


def smote(df: DataFrame, target: str, key: str, wanted: dict | DataFrame | None = None, k: int | None = None, clip: bool = True, seed: int = 42) -> DataFrame:
    """The table with every class grown to the greatest one by ``smote_rows``; numbers clipped to their 1st and 99th percentile."""
    cols = [c for c in features(df, [key]) if c != target]
    fresh = smote_rows(df, target, key, wanted, k, seed)
    q = quantiles(df, cols, [0.01, 0.99]) if clip else {}
    bound = lambda c: F.least(F.greatest(at(c), F.lit(q[c][0])), F.lit(q[c][1])) if clip and q[c][0] is not None else at(c)
    fresh = fresh.select(*[bound(c).alias(c) if c in cols else at(c) for c in df.columns])
    return df.select(*[number(df, c).alias(c) if c in cols else at(c) for c in df.columns]).unionByName(fresh)


def rebalance(df: DataFrame, keys: list[str], target: str | None = None, method: str = "SMOTE", seed: int = 42) -> DataFrame:
    """Rebalance by method name; tables without a class-like target or without numbers come back unchanged."""
    if target is None or target not in df.columns:
        return df
    if not target_is_class_like(df, target).first()["class_like"] or not [c for c in features(df, keys) if c != target]:
        return df
    if method == "SMOTE":
        return smote(df, target, keys[0], seed=seed)
    if method == "RandomOverSampler":
        return oversample_random(df, target, keys, seed=seed)
    if method == "RandomUnderSampler":
        return undersample_random(df, target, keys, seed=seed)
    return df


# ---- target sizes -------------------------------------------------------------------

def strategy_multiclass(df: DataFrame, target: str, percent: float) -> DataFrame:
    """Wanted rows per class: ``int(count · percent / 100)``."""
    return (df.where(~missing(df, target)).groupBy(at(target).alias("label")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("wanted", F.floor(F.col("n") * F.lit(percent) / 100)))


def strategy_binary(df: DataFrame, target: str, ratio: float) -> DataFrame:
    """The least class and its wanted size as a share of the greatest class."""
    counts = df.where(~missing(df, target)).groupBy(at(target).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by("label", F.struct("n", "label")).alias("label"), F.min("n").alias("n"),
                      F.floor(F.max("n") * F.lit(ratio)).alias("wanted"))


def strategy_levels(df: DataFrame, target: str) -> DataFrame:
    """Wanted rows per class under three rules: all to the greatest; those below the mean to it; those below the median to it."""
    counts = df.where(~missing(df, target)).groupBy(at(target).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    stats = counts.agg(F.max("n").alias("top"), F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median")).first()   # one number per class
    if stats["top"] is None:
        return counts.select(F.lit("max").alias("strategy"), "label", "n", F.col("n").alias("wanted"))
    sets = F.array_compact(F.array(
        F.struct(F.lit("max").alias("strategy"), F.lit(round(stats["top"])).cast("long").alias("wanted")),
        F.when(F.col("n") < stats["mean"], F.struct(F.lit("mean").alias("strategy"), F.lit(round(stats["mean"])).cast("long").alias("wanted"))),
        F.when(F.col("n") < stats["median"], F.struct(F.lit("median").alias("strategy"), F.lit(round(stats["median"])).cast("long").alias("wanted")))))
    return counts.withColumn("s", F.explode(sets)).select("s.strategy", "label", "n", "s.wanted")
