"""Exact quantiles (linear interpolation) whose memory does not grow with the table.

Small columns are answered by one ``percentile`` aggregate. Larger ones are narrowed
by passes that each aggregate to one row: a sketch of a bounded random sample brackets every
wanted rank, exact counts over all rows confirm the bracket (a missed one is searched on
the side the counts name), and what is left inside shrinks by one to two orders of
magnitude per pass, until it is few enough values to look at. The result is exact
whatever the sample holds. Repeated values end a search early, so a value that fills a
third of the column costs nothing extra.
"""

from __future__ import annotations

from math import ceil, floor, sqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import at, double_sql, number
from ..session import written

SMALL = 50_000         # values a single aggregate buffer may hold
ACCURACY = 10_000      # sketch accuracy of the narrowing passes
SAMPLES = (100_000, 1_000_000)   # sampled values per pass: a tenth of the rest between these bounds
COLUMNS_PER_PASS = 60  # expressions per job stay bounded for wide tables
PARTS = 256            # parts of a range counted in one pass of the grouped search
WIDE = 1_000.0         # ranges whose ends differ by a greater factor are parted by logarithm
FEW = 50_000           # groups or ranges that may be broadcast: three numbers and a group each
SALTS = 32             # pieces of a group where there are more ranges than that


def quantiles(df: DataFrame, columns: list[str], probs: list[float], small: int = SMALL,
              sizes: dict[str, int] | None = None) -> dict[str, list[float | None]]:
    """``{column: [quantile per prob]}``; a column without values gives ``None`` entries.

    ``sizes`` (non-missing values per column) saves a pass where the caller knows them."""
    exprs = {c: number(df, c) for c in columns}
    return expression_quantiles(df, exprs, probs, small, sizes)


def expression_quantiles(df: DataFrame, exprs: dict[str, Column], probs: list[float], small: int = SMALL,
                         sizes: dict[str, int] | None = None) -> dict[str, list[float | None]]:
    names, out = list(exprs), {}
    for i in range(0, len(names), COLUMNS_PER_PASS):
        part = names[i:i + COLUMNS_PER_PASS]
        slim = df.select(*[exprs[n].alias(f"x{j}") for j, n in enumerate(part)])
        for j, values in _solve(slim, len(part), probs, small, sizes and [sizes[n] for n in part]).items():
            out[part[j]] = values
    return out


def _solve(df: DataFrame, width: int, probs: list[float], small: int, sizes):
    if sizes is None:
        sizes = list(df.selectExpr(*[f"count(x{j})" for j in range(width)]).first())
    wanted = {j: [(sizes[j] - 1) * p for p in probs] for j in range(width)}
    light = [j for j in range(width) if 0 < sizes[j] <= small]
    out = {j: [None] * len(probs) for j in range(width)}
    if light:
        levels = ", ".join(double_sql(float(p)) for p in probs)
        row = df.selectExpr(*[f"percentile(x{j}, array({levels})) AS q{j}" for j in light]).first()
        for j in light:
            out[j] = list(row[f"q{j}"])
    heavy = {j: sizes[j] for j in range(width) if sizes[j] > small}
    if heavy:
        ranks = {(j, r) for j in heavy for h in wanted[j] for r in (floor(h), ceil(h))}
        found = _order_statistics(df, ranks, heavy, small)
        for j in heavy:
            out[j] = [_mix(found[j, floor(h)], found[j, ceil(h)], h - floor(h)) for h in wanted[j]]
    return out


def _mix(low: float, high: float, weight: float) -> float:
    return low if weight == 0 else low + (high - low) * weight


def _inside(j: int, low, high) -> str:
    test = f"x{j} IS NOT NULL"
    if low is not None:
        test += f" AND x{j} > {double_sql(low)}"
    if high is not None:
        test += f" AND x{j} < {double_sql(high)}"
    return test


def _order_statistics(df, ranks, sizes, small):
    """Value at each (column, 0-based rank)."""
    found = {}
    # open interval of a column -> (values at or below its lower end, values inside, ranks wanted there)
    todo = {(j, None, None): (0, n, sorted(r for c, r in ranks if c == j)) for j, n in sizes.items()}
    while todo:
        spans = list(todo)
        brackets = _brackets(df, spans, todo)
        tests, keys = [], []
        for span, b1, b2, wanted in brackets:
            j, low, _ = span
            i, inner = len(keys), _inside(j, b1, b2)
            keys.append((span, b1, b2, wanted))
            tests += [f"count_if({_inside(j, low, b1)}) AS l{i}", f"count_if(x{j} = {double_sql(b1)}) AS e{i}", f"count_if(x{j} = {double_sql(b2)}) AS f{i}",
                      f"sort_array(collect_list(CASE WHEN {inner} THEN x{j} END)) AS m{i}" if wanted["expected"] <= small else f"count_if({inner}) AS m{i}"]
        row = df.selectExpr(*tests).first()
        todo = {}
        for i, (span, b1, b2, wanted) in enumerate(keys):
            j, low, high = span
            below, inside = wanted["below"], wanted["inside"]
            less, equal, mid = row[f"l{i}"], row[f"e{i}"], row[f"m{i}"]
            held = mid if isinstance(mid, list) else None
            width = len(held) if held is not None else mid
            if b1 == b2:
                width, held = 0, []
            top = row[f"f{i}"] if b2 > b1 else 0
            for r in wanted["ranks"]:
                place = r - below
                if place < less:
                    _want(todo, (j, low, b1), below, less, r)
                elif place < less + equal:
                    found[j, r] = b1
                elif place < less + equal + width:
                    if held is not None:
                        found[j, r] = held[place - less - equal]
                    else:
                        _want(todo, (j, b1, b2), below + less + equal, width, r)
                elif place < less + equal + width + top:
                    found[j, r] = b2
                else:
                    passed = less + equal + width + top
                    _want(todo, (j, b2, high), below + passed, inside - passed, r)
    return found


def _want(todo, span, below, inside, rank):
    todo.setdefault(span, (below, inside, []))[2].append(rank)


def _brackets(df, spans, todo):
    """One sketch per open interval gives two values around every run of neighbouring ranks."""
    plans, sketches = [], []
    for i, span in enumerate(spans):
        below, inside, ranks = todo[span]
        runs = []
        for r in sorted(set(ranks)):
            if runs and r - runs[-1][-1] <= 1:
                runs[-1].append(r)
            else:
                runs.append([r])
        size = min(inside, max(SAMPLES[0], min(SAMPLES[1], inside // 10)))
        ends = []
        for run in runs:
            share = (run[0] - below) / inside
            # five deviations of a sampled rank, and the sketch's own error
            slack = 2.0 / ACCURACY + (5 * sqrt(share * (1 - share) / size) if size < inside else 0.0)
            ends += [max(0.0, share - slack), min(1.0, (run[-1] - below) / inside + slack)]
        plans.append((span, runs, ends))
        drawn = _inside(*span) + (f" AND u < {double_sql(size / inside)}" if size < inside else "")
        sketches.append(f"percentile_approx(CASE WHEN {drawn} THEN x{span[0]} END, array({', '.join(map(double_sql, ends))}), {ACCURACY}) AS b{i}")
    row = df.selectExpr("*", "rand(7) AS u").selectExpr(*sketches).first()
    out = []
    for i, (span, runs, ends) in enumerate(plans):
        values = row[f"b{i}"]
        if values is None:      # an empty sample of a tiny rest: bracket it by its own ends
            values = [x for _ in runs for x in _ends(df, span)]
        for k, run in enumerate(runs):
            below, inside = todo[span][:2]
            out.append((span, values[2 * k], values[2 * k + 1], {
                "ranks": run, "below": below, "inside": inside, "expected": 2 * inside * (ends[2 * k + 1] - ends[2 * k])}))
    return out


def _ends(df, span):
    return list(df.selectExpr(f"min(CASE WHEN {_inside(*span)} THEN x{span[0]} END)", f"max(CASE WHEN {_inside(*span)} THEN x{span[0]} END)").first())


def grouped_quantiles(df: DataFrame, group: str, column: str, probs: list[float],
                      small: int = SMALL) -> DataFrame:
    """``group, n, q`` (array of exact quantiles) of every group that has values; rows without group or value take no part.

    Groups of up to ``small`` values share one aggregate. All greater ones are searched together: their wanted ranks are a
    table of open ranges, and each pass counts the values of all ranges in ``PARTS`` parts and keeps the part that holds the
    rank. Plan and driver see neither groups nor values, however many groups are great."""
    v = number(df, column)
    slim = df.select(at(group).alias("g"), v.alias("v")).where(F.col("v").isNotNull() & F.col("g").isNotNull())
    sizes = written(slim.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    levels = F.array(*[F.lit(float(p)) for p in probs])
    great = sizes.where(F.col("n") > small)
    few, some = _few(great), not great.isEmpty()
    rest = slim.join(few(great.select("g")), "g", "left_anti") if some else slim
    out = rest.groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", levels).alias("q"))
    if some:
        ends = F.flatten(F.transform(levels, lambda p: F.array(F.floor(_place(p)), F.ceil(_place(p)))))
        ranks = great.select("g", F.explode(F.array_distinct(ends)).alias("r"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
        held = _ranked(slim, ranks, small).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("r", "value"))).alias("held"))   # two entries a quantile
        low, high = lambda p: F.col("held")[F.floor(_place(p))], lambda p: F.col("held")[F.ceil(_place(p))]
        weight = lambda p: _place(p) - F.floor(_place(p))
        mixed = F.transform(levels, lambda p: F.when((weight(p) == 0) | (low(p) == high(p)), low(p)).otherwise(low(p) + (high(p) - low(p)) * weight(p)))
        out = out.unionByName(great.join(held, "g").select("g", "n", mixed.alias("q")))
    return out.withColumnRenamed("g", group)


def _place(p: Column) -> Column:
    return (F.col("n") - 1) * p


def _few(table: DataFrame):
    """``broadcast`` where the table was counted to be small, else nothing."""
    return F.broadcast if table.limit(FEW + 1).count() <= FEW else lambda t: t


def _part(lo: Column, hi: Column) -> Column:
    """Number of the part of ``[lo, hi]`` that holds ``v``; never falls as ``v`` grows, and differs between the two ends.

    Ranges over zero or with infinite ends are parted by sign first, wide ones by logarithm, others evenly."""
    v, size = F.col("v"), lambda x: F.ln(F.abs(x))
    endless = [F.lit(float("-inf")), F.lit(float("inf"))]
    sign = F.when(v == endless[0], -2).when(v == endless[1], 2).otherwise(F.signum(v))
    wide = F.greatest(F.abs(lo), F.abs(hi)) / F.least(F.abs(lo), F.abs(hi)) > WIDE
    even = (v - lo) / (hi - lo)
    return (F.when(((lo <= 0) & (hi >= 0)) | (lo == endless[0]) | (hi == endless[1]), sign)
            .otherwise(F.floor(PARTS * F.when(wide, (size(v) - size(lo)) / (size(hi) - size(lo))).otherwise(even)))).cast("int")


def _met(slim: DataFrame, spans: DataFrame) -> DataFrame:
    """The values inside each range of their group. Many ranges are dealt over salts, as their groups are the great ones."""
    if spans.limit(FEW + 1).count() <= FEW:
        met = slim.join(F.broadcast(spans), "g")
    else:
        salted = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = slim.withColumn("salt", (F.rand(11) * SALTS).cast("int")).join(salted, ["g", "salt"]).drop("salt")
    return met.where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))


def _ranked(slim: DataFrame, ranks: DataFrame, small: int) -> DataFrame:
    """(g, r, value): the value at each 0-based rank of its group; ``ranks`` has (g, r, lo, hi, below, inside)."""
    span = ["g", "lo", "hi"]
    state = written(ranks)
    while True:
        wide = (F.col("lo") < F.col("hi")) & (F.col("inside") > small)
        todo = state.where(wide)
        if todo.isEmpty():
            break
        parts = (_met(slim, todo.select(*span).distinct()).groupBy(*span, _part(F.col("lo"), F.col("hi")).alias("part"))
                 .agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("least"), F.max("v").alias("most")))
        before = Window.partitionBy(*span).orderBy("part")         # at most PARTS + 1 rows a range
        parts = parts.withColumn("before", F.sum("m").over(before) - F.col("m"))
        inside = (F.col("r") - F.col("below") >= F.col("before")) & (F.col("r") - F.col("below") < F.col("before") + F.col("m"))
        found = todo.join(parts, span).where(inside).select("g", "r", F.col("least").alias("lo"), F.col("most").alias("hi"),
                                                            (F.col("below") + F.col("before")).alias("below"), F.col("m").alias("inside"))
        state = written(state.where(~wide).unionByName(found))
    short = state.where(F.col("lo") < F.col("hi"))
    values = _met(slim, short.select(*span).distinct()).groupBy(*span).agg(F.sort_array(F.collect_list("v")).alias("vs"))     # at most `small` values
    picked = short.join(values, span).select("g", "r", F.get("vs", (F.col("r") - F.col("below")).cast("int")).alias("value"))
    return state.where(F.col("lo") == F.col("hi")).select("g", "r", F.col("lo").alias("value")).unionByName(picked)
