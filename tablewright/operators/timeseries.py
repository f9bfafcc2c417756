"""Time-series operators.

Row-based frames (shift, rolling, fill) run over the whole series without a single-task
window: rows are numbered by (series, date, key), cut into blocks with the neighbours a
frame needs, and windows run per block. Several series may share a table (``series``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import DATE_TYPES, at, missing, number, numeric_columns
from ..functions.dates import parse_datetime
from ..plans.positions import block_size, in_blocks, ordered_positions
from .augment import deviations, noisy


def measures(df: DataFrame, date: str, keys: list[str], series: list[str] = ()) -> list[str]:
    return [c for c in numeric_columns(df) if c != date and c not in keys and c not in series]


def _framed(df: DataFrame, date: str, keys: list[str], series: list[str], before: int, after: int):
    """Numbered rows in blocks, and the window per block and series."""
    numbered, total = ordered_positions(df, [*series, date, *keys])
    blocks = in_blocks(numbered, block_size(total), before, after)
    return blocks, Window.partitionBy("_block", *[at(s) for s in series]).orderBy("_pos")


def ts_shift(df: DataFrame, date: str, keys: list[str], rows: int = 1, series: list[str] = (), columns: list[str] | None = None) -> DataFrame:
    """Numbers moved down by ``rows`` rows (up if negative); rows left incomplete are dropped."""
    cols = columns or measures(df, date, keys, series)
    blocks, w = _framed(df, date, keys, list(series), max(rows, 0), max(-rows, 0))
    moved = blocks.select("_own", *[F.lag(at(c), rows).over(w).alias(c) if c in cols else at(c) for c in df.columns])
    return moved.where("_own").drop("_own").na.drop("any")


def ts_window_average(df: DataFrame, date: str, keys: list[str], size: int = 3, series: list[str] = (), columns: list[str] | None = None) -> DataFrame:
    """Centred moving mean over ``size`` rows, full windows only."""
    cols = columns or measures(df, date, keys, series)
    before, after = size // 2, (size - 1) // 2
    blocks, w = _framed(df, date, keys, list(series), before, after)
    frame = w.rowsBetween(-before, after)
    mean = lambda c: F.when(F.count(number(df, c)).over(frame) == size, F.avg(number(df, c)).over(frame))
    return blocks.select("_own", *[mean(c).alias(c) if c in cols else at(c) for c in df.columns]).where("_own").drop("_own").na.drop("any")


def lag_features(df: DataFrame, date: str, keys: list[str], column: str, lags: int, series: list[str] = ()) -> DataFrame:
    """Columns ``<column>_lag_1`` to ``_lag_<lags>``."""
    blocks, w = _framed(df, date, keys, list(series), lags, 0)
    return (blocks.select("_own", *[at(c) for c in df.columns], *[F.lag(at(column), i).over(w).alias(f"{column}_lag_{i}") for i in range(1, lags + 1)])
            .where("_own").drop("_own"))


def rolling_statistics(df: DataFrame, date: str, keys: list[str], column: str, size: int, series: list[str] = ()) -> DataFrame:
    """Trailing mean, deviation, least and greatest over ``size`` rows, missing before the window is full."""
    blocks, w = _framed(df, date, keys, list(series), size - 1, 0)
    frame, v = w.rowsBetween(-(size - 1), 0), number(df, column)
    full = F.count(v).over(frame) == size
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return (blocks.select("_own", *[at(c) for c in df.columns], *[F.when(full, f(v).over(frame)).alias(f"{column}_rolling_{n}") for n, f in stats.items()])
            .where("_own").drop("_own"))


def _fill(df: DataFrame, date: str, keys: list[str], columns: list[str], series: list[str], forward: bool) -> DataFrame:
    numbered, total = ordered_positions(df, [*series, date, *keys])
    blocks = numbered.withColumn("_block", F.expr(f"_pos div {block_size(total)}"))
    parts = [at(s) for s in series]
    pick = F.max_by if forward else F.min_by
    clean = lambda c: F.when(~missing(df, c), at(c))
    # what each block hands on: its last (first) known value per column; one row per block
    edges = blocks.groupBy("_block", *parts).agg(*[pick(clean(c), F.when(~missing(df, c), F.col("_pos"))).alias(f"_e_{c}") for c in columns])
    order = Window.partitionBy(*parts).orderBy("_block")
    span = order.rowsBetween(Window.unboundedPreceding, -1) if forward else order.rowsBetween(1, Window.unboundedFollowing)
    take = F.last if forward else F.first
    carry = edges.select("_block", *parts, *[take(f"_e_{c}", ignorenulls=True).over(span).alias(f"_c_{c}") for c in columns])
    same = F.col("l._block") == F.col("r._block")
    for s in series:
        same = same & F.col(f"l.{s}").eqNullSafe(F.col(f"r.{s}"))
    joined = blocks.alias("l").join(carry.alias("r"), same, "left").select("l.*", *[f"r._c_{c}" for c in columns])
    w = Window.partitionBy("_block", *parts).orderBy("_pos")
    inside = w.rowsBetween(Window.unboundedPreceding, 0) if forward else w.rowsBetween(0, Window.unboundedFollowing)
    return joined.select(*[
        F.coalesce(take(clean(c), ignorenulls=True).over(inside), F.col(f"_c_{c}")).alias(c) if c in columns else at(c) for c in df.columns])


def ffill(df: DataFrame, date: str, keys: list[str], columns: list[str], series: list[str] = ()) -> DataFrame:
    """Missing values take the last known value before them."""
    return _fill(df, date, keys, columns, list(series), True)


def bfill(df: DataFrame, date: str, keys: list[str], columns: list[str], series: list[str] = ()) -> DataFrame:
    """Missing values take the next known value."""
    return _fill(df, date, keys, columns, list(series), False)


def ts_noise(df: DataFrame, date: str, keys: list[str], level: float = 0.01, seed: int = 42) -> DataFrame:
    return noisy(df, keys, level, seed, deviations(df, measures(df, date, keys)))


def ts_scale(df: DataFrame, date: str, keys: list[str], factor: float = 1.0) -> DataFrame:
    cols = measures(df, date, keys)
    return df.select(*[(number(df, c) * F.lit(factor)).alias(c) if c in cols else at(c) for c in df.columns])


def as_time(df: DataFrame, date: str) -> Column:
    return at(date).cast("timestamp_ntz") if isinstance(df.schema[date].dataType, DATE_TYPES) else parse_datetime(at(date))


def period_end(day: Column, freq: str) -> Column:
    """Last day of the day's period: D, W (ends Sunday), M, Q or Y."""
    d = day.cast("date")
    if freq == "D":
        return d
    if freq == "W":
        return F.next_day(F.date_sub(d, 1), "SUN")
    if freq == "M":
        return F.last_day(d)
    if freq == "Q":
        return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))
    if freq == "Y":
        return F.make_date(F.year(d), F.lit(12), F.lit(31))
    raise ValueError(f"unknown frequency {freq}")


STEPS = {"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY", "M": "INTERVAL 1 MONTH", "Q": "INTERVAL 3 MONTH", "Y": "INTERVAL 1 YEAR"}


def ts_resample(df: DataFrame, date: str, freq: str = "W", columns: list[str] | None = None) -> DataFrame:
    """Mean per period, labelled with the period's last day; periods without rows are kept, their means missing.

    Rows are merged per period before the shuffle; the calendar has one row per period."""
    cols = columns or [c for c in numeric_columns(df) if c != date]
    means = (df.select(period_end(as_time(df, date), freq).alias(date), *[number(df, c).alias(c) for c in cols]).where(at(date).isNotNull())
             .groupBy(date).agg(*[F.avg(at(c)).alias(c) for c in cols]))
    ends = df.select(period_end(as_time(df, date), freq).alias("p")).agg(F.min("p").alias("a"), F.max("p").alias("b"))
    # months differ in length: step through period starts, then take each period's end
    days = ends.where("a IS NOT NULL").select(F.explode(F.sequence(F.trunc("a", "month") if freq in "MQY" else F.col("a"), F.col("b"), F.expr(STEPS[freq]))).alias("p"))
    calendar = days.select(period_end(F.col("p"), freq).alias(date))
    return calendar.join(means, date, "left").select(at(date).cast("timestamp_ntz").alias(date), *cols)


def ts_methods() -> dict[str, Callable]:
    """Name to function ``(df, date, keys, **parameters)``."""
    return {"noise": ts_noise, "shift": ts_shift, "resample": lambda df, date, keys, freq="W": ts_resample(df, date, freq, measures(df, date, keys)),
            "scale": ts_scale, "window_average": ts_window_average}


def ts_augment(df: DataFrame, date: str, keys: list[str], method: str, **parameters) -> DataFrame:
    """Run a method by name; an unknown name gives the table back."""
    found = ts_methods().get(method)
    return found(df, date, keys, **parameters) if found else df
