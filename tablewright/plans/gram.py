"""Products of all pairs of columns in one pass, over the rows where both are present."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import number
from .partials import matrix, totals


@dataclass
class PairSums:
    """Square matrices over columns; entry (a, b) is a sum over rows where a and b are both present and finite."""
    rows: np.ndarray
    first: np.ndarray          # of a, less its centre
    square: np.ndarray         # of a squared
    product: np.ndarray        # of a times b
    infinite: np.ndarray       # rows where both are present and one of them is infinite


def pair_sums(df: DataFrame, columns: list[str]) -> PairSums:
    """Values are taken less the mean of their finite ones, so that sums of squares keep their digits."""
    values = [number(df, c) for c in columns]
    finite = [F.when(F.abs(v) < float("inf"), v) for v in values]
    means = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(finite)]).first()
    centre = np.array([m if m is not None and np.isfinite(m) else 0.0 for m in means])
    p = len(columns)

    def run(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(0)) - centre
        far, held = np.isinf(x), ~np.isnan(x)
        good = (held & ~far).astype(float)
        x = np.where(good > 0, x, 0.0)
        lost = np.zeros((p, p))
        if far.any():
            lost = held.T.astype(float) @ held - good.T @ good
        with np.errstate(all="ignore"):                     # what overflows is in doubt later
            return np.stack([good.T @ good, x.T @ good, (x * x).T @ good, x.T @ x, lost])

    found = totals(df.select(F.array(*values).alias("x")), run, 5 * p * p).reshape(5, p, p)
    return PairSums(*found)


def correlations(sums: PairSums) -> tuple[np.ndarray, np.ndarray]:
    """Pearson r of every pair (NaN: none), and the pairs whose digits do not suffice to tell: nearly constant or beyond doubles."""
    with np.errstate(all="ignore"):
        n = sums.rows
        spread = sums.square - sums.first * sums.first / n
        r = (sums.product - sums.first * sums.first.T / n) / np.sqrt(spread * spread.T)
        flat = ~(spread > 1e-9 * sums.square)
    unsure = (n > 0) & (sums.infinite == 0) & (flat | flat.T | ~np.isfinite(r))
    r = np.where((n > 0) & (sums.infinite == 0), np.clip(r, -1, 1), np.nan)
    return r, unsure
