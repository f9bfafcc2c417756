"""Random draws that depend only on a row's key, a seed and a draw name.

The same row gets the same draw whatever the partitioning, after a retry or on
another cluster, so results are repeatable and can be checked in another engine.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, functions as F

from .columns import at

RANGE = 4294967296.0  # draws are 32-bit integers taken from a digest


def digest(keys: list[str | Column], seed: int, draw: str | int) -> Column:
    parts = [k if isinstance(k, Column) else at(k) for k in keys]
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts], F.lit(str(seed)), F.lit(str(draw))))


def _word(h: Column, start: int) -> Column:
    return F.conv(F.substring(h, start, 8), 16, 10).cast("double")


def uniform(keys, seed: int, draw) -> Column:
    """Uniform in [0, 1)."""
    return _word(digest(keys, seed, draw), 1) / F.lit(RANGE)


def normal(keys, seed: int, draw) -> Column:
    """Standard normal (Box and Muller) from two words of one digest."""
    h = digest(keys, seed, draw)
    radius = F.sqrt(F.lit(-2.0) * F.log((_word(h, 1) + 1) / F.lit(RANGE)))
    return radius * F.cos(F.lit(2 * pi) * _word(h, 9) / F.lit(RANGE))
