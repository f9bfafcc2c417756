"""Registration of queries with their ANSI SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PRICES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; without SQL only rows are checked."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def each(template: str, columns: list[str], sep: str = " UNION ALL ") -> str:
    """The template once per column; ``{c}`` is the column and ``{i}`` its position."""
    return sep.join(template.replace("{c}", c).replace("{i}", str(i)) for i, c in enumerate(columns))


def uniform_sql(key: str, seed: int, draw) -> str:
    return f"(('0x' || substr(md5({key} || ':{seed}:{draw}'), 1, 8))::BIGINT / 4294967296.0)"


def order_sql(key: str, seed: int) -> str:
    return f"md5({key} || ':{seed}:order')"


def normal_sql(key: str, seed: int, draw) -> str:
    h = f"md5({key} || ':{seed}:{draw}')"
    word = lambda start: f"(('0x' || substr({h}, {start}, 8))::BIGINT)::DOUBLE"
    return f"(sqrt(-2.0 * ln(({word(1)} + 1) / 4294967296.0::DOUBLE)) * cos(2 * pi() * {word(9)} / 4294967296.0::DOUBLE))"
