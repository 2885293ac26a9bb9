"""Name -> (query, SQL) registry behind the driver entry points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` states the same result for another engine."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r9(col: Column | str) -> Column:
    """Nine digits, negative zero folded: float sums depend on their order below that.

    Scaled and rounded to even, which is the same double arithmetic in every engine;
    ``round`` is not, because engines differ in how they treat a decimal tie.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.rint(c.cast("double") * F.lit(1e9)) / F.lit(1e9) + F.lit(0.0)


def sql_r9(expr: str) -> str:
    return f"(round_even(CAST({expr} AS DOUBLE) * CAST(1e9 AS DOUBLE), 0) / CAST(1e9 AS DOUBLE) + CAST(0 AS DOUBLE))"
