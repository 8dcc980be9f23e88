"""Registry of named queries, each with an equivalent SQL text where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, places: int = 6, **other: int) -> DataFrame:
    """Round the double columns (adding 0.0 turns −0.0 into 0.0)."""
    return df.select(
        *[
            (F.round(c, other.get(c, places)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def r(expression: str, alias: str | None = None, places: int = 6) -> str:
    """The same rounding in SQL."""
    return f"round(CAST({expression} AS DOUBLE), {places}) + 0.0 AS {alias or expression}"


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
