"""Queries by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def shown(df: DataFrame, keys: tuple[str, ...], *columns: str, digits: int = 6) -> DataFrame:
    """The keys as they are and the columns rounded, with -0.0 as 0.0."""
    return df.select(*keys, *[(F.round(F.col(c).cast("double"), digits) + 0.0).alias(c) for c in columns])


def rounded(*columns: str, digits: int = 6) -> str:
    """The same for DuckDB; each is a column or `expression AS name`."""
    parts = [c.rpartition(" AS ") for c in columns]
    return ", ".join(f"round(({e or n})::DOUBLE, {digits}) + 0.0 AS {n}" for e, _, n in parts)
