"""Registry of the named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round floating columns, so that the order of a sum cannot show."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, digits) for c in doubles}) if doubles else df


def rounded_sql(select: str, columns: str, digits: int = 9) -> str:
    """The same rounding in SQL; ``select`` may start with WITH."""
    items = ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in columns.split())
    return f"SELECT * REPLACE ({items}) FROM ({select})"
