"""Sorted lists, limits and the best rows per group, always with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Up to this size Spark limits each group before the shuffle (WindowGroupLimit).
GROUP_LIMIT = 1000
SALTS = 64


def best_first(score: str, *ties: str) -> list[Column]:
    """Sort order: highest score first, unknown scores last, then the tie columns."""
    return [F.col(score).desc_nulls_last(), *[F.asc_nulls_last(t) for t in ties]]


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows; each task keeps only n candidates."""
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of every group.

    Tasks cut each group to k rows before the shuffle, so a group with a large share of all rows
    still sends little.  Above the size for which Spark does that, a salted first round spreads
    every group over many tasks and only its winners meet in the second round.
    """
    if k > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
        first = Window.partitionBy(*groups, "_salt").orderBy(*order)
        df = (df.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(first))
              .filter(F.col("_rn") <= k).drop("_rn", "_salt"))
    window = Window.partitionBy(*groups).orderBy(*order)
    return (df.withColumn("_rn", F.row_number().over(window))
            .filter(F.col("_rn") <= k).drop("_rn"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).count().orderBy(F.desc("count"), F.asc_nulls_last(column))
