"""Ranks and running totals over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankforge.config import SEED
from rankforge.session import written


def seeded_key(key: str, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def shuffled_rank(df: DataFrame, group: str, key: str, seed: int = SEED, digits: int = 3) -> DataFrame:
    """Zero-based ``rank`` of every row in a seeded random order of its group, and group ``size``.

    Equal to a row number over (partition by group order by hash, key), but the hash's leading
    digits cut each group into 16^digits buckets that are numbered separately; counts per
    (group, bucket) give each bucket's start.  A group with half of all rows is thus numbered by
    thousands of tasks.  The count table has at most classes x 16^digits rows.
    """
    hashed = df.withColumn("_h", seeded_key(key, seed)).withColumn(
        "_b", F.substring("_h", 1, digits))
    counts = hashed.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        group, "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy(group)).alias("size"))
    inside = Window.partitionBy(group, "_b").orderBy("_h", key)
    numbered = hashed.withColumn("_i", F.row_number().over(inside) - 1)
    return (numbered.join(starts, [group, "_b"])
            .withColumn("rank", F.col("_start") + F.col("_i"))
            .drop("_h", "_b", "_i", "_start"))


def running_totals(df: DataFrame, value: str, totals: list[str], previous: tuple[str, ...] = ()) -> DataFrame:
    """``below_<c>``: the sum of each total over all rows with a smaller value.

    ``previous_<c>`` is the value of a column in the row before, null in the first one; the last row
    of each range is handed over to the next range.  ``df`` has one row per distinct value.  It is dealt into ranges of the value and stored with the
    range number, as many ranges as shuffles have partitions; sums per range give each range's
    start, and windows run inside the ranges only.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = written(df.repartitionByRange(parts, value).withColumn("_b", F.spark_partition_id()), "ranges")
    sums = marked.groupBy("_b").agg(*[F.sum(c).alias(f"_s_{c}") for c in totals],
                                    *[F.max_by(c, value).alias(f"_l_{c}") for c in previous])
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "_b", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_start_{c}") for c in totals],
        *[F.lag(f"_l_{c}").over(Window.orderBy("_b")).alias(f"_last_{c}") for c in previous])
    ordered = Window.partitionBy("_b").orderBy(value)
    inside = ordered.rowsBetween(Window.unboundedPreceding, -1)
    run = marked.withColumns(
        {f"_run_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in totals}
        | {f"_lag_{c}": F.lag(c).over(ordered) for c in previous})
    # At most one row per range.
    out = run.join(F.broadcast(starts), "_b").withColumns(
        {f"below_{c}": F.col(f"_start_{c}") + F.col(f"_run_{c}") for c in totals}
        | {f"previous_{c}": F.coalesce(f"_lag_{c}", f"_last_{c}") for c in previous})
    return out.drop("_b", *[f"{x}_{c}" for x in ("_run", "_start") for c in totals],
                    *[f"{x}_{c}" for x in ("_lag", "_last") for c in previous])
