"""The first row of every key over files that keep arriving.

The stream holds the best row of each key so far as state, in a RocksDB store whose changes go to the shared progress
folder, so its size is bounded by the disks and a restart goes on where the last run ended. Each run of files adds the
keys whose best row changed to the target, a folder for each batch; a batch that is run again replaces its folder.

A row that arrives late but comes earlier in the order takes the place of the one before; the target then holds both, and
:func:`first_rows` returns the better one. Rows that are equal in the order columns are ordered by their other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rankforge.operators.cleaning import keep_first

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_first_stream(rows: DataFrame, keys: list[str], order: list[str], target: str, progress: str) -> StreamingQuery:
    """Keep the first row per key of a stream; runs until the present files are done.

    ``target`` gets the changed rows of each batch and ``progress`` remembers state and files; both
    belong to the shared storage. A later call with the same folders goes on.
    """
    spark = rows.sparkSession
    spark.conf.set(STORE, ROCKS)
    rest = [c for c in rows.columns if c not in keys and c not in order]
    columns = rows.columns
    # Partial aggregates keep one row of a key in each task before the shuffle.
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_best"))

    def save(batch: DataFrame, number: int) -> None:
        batch.select(*keys, "_best.*").select(*columns).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (best.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", progress)
            .trigger(availableNow=True).start())


def first_rows(spark: SparkSession, target: str, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key over all batches written so far."""
    rows = spark.read.parquet(target)
    columns = [c for c in rows.columns if c != "batch"]
    rest = [c for c in columns if c not in keys and c not in order]
    return keep_first(rows.select(*columns), keys, [*order, *rest])
