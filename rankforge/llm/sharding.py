"""Sharding by jump consistent hashing, with a gapless slot for every row of a shard.

A row's shard follows from its id and the number of shards alone; no ring table is kept. With one more shard, a row
either stays or goes to the new one. Slots number the rows of a shard in the order of id, checksum and size: the thin
rows (no texts) are range-partitioned and sorted, numbered inside each partition, and moved up by what earlier
partitions hold. A stored row number is the last sort key, so even equal rows spread over partitions.

Defined results: a null id is hashed as the empty text; a null text has no bytes; repeated rows share a shard and get
slots of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from rankforge.llm import common
from rankforge.session import written

SHARDS = 8
#: Multiplier of the generator inside jump consistent hashing (a fixed value of the method).
MULTIPLIER = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key."""
    state = keys.astype(np.uint64)
    shard = np.full(len(state), -1, np.int64)
    following = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = following[live]
        state[live] = state[live] * np.uint64(MULTIPLIER) + np.uint64(1)
        share = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        following[live] = ((shard[live] + 1) * share).astype(np.int64)
        live = live[following[live] < shards]
    return shard


def key_of(column: Column) -> Column:
    """A stable number for any id: the first 15 hexadecimal digits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def shard_of(column: Column, shards: int) -> Column:
    """The shard of an id among ``shards``."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(), shards).astype(np.int32))

    return place(key_of(column))


def with_slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, ... inside each shard by ``order``; rows equal in it are taken in any order."""
    spark = rows.sparkSession
    kept = written(rows.withColumn("_row", F.monotonically_increasing_id()), "shards")
    keys = [shard, *order, "_row"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = kept.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_row")
    names = ordered.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields),
                        "_part int", "_place bigint"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            shards = batch.column(shard).to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(shards) else []
            place = np.arange(len(shards), dtype=np.int64)
            for begin, end in zip(begins, [*begins[1:], len(shards)]):
                before = seen.get(int(shards[begin]), 0)
                place[begin:end] += before - begin
                seen[int(shards[begin])] = before + int(end - begin)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(shards), part, np.int32)), pa.array(place)],
                names=[*names, "_part", "_place"])

    numbered = written(ordered.mapInArrow(number, schema), "slots")
    # At most one row for each partition and one more for each shard.
    counts = numbered.groupBy(shard, "_part").agg(F.count("*").alias("n"))
    before = counts.withColumn("_before", F.sum("n").over(Window.partitionBy(shard).orderBy("_part")) - F.col("n"))
    return numbered.join(F.broadcast(before.drop("n")), [shard, "_part"]).withColumn(
        "slot", F.col("_before") + F.col("_place")).select(*rows.columns, "slot")


def assign(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``grown_shard`` (with one more shard) and ``slot``."""
    thin = docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = thin.withColumns({"shard": shard_of(F.col("doc_id"), shards),
                               "grown_shard": shard_of(F.col("doc_id"), shards + 1)})
    return with_slots(placed, "shard", ["doc_id", "text_crc32", "size"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

