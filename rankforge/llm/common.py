"""Helpers the corpus operators share: thin reads, Arrow slices of bounded size, span digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Texts are worked on in slices of about this many bytes, so a task's memory does not follow its partition.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def neutral(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with columns c0, c1, ..., which clash with no name an operator adds, and each column's new name."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def offsets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and where each text begins (one more entry than texts)."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=texts.offset + len(texts) + 1)[texts.offset:]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0]:ends[-1]], ends - ends[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of each batch whose texts hold about ``limit`` bytes; a longer text stands alone, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(column), "")


def lists_of(codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Where the entries of each of ``n`` owners begin in an array sorted by owner (one more entry than owners)."""
    return np.searchsorted(owner, np.arange(n + 1))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def word_arrays(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, flat, and the row of each word."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    real = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(real).as_py():
        owner = owner[real.to_numpy(zero_copy_only=False)]
        flat = flat.filter(real)
    return flat, owner
