"""The row-wise steps on a file stream.

Cleaning, features, rule scores and similarity to a fixed reference list work row by row, so the
same functions run on a streaming DataFrame.  Steps that look at the whole table (ranges, top lists,
ranking across categories) stay batch jobs over the landed predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rankforge.operators.scoring import score_category


def stream_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def score_stream(candidates: DataFrame, category: str, target: str, progress: str) -> StreamingQuery:
    """Score arriving candidates and append them to a table; runs until the present files are done.

    ``progress`` is the folder that remembers which files were read.  A later call with the same
    target and progress goes on where the last one ended; both belong to the shared storage.
    """
    return (score_category(candidates, category).writeStream.format("parquet")
            .option("path", target).option("checkpointLocation", progress)
            .outputMode("append").trigger(availableNow=True).start())
