"""Small literal tables. Their sizes are fixed in ``rankforge.config``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankforge import config as C


def _named(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    data = [(i, name, smiles) for i, (name, smiles) in enumerate(rows)]
    return spark.createDataFrame(data, "pos INT, name STRING, smiles STRING")


def natural_products(spark: SparkSession) -> DataFrame:
    return _named(spark, C.NATURAL_PRODUCTS)


def starting_points(spark: SparkSession) -> DataFrame:
    return _named(spark, C.STARTING_POINTS)


def reference_actives(spark: SparkSession) -> DataFrame:
    return _named(spark, C.REFERENCE_ACTIVES)


def linkers(spark: SparkSession) -> DataFrame:
    return _named(spark, C.LINKERS)


def hybrid_motifs(spark: SparkSession) -> DataFrame:
    return _named(spark, C.HYBRID_MOTIFS)


def targets(spark: SparkSession) -> DataFrame:
    data = [(i, *row) for i, row in enumerate(C.TARGETS)]
    return spark.createDataFrame(data, "pos INT, target STRING, name STRING, bacteria STRING")


def numbered_names(spark: SparkSession, names: list[str]) -> DataFrame:
    """A list of names with positions; repeated names stay."""
    return spark.createDataFrame(list(enumerate(names)), "name_pos INT, name STRING")
