"""Filters, labels, de-duplication and the two preprocessing jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rankforge.functions.sequences import clean_sequence
from rankforge.functions.structures import is_valid_structure
from rankforge.sources.tables import require_columns


def keep_length(df: DataFrame, column: str, low: int = 10, high: int = 50) -> DataFrame:
    """Keep texts whose length is inside [low, high]."""
    return df.filter(F.length(column).between(low, high))


def threshold_label(value: Column, limit: float = 32.0) -> Column:
    """1 up to the limit, else 0; an unknown value gives 0."""
    return F.when(value <= limit, 1).otherwise(0)


def text_label(value: Column) -> Column:
    """``active`` is 1, ``inactive`` is 0, any other text is null."""
    return F.when(value == "active", 1).when(value == "inactive", 0)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order.

    Each task already reduces a key to one row before the shuffle (a row number limited to 1),
    so one very frequent key costs at most one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_rn", F.row_number().over(window))
            .filter(F.col("_rn") == 1).drop("_rn"))


def distinct_records(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each record once."""
    return df.select(*columns).distinct()


def at_most(df: DataFrame, column: str, limit: float) -> DataFrame:
    """Upper bound, applied only where the table has the column."""
    return df.filter(F.col(column) <= limit) if column in df.columns else df


def column_or(df: DataFrame, name: str, default: float) -> Column:
    """The column, or a constant where the table lacks it."""
    return F.col(name) if name in df.columns else F.lit(default)


def of_type(df: DataFrame, value: str, column: str = "type") -> DataFrame:
    return df.filter(F.col(column) == value)


def valid_structures(df: DataFrame, structure: str = "smiles") -> DataFrame:
    """Drop rows whose structure text is not lexically valid; labels stay with their rows."""
    return df.filter(is_valid_structure(F.col(structure)))


def feature_columns(df: DataFrame, exclude: tuple = ("sequence", "smiles", "activity", "name")) -> list[str]:
    """Every numeric column that is not an identifier or the label."""
    return [f.name for f in df.schema.fields
            if f.name not in exclude and isinstance(f.dataType, T.NumericType)]


def preprocess_peptides(
    df: DataFrame, order: list[str], limit: float = 32.0, low: int = 10, high: int = 50,
) -> DataFrame:
    """Clean, filter by length, label, drop unlabelled rows, keep the first of each sequence."""
    out = require_columns(df, "sequence").withColumn(
        "sequence", clean_sequence(F.col("sequence").cast("string")))
    out = keep_length(out, "sequence", low, high)
    if "mic" in out.columns:
        out = out.withColumn("activity", threshold_label(F.col("mic"), limit))
    elif isinstance(out.schema["activity"].dataType, T.StringType):
        out = out.withColumn("activity", text_label(F.col("activity")))
    return keep_first(out.na.drop(subset=["sequence", "activity"]), ["sequence"], order)


def preprocess_degraders(df: DataFrame, order: list[str], max_weight: float = 1000) -> DataFrame:
    """Bound the weight if known, drop incomplete rows, keep the first of each structure."""
    out = at_most(require_columns(df, "smiles"), "MW", max_weight)
    return keep_first(out.na.drop(subset=["smiles", "activity"]), ["smiles"], order)
