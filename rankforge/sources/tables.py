"""File sources. Text sources carry ``ingest_pos``, a sortable mark of the input order; parquet on request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankforge.functions.text import normalize_nan

#: Tables of at most so many bytes may be dealt over the cores.
SMALL_BYTES = 64 << 20
REACTANTS = "type STRING, name STRING, smiles STRING"
PEPTIDES = "sequence STRING, mic DOUBLE, target STRING, activity STRING"
MOLECULES = (
    "smiles STRING, MW DOUBLE, LogP DOUBLE, TPSA DOUBLE, NumHDonors INT, NumHAcceptors INT, "
    "NumRotatableBonds INT, NumAromaticRings INT, NumHeavyAtoms INT, FractionCSP3 DOUBLE, "
    "NumRings INT, BertzCT DOUBLE, NumValenceElectrons INT"
)
DEGRADER_TRAINING = "smiles STRING, activity INT, MW DOUBLE, target STRING"
LANDED_LOOKUPS = (
    "cid BIGINT, name STRING, smiles STRING, inchi STRING, inchikey STRING, "
    "molecular_formula STRING, molecular_weight DOUBLE, term STRING, term_order INT, hit_pos INT"
)


def spread_small(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """Deal a small table, by the size its files state, over all cores; a larger one is left as it is.

    A single small file is one task otherwise.  The bound keeps this from ever shuffling a large table.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= limit else df


def add_ingest_pos(df: DataFrame) -> DataFrame:
    """Input order of a file scan: file, block in the file, row in the block.

    The order does not depend on how Spark packs blocks into tasks.
    """
    return df.withColumn(
        "ingest_pos",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header row and a declared schema."""
    raw = spark.read.schema(schema).csv(path, header=True, nanValue="NaN")
    return normalize_nan(add_ingest_pos(raw))


def scan_parquet(spark: SparkSession, path: str, with_pos: bool = False) -> DataFrame:
    """Parquet with NaN as null; ``ingest_pos`` (file, row in the file) only on request.

    The position comes from the file's own row numbers, so filters and columns still reach the scan.
    """
    rows = spark.read.parquet(path)
    if with_pos:
        rows = rows.withColumn("ingest_pos", F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    return normalize_nan(rows)


def scan_fasta(spark: SparkSession, path: str, with_length: bool = True) -> DataFrame:
    """FASTA records, one row per record.

    Splitting the text at newline-plus-``>`` makes each record one row, so large files still
    split over tasks.
    """
    raw = add_ingest_pos(spark.read.text(path, lineSep="\n>"))
    record = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    head = F.substring_index(record, "\n", 1)
    body = F.when(
        F.contains(record, F.lit("\n")),
        F.regexp_replace(F.substr(record, F.length(head) + 2), r"\s", ""),
    ).otherwise("")
    out = raw.select(
        body.alias("sequence"),
        F.regexp_extract(head, r"^(\S*)", 1).alias("name"),
        head.alias("description"),
        "ingest_pos",
    ).filter(F.length("description") > 0)
    if with_length:
        out = out.withColumn("length", F.length("sequence"))
    return out


def load_sequences(spark: SparkSession, path: str, schema: str = PEPTIDES) -> DataFrame:
    """Read by file suffix: ``.csv`` or ``.fasta``; anything else is an error."""
    if path.endswith(".csv"):
        return scan_csv(spark, path, schema)
    if path.endswith(".fasta"):
        return scan_fasta(spark, path, with_length=False)
    raise ValueError(f"unsupported file format: {path}")


def load_category(spark: SparkSession, base: str, category: str) -> DataFrame:
    """Training rows of one category from a table laid out as ``base/category=<name>/``."""
    rows = spark.read.parquet(base).filter(F.col("category") == category)
    if not rows.take(1):
        raise FileNotFoundError(f"no training data for category {category}")
    return normalize_nan(rows)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The same table, or a ``ValueError`` naming what is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"table must contain {', '.join(missing)}")
    return df
