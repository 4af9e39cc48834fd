"""A corpus pipeline of five stages; each works on all that its predecessor kept.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; all but the last return the columns of ``documents``. ``run``
writes each stage's rows to the shared folder and reads them again, so that a lost executor costs no earlier stage.

Defined results: a null or empty text fails the quality rules, so later stages get none from :func:`run`; taken alone they
keep such rows (near-dedup one of them). A null id is kept last among near-duplicates and stays null. Equal rows are
near-duplicates, of which one stays. Very long texts are worked on whole. An empty table gives no rows after every stage, and
an empty benchmark cuts nothing. Further columns go through all stages but the last, whatever their names; ``n_chars``
follows the text where the table has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm import common, decontaminate, pieces, repetition, secrets, simhash
from rankforge.session import written


def with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` follows the text where the table has that column."""
    if "n_chars" in columns and "text" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return repetition.keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut from the texts."""
    return with_length(decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark")), docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return with_length(secrets.redact(docs, secrets.train(docs)), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left."""
    return pieces.encode(docs, ["doc_id"]).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding", tokens),
]

#: Fingerprints, character models and piece ids have no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
