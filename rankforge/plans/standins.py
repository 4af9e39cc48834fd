"""Candidate tables derived from the generic benchmark tables, as DataFrames and as SQL.

Each view reads all rows and whole texts of its table.  The SQL text is what the comparison engine
runs and is written on its own, not produced from the DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankforge import config as C
from rankforge.functions.structures import hashed_bits
from rankforge.functions.sequences import clean_sequence
from rankforge.operators.similarity import add_fingerprint
from rankforge.functions.text import normalize_nan
from rankforge.sources.tables import spread_small

TAILS = ["", "C(=O)N", "C(=O)O", "NC(=O)C", "OC", "CCl", "N", "c1ccncc1"]
LIGANDS = ["O=CC1=CC=CC=C1", "O=CC1=CC=CC=C1O", "O=CCC", "NC1=CC=CC=C1"]


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def read_spread(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    """The needed columns, over all cores, for work that is heavy per row."""
    return spread_small(read(spark, folder, table).select(*columns))


def choose(values: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), number.cast("int"))


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence or line of every document as a raw peptide record."""
    docs = read_spread(spark, folder, "documents", "doc_id", "text")
    parts = docs.select("doc_id", F.posexplode(F.split("text", r"[.!?\n]+")).alias("seg", "raw"))
    d, s = F.col("doc_id"), F.col("seg").cast("bigint")
    pep_id = d * 1000000 + s
    return parts.select(
        pep_id.alias("pep_id"), "doc_id", s.alias("seg"), "raw",
        F.when((d + s) % 50 != 0, (1 + (d * 37 + s * 11) % 256).cast("double")).alias("mic"),
        choose(C.TARGET_ORGANISMS, (d + s) % 5).alias("target"),
        choose(["active", "inactive", "unknown"], pep_id % 3).alias("activity_text"),
        (((d * 7919 + s * 31) % 1000) / 1000.0).alias("probability_active"),
    )


SEGMENTS = """seg_lists AS (
  SELECT doc_id, string_split_regex(text, '[.!?\\n]+') AS l FROM documents),
seg_rows AS (
  SELECT doc_id, unnest(l) AS raw, CAST(unnest(range(len(l))) AS BIGINT) AS seg FROM seg_lists),
segments AS (
  SELECT doc_id * 1000000 + seg AS pep_id, doc_id, seg, raw,
    CASE WHEN (doc_id + seg) % 50 <> 0
         THEN CAST(1 + (doc_id * 37 + seg * 11) % 256 AS DOUBLE) END AS mic,
    ['E. coli', 'S. aureus', 'P. aeruginosa', 'B. subtilis', 'K. pneumoniae']
      [CAST(1 + (doc_id + seg) % 5 AS INT)] AS target,
    ['active', 'inactive', 'unknown'][CAST(1 + (doc_id * 1000000 + seg) % 3 AS INT)] AS activity_text,
    ((doc_id * 7919 + seg * 31) % 1000) / 1000.0::DOUBLE AS probability_active
  FROM seg_rows)"""


def peptides(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with the cleaned sequence."""
    return segments(spark, folder).withColumn("sequence", clean_sequence(F.col("raw")))


PEPTIDES = SEGMENTS + """,
peptides AS (
  SELECT *, regexp_replace(upper(replace(raw, 'ß', 'ss')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')
    AS sequence
  FROM segments)"""


def molecules(spark: SparkSession, folder: str) -> DataFrame:
    """One molecule per part: a structure text built from the row, and descriptor columns."""
    part = read_spread(spark, folder, "part", "p_partkey", "p_size", "p_brand")
    k, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    brand = F.expr("cast(substr(p_brand, 7) as int)")
    smiles = F.concat(
        choose([s for _, s in C.STARTING_POINTS], k % 10),
        F.expr("repeat('C', cast(substr(p_brand, 7) as int))"),
        choose([s for _, s in C.LINKERS], size % 5),
        choose(TAILS, F.floor(k / 10) % 8),
        F.when(k % 41 == 0, "(").otherwise(""),
    )
    made = part.select(
        k.alias("mol_id"),
        choose([n for n, _ in C.STARTING_POINTS], k % 10).alias("base_name"),
        brand.alias("brand"),
        smiles.alias("smiles"),
        (80 + k * 13 % 1100).cast("double").alias("MW"),
        F.when(k % 53 == 0, F.lit(float("nan"))).otherwise((size - 15) / 5.0).alias("LogP"),
        (k * 7 % 220).cast("double").alias("TPSA"),
        (k % 8).cast("int").alias("NumHDonors"),
        (k % 14).cast("int").alias("NumHAcceptors"),
        (k % 9).cast("int").alias("NumRotatableBonds"),
        (k % 4).cast("int").alias("NumAromaticRings"),
        (10 + k % 40).cast("int").alias("NumHeavyAtoms"),
        ((k % 10) / 10.0).alias("FractionCSP3"),
        (k % 5).cast("int").alias("NumRings"),
        (k * 17 % 900).cast("double").alias("BertzCT"),
        (30 + k % 120).cast("int").alias("NumValenceElectrons"),
        ((k * 7919 % 1000) / 1000.0).alias("probability_active"),
    )
    return normalize_nan(made)


MOLECULES = """molecules AS (
  SELECT p_partkey AS mol_id,
    ['Curcumin', 'Resveratrol', 'Quercetin', 'Epigallocatechin gallate', 'Hydroxytyrosol',
     'Caffeic acid', 'Ferulic acid', 'Gallic acid', 'Ellagic acid', 'Epicatechin']
      [CAST(1 + p_partkey % 10 AS INT)] AS base_name,
    CAST(substr(p_brand, 7) AS INT) AS brand,
    ['CC(=O)CC(C)=CC1=CC=C(O)C(OC)=C1', 'OC1=CC=C(C=C1)C=CC1=CC(O)=CC(O)=C1',
     'OC1=C(O)C=C2C(=O)C3C(O)=C(O)C(C3OC2=C1)=O',
     'CC1(C)OC2=C(C1)OC3=C(C2=O)C=C(C=C3O)C4=CC(C5=C(C=C(C5)O)O)C(=O)O',
     'OC1=CC=C(O)C(CO)=C1', 'OC1=CC=C(C=CC(O)=O)C1', 'COC1=C(C=CC(=C1)C=CC(O)=O)C',
     'OC1=CC(O)=C(O)C(O)=C1', 'OC1=C(O)C2=C(C=C1O)C1=C(O)C(=O)C3=C(O)C(O)=C(O)C3=C1C2=O',
     'OC1C2C(OC3=C(C2=O)C=C(C=C3O)C1CO)CO'][CAST(1 + p_partkey % 10 AS INT)]
    || repeat('C', CAST(substr(p_brand, 7) AS INT))
    || ['CCC', 'CCCCCC', 'CCCCCCCCCC', 'CCOCCOCC', 'c1ccccc1'][1 + p_size % 5]
    || ['', 'C(=O)N', 'C(=O)O', 'NC(=O)C', 'OC', 'CCl', 'N', 'c1ccncc1']
         [CAST(1 + (p_partkey // 10) % 8 AS INT)]
    || CASE WHEN p_partkey % 41 = 0 THEN '(' ELSE '' END AS smiles,
    CAST(80 + p_partkey * 13 % 1100 AS DOUBLE) AS "MW",
    CASE WHEN p_partkey % 53 <> 0 THEN (p_size - 15) / 5.0::DOUBLE END AS "LogP",
    CAST(p_partkey * 7 % 220 AS DOUBLE) AS "TPSA",
    CAST(p_partkey % 8 AS INT) AS "NumHDonors", CAST(p_partkey % 14 AS INT) AS "NumHAcceptors",
    CAST(p_partkey % 9 AS INT) AS "NumRotatableBonds", CAST(p_partkey % 4 AS INT) AS "NumAromaticRings",
    CAST(10 + p_partkey % 40 AS INT) AS "NumHeavyAtoms",
    (p_partkey % 10) / 10.0::DOUBLE AS "FractionCSP3", CAST(p_partkey % 5 AS INT) AS "NumRings",
    CAST(p_partkey * 17 % 900 AS DOUBLE) AS "BertzCT",
    CAST(30 + p_partkey % 120 AS INT) AS "NumValenceElectrons",
    (p_partkey * 7919 % 1000) / 1000.0::DOUBLE AS probability_active
  FROM part)"""

# Lexical validity of a structure text, as SQL.
VALID_SQL = """(length({c}) > 0
  AND len(regexp_extract_all({c}, '\\[[^\\]]+\\]|Br|Cl|[BCNOPSFIbcnops]')) > 0
  AND length(array_to_string(regexp_extract_all({c},
    '\\[[^\\]]+\\]|Br|Cl|[BCNOPSFIbcnops]|%[0-9][0-9]|[0-9]|[()=#./\\\\:~*$+-]'), '')) = length({c})
  AND len(list_filter([regexp_replace({c}, '\\[[^\\]]*\\]', '', 'g')], lambda o:
    length(replace(o, '(', '')) = length(replace(o, ')', ''))
    AND len(list_filter([regexp_replace(o, '[^()]', '', 'g')], lambda q: len(list_filter(range(1, length(q) + 1),
      lambda i: length(replace(q[1:i], ')', '')) < length(replace(q[1:i], '(', '')))) = 0)) = 1
    AND len(list_filter([regexp_extract_all(o, '%[0-9][0-9]|[0-9]')], lambda l: len(list_filter(list_distinct(l),
      lambda d: len(list_filter(l, lambda e: e = d)) % 2 <> 0)) = 0)) = 1)) = 1)"""


def valid_sql(column: str) -> str:
    return VALID_SQL.replace("{c}", column)


def word_bits(c: Column) -> Column:
    """Hashed bits of the distinct words of a whole text."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return hashed_bits(F.array_distinct(words), 1024)


def document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_spread(spark, folder, "documents", "doc_id", "text")
    return add_fingerprint(docs, word_bits(F.col("text"))).drop("text")


def benchmark_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    items = read(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_pos"), F.concat(F.lit("item"), F.col("item_id")).alias("query"),
        "text")
    return add_fingerprint(items, word_bits(F.col("text"))).drop("text")


def fingerprint_sql(name: str, table: str, key: str) -> str:
    """Rows (key, bit) and sizes of the word fingerprints of one table."""
    return f"""{name}_bits AS (
  SELECT DISTINCT {key}, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 1024 AS bit
  FROM (SELECT {key}, unnest(list_distinct(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'))) AS w
        FROM {table}) WHERE w <> ''),
{name}_sizes AS (SELECT {key}, count(*) AS n FROM {name}_bits GROUP BY {key})"""


DOCUMENT_FINGERPRINTS = fingerprint_sql("doc", "documents", "doc_id")
BENCHMARK_FINGERPRINTS = fingerprint_sql("item", "benchmark", "item_id")


def labelled_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Labels with a score taken from the document length."""
    labels = read(spark, folder, "labels").select("doc_id", "quality")
    docs = read(spark, folder, "documents").select("doc_id", "n_chars")
    score = (F.col("n_chars") * 31 % 997) / 997.0
    return labels.join(docs, "doc_id").select(
        "doc_id", F.col("quality").alias("y_true"), score.alias("y_prob"),
        F.when(score >= 0.5, 1).otherwise(0).alias("y_pred"))


LABELLED = """labelled AS (
  SELECT doc_id, quality AS y_true, (n_chars * 31 % 997) / 997.0::DOUBLE AS y_prob,
    CASE WHEN (n_chars * 31 % 997) / 997.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END AS y_pred
  FROM labels JOIN documents USING (doc_id))"""


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """Landed lookup results, one per order: search terms, hit positions, compounds, names."""
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return orders.select(
        (c % 400).alias("cid"),
        choose(C.APPROVED_DRUG_NAMES[:30] + ["aspirin", "caffeine", ""], c % 33).alias("name"),
        choose([s for _, s in C.STARTING_POINTS], c % 10).alias("smiles"),
        F.concat(F.lit("InChI="), c % 400).alias("inchi"),
        F.upper(F.substring(F.md5((c % 400).cast("string")), 1, 14)).alias("inchikey"),
        F.concat(F.lit("C"), c % 400, F.lit("H2")).alias("molecular_formula"),
        ((c % 400) * 1.5).cast("double").alias("molecular_weight"),
        choose(C.SEARCH_TERMS + ["other"], k % 4).alias("term"),
        k.alias("hit_pos"),
    )


LANDED = """landed AS (
  SELECT o_custkey % 400 AS cid,
    ['ciprofloxacin', 'levofloxacin', 'moxifloxacin', 'azithromycin', 'ampicillin', 'amoxicillin',
     'cephalexin', 'doxycycline', 'minocycline', 'sulfamethoxazole', 'trimethoprim',
     'nitrofurantoin', 'tetracycline', 'chloramphenicol', 'vancomycin', 'linezolid', 'daptomycin',
     'colistin', 'polymyxin B', 'rifampicin', 'gentamicin', 'amikacin', 'tobramycin', 'cefepime',
     'cefazolin', 'meropenem', 'imipenem', 'ertapenem', 'piperacillin', 'ticarcillin', 'aspirin',
     'caffeine', ''][CAST(1 + o_custkey % 33 AS INT)] AS name,
    ['CC(=O)CC(C)=CC1=CC=C(O)C(OC)=C1', 'OC1=CC=C(C=C1)C=CC1=CC(O)=CC(O)=C1',
     'OC1=C(O)C=C2C(=O)C3C(O)=C(O)C(C3OC2=C1)=O',
     'CC1(C)OC2=C(C1)OC3=C(C2=O)C=C(C=C3O)C4=CC(C5=C(C=C(C5)O)O)C(=O)O',
     'OC1=CC=C(O)C(CO)=C1', 'OC1=CC=C(C=CC(O)=O)C1', 'COC1=C(C=CC(=C1)C=CC(O)=O)C',
     'OC1=CC(O)=C(O)C(O)=C1', 'OC1=C(O)C2=C(C=C1O)C1=C(O)C(=O)C3=C(O)C(O)=C(O)C3=C1C2=O',
     'OC1C2C(OC3=C(C2=O)C=C(C=C3O)C1CO)CO'][CAST(1 + o_custkey % 10 AS INT)] AS smiles,
    'InChI=' || o_custkey % 400 AS inchi,
    upper(substr(md5(CAST(o_custkey % 400 AS VARCHAR)), 1, 14)) AS inchikey,
    'C' || o_custkey % 400 || 'H2' AS molecular_formula,
    CAST((o_custkey % 400) * 1.5 AS DOUBLE) AS molecular_weight,
    ['antibacterial drug FDA approved', 'antibiotic FDA approved', 'antimicrobial drug', 'other']
      [CAST(1 + o_orderkey % 4 AS INT)] AS term,
    o_orderkey AS hit_pos
  FROM orders)"""


def reactants(spark: SparkSession, folder: str) -> DataFrame:
    """Aldehydes from parts and amines from nations, as one reactant table."""
    part = read_spread(spark, folder, "part", "p_partkey", "p_size", "p_name")
    nation = read(spark, folder, "nation").select("n_nationkey", "n_name")
    k = F.col("p_partkey")
    aldehydes = part.select(
        F.lit("aldehyde").alias("type"), F.concat("p_name", F.lit("-"), k).alias("name"),
        F.concat(choose(LIGANDS, k % 4), F.expr("repeat('C', p_size)")).alias("smiles"))
    amines = nation.select(
        F.lit("amine").alias("type"), F.col("n_name").alias("name"),
        F.concat(F.lit("N"), F.expr("repeat('C', n_nationkey)"), F.lit("O")).alias("smiles"))
    return aldehydes.unionByName(amines)


REACTANTS = """reactants AS (
  SELECT 'aldehyde' AS type, p_name || '-' || p_partkey AS name,
    ['O=CC1=CC=CC=C1', 'O=CC1=CC=CC=C1O', 'O=CCC', 'NC1=CC=CC=C1'][CAST(1 + p_partkey % 4 AS INT)]
    || repeat('C', p_size) AS smiles FROM part
  UNION ALL
  SELECT 'amine', n_name, 'N' || repeat('C', n_nationkey) || 'O' FROM nation)"""

VIEWS = {
    "segments": SEGMENTS, "peptides": PEPTIDES, "molecules": MOLECULES, "labelled": LABELLED,
    "landed": LANDED, "reactants": REACTANTS, "doc_fp": DOCUMENT_FINGERPRINTS,
    "item_fp": BENCHMARK_FINGERPRINTS,
}


def sql(views: str, body: str, recursive: bool = False) -> str:
    """A statement with the named views in front."""
    parts = ",\n".join(VIEWS[v] for v in views.split())
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    joint = ",\n" if body.lower().startswith("with ") else "\n"
    body = body[5:] if joint == ",\n" else body
    return (head + parts + joint + body) if parts else body
