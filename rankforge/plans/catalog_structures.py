"""Registered queries: features read from structure texts and descriptor-table joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankforge.functions import structures as M
from rankforge.operators import cleaning, joins
from rankforge.plans import standins as V
from rankforge.plans.registry import query, rounded, rounded_sql
from rankforge.sources import sinks

BASE = ["MW", "LogP", "TPSA", "NumHDonors", "NumHAcceptors", "NumRotatableBonds", "NumAromaticRings",
        "NumHeavyAtoms", "FractionCSP3", "NumRings", "BertzCT", "NumValenceElectrons"]
BASE_SQL = ", ".join(f'd."{c}"' for c in BASE)

# One descriptor row per structure.
TABLE_SQL = """descriptors AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY smiles ORDER BY mol_id) AS r FROM molecules)
  WHERE r = 1 AND "MW" <= 1000)"""


def descriptor_table(spark: SparkSession, folder: str) -> DataFrame:
    """Toolkit values keyed by structure; structures above a weight of 1000 have none."""
    rows = cleaning.keep_first(V.molecules(spark, folder), ["smiles"], ["mol_id"])
    return rows.filter("MW <= 1000").select("smiles", *BASE)


@query("m01_m12_descriptor_join", V.sql("molecules", f"""
WITH {TABLE_SQL}
SELECT m.mol_id, m.smiles, {BASE_SQL} FROM molecules m JOIN descriptors d USING (smiles)
WHERE {V.valid_sql('m.smiles')}"""))
def descriptor_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = cleaning.valid_structures(V.molecules(spark, folder).select("mol_id", "smiles"))
    return rows.join(descriptor_table(spark, folder), "smiles")


@query("m13_j05_three_properties", V.sql("molecules", f"""
WITH {TABLE_SQL}
SELECT m.mol_id, m.smiles, d."MW" AS "MolWt", d."LogP" AS "logP", d."TPSA" FROM molecules m LEFT JOIN descriptors d USING (smiles)"""))
def three_properties(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.molecules(spark, folder).select("mol_id", "smiles")
    table = descriptor_table(spark, folder).select(
        "smiles", F.col("MW").alias("MolWt"), F.col("LogP").alias("logP"), "TPSA")
    return rows.join(table, "smiles", "left")


# Oxygen atoms with a hydrogen, as SQL.
HYDROXYL_SQL = """(len(string_split(smiles, 'O)')) - len(string_split(smiles, '=O)'))
  + len(string_split(smiles, 'O.')) - len(string_split(smiles, '=O.'))
  + CASE WHEN smiles LIKE '%O' AND smiles NOT LIKE '%=O' THEN 1 ELSE 0 END
  + len(regexp_extract_all(smiles, '(?:^|\\.)O[A-Za-z(\\[]')) + len(regexp_extract_all(smiles, '\\[OH')))"""


@query("m02_m04_solubility_record", rounded_sql(V.sql("molecules", f"""
SELECT mol_id, CAST({HYDROXYL_SQL} AS INT) AS "NumPhenolicOH", -0.65 * "LogP" + 0.07 * "TPSA" + 0.66 AS "LogS_estimate",
  "NumHDonors" AS "NumHBD", "NumHAcceptors" AS "NumHBA", "MW" FROM molecules"""), "LogS_estimate"))
def solubility(spark: SparkSession, folder: str) -> DataFrame:
    rows = M.add_solubility_features(V.molecules(spark, folder))
    return rounded(rows.select(
        "mol_id", "NumPhenolicOH", "LogS_estimate", F.col("NumHDonors").alias("NumHBD"),
        F.col("NumHAcceptors").alias("NumHBA"), "MW"))


@query("m05_m08_degrader_record", rounded_sql(V.sql("molecules", """
SELECT mol_id,
  CAST(len(string_split(smiles, 'C(=O)N')) + len(string_split(smiles, 'NC(=O)')) - 2 AS INT) AS "NumAmideBonds",
  CAST(greatest(1, len(regexp_extract_all(smiles, '[CNOPS]')) // 3) AS INT) AS "ChainLength",
  len(regexp_extract_all(smiles, '(?:\\[[^\\]]+\\]|Br|Cl|[BCNOPSFIbcnops])(?:[0-9(]|%[0-9][0-9])'))
    / len(regexp_extract_all(smiles, '\\[[^\\]]+\\]|Br|Cl|[BCNOPSFIbcnops]')) AS "BranchingIndex"
FROM molecules"""), "BranchingIndex"))
def degrader(spark: SparkSession, folder: str) -> DataFrame:
    rows = M.add_degrader_features(V.molecules(spark, folder))
    return rounded(rows.select("mol_id", "NumAmideBonds", "ChainLength", "BranchingIndex"))


NITROGEN_SQL = """len(list_filter(regexp_extract_all(smiles, '\\[[^\\]]+\\]|Br|Cl|[BCNOPSFIbcnops]'),
  lambda a: regexp_full_match(a, 'N|n|\\[[0-9]*[Nn]([^a-z].*)?\\]')))"""
OXYGEN_SQL = NITROGEN_SQL.replace("N|n", "O|o").replace("[Nn]", "[Oo]")


@query("m09_hydrogen_bond_counts", V.sql("molecules", f"""
SELECT mol_id, CAST(CASE WHEN {V.valid_sql('smiles')} THEN {NITROGEN_SQL} + {HYDROXYL_SQL} ELSE 0 END AS INT) AS hbd,
  CAST(CASE WHEN {V.valid_sql('smiles')} THEN {NITROGEN_SQL} + {OXYGEN_SQL} - {HYDROXYL_SQL} ELSE 0 END AS INT) AS hba
FROM molecules"""))
def hydrogen_bonds(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("smiles")
    return V.molecules(spark, folder).select(
        "mol_id", M.hbond_donors(s).alias("hbd"), M.hbond_acceptors(s).alias("hba"))


@query("m10_structure_bits", V.sql("molecules", f"""
WITH toks AS (
  SELECT mol_id, regexp_extract_all(smiles,
    '\\[[^\\]]+\\]|Br|Cl|[BCNOPSFIbcnops]|%[0-9][0-9]|[0-9]|[()=#./\\\\:~*$+-]') AS t
  FROM molecules WHERE {V.valid_sql('smiles')}),
grams AS (
  SELECT mol_id, unnest(t) AS g FROM toks
  UNION SELECT mol_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM toks
  UNION SELECT mol_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM toks)
SELECT mol_id, list_sort(list(DISTINCT CAST(CAST(('0x' || substr(md5(g), 1, 8)) AS BIGINT) % 2048 AS INT))) AS bits
FROM grams GROUP BY mol_id"""))
def bits(spark: SparkSession, folder: str) -> DataFrame:
    rows = cleaning.valid_structures(V.molecules(spark, folder).select("mol_id", "smiles"))
    return rows.select("mol_id", M.token_bits(F.col("smiles"), 2048).alias("bits"))


@query("m11_structure_keys", V.sql("molecules", """
SELECT mol_id, list_transform(list_filter(range(1, len(p) + 1), lambda i: regexp_matches(smiles, p[i])),
  lambda i: CAST(i - 1 AS INT)) AS keys
FROM molecules, (SELECT ['\\[', 'Cl', 'Br', 'F', 'I', 'S', 'P', 'N', 'O', 'n', 'o', 's', '=O', '=N', '#', 'C\\(=O\\)O',
  'C\\(=O\\)N', 'NC\\(=O\\)', 'S\\(=O\\)', 'c1', 'C1', '2', '3', '\\(C\\)', 'OC', 'CO', 'NC', 'CN', 'C=C', '\\.', 'CCC',
  '\\(O\\)'] AS p)"""))
def keys(spark: SparkSession, folder: str) -> DataFrame:
    return V.molecules(spark, folder).select("mol_id", M.structure_keys(F.col("smiles")).alias("keys"))


@query("m14_scaffold_key", V.sql("molecules", """
SELECT key, count(*) AS n FROM (
  SELECT regexp_replace(replace(smiles, 'CC', 'C[C@@H]'), '[@/\\\\]', '', 'g') AS key FROM molecules) GROUP BY key"""))
def scaffold(spark: SparkSession, folder: str) -> DataFrame:
    marked = F.replace("smiles", F.lit("CC"), F.lit("C[C@@H]"))
    rows = V.molecules(spark, folder).select(M.scaffold_key(marked).alias("key"))
    return rows.groupBy("key").agg(F.count("*").alias("n"))


MERGED = V.sql("molecules", f"""
WITH {TABLE_SQL},
extra AS (
  SELECT smiles, any_value("MW") + 1 AS "MW", CASE WHEN max(brand) % 2 = 0 THEN min("TPSA") END AS "TPSA", max(brand) AS brand
  FROM (SELECT smiles, 100.0::DOUBLE AS "MW", "TPSA", brand FROM molecules) GROUP BY smiles HAVING max(brand) > 5)
SELECT smiles, CASE WHEN e.brand IS NOT NULL THEN e."MW" ELSE d."MW" END AS "MW",
  CASE WHEN e.brand IS NOT NULL THEN e."TPSA" ELSE d."TPSA" END AS "TPSA", d."LogP", e.brand
FROM (SELECT smiles, "MW", "LogP", "TPSA" FROM descriptors) d FULL JOIN extra e USING (smiles)""")


@query("j06_merge_features", MERGED)
def merge(spark: SparkSession, folder: str) -> DataFrame:
    return joins.merge_features(*feature_tables(spark, folder), "smiles")


@query("j06_m01_m12_bucketed_features", MERGED)
def merge_bucketed(spark: SparkSession, folder: str) -> DataFrame:
    """The same from stored tables in buckets of the structure, which are joined without a shuffle."""
    left, right = (sinks.write_features(t, "smiles") for t in feature_tables(spark, folder))
    return joins.merge_features(left, right, "smiles")


def feature_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    left = descriptor_table(spark, folder).select("smiles", "MW", "LogP", "TPSA")
    right = V.molecules(spark, folder).groupBy("smiles").agg(
        F.lit(101.0).alias("MW"), F.when(F.max("brand") % 2 == 0, F.min("TPSA")).alias("TPSA"),
        F.max("brand").alias("brand"))
    return left, right.filter("brand > 5")


def partner_sql() -> str:
    return V.sql("molecules", f"""
WITH counted AS (
  SELECT mol_id, smiles, CAST(CASE WHEN {V.valid_sql('smiles')} THEN {NITROGEN_SQL} + {HYDROXYL_SQL} ELSE 0 END AS INT) AS hbd,
    CAST(CASE WHEN {V.valid_sql('smiles')} THEN {NITROGEN_SQL} + {OXYGEN_SQL} - {HYDROXYL_SQL} ELSE 0 END AS INT) AS hba
  FROM molecules),
asked AS (
  SELECT name AS query, {NITROGEN_SQL} + {HYDROXYL_SQL} AS qd,
    {NITROGEN_SQL} + {OXYGEN_SQL} - {HYDROXYL_SQL} AS qa
  FROM (VALUES ('Curcumin', 'CC(=O)CC(C)=CC1=CC=C(O)C(OC)=C1'), ('Caffeic acid', 'OC1=CC=C(C=CC(O)=O)C1')) AS t(name, smiles))
SELECT mol_id, query, hbd, hba, CAST(abs(hbd - qa) AS INT) AS hbd_match, CAST(abs(hba - qd) AS INT) AS hba_match,
  1.0::DOUBLE / (1.0 + abs(hbd - qa) + abs(hba - qd)) AS compatibility FROM counted, asked""")


@query("j08_r10_l07_partner_matching", rounded_sql(partner_sql(), "compatibility"))
def partners(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.molecules(spark, folder).select("mol_id", "smiles")
    asked = [("Curcumin", "CC(=O)CC(C)=CC1=CC=C(O)C(OC)=C1"), ("Caffeic acid", "OC1=CC=C(C=CC(O)=O)C1")]
    found = joins.match_partners(rows, asked).drop("smiles")
    return rounded(found.orderBy(F.desc("compatibility"), "query", "mol_id"))
