"""Registered queries: scans, landed lookups, dimension tables and sinks."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankforge import config as C
from rankforge.operators import cleaning
from rankforge.plans import standins as V
from rankforge.plans.registry import query, rounded
from rankforge.session import scratch_path
from rankforge.sources import dimensions, lookups, sinks, tables

MOLECULE_COLUMNS = [c.split()[0] for c in tables.MOLECULES.split(", ")]
MOLECULE_SQL = ", ".join(f'"{c}"' for c in MOLECULE_COLUMNS)


@query("s01_csv_scan", V.sql("molecules", f"SELECT {MOLECULE_SQL} FROM molecules"))
def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "molecules") + ".csv"
    rows = V.molecules(spark, folder).select(*MOLECULE_COLUMNS)
    rows = rows.withColumn("LogP", F.coalesce("LogP", F.lit(float("nan"))))
    rows.write.csv(path, header=True)
    return tables.scan_csv(spark, path, tables.MOLECULES).drop("ingest_pos")


@query("s02_s13_category_table", V.sql("molecules", """
SELECT smiles, "MW", probability_active, 'polyphenol' AS category FROM molecules WHERE brand <= 12"""))
def category_table(spark: SparkSession, folder: str) -> DataFrame:
    base = scratch_path(spark, "categories")
    rows = V.molecules(spark, folder).select("smiles", "MW", "probability_active", "brand")
    sinks.write_category(rows.filter("brand <= 12").drop("brand"), base, "polyphenol")
    sinks.write_category(rows.filter("brand > 12").drop("brand"), base, "repurposed")
    return tables.load_category(spark, base, "polyphenol")


def _write_fasta(spark: SparkSession, folder: str) -> str:
    """Cleaned sequences as FASTA with two-line bodies and a ``>`` inside the header."""
    path = scratch_path(spark, "peptides") + ".fasta"
    s, half = F.col("sequence"), F.floor(F.length("sequence") / 2).cast("int")
    V.peptides(spark, folder).select(F.concat(
        F.lit(">pep"), F.col("pep_id"), F.lit(" mic>"), F.coalesce(F.col("mic").cast("string"), F.lit("na")),
        F.lit("\n"), F.substr(s, F.lit(1), half), F.lit("\n"), F.substr(s, half + 1),
    ).alias("value")).write.text(path)
    return path


@query("s03_fasta_scan", V.sql("peptides", """
SELECT sequence, CAST(length(sequence) AS INT) AS length, 'pep' || pep_id AS name,
  'pep' || pep_id || ' mic>' || coalesce(CAST(mic AS VARCHAR), 'na') AS description
FROM peptides"""))
def fasta_scan(spark: SparkSession, folder: str) -> DataFrame:
    return tables.scan_fasta(spark, _write_fasta(spark, folder)).drop("ingest_pos")


@query("s04_load_by_suffix", V.sql("peptides", """
SELECT sequence, 'fasta' AS origin FROM peptides
UNION ALL SELECT CASE WHEN sequence <> '' THEN sequence END, 'csv' FROM peptides"""))
def load_by_suffix(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "peptides") + ".csv"
    pep = V.peptides(spark, folder)
    pep.select("sequence", "mic", "target", F.col("activity_text").alias("activity")).write.csv(path, header=True)
    fasta = tables.load_sequences(spark, _write_fasta(spark, folder))
    csv = tables.load_sequences(spark, path)
    return (fasta.select("sequence", F.lit("fasta").alias("origin"))
            .union(csv.select(F.nullif("sequence", F.lit("")).alias("sequence"), F.lit("csv"))))


@query("s05_f09_reactants", V.sql("reactants", """
SELECT type, name, smiles FROM reactants WHERE type = 'aldehyde'
UNION ALL SELECT type, name, smiles FROM reactants WHERE type = 'amine'"""))
def reactant_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "reactants") + ".csv"
    V.reactants(spark, folder).write.csv(path, header=True)
    rows = tables.scan_csv(spark, path, tables.REACTANTS).drop("ingest_pos")
    return cleaning.of_type(rows, "aldehyde").union(cleaning.of_type(rows, "amine"))


@query("s06_f12_degrader_training", V.sql("molecules", """
SELECT smiles, activity, MW FROM (
  SELECT smiles, activity, MW, row_number() OVER (PARTITION BY smiles ORDER BY mol_id) AS r
  FROM (SELECT mol_id, smiles, "MW" AS MW,
          CASE WHEN mol_id % 7 <> 0 THEN CAST(probability_active >= 0.5 AS INT) END AS activity
        FROM molecules)
  WHERE MW <= 1000 AND activity IS NOT NULL) WHERE r = 1"""))
def degrader_training(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "degraders") + ".csv"
    m = V.molecules(spark, folder)
    (m.orderBy("mol_id").select(
        "smiles",
        F.when(F.col("mol_id") % 7 != 0, (F.col("probability_active") >= 0.5).cast("int")).alias("activity"),
        "MW", F.lit("LpxC").alias("target")).write.csv(path, header=True))
    rows = tables.scan_csv(spark, path, tables.DEGRADER_TRAINING)
    return cleaning.preprocess_degraders(rows, ["ingest_pos"]).select("smiles", "activity", "MW")


@query("s07_j07_dimension_lookup", V.sql("molecules", """
SELECT m.mol_id, m.base_name, s.smiles AS start_smiles, t.name AS target_name, t.bacteria
FROM molecules m
JOIN (SELECT base_name, arg_min(smiles, mol_id) AS any_smiles FROM molecules GROUP BY 1) USING (base_name)
JOIN (VALUES ('Curcumin', 'CC(=O)CC(C)=CC1=CC=C(O)C(OC)=C1'),
  ('Resveratrol', 'OC1=CC=C(C=C1)C=CC1=CC(O)=CC(O)=C1'),
  ('Quercetin', 'OC1=C(O)C=C2C(=O)C3C(O)=C(O)C(C3OC2=C1)=O'),
  ('Epigallocatechin gallate', 'CC1(C)OC2=C(C1)OC3=C(C2=O)C=C(C=C3O)C4=CC(C5=C(C=C(C5)O)O)C(=O)O'),
  ('Hydroxytyrosol', 'OC1=CC=C(O)C(CO)=C1'), ('Caffeic acid', 'OC1=CC=C(C=CC(O)=O)C1'),
  ('Ferulic acid', 'COC1=C(C=CC(=C1)C=CC(O)=O)C'), ('Gallic acid', 'OC1=CC(O)=C(O)C(O)=C1'),
  ('Ellagic acid', 'OC1=C(O)C2=C(C=C1O)C1=C(O)C(=O)C3=C(O)C(O)=C(O)C3=C1C2=O'),
  ('Epicatechin', 'OC1C2C(OC3=C(C2=O)C=C(C=C3O)C1CO)CO')) AS s(name, smiles) ON s.name = m.base_name
JOIN (VALUES (0, 'LpxC (UDP-3-O-(R-3-hydroxyacyl)-glucosamine N-deacetylase)', 'Gram-negative'),
  (1, 'ClpP (Caseinolytic protease)', 'Gram-positive'), (2, 'FtsH (membrane protease)', 'Gram-negative'),
  (3, 'DegP (serine protease)', 'Gram-negative')) AS t(pos, name, bacteria) ON t.pos = m.mol_id % 4"""))
def dimension_lookup(spark: SparkSession, folder: str) -> DataFrame:
    m = V.molecules(spark, folder).select("mol_id", "base_name")
    starts = dimensions.starting_points(spark).select(
        F.col("name").alias("base_name"), F.col("smiles").alias("start_smiles"))
    targets = dimensions.targets(spark).select(
        F.col("pos").cast("bigint").alias("_t"), F.col("name").alias("target_name"), "bacteria")
    # Ten and four literal rows.
    return (m.join(F.broadcast(starts), "base_name")
            .withColumn("_t", F.col("mol_id") % 4).join(F.broadcast(targets), "_t").drop("_t"))


RECORD = ["cid", "name", "smiles", "inchi", "inchikey", "molecular_formula", "molecular_weight"]
RECORD_SQL = ", ".join(RECORD)


@query("s08_u04_landed_search", V.sql("landed", f"""
SELECT {RECORD_SQL} FROM (
  SELECT *, row_number() OVER (PARTITION BY {RECORD_SQL} ORDER BY t, hit_pos) AS r
  FROM (SELECT *, CASE term WHEN 'antibacterial drug FDA approved' THEN 0
                 WHEN 'antibiotic FDA approved' THEN 1 WHEN 'antimicrobial drug' THEN 2 END AS t
        FROM landed) WHERE t IS NOT NULL)
WHERE r = 1 ORDER BY t, hit_pos LIMIT 500"""))
def landed_search(spark: SparkSession, folder: str) -> DataFrame:
    return lookups.search_results(V.landed(spark, folder), C.SEARCH_TERMS, RECORD, 500)


@query("s09_first_hit_per_name", V.sql("landed", """
SELECT n.name, l.cid, l.smiles, l.molecular_weight, 1 AS is_antibiotic
FROM (SELECT unnest(['ciprofloxacin', 'levofloxacin', 'moxifloxacin', 'azithromycin', 'ampicillin',
  'amoxicillin', 'cephalexin', 'doxycycline', 'minocycline', 'sulfamethoxazole', 'trimethoprim',
  'nitrofurantoin', 'tetracycline', 'chloramphenicol', 'vancomycin', 'linezolid', 'daptomycin',
  'colistin', 'polymyxin B', 'rifampicin', 'gentamicin', 'amikacin', 'tobramycin', 'cefepime',
  'cefazolin', 'meropenem', 'imipenem', 'ertapenem', 'piperacillin', 'ticarcillin', 'halicin',
  'clofoctol', 'triclosan', 'triclosan']) AS name) n
JOIN (SELECT *, row_number() OVER (PARTITION BY name ORDER BY hit_pos) AS r FROM landed) l
  ON l.name = n.name AND l.r = 1"""))
def first_hit_per_name(spark: SparkSession, folder: str) -> DataFrame:
    names = dimensions.numbered_names(spark, C.APPROVED_DRUG_NAMES)
    return lookups.first_hit_per_name(V.landed(spark, folder), names, 500)


@query("s10_all_hits_by_name", V.sql("landed", f"""
SELECT {RECORD_SQL} FROM (
  SELECT l.*, row_number() OVER (PARTITION BY smiles ORDER BY n.pos, hit_pos) AS r
  FROM landed l JOIN (SELECT unnest(range(15)) AS pos, unnest(['ciprofloxacin', 'levofloxacin',
    'azithromycin', 'ampicillin', 'amoxicillin', 'cephalexin', 'doxycycline', 'minocycline',
    'sulfamethoxazole', 'trimethoprim', 'nitrofurantoin', 'tetracycline', 'chloramphenicol',
    'vancomycin', 'linezolid']) AS name) n USING (name)) WHERE r = 1"""))
def all_hits_by_name(spark: SparkSession, folder: str) -> DataFrame:
    names = dimensions.numbered_names(spark, C.SUBSET_DRUG_NAMES)
    return lookups.all_hits_by_name(V.landed(spark, folder), names).select(*RECORD)


@query("s11_by_id", V.sql("landed", """
SELECT c_custkey, l.cid, smiles, inchi, inchikey, molecular_formula, molecular_weight
FROM (SELECT DISTINCT cid, smiles, inchi, inchikey, molecular_formula, molecular_weight FROM landed
      QUALIFY row_number() OVER (PARTITION BY cid ORDER BY hit_pos) = 1) l
JOIN (SELECT c_custkey, c_custkey % 500 AS cid FROM customer) c ON c.cid = l.cid"""))
def by_id(spark: SparkSession, folder: str) -> DataFrame:
    compounds = cleaning.keep_first(V.landed(spark, folder), ["cid"], ["hit_pos"])
    ids = V.read(spark, folder, "customer").select("c_custkey", (F.col("c_custkey") % 500).alias("cid"))
    found = lookups.by_id(compounds, ids.select("cid").distinct())
    return ids.join(found, "cid")


@query("s12_display_name", V.sql("landed", """
SELECT hit_pos, CASE WHEN name = '' OR name IS NULL THEN 'CID_' || cid ELSE name END AS name
FROM landed"""))
def display_name(spark: SparkSession, folder: str) -> DataFrame:
    return V.landed(spark, folder).select(
        "hit_pos", lookups.display_name(F.col("name"), F.col("cid")).alias("name"))


@query("s14_s15_s16_prediction_sinks", V.sql("molecules", """
SELECT smiles, probability_active, 'polyphenol' AS category, 'run1' AS run_id,
  '{"top_k": 50}' AS settings FROM molecules
UNION ALL SELECT smiles, probability_active, 'results', 'run1', '{"top_k": 50}' FROM molecules"""))
def prediction_sinks(spark: SparkSession, folder: str) -> DataFrame:
    base = scratch_path(spark, "results")
    rows = V.molecules(spark, folder).select("smiles", "probability_active")
    sinks.save_predictions(rows, f"{base}/predictions", "polyphenol", "run1")
    csv = sinks.save_results(rows, base, "results", "run1")
    config = sinks.save_settings(spark, {"top_k": 50}, base, run_id="run1")
    predictions = spark.read.parquet(f"{base}/predictions")
    results = spark.read.schema("smiles STRING, probability_active DOUBLE").csv(csv, header=True)
    results = results.withColumns({"category": F.lit("results"), "run_id": F.lit("run1")})
    settings = spark.read.schema("run_id STRING, settings STRING").json(config)
    # One settings row.
    return predictions.unionByName(results).join(F.broadcast(settings), "run_id")


@query("c19_s14_own_run_id", V.sql("molecules", """
SELECT smiles, probability_active, 'polyphenol' AS category, true AS stamped, 2::BIGINT AS runs FROM molecules, range(2)"""))
def own_run_id(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs that take their ids from the session clock; the second one is appended beside the first."""
    base = scratch_path(spark, "results")
    rows = V.molecules(spark, folder).select("smiles", "probability_active")
    first = sinks.save_predictions(rows, base, "polyphenol")
    second = first
    while second == first:  # ids have whole seconds
        time.sleep(0.1)
        second = sinks.run_stamp(spark)
    sinks.save_predictions(rows, base, "polyphenol", second)
    saved = spark.read.schema("smiles STRING, probability_active DOUBLE, category STRING, run_id STRING").parquet(base)
    runs = saved.select(F.countDistinct("run_id")).scalar()
    return saved.select("smiles", "probability_active", "category", F.col("run_id").rlike("^20[0-9]{6}_[0-9]{6}$").alias("stamped"),
                        runs.alias("runs"))
