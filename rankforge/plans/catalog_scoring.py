"""Registered queries: scores, rankings and top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankforge.functions import sequences as S
from rankforge.functions.structures import add_degrader_features, add_solubility_features
from rankforge.operators import cleaning, diversity, ranking, scoring, toplists
from rankforge.plans import jobs, standins as V
from rankforge.plans.catalog_cleaning import PREPROCESSED, prepared_peptides
from rankforge.plans.catalog_generation import FRAGMENT_CTE, THREE_PART_SQL, fragment_rows
from rankforge.plans.catalog_peptides import DESCRIPTOR_SQL, counted
from rankforge.plans.catalog_structures import BASE_SQL, HYDROXYL_SQL, TABLE_SQL, descriptor_table
from rankforge.plans.registry import query, rounded, rounded_sql
from rankforge.session import written


def peptide_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Prepared peptides with descriptors."""
    rows = prepared_peptides(spark, folder).select("sequence", "pep_id", "probability_active")
    return S.add_descriptors(rows)


def category_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    m = V.molecules(spark, folder)
    small = m.select("smiles", "mol_id", F.col("mol_id").alias("ingest_pos"), "MW", "LogP", "TPSA", "NumHDonors", "NumHAcceptors", "probability_active")
    return {
        "amp": peptide_candidates(spark, folder).withColumn("ingest_pos", F.col("pep_id")),
        "schiff_base": small.withColumnRenamed("smiles", "product"),
        "repurposed": small,
        "polyphenol": small.drop("LogP"),
        "protac": small.drop("probability_active", "NumHDonors"),
    }


PEPTIDE_CTE = f"""{PREPROCESSED.replace("mic, target", "mic, target, probability_active").replace("activity, target FROM (", "activity, target, probability_active FROM (")},
{counted("prepared")},
candidates AS (
  SELECT c.*, p.probability_active FROM (SELECT pep_id, sequence, {DESCRIPTOR_SQL} FROM counted) c
  JOIN prepared p USING (pep_id))"""


def clipped(*terms: str) -> str:
    return f"CAST(least(greatest(0.5 + {' + '.join(terms)}, 0.0), 1.0) AS DOUBLE)"


def bonus(weight: float, cond: str) -> str:
    return f"CASE WHEN {cond} THEN {weight} ELSE 0.0 END"


AMP_DRUG = clipped(
    bonus(0.3, "length >= 10 AND length <= 40"), bonus(0.3, "hydrophobic_ratio >= 0.3 AND hydrophobic_ratio <= 0.6"),
    bonus(0.2, "net_charge_abs >= 1 AND net_charge_abs <= 8"), bonus(0.2, "aromatic_ratio < 0.2"))
MW_T, LOGP_T, TPSA_T = (bonus(0.3, '"MW" < 500 AND "MW" > 100'), bonus(0.3, '"LogP" >= -1 AND "LogP" <= 5'),
                        bonus(0.2, '"TPSA" < 140'))
DON_T, ACC_T = bonus(0.1, '"NumHDonors" <= 5'), bonus(0.1, '"NumHAcceptors" <= 10')
DRUG = {
    "schiff_base": clipped(MW_T, LOGP_T, TPSA_T, DON_T, ACC_T), "repurposed": clipped(MW_T, LOGP_T, DON_T, ACC_T),
    "polyphenol": clipped(MW_T, DON_T, ACC_T), "protac": clipped(MW_T, ACC_T),
}


def rank_sql(k: int, weights: dict[str, float]) -> str:
    """The ranking across categories, written out per category."""
    parts = [f"""SELECT 'amp' AS category, sequence AS structure, pep_id AS id, activity_score, druglikeness_score
    FROM (SELECT *, probability_active AS activity_score, {AMP_DRUG} AS druglikeness_score FROM candidates)
    ORDER BY 0.5 * activity_score + 0.3 * druglikeness_score + 0.1 DESC, sequence, pep_id LIMIT {k}"""]
    for category, drug in DRUG.items():
        activity = "0.5::DOUBLE" if category == "protac" else "probability_active"
        parts.append(f"""SELECT '{category}' AS category, smiles AS structure, mol_id AS id, activity_score, druglikeness_score
    FROM (SELECT *, {activity} AS activity_score, {drug} AS druglikeness_score FROM molecules)
    ORDER BY 0.5 * activity_score + 0.3 * druglikeness_score + 0.1 DESC, smiles, mol_id LIMIT {k}""")
    union = "\n  UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)
    weight = "CASE " + " ".join(f"WHEN category = '{c}' THEN {w}" for c, w in weights.items()) + " ELSE 1.0 END" if weights else "1.0"
    return V.sql("peptides molecules", f"""
WITH {PEPTIDE_CTE}, combined AS ({union})
SELECT category, structure, activity_score, druglikeness_score,
  0.5 * activity_score + 0.3 * druglikeness_score + 0.1 AS composite_score,
  CASE WHEN max(activity_score) OVER () > 0 THEN activity_score / max(activity_score) OVER () ELSE 0 END AS normalized_activity,
  CASE WHEN max(activity_score) OVER () > 0 THEN activity_score / max(activity_score) OVER () ELSE 0 END
    * CAST({weight} AS DOUBLE) * druglikeness_score AS final_score
FROM combined""")


RANK_WEIGHTS = {"amp": 1.2, "repurposed": 1.0, "polyphenol": 1.0, "protac": 1.3}
RANK_COLUMNS = "activity_score druglikeness_score composite_score normalized_activity final_score"


def _ranked(df: DataFrame) -> DataFrame:
    structure = F.coalesce(*[F.col(c) for c in ("sequence", "product", "smiles") if c in df.columns])
    return rounded(df.select("category", structure.alias("structure"), *RANK_COLUMNS.split()))


@query("r05_rank_categories", rounded_sql(rank_sql(50, RANK_WEIGHTS), RANK_COLUMNS))
def rank_categories(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(ranking.rank_categories(category_tables(spark, folder), RANK_WEIGHTS, 50))


@query("r05_l02_f15_a04_rank_unweighted", rounded_sql(rank_sql(30, {}), RANK_COLUMNS))
def rank_unweighted(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(ranking.rank_categories(category_tables(spark, folder), None, 30))


def druglike_sql() -> str:
    parts = [f"SELECT 'amp' AS category, pep_id AS id, {AMP_DRUG} AS score FROM candidates"]
    parts += [f"SELECT '{c}', mol_id, {d} FROM molecules" for c, d in DRUG.items()]
    return V.sql("peptides molecules", f"WITH {PEPTIDE_CTE} " + " UNION ALL ".join(parts))


@query("r01_r02_r03_druglikeness", rounded_sql(druglike_sql(), "score"))
def druglikeness(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for category, df in category_tables(spark, folder).items():
        key = "pep_id" if category == "amp" else "mol_id"
        part = df.select(F.lit(category).alias("category"), F.col(key).alias("id"),
                         scoring.druglikeness(df, category).alias("score"))
        out = part if out is None else out.union(part)
    return rounded(out)


@query("r04_l01_rank_one_category", rounded_sql(V.sql("molecules", f"""
SELECT mol_id, smiles, activity_score, druglikeness_score, 0.6 * activity_score + 0.3 * druglikeness_score + 0.1 * 0.5 AS composite_score
FROM (SELECT *, probability_active AS activity_score, {DRUG['schiff_base']} AS druglikeness_score FROM molecules)"""),
    "activity_score druglikeness_score composite_score"))
def rank_one(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.molecules(spark, folder)
    ranked = ranking.rank_category(rows, "schiff_base", {"activity": 0.6, "diversity": 0.1})
    return rounded(ranked.select("mol_id", "smiles", "activity_score", "druglikeness_score", "composite_score"))


@query("r06_a05_l06_peptide_viability", rounded_sql(V.sql("peptides", f"""
WITH {PEPTIDE_CTE}
SELECT pep_id, sequence, hydrophobicity_score, charge_score, length_score,
  0.5 * probability_active + 0.2 * hydrophobicity_score + 0.15 * charge_score + 0.15 * length_score AS viability_score
FROM (SELECT pep_id, sequence, probability_active,
  (hydrophobicity - min(hydrophobicity) OVER ()) / (max(hydrophobicity) OVER () - min(hydrophobicity) OVER () + 1e-8) AS hydrophobicity_score,
  1 - net_charge_abs / (max(net_charge_abs) OVER () + 1e-8) AS charge_score,
  1 - abs(length - 25) / 25 AS length_score FROM candidates)"""),
    "hydrophobicity_score charge_score length_score viability_score"))
def peptide_viability(spark: SparkSession, folder: str) -> DataFrame:
    ranked = scoring.peptide_viability(written(peptide_candidates(spark, folder), "candidates"))
    ranked = ranked.orderBy(*toplists.best_first("viability_score", "sequence"))
    return rounded(ranked.select("pep_id", "sequence", "hydrophobicity_score", "charge_score", "length_score", "viability_score"))


LOGS = '(-0.65 * "LogP" + 0.07 * "TPSA" + 0.66)'


@query("r07_m03_polyphenol_viability", rounded_sql(V.sql("molecules", f"""
SELECT mol_id, solubility_score, druglikeness_score,
  0.5 * probability_active + 0.3 * solubility_score + 0.2 * druglikeness_score AS viability_score
FROM (SELECT *, CAST(CASE WHEN "LogP" IS NOT NULL THEN least(greatest(-{LOGS}, 0.0), 1.0) END AS DOUBLE) AS solubility_score,
  CAST({bonus(0.33, '"MW" < 500')} + {bonus(0.33, '"LogP" < 5')} + {bonus(0.34, '"TPSA" < 140')} AS DOUBLE) AS druglikeness_score
  FROM molecules)"""), "solubility_score druglikeness_score viability_score"))
def polyphenol_viability(spark: SparkSession, folder: str) -> DataFrame:
    rows = scoring.polyphenol_viability(add_solubility_features(V.molecules(spark, folder)))
    rows = rows.orderBy(*toplists.best_first("viability_score", "smiles", "mol_id"))
    return rounded(rows.select("mol_id", "solubility_score", "druglikeness_score", "viability_score"))


DEGRADER = """degraders AS (
  SELECT *, CAST(len(string_split(smiles, 'C(=O)N')) + len(string_split(smiles, 'NC(=O)')) - 2 AS INT) AS amides,
    CAST(greatest(1, len(regexp_extract_all(smiles, '[CNOPS]')) // 3) AS INT) AS chain FROM molecules)"""
DEGRADER_SCORE = (f"CAST({bonus(0.3, 'amides >= 1')} + {bonus(0.3, 'chain >= 3 AND chain <= 15')} + "
                  f"{bonus(0.2, chr(34) + 'NumRings' + chr(34) + ' >= 2')} + "
                  f"{bonus(0.2, chr(34) + 'NumRotatableBonds' + chr(34) + ' >= 3')} AS DOUBLE)")


@query("r08_r09_degrader_viability", rounded_sql(V.sql("molecules", f"""
WITH {DEGRADER}
SELECT mol_id, degrader_score, druglikeness_score,
  0.5 * probability_active + 0.3 * degrader_score + 0.2 * druglikeness_score AS viability_score
FROM (SELECT *, {DEGRADER_SCORE} AS degrader_score,
  CAST({bonus(0.4, '"MW" < 800')} + {bonus(0.3, '"LogP" < 5')} + {bonus(0.3, '"TPSA" < 150')} AS DOUBLE) AS druglikeness_score
  FROM degraders)"""), "degrader_score druglikeness_score viability_score"))
def degrader_viability(spark: SparkSession, folder: str) -> DataFrame:
    rows = scoring.degrader_viability(add_degrader_features(V.molecules(spark, folder)))
    rows = rows.orderBy(*toplists.best_first("viability_score", "smiles", "mol_id"))
    return rounded(rows.select("mol_id", "degrader_score", "druglikeness_score", "viability_score"))


@query("r12_class_from_probability", V.sql("molecules", """
SELECT mol_id, CASE WHEN probability_active >= 0.5 THEN 1 ELSE 0 END AS predicted_activity FROM molecules"""))
def classes(spark: SparkSession, folder: str) -> DataFrame:
    return V.molecules(spark, folder).select(
        "mol_id", scoring.class_from_probability(F.col("probability_active")).alias("predicted_activity"))


@query("w01_top_per_category", V.sql("peptides", """
SELECT target, sequence, pep_id FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY probability_active DESC, pep_id) AS r FROM peptides) WHERE r <= 50"""))
def top_per_category(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.peptides(spark, folder)
    best = toplists.top_per_group(rows, ["target"], toplists.best_first("probability_active", "pep_id"), 50)
    return best.select("target", "sequence", "pep_id")


@query("l10_x04_peptide_head", V.sql("peptides", """
SELECT pep_id, sequence FROM peptides ORDER BY probability_active DESC, pep_id LIMIT 100"""))
def peptide_head(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.peptides(spark, folder)
    order = toplists.best_first("probability_active", "pep_id")
    return diversity.diversity_filter(rows, "amp", F.col("pep_id"), order).select("pep_id", "sequence")


@query("t22_screen_hybrids", rounded_sql(V.sql("molecules", f"""
WITH {TABLE_SQL}
SELECT mol_id, smiles, {BASE_SQL}, CAST({HYDROXYL_SQL} AS INT) AS "NumPhenolicOH", -0.65 * d."LogP" + 0.07 * d."TPSA" + 0.66 AS "LogS_estimate"
FROM (SELECT mol_id, smiles FROM molecules WHERE {V.valid_sql('smiles')}) m
JOIN (SELECT * EXCLUDE (mol_id) FROM descriptors) d USING (smiles)"""), "LogS_estimate"))
def screen_hybrids(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.molecules(spark, folder).select("mol_id", "smiles")
    return rounded(jobs.screen_hybrids(rows, descriptor_table(spark, folder)))


@query("t22_screen_degraders", V.sql("molecules", f"""
WITH {TABLE_SQL}, {DEGRADER}
SELECT m.mol_id, m.amides AS "NumAmideBonds", m.chain AS "ChainLength",
  round({DEGRADER_SCORE.replace('"Num', 'd."Num')}, 9) AS degrader_score
FROM degraders m JOIN descriptors d USING (smiles) WHERE {V.valid_sql('m.smiles')}"""))
def screen_degraders(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.molecules(spark, folder).select("mol_id", "smiles")
    found = jobs.screen_degraders(rows, descriptor_table(spark, folder))
    return rounded(found.select("mol_id", "NumAmideBonds", "ChainLength", "degrader_score"))


@query("t23_r13_design_for_target", V.sql("molecules", f"""
WITH {TABLE_SQL}, {FRAGMENT_CTE},
made AS (SELECT product AS smiles FROM ({THREE_PART_SQL}) UNION SELECT product FROM recombined),
amounts AS (
  SELECT smiles, CAST(len(string_split(smiles, 'C(=O)N')) + len(string_split(smiles, 'NC(=O)')) - 2 AS INT) AS amides,
    CAST(greatest(1, len(regexp_extract_all(smiles, '[CNOPS]')) // 3) AS INT) AS chain FROM made)
SELECT smiles, round({DEGRADER_SCORE.replace('"Num', 'd."Num')}, 9) AS degrader_score, 'LpxC' AS target
FROM amounts LEFT JOIN descriptors d USING (smiles)"""))
def design(spark: SparkSession, folder: str) -> DataFrame:
    table = descriptor_table(spark, folder).select("smiles", "NumRings", "NumRotatableBonds")
    made = jobs.design_for_target(fragment_rows(spark, folder), "fragments", "mol_id", table, "LpxC", 8)
    return rounded(made.select("smiles", "degrader_score", "target"))


@query("g17_category_sample", V.sql("molecules", """
SELECT 'polyphenol' AS category, count(*) AS rows FROM molecules UNION ALL SELECT 'schiff_base', 0"""))
def category_sample(spark: SparkSession, folder: str) -> DataFrame:
    tables = {"polyphenol": V.molecules(spark, folder)}
    out = None
    for category in ("polyphenol", "schiff_base"):
        part = jobs.category_sample(tables, category).agg(F.count("*").alias("rows")).select(
            F.lit(category).alias("category"), "rows")
        out = part if out is None else out.union(part)
    return out
