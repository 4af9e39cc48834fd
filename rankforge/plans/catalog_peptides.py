"""Registered queries: peptide features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankforge.functions import sequences as S
from rankforge.plans import standins as V
from rankforge.plans.registry import query, rounded, rounded_sql

LETTERS = "ACDEFGHIKLMNPQRSTVWY"
COUNTS = ",\n    ".join(
    f"CAST(length(s) - length(replace(s, '{a}', '')) AS INT) AS n{a}" for a in LETTERS)


def counted(source: str = "peptides", column: str = "sequence") -> str:
    """Letter counts per sequence."""
    return f"""counted AS (
  SELECT pep_id, s, s AS sequence, CAST(length(s) AS INT) AS len,
    {COUNTS}
  FROM (SELECT pep_id, {column} AS s FROM {source}))"""


HYDROPATHY = ("1.8*nA + 2.5*nC - 3.5*nD - 3.5*nE + 2.8*nF - 0.4*nG - 3.2*nH + 4.5*nI - 3.9*nK + 3.8*nL + 1.9*nM"
              " - 3.5*nN - 1.6*nP - 3.5*nQ - 4.5*nR - 0.8*nS - 0.7*nT + 4.2*nV - 0.9*nW - 1.3*nY")
VOLUME = ("88.6*nA + 108.5*nC + 111.1*nD + 138.4*nE + 189.9*nF + 60.1*nG + 153.2*nH + 166.7*nI + 168.6*nK + 166.7*nL"
          " + 162.9*nM + 114.1*nN + 112.7*nP + 143.8*nQ + 173.4*nR + 89.0*nS + 116.1*nT + 140.0*nV + 227.8*nW + 193.6*nY")

DESCRIPTOR_SQL = f"""
  CASE WHEN len > 0 THEN len END AS length,
  CAST(CASE WHEN len > 0 THEN ({HYDROPATHY}) / len END AS DOUBLE) AS hydrophobicity,
  CASE WHEN len > 0 THEN nR + nK + nH - nD - nE END AS net_charge,
  CAST(CASE WHEN len > 0 THEN ({VOLUME}) / len END AS DOUBLE) AS avg_volume,
  CASE WHEN len > 0 THEN (nA + nI + nL + nM + nF + nV + nW + nP) / len END AS hydrophobic_ratio,
  CASE WHEN len > 0 THEN (nR + nK + nD + nE + nN + nQ + nS + nT + nY) / len END AS hydrophilic_ratio,
  CASE WHEN len > 0 THEN (nR + nK + nH) / len END AS positive_ratio,
  CASE WHEN len > 0 THEN (nD + nE) / len END AS negative_ratio,
  CASE WHEN len > 0 THEN (nF + nW + nY) / len END AS aromatic_ratio,
  CASE WHEN len > 0 THEN (nR + nK + nH - nD - nE) / len END AS charge_density,
  CASE WHEN len > 0 THEN abs(nR + nK + nH - nD - nE) END AS net_charge_abs,
  CASE WHEN len = 0 THEN NULL WHEN nR + nK + nH + nD + nE > 0
       THEN (nR + nK + nH) / len - (nD + nE) / len ELSE 0 END AS charge_balance"""
RATIOS = ("hydrophobicity avg_volume hydrophobic_ratio hydrophilic_ratio positive_ratio negative_ratio "
          "aromatic_ratio charge_density charge_balance")


@query("p01_p12_peptide_descriptors", rounded_sql(V.sql("peptides", f"""
WITH {counted()}
SELECT pep_id, sequence, {DESCRIPTOR_SQL} FROM counted"""), RATIOS))
def descriptors(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(V.peptides(spark, folder).select("pep_id", "sequence").transform(S.add_descriptors))


@query("p13_basic_descriptors", rounded_sql(V.sql("segments", f"""
WITH {counted("segments", "upper(replace(raw, 'ß', 'ss'))")}
SELECT pep_id, sequence, len AS length, CAST(({HYDROPATHY}) / len AS DOUBLE) AS hydrophobicity,
  nR + nK - nD - nE AS net_charge, (nA + nI + nL + nM + nF + nV + nW + nP) / len AS hydrophobic_ratio,
  (nF + nW + nY) / len AS aromatic_ratio,
  (nR + nN + nD + nQ + nE + nH + nK + nS + nT + nY) / len AS polar_ratio,
  (nR + nK - nD - nE) / len AS charge_density
FROM counted WHERE len > 0"""),
    "hydrophobicity hydrophobic_ratio aromatic_ratio polar_ratio charge_density"))
def basic(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.segments(spark, folder).select("pep_id", F.col("raw").alias("sequence"))
    return rounded(rows.transform(S.add_basic_descriptors))


@query("p14_one_hot", V.sql("peptides", """
SELECT CAST(pos AS INT) AS pos, CAST(instr('ACDEFGHIKLMNPQRSTVWY', sequence[pos + 1]) - 1 AS INT) AS idx, count(*) AS n
FROM (SELECT sequence, unnest(range(least(length(sequence), 50))) AS pos FROM peptides) GROUP BY ALL"""))
def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    cells = V.peptides(spark, folder).select(F.inline(S.one_hot_indices(F.col("sequence"))))
    return cells.groupBy("pos", "idx").agg(F.count("*").alias("n"))


CHARGE = """nK/(1+pow(10.0, {ph}-10.0)) + nR/(1+pow(10.0, {ph}-12.0)) + nH/(1+pow(10.0, {ph}-5.98))
    + 1/(1+pow(10.0, {ph}-pkn)) - nD/(1+pow(10.0, 4.05-{ph})) - nE/(1+pow(10.0, 4.45-{ph}))
    - nC/(1+pow(10.0, 9.0-{ph})) - nY/(1+pow(10.0, 10.0-{ph})) - 1/(1+pow(10.0, pkc-{ph}))"""


def charge(ph: str) -> str:
    return CHARGE.replace("{ph}", ph)


MASS = ("89.0932*nA + 121.1582*nC + 133.1027*nD + 147.1293*nE + 165.1891*nF + 75.0666*nG + 155.1546*nH + 131.1729*nI"
        " + 146.1876*nK + 131.1729*nL + 149.2113*nM + 132.1179*nN + 115.1305*nP + 146.1445*nQ + 174.201*nR"
        " + 105.0926*nS + 119.1192*nT + 117.1463*nV + 204.2252*nW + 181.1885*nY")
TERMINAL = """terminal AS (
  SELECT *, CASE s[1] WHEN 'A' THEN 7.59 WHEN 'M' THEN 7.0 WHEN 'S' THEN 6.93 WHEN 'P' THEN 8.36
      WHEN 'T' THEN 6.82 WHEN 'V' THEN 7.44 WHEN 'E' THEN 7.7 ELSE 7.5 END::DOUBLE AS pkn,
    CASE s[-1] WHEN 'D' THEN 4.55 WHEN 'E' THEN 4.75 ELSE 3.55 END::DOUBLE AS pkc
  FROM counted WHERE len > 0)"""
HALVING = f"""halving AS (
  SELECT pep_id, 4.05::DOUBLE AS lo, 12.0::DOUBLE AS hi, 0 AS i FROM terminal
  UNION ALL
  SELECT h.pep_id, CASE WHEN {charge('((lo+hi)/2)')} > 0 THEN (lo+hi)/2 ELSE lo END,
    CASE WHEN {charge('((lo+hi)/2)')} > 0 THEN hi ELSE (lo+hi)/2 END, i + 1
  FROM halving h JOIN terminal t USING (pep_id) WHERE i < 17)"""
EXTENDED_SQL = f"""CAST({MASS} - 18.0153 * (len - 1) AS DOUBLE) AS molecular_weight, (nF + nW + nY) / len AS aromaticity,
  round((lo + hi) / 2, 2) AS isoelectric_point, CAST(({HYDROPATHY}) / len AS DOUBLE) AS gravy,
  {charge('7.0')} AS "charge_at_pH7", {charge('5.0')} AS "charge_at_pH5",
  (nE + nM + nA + nL + nK) / len AS helix_frac, (nN + nP + nG + nS + nD) / len AS turn_frac,
  (nV + nI + nY + nF + nW + nL + nT) / len AS sheet_frac,
  """ + ", ".join(f'n{a} / len AS "aa_{a}_ratio"' for a in LETTERS)
EXTENDED = "molecular_weight aromaticity isoelectric_point gravy charge_at_pH7 charge_at_pH5 helix_frac turn_frac sheet_frac"
COMPOSITION = " ".join(f"aa_{a}_ratio" for a in LETTERS)


@query("p15_p21_all_features", rounded_sql(V.sql("peptides", f"""
WITH {counted()},
{TERMINAL},
{HALVING}
SELECT pep_id, sequence, {DESCRIPTOR_SQL}, {EXTENDED_SQL}
FROM terminal JOIN halving USING (pep_id) WHERE i = 17""", recursive=True), f"{RATIOS} {EXTENDED} {COMPOSITION}"))
def all_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.peptides(spark, folder).select("pep_id", "sequence").filter("sequence <> ''")
    return rounded(rows.transform(S.featurize))
