"""Rule-based scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankforge import config as C
from rankforge.functions.text import add_all, clamp, indicator
from rankforge.operators.cleaning import column_or


def small_molecule_druglikeness(df: DataFrame, category: str) -> Column:
    """Base 0.5 plus bonuses for the properties the category configures and the table has."""
    roles = C.CATEGORY_ROLES[category]
    have = set(df.columns)
    score = [F.lit(0.5)]
    weight, logp, tpsa = roles.get("weight"), roles.get("logp"), roles.get("tpsa")
    if weight in have:
        score.append(0.3 * indicator((F.col(weight) > 100) & (F.col(weight) < 500)))
    if logp in have:
        score.append(0.3 * indicator(F.col(logp).between(-1, 5)))
    if tpsa in have:
        score.append(0.2 * indicator(F.col(tpsa) < 140))
    if "NumHDonors" in have:
        score.append(0.1 * indicator(F.col("NumHDonors") <= 5))
    if "NumHAcceptors" in have:
        score.append(0.1 * indicator(F.col("NumHAcceptors") <= 10))
    return clamp(add_all(score), 0.0, 1.0)


def peptide_druglikeness(df: DataFrame) -> Column:
    """Base 0.5 plus bonuses for length, hydrophobic share, charge and aromatic share."""
    bonus = {
        "length": 0.3 * indicator(F.col("length").between(10, 40)),
        "hydrophobic_ratio": 0.3 * indicator(F.col("hydrophobic_ratio").between(0.3, 0.6)),
        "net_charge": 0.2 * indicator(F.abs("net_charge").between(1, 8)),
        "aromatic_ratio": 0.2 * indicator(F.col("aromatic_ratio") < 0.2),
    }
    return clamp(
        add_all([F.lit(0.5)] + [b for name, b in bonus.items() if name in df.columns]), 0.0, 1.0)


def druglikeness(df: DataFrame, category: str) -> Column:
    if category == "amp":
        return peptide_druglikeness(df)
    if category in C.CATEGORY_ROLES:
        return small_molecule_druglikeness(df, category)
    if "druglikeness_score" in df.columns:
        return F.col("druglikeness_score")
    raise ValueError(f"unknown category {category}")


def score_category(df: DataFrame, category: str, weights: dict | None = None) -> DataFrame:
    """Activity, drug-likeness and composite score of one category."""
    weights = C.COMPONENT_WEIGHTS if weights is None else weights
    part = {k: float(weights.get(k, v)) for k, v in C.COMPONENT_WEIGHTS.items()}
    activity = C.CATEGORY_ROLES.get(category, {}).get("activity", "probability_active")
    scored = df.withColumns({
        "activity_score": column_or(df, activity, 0.5),
        "druglikeness_score": druglikeness(df, category),
    })
    return scored.withColumn(
        "composite_score",
        part["activity"] * F.col("activity_score")
        + part["druglikeness"] * F.col("druglikeness_score")
        + part["diversity"] * column_or(df, "diversity_score", 0.5),
    )


def peptide_viability(df: DataFrame, weights: dict | None = None) -> DataFrame:
    """Activity, hydrophobicity, charge and length scores combined.

    The column ranges come from one aggregate row used as a scalar subquery.
    """
    weights = C.PEPTIDE_VIABILITY_WEIGHTS if weights is None else weights
    ranges = df.select(F.struct(
        F.min("hydrophobicity").alias("lo"),
        F.max("hydrophobicity").alias("hi"),
        F.max(F.abs("net_charge")).alias("charge"),
    )).scalar()
    scored = df.withColumn("_r", ranges).withColumns({
        "activity_score": F.col("probability_active"),
        "hydrophobicity_score": (F.col("hydrophobicity") - F.col("_r.lo"))
        / (F.col("_r.hi") - F.col("_r.lo") + 1e-8),
        "charge_score": 1 - F.abs("net_charge") / (F.col("_r.charge") + 1e-8),
        "length_score": 1 - F.abs(F.col("length") - 25) / 25,
    }).drop("_r")
    return scored.withColumn("viability_score", add_all([
        F.lit(float(weights[part])) * F.col(f"{part}_score")
        for part in ("activity", "hydrophobicity", "charge", "length")
    ]))


def polyphenol_viability(
    df: DataFrame, activity: float = 0.5, solubility: float = 0.3, druglike: float = 0.2,
) -> DataFrame:
    scored = df.withColumns({
        "activity_score": F.col("probability_active"),
        "solubility_score": clamp(-F.col("LogS_estimate"), 0.0, 1.0),
        "druglikeness_score": 0.33 * indicator(F.col("MW") < 500)
        + 0.33 * indicator(F.col("LogP") < 5) + 0.34 * indicator(F.col("TPSA") < 140),
    })
    return scored.withColumn(
        "viability_score",
        activity * F.col("activity_score") + solubility * F.col("solubility_score")
        + druglike * F.col("druglikeness_score"))


def degrader_score(df: DataFrame) -> DataFrame:
    """Rule score over amide bonds, chain length, rings and rotatable bonds."""
    return df.withColumn(
        "degrader_score",
        0.3 * indicator(F.col("NumAmideBonds") >= 1)
        + 0.3 * indicator(F.col("ChainLength").between(3, 15))
        + 0.2 * indicator(F.col("NumRings") >= 2)
        + 0.2 * indicator(F.col("NumRotatableBonds") >= 3))


def degrader_viability(
    df: DataFrame, activity: float = 0.5, degrader: float = 0.3, druglike: float = 0.2,
) -> DataFrame:
    scored = degrader_score(df).withColumns({
        "activity_score": F.col("probability_active"),
        "druglikeness_score": 0.4 * indicator(F.col("MW") < 800)
        + 0.3 * indicator(F.col("LogP") < 5) + 0.3 * indicator(F.col("TPSA") < 150),
    })
    return scored.withColumn(
        "viability_score",
        activity * F.col("activity_score") + degrader * F.col("degrader_score")
        + druglike * F.col("druglikeness_score"))


def partner_compatibility(hbd: Column, hba: Column, query_hbd: Column, query_hba: Column) -> dict:
    """Donor and acceptor mismatch of a candidate against a query, and the resulting score."""
    hbd_match = F.abs(hbd - query_hba)
    hba_match = F.abs(hba - query_hbd)
    return {
        "hbd": hbd, "hba": hba, "hbd_match": hbd_match, "hba_match": hba_match,
        "compatibility": F.lit(1.0) / (F.lit(1.0) + hbd_match + hba_match),
    }


def combined_screen_score(probability: Column, similarity: Column) -> Column:
    zero = F.lit(0.0)
    return 0.5 * F.coalesce(probability, zero) + 0.5 * F.coalesce(similarity, zero)


def class_from_probability(probability: Column) -> Column:
    return F.when(probability >= 0.5, 1).otherwise(0)
