"""Ranking inside one category and across categories with different schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankforge import config as C
from rankforge.functions.text import normalize_nan
from rankforge.operators.scoring import score_category
from rankforge.operators.toplists import best_first, top_rows


def category_order(df: DataFrame, category: str, score: str = "composite_score") -> list[Column]:
    """Best score first; structure text, then input order break ties."""
    structure = C.CATEGORY_ROLES.get(category, {}).get("structure")
    ties = [c for c in (structure, "ingest_pos") if c in df.columns]
    return best_first(score, *ties)


def rank_category(df: DataFrame, category: str, weights: dict | None = None) -> DataFrame:
    scored = score_category(normalize_nan(df), category, weights)
    return scored.orderBy(*category_order(scored, category))


def rank_categories(
    tables: dict[str, DataFrame], weights: dict[str, float] | None = None, top_k: int = 50,
) -> DataFrame:
    """Best ``top_k`` of every category, put on one scale and ranked together.

    NaN counts as missing in every column. Each category is cut to ``top_k`` rows before the union, so the steps after it see at most
    ``top_k`` rows per category however large the inputs are.
    """
    weights = weights or {}
    parts = []
    for category, df in tables.items():
        tagged = df.withColumns({
            "category": F.lit(category),
            "category_weight": F.lit(float(weights.get(category, 1.0))),
        })
        scored = score_category(normalize_nan(tagged), category)
        parts.append(top_rows(scored, category_order(scored, category), top_k))
    combined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    best = F.max("activity_score").over(Window.partitionBy())
    combined = combined.withColumn(
        "normalized_activity",
        F.when(best > 0, F.col("activity_score") / best).otherwise(F.lit(0.0)),
    ).withColumn(
        "final_score",
        F.col("normalized_activity") * F.col("category_weight") * F.col("druglikeness_score"),
    )
    structures = {C.CATEGORY_ROLES.get(c, {}).get("structure") for c in tables}
    ties = ["category", *sorted(s for s in structures if s in combined.columns)]
    if "ingest_pos" in combined.columns:
        ties.append("ingest_pos")
    return top_rows(combined, best_first("final_score", *ties), top_k * len(tables))
