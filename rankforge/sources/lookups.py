"""Joins against landed lookup results (the network client itself is not part of this library)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankforge.operators.cleaning import keep_first
from rankforge.operators.toplists import top_rows


def search_results(
    landed: DataFrame, terms: list[str], record: list[str], max_rows: int = 500,
) -> DataFrame:
    """Results of several terms in term order, exact repeats of a record dropped, first rows kept."""
    order = F.create_map(*[x for i, t in enumerate(terms) for x in (F.lit(t), F.lit(i))])
    hits = landed.filter(F.col("term").isin(terms)).withColumn("_t", order[F.col("term")])
    first = keep_first(hits, record, ["_t", "hit_pos"])
    return top_rows(first, [F.asc("_t"), F.asc("hit_pos")], max_rows).select(*record)


def first_hit_per_name(
    landed: DataFrame, names: DataFrame, max_rows: int = 500,
) -> DataFrame:
    """One row per listed name with its best hit, tagged as an antibiotic.

    ``names`` is a literal list (``name_pos``, ``name``), so it is small by construction.  The
    hits are reduced to one per distinct name before the names are joined.
    """
    wanted = F.broadcast(names.select("name").distinct())
    hits = landed.join(wanted, "name", "left_semi")
    best = keep_first(hits, ["name"], ["hit_pos"])
    listed = F.broadcast(names).join(best, "name", "inner")
    tagged = listed.withColumn("is_antibiotic", F.lit(1))
    return top_rows(tagged, [F.asc("name_pos")], max_rows).select(
        "name", "cid", "smiles", "molecular_weight", "is_antibiotic")


def all_hits_by_name(landed: DataFrame, names: DataFrame) -> DataFrame:
    """All hits of the listed names, first row per structure in list order."""
    hits = landed.join(F.broadcast(names), "name", "inner")
    return keep_first(hits, ["smiles"], ["name_pos", "hit_pos"])


def by_id(landed: DataFrame, ids: DataFrame, key: str = "cid") -> DataFrame:
    """Landed compounds for the requested ids; ids without a compound give no row."""
    return ids.join(landed, key, "inner").select(
        key, "smiles", "inchi", "inchikey", "molecular_formula", "molecular_weight")


def display_name(name: Column, cid: Column) -> Column:
    """The name, or ``CID_<id>`` when it is null or empty."""
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("CID_"), cid.cast("string")))
