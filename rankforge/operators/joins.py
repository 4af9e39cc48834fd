"""Joins between candidate tables and partner tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rankforge.config import BROADCAST_ROWS
from rankforge.functions.structures import hbond_acceptors, hbond_donors
from rankforge.operators.scoring import partner_compatibility
from rankforge.session import written


FEW = 4
#: Bytes that :func:`beside` broadcasts, and rows of one key that it leaves to one task.
BESIDE_BYTES, KEY_ROWS = 8 << 20, 20_000


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether the table has at most ``limit`` rows; looks at no more than one row beyond it."""
    return df.limit(limit + 1).count() <= limit


def beside(
    rows: DataFrame, known: DataFrame, keys: list[str], spread: Column, limit: int | None = None,
) -> DataFrame:
    """Rows left-joined with ``known``: one row for a key, and ``_rows``, how many rows ask for it.

    A table of up to ``limit`` bytes is broadcast.  Beyond that it is joined, and keys that
    ``KEY_ROWS`` rows or more ask for (at most one key for so many rows) are dealt by ``spread``.
    """
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in known.schema.fields
             if f.dataType.simpleString() in ("string", "binary")]
    each = reduce(lambda a, b: a + b, texts, F.lit(32 + 8 * len(known.columns)))
    size = known.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]
    if size <= (BESIDE_BYTES if limit is None else limit):
        return rows.join(F.broadcast(known.drop("_rows")), keys, "left")
    parts = F.floor(F.col("_rows") / KEY_ROWS) + 1
    hot = known.where(F.col("_rows") >= KEY_ROWS).select(*keys, parts.alias("_parts"))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    dealt = known.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("_rows")
    return salted.join(dealt, [*keys, "_salt"], "left").drop("_salt")


def numbers(n: int) -> Column:
    """The array 0 to n - 1 of 64-bit numbers."""
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def pair_up(left: DataFrame, right: DataFrame, cells: int = 64) -> DataFrame:
    """Every left row with every right row.

    The result is the product by definition.  Both sides are dealt over a grid of
    ``cells`` x ``cells`` tasks: a left row goes to one grid line, a right row to one grid column,
    and they meet in an ordinary equi-join on the cell, so no side is held in one task.  A right
    side that is small enough by count is broadcast instead, with a few lines and one column.
    """
    if fits_broadcast(right, BROADCAST_ROWS // FEW):
        line = F.pmod(F.xxhash64(*left.columns), F.lit(FEW))
        copies = right.withColumn("_line", F.explode(numbers(FEW)))
        return left.withColumn("_line", line).join(F.broadcast(copies), "_line").drop("_line")
    line = F.pmod(F.xxhash64(*left.columns), F.lit(cells))
    column = F.pmod(F.xxhash64(*right.columns), F.lit(cells))
    every = F.explode(numbers(cells))
    spread_left = left.withColumns({"_line": line, "_column": every})
    spread_right = right.withColumns({"_column": column, "_line": every})
    return spread_left.join(spread_right, ["_line", "_column"]).drop("_line", "_column")


def literal_rows(rows: list[tuple], names: list[str]) -> Column:
    """A short fixed list as an array of structs, to be exploded next to each row."""
    return F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows
    ])


def merge_features(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Join two feature tables with one row per key; the right side wins on shared columns.

    Wherever the right side has a row its values win, nulls too; a key found on one side only keeps
    that side's values.
    """
    shared = [c for c in right.columns if c in left.columns and c != key]
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in shared}).withColumn("_right", F.lit(True))
    joined = left.join(renamed, key, "full_outer")
    return joined.withColumns(
        {c: F.when(F.col("_right"), F.col(f"_right_{c}")).otherwise(F.col(c)) for c in shared}
    ).drop("_right", *[f"_right_{c}" for c in shared])


def attach_hits(predictions: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Full outer join of predictions with hits that have one row per key.

    Written as a left join plus the hits without a prediction.  The hits are stored once; while
    their counted size allows they are broadcast, and the predictions are then never shuffled.
    Above that size both parts are ordinary joins whose skewed left side Spark can split, which a
    full outer join does not allow.
    """
    hits = written(hits, "hits")
    small = fits_broadcast(hits)
    side = F.broadcast(hits) if small else hits
    matched = predictions.join(side, key, "left")
    present = predictions.select(key)
    if small:
        present = present.join(F.broadcast(hits.select(key)), key, "left_semi")
    alone = hits.join(present.distinct(), key, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def match_partners(
    candidates: DataFrame, queries: list[tuple[str, str]], structure: str = "smiles",
) -> DataFrame:
    """Compatibility of each candidate with each query of a short fixed list (name, structure).

    The donor and acceptor counts of a query are constants of the plan, so the candidates are
    neither joined nor shuffled.
    """
    c, q = F.col(structure), F.col("_query")
    bound = bind_literal(candidates, queries, ["query", "_query"]).withColumns({
        "_qd": hbond_donors(q), "_qa": hbond_acceptors(q),
        "_cd": hbond_donors(c), "_ca": hbond_acceptors(c),
    })
    scores = partner_compatibility(F.col("_cd"), F.col("_ca"), F.col("_qd"), F.col("_qa"))
    return bound.withColumns(scores).drop("_query", "_qd", "_qa", "_cd", "_ca")


def bind_literal(df: DataFrame, rows: list[tuple], names: list[str]) -> DataFrame:
    """Each row once per entry of a short fixed list."""
    entry = df.withColumn("_entry", F.explode(literal_rows(rows, names)))
    return reduce(
        lambda d, n: d.withColumn(n, F.col(f"_entry.{n}")), names, entry).drop("_entry")


def imines(aldehydes: DataFrame, amines: DataFrame) -> DataFrame:
    """Condensation products of aldehydes written ``O=C...`` with amines written ``N...``.

    Reactants written otherwise, and ring nitrogens (``N1...``), give no product.
    """
    left = aldehydes.filter(F.col("smiles").rlike("^O=C")).select(
        F.col("name").alias("aldehyde"), F.col("smiles").alias("_ald"))
    right = amines.filter(F.col("smiles").rlike(r"^N[A-Za-z(\[]")).select(
        F.col("name").alias("amine"), F.col("smiles").alias("_amine"))
    product = F.concat(
        F.lit("C(=N"), F.expr("substr(_amine, 2)"), F.lit(")"), F.expr("substr(_ald, 4)"))
    return pair_up(left, right).select("aldehyde", "amine", product.alias("product"))
