"""Tanimoto similarity on bit fingerprints and similarity search."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rankforge.functions.text import add_all
from rankforge.operators import overlaps
from rankforge.operators.joins import attach_hits
from rankforge.operators.scoring import combined_screen_score
from rankforge.operators.toplists import best_first, top_per_group, top_rows
from rankforge.operators.vector_index import cosine_hits

WORDS = 16
WORD_COLUMNS = [f"w{i}" for i in range(WORDS)]
FINGERPRINT = [*WORD_COLUMNS, "n"]


def add_fingerprint(df: DataFrame, bits: Column) -> DataFrame:
    """Pack set bits (0 to 1023) into sixteen 64-bit words and their count ``n``.

    Everything happens inside the row, so no shuffle is needed.  Rows without bits get null words.
    """
    one = F.lit(1).cast("bigint")

    def word(i: int) -> Column:
        inside = F.filter("_bits", lambda b: F.shiftright(b, 6) == i)
        return F.aggregate(
            inside, F.lit(0).cast("bigint"),
            lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", one, b.bitwiseAND(63))))

    packed = df.withColumn("_bits", bits).withColumns(
        {name: word(i) for i, name in enumerate(WORD_COLUMNS)} | {"n": F.size("_bits")})
    return packed.withColumn("n", F.when(F.col("_bits").isNotNull(), F.col("n"))).drop("_bits")


def tanimoto(left: list[Column], left_n: Column, right: list[Column], right_n: Column) -> Column:
    """Shared bits over all bits of two fingerprints; 0 when both are empty."""
    shared = add_all([F.bit_count(a.bitwiseAND(b)) for a, b in zip(left, right)])
    union = left_n + right_n - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def size_edges(threshold: float, largest: int = 64 * WORDS) -> list[int]:
    """Lower ends of bit-count classes such that similar sets lie in the same or the next class.

    Sets with similarity >= t have sizes within a factor 1/t of each other, and each class spans
    at least that factor.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    factor = min(threshold, 0.95)
    edges = [1]
    while edges[-1] <= largest:
        edges.append(int(edges[-1] / factor) + 1)
    return edges


def size_class(n: Column, threshold: float) -> Column:
    return add_all([F.when(n >= e, 1).otherwise(0) for e in size_edges(threshold)])


def searched(database: DataFrame, queries: DataFrame, key: str) -> tuple[DataFrame, DataFrame, str]:
    """Both sides with a fingerprint only, and the schema of their hits."""
    # Rows without a fingerprint are left out by the tasks: a filter would make all words a second time.
    rows = database.select(key, *FINGERPRINT)
    asked = queries.filter("n IS NOT NULL").select("query", "query_pos", *FINGERPRINT)
    names = [*asked.select("query", "query_pos").schema.fields, *rows.select(key).schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)
    return rows, asked, schema + ", similarity double"


def find_similar(
    database: DataFrame, queries: DataFrame, key: str, threshold: float = 0.3,
) -> DataFrame:
    """All (query, database row) pairs with similarity >= threshold.

    ``database`` has ``key`` and a fingerprint; ``queries`` has ``query``, ``query_pos`` and a
    fingerprint.  Rows without a fingerprint never match.  Queries go to the tasks in passes of
    bounded size, so the database is never shuffled; each task gets the overlaps of its rows with
    all queries of like size at once, and only pairs that reach the threshold become rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    rows, asked, schema = searched(database, queries, key)

    def search(part):
        names = [overlaps.whole(part.column(c)) for c in ("query", "query_pos")]
        right = overlaps.Sized(overlaps.words_of(part, WORD_COLUMNS), part.column("n").to_numpy())

        def run(batches):
            for batch in overlaps.with_bits(batches):
                left = overlaps.Sized(overlaps.words_of(batch, WORD_COLUMNS), batch.column("n").to_numpy())
                for x, y, found in overlaps.near(left, right, threshold):
                    yield pa.RecordBatch.from_arrays(
                        [*(n.take(pa.array(y)) for n in names), batch.column(key).take(pa.array(x)), pa.array(found)],
                        names=["query", "query_pos", key, "similarity"])

        return run

    return overlaps.map_passes(rows, asked, "query", search, schema)


def top_similar(
    database: DataFrame, queries: DataFrame, key: str, top_k: int = 10, threshold: float = 0.3,
) -> DataFrame:
    """The most similar database rows per query, ties in key order.

    A task keeps the best rows of each query over all its rows, and leaves out classes of row sizes
    that allow nothing better (:func:`overlaps.bounded_search`); the few that are left are merged.
    """
    rows, asked, schema = searched(database, queries, key)
    edges = size_edges(max(threshold, 0.5))

    def search(part):
        names = [overlaps.whole(part.column(c)) for c in ("query", "query_pos")]
        words, sizes = overlaps.words_of(part, WORD_COLUMNS), part.column("n").to_numpy()

        def run(batches):
            hits, kind = overlaps.TopHits(len(sizes), top_k, threshold), None
            for batch in overlaps.with_bits(batches):
                kind = batch.column(key).type
                overlaps.bounded_search(overlaps.words_of(batch, WORD_COLUMNS), batch.column("n").to_numpy(),
                                        batch.column(key), words, sizes, hits, edges)
            if kind is not None:
                yield overlaps.emitted(hits, names, [kind], ["query", "query_pos", key, "similarity"])

        return run

    hits = overlaps.map_passes(rows, asked, "query", search, schema)
    return top_per_group(hits, ["query", "query_pos"], best_first("similarity", key), top_k)


def best_reference(hits: DataFrame, key: str) -> DataFrame:
    """One row per database row: its highest similarity and the first reference in list order."""
    return hits.groupBy(key).agg(
        F.max("similarity").alias("similarity"),
        F.min_by("query", "query_pos").alias("reference"),
    )


def screen(
    database: DataFrame, references: DataFrame, key: str, top_k: int = 20, per_reference: int = 50,
    threshold: float = 0.2, predictions: DataFrame | None = None,
) -> DataFrame:
    """Rank by similarity to known actives, together with model probabilities where given.

    Without predictions the similarity stands in for the probability.
    """
    hits = best_reference(
        top_similar(database, references, key, per_reference, threshold), key)
    if predictions is None:
        rows = hits.withColumn("probability_active", F.col("similarity"))
    else:
        rows = attach_hits(predictions, hits, key)
    scored = rows.withColumn(
        "combined_score",
        combined_screen_score(F.col("probability_active"), F.col("similarity")))
    return top_rows(scored, best_first("combined_score", key), top_k)


def cosine_top_k(
    vectors: DataFrame, queries: DataFrame, key: str, vector: str, top_k: int = 10,
) -> DataFrame:
    """The most similar vectors of the whole table for each query, without an index.

    ``queries`` has ``query`` and ``query_vector``, any number of rows.  They go to the tasks in
    passes of bounded size; a task keeps the best rows of each query over all its rows, by matrix
    products, before they are merged by query.  :mod:`vector_index` reads fewer rows.
    """
    found = None
    for part in overlaps.passes_of(queries.select("query", "query_vector"), "query"):
        hits = cosine_hits(vectors, key, vector, part, top_k)
        found = hits if found is None else found.unionByName(hits)
    return top_per_group(found, ["query"], best_first("similarity", key), top_k)
