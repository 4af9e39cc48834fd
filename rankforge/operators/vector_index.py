"""Exact search for the most similar vectors (cosine), over a stored index of cells.

A cell holds the vectors nearest to its centre, one folder each. The angle between a query and any vector of a cell is at
least the angle to the centre less the cell's radius, so a cell whose best possible cosine stays below a query's k-th hit
cannot change the result and is not read for it. Overlaps are matrix products of a block of rows with the queries that
need its cell; no pair of a vector and a query is a row before it is a hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from rankforge.config import SEED
from rankforge.operators import overlaps
from rankforge.operators.toplists import best_first, top_per_group
from rankforge.session import scratch_path

#: The centres come from at most this many vectors; every vector is stored in a cell.
SAMPLE_ROWS, MOST_CELLS, ROUNDS = 20_000, 2048, 8
#: Rows of one matrix product; what its rounding may change of a cosine.
BLOCK, SLACK = 4096, 1e-9


def matrix(lists: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one width (that of the first by default) as rows, and their places in the array.

    Null vectors, those of another width, and those without a finite length above zero are left out.
    """
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), -1))
    if width is None:
        width = int(sizes[sizes > 0][0]) if (sizes > 0).any() else 0
    places = np.flatnonzero(sizes == width)
    flat = np.asarray(lists.take(pa.array(places)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    rows = flat.reshape(len(places), width) if width else np.zeros((len(places), 0))
    norms = np.sqrt((rows * rows).sum(axis=1))
    good = np.isfinite(norms) & (norms > 0)
    return rows[good], places[good]


def units(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def centres_of(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Directions of ``cells`` groups of the sample, by a few rounds of assigning and averaging."""
    points = units(sample)
    cells = min(cells, len(points))
    centres = points[np.sort(np.random.default_rng(seed).choice(len(points), cells, replace=False))]
    for _ in range(rounds):
        own = np.concatenate([(points[a:a + BLOCK] @ centres.T).argmax(axis=1) for a in range(0, len(points), BLOCK)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        sizes = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1e-300)[:, None], centres)
    return centres


class VectorIndex:
    """A stored index: where it is, and of each cell its centre, radius (an angle) and rows."""

    def __init__(self, rows: DataFrame, key: str, vector: str, centres: np.ndarray, facts: dict[int, tuple[float, int]]) -> None:
        self.rows, self.key, self.vector, self.centres = rows, key, vector, centres
        self.radius = np.array([facts.get(c, (0.0, 0))[0] for c in range(len(centres))])
        self.counts = np.array([facts.get(c, (0.0, 0))[1] for c in range(len(centres))], np.int64)


def build_index(vectors: DataFrame, key: str, vector: str, cells: int | None = None, path: str | None = None) -> VectorIndex:
    """Store the vectors by cell below ``path`` (by default a new folder of the shared one).

    The number of cells is the square root of that of the rows, at most ``MOST_CELLS``.
    """
    spark: SparkSession = vectors.sparkSession
    given = vectors.select(key, vector)
    total = given.count()
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    picked = given.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) <= int(share * (1 << 20))).limit(2 * SAMPLE_ROWS)
    sample = matrix(picked.select(vector).toArrow().column(0))[0]
    width = sample.shape[1]
    centres = centres_of(sample, cells or min(MOST_CELLS, max(1, int(total ** 0.5)))) if len(sample) else np.zeros((0, width))
    sent = spark.sparkContext.broadcast(centres)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places = matrix(batch.column(1), width)
            for at in range(0, len(rows), BLOCK):
                nearness = units(rows[at:at + BLOCK]) @ sent.value.T
                own = nearness.argmax(axis=1)
                angle = np.arccos(np.clip(nearness[np.arange(len(own)), own], -1, 1))
                some = batch.take(pa.array(places[at:at + BLOCK]))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(angle), pa.array(own.astype(np.int32))],
                                                 names=[key, vector, "_angle", "_cell"])

    path = path or scratch_path(spark, "cells")
    dealt = given.mapInArrow(assign, f"{kinds}, _angle double, _cell int") if len(centres) else given.limit(0).withColumns(
        {"_angle": F.lit(0.0), "_cell": F.lit(0)})
    dealt.write.partitionBy("_cell").parquet(path)
    stored = spark.read.schema(dealt.schema).parquet(path)
    # A row for each cell.
    facts = {r["_cell"]: (r["radius"], r["rows"]) for r in stored.groupBy("_cell").agg(
        F.max("_angle").alias("radius"), F.count("*").alias("rows")).collect()}
    return VectorIndex(stored, key, vector, centres, facts)


def add_block(hits: overlaps.TopHits, rows: np.ndarray, keys: pa.Array, asked: np.ndarray, numbers: np.ndarray) -> None:
    """Add the best of a block of rows to the hits of the queries ``numbers``.

    A matrix product finds the rows that can matter; their cosines are then computed one by one, so
    that equal vectors get equal values wherever they stand.
    """
    rank = overlaps.key_rank(keys)
    own, norms = np.sqrt((rows * rows).sum(axis=1)), np.sqrt((asked * asked).sum(axis=1))
    for at in range(0, len(rows), BLOCK):
        part = slice(at, at + BLOCK)
        rough = (rows[part] @ asked[numbers].T) / own[part, None] / norms[numbers][None, :]
        for column in np.flatnonzero(rough.max(axis=0) >= hits.bars[numbers] - SLACK):
            query, values = numbers[column], rough[:, column]
            bar = hits.bars[query]
            if len(values) > hits.k:
                bar = max(bar, np.partition(values, -hits.k)[-hits.k])
            places = at + np.flatnonzero(values >= bar - SLACK)
            exact = (rows[places] * asked[query]).sum(axis=1) / (own[places] * norms[query])
            hits.add(query, exact, keys, rank, places)


def cosine_hits(rows: DataFrame, key: str, vector: str, part: pa.Table, top_k: int,
                cell_queries: dict[int, np.ndarray] | None = None, bars: np.ndarray | None = None) -> DataFrame:
    """Each task's best rows for the queries of ``part``; only for those of its cell where ``cell_queries`` says which."""
    asked, places = matrix(part.column("query_vector"))
    names = overlaps.whole(part.column("query")).take(pa.array(places))
    kind = rows.schema[key].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast((asked, cell_queries, bars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, wanted, bars = sent.value
        hits, found_kind = overlaps.TopHits(len(asked), top_k, -np.inf if bars is None else bars), None
        for batch in batches:
            found_kind = batch.column(key).type
            cells = batch.column("_cell").to_numpy() if wanted is not None else np.zeros(batch.num_rows, int)
            for cell in np.unique(cells):
                numbers = np.arange(len(asked)) if wanted is None else wanted.get(int(cell), np.zeros(0, int))
                there = np.flatnonzero(cells == cell)
                if len(numbers):
                    block, inside = matrix(batch.column(vector).take(pa.array(there)), asked.shape[1])
                    add_block(hits, block, batch.column(key).take(pa.array(there[inside])), asked, numbers)
        if found_kind is not None:
            yield overlaps.emitted(hits, [names], [found_kind], ["query", key, "similarity"])

    columns = [key, vector] + (["_cell"] if cell_queries is not None else [])
    query_kind = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string"}.get(names.type, "string")
    return rows.select(*columns).mapInArrow(run, f"query {query_kind}, `{key}` {kind}, similarity double")


def search_index(index: VectorIndex, queries: DataFrame, top_k: int = 10) -> tuple[DataFrame, float]:
    """``query``, key and ``similarity`` of each query's ``top_k`` best rows, and the share of the rows visited for a query.

    ``queries`` has ``query`` and ``query_vector``. First a query reads the cells that allow the best
    values until they hold ``top_k`` rows; then all others that can still hold something better.
    """
    out, seen, total = None, 0, 0
    best = best_first("similarity", index.key)
    for part in overlaps.passes_of(queries.select("query", "query_vector"), "query"):
        asked, places = matrix(part.column("query_vector"))
        if not len(asked) or not len(index.centres) or asked.shape[1] != index.centres.shape[1]:
            continue
        angle = np.arccos(np.clip(units(asked) @ index.centres.T, -1, 1))
        allowed = np.where(index.counts > 0, np.cos(np.maximum(0, angle - index.radius)), -2.0)
        order = np.argsort(-allowed, axis=1, kind="stable")
        held = np.cumsum(index.counts[order], axis=1)
        first = np.zeros_like(allowed, bool)
        np.put_along_axis(first, order, held - index.counts[order] < top_k, axis=1)
        first &= index.counts > 0
        near = visit(index, part, first, top_k, None)
        # At most top_k rows for each query of the pass.
        near = top_per_group(near, ["query"], best, top_k)
        rows = near.toArrow()
        bars = np.full(len(asked), -2.0)
        number = {q: i for i, q in enumerate(overlaps.whole(part.column("query")).take(pa.array(places)).to_pylist())}
        counts = np.zeros(len(asked), np.int64)
        lows = np.full(len(asked), 2.0)
        for q, s in zip(rows.column("query").to_pylist(), rows.column("similarity").to_pylist()):
            counts[number[q]] += 1
            lows[number[q]] = min(lows[number[q]], s)
        bars[counts == top_k] = lows[counts == top_k]
        rest = (allowed >= bars[:, None] - SLACK) & ~first & (index.counts > 0)
        found = near.sparkSession.createDataFrame(rows, near.schema)
        if rest.any():
            found = found.unionByName(visit(index, part, rest, top_k, bars))
        merged = top_per_group(found, ["query"], best, top_k)
        out = merged if out is None else out.unionByName(merged)
        seen += int(((first | rest) * index.counts).sum())
        total += len(asked) * int(index.counts.sum())
    if out is None:
        out = queries.select("query").limit(0).join(index.rows.select(index.key).limit(0)).withColumn("similarity", F.lit(0.0))
    return out, seen / total if total else 0.0


def visit(index: VectorIndex, part: pa.Table, wanted: np.ndarray, top_k: int, bars: np.ndarray | None) -> DataFrame:
    """Best rows of the wanted (query, cell); other cells' folders are not read."""
    cells = np.flatnonzero(wanted.any(axis=0))
    rows = index.rows.where(F.col("_cell").isin([int(c) for c in cells]))
    return cosine_hits(rows, index.key, index.vector, part, top_k, {int(c): np.flatnonzero(wanted[:, c]) for c in cells}, bars)
