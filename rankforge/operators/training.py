"""Splits, folds, scaling, class weights and minority oversampling."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from rankforge.config import SEED
from rankforge.functions.text import hash_uniform
from rankforge.operators.ordering import seeded_key, shuffled_rank
from rankforge.session import written

#: Rows of one cell of the neighbour search, the most pivots, and the rows that one task meets at a time.
BLOCK = 2000
PIVOTS = 1024
SHELF = 32768
#: Fewer rows are dealt over about so many shelves, and a point is sent to each side that often.
SHELVES = 8
#: Rows of one matrix product and its cells, rows on either side for a first bound, and pairs measured at a time.
STRIPE, PRODUCT, NEARBY, PAIRS = 256, 4_000_000, 1024, 65536


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """A ``fold`` in [0, k) such that every class is spread evenly over the folds."""
    ranked = shuffled_rank(df, label, key, seed)
    return ranked.withColumn("fold", (F.col("rank") % k).cast("int")).drop("rank", "size")


def stratified_split(
    df: DataFrame, label: str, key: str, test: float = 0.2, validation: float = 0.0,
    seed: int = SEED,
) -> DataFrame:
    """A ``split`` column (train, validation, test) with exact shares inside every class."""
    ranked = shuffled_rank(df, label, key, seed)
    test_end = F.floor(F.col("size") * F.lit(test) + 1e-9)
    validation_end = F.floor(F.col("size") * F.lit(test + validation) + 1e-9)
    split = (F.when(F.col("rank") < test_end, "test")
             .when(F.col("rank") < validation_end, "validation").otherwise("train"))
    return ranked.withColumn("split", split).drop("rank", "size")


def split_histogram(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy("split", label).agg(F.count("*").alias("rows"))


def scaler_statistics(train: DataFrame, columns: list[str]) -> Column:
    """Mean and population deviation of every column as one scalar subquery."""
    return train.select(F.struct(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns
    ])).scalar()


def scale(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """Standardize with the statistics of the training rows; a constant column is only centred."""
    stats = scaler_statistics(train, columns)

    def scaled(c: str) -> Column:
        mean, std = F.col("_stats")[c]["mean"], F.col("_stats")[c]["std"]
        return (F.col(c) - mean) / F.when(std > 0, std).otherwise(F.lit(1.0))

    return df.withColumn("_stats", stats).withColumns({c: scaled(c) for c in columns}).drop("_stats")


def class_weights(df: DataFrame, label: str, classes: tuple = (0, 1)) -> DataFrame:
    """Rows and balanced weight n / (classes * rows of the class) for each given class."""
    total = F.lit(len(classes)).cast("double")
    counts = df.filter(F.col(label).isin(*classes)).groupBy(label).agg(F.count("*").alias("rows"))
    everything = df.filter(F.col(label).isin(*classes)).select(F.count("*").alias("n")).scalar()
    return counts.withColumn("weight", everything / (total * F.col("rows")))


def add_class_weights(df: DataFrame, label: str, classes: tuple = (0, 1)) -> DataFrame:
    """Balanced ``weight`` on every row of the given classes; other rows stay and have none.

    The weight table has one row per given class.
    """
    weights = class_weights(df, label, classes).drop("rows")
    return df.join(F.broadcast(weights), label, "left")


def _distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    squares = (points ** 2).sum(axis=1)[:, None] + (others ** 2).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(squares - 2 * points @ others.T, 0.0))


def _points_of(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _key_ranks(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Keys as numbers of the same order over all columns, nulls first."""
    coded = pa.concat_arrays([x for c in columns for x in c.chunks]).dictionary_encode("encode")
    order = pc.array_sort_indices(coded.dictionary, null_placement="at_start").to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return np.split(rank[coded.indices.to_numpy()], np.cumsum([len(c) for c in columns])[:-1])


def _without_copies(points: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be among the k nearest of a row of any other key.

    Of equal points these are the first k + 1 keys, and k rows of each.
    """
    plain = np.ascontiguousarray(points + 0.0)  # no negative zeros
    group = np.unique(plain.view(f"V{plain.shape[1] * 8}").ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((keys, group))
    g, at = group[order], np.arange(len(order))
    new_group = np.r_[True, g[1:] != g[:-1]]
    new_key = new_group | np.r_[True, keys[order][1:] != keys[order][:-1]]
    nth_key = np.cumsum(new_key) - np.cumsum(new_key)[np.maximum.accumulate(np.where(new_group, at, 0))]
    nth_row = at - np.maximum.accumulate(np.where(new_key, at, 0))
    return np.sort(order[(nth_key <= k) & (nth_row < k)])


def _closest(mine: np.ndarray, my_keys: np.ndarray, bound: np.ndarray, theirs: np.ndarray, their_keys: np.ndarray, k: int):
    """Yields rows, others and exact distances of the k nearest rows of another key, none further away than the bound.

    One matrix product gives the squares of some rows at a time; only pairs that it leaves within the
    bound, or within the k-th of the row where there is none, are measured exactly.
    """
    kept = _without_copies(theirs, their_keys, k)
    kept = kept[np.isfinite(theirs[kept]).all(axis=1)]
    theirs, their_keys = theirs[kept], their_keys[kept]
    squares, their_squares = (mine ** 2).sum(axis=1), (theirs ** 2).sum(axis=1)
    one = np.ones(max(len(mine), len(theirs)))
    left = np.column_stack([-2 * mine, squares, one[:len(mine)]])
    right = np.column_stack([theirs, one[:len(theirs)], their_squares]).T
    slack = 1e-11 * (squares + their_squares.max(initial=0.0))
    by_key = np.argsort(their_keys, kind="stable")
    first, last = (np.searchsorted(their_keys[by_key], my_keys, side) for side in ("left", "right"))
    size = max(1, min(STRIPE, PRODUCT // max(1, len(theirs))))
    for at in range(0, len(mine), size):
        stripe = slice(at, at + size)
        far = left[stripe] @ right
        same = (last - first)[stripe]
        rows = np.repeat(np.arange(len(far)), same)
        far[rows, by_key[np.repeat(first[stripe] - np.cumsum(same) + same, same) + np.arange(len(rows))]] = np.inf
        limit = bound[stripe] ** 2
        unknown = np.flatnonzero(np.isinf(limit))
        if len(unknown) and len(theirs) > k:
            limit[unknown] = np.partition(far[unknown], k - 1, axis=1)[:, k - 1]
        limit = np.minimum(limit * (1 + 1e-9) + slack[stripe], np.finfo(float).max)
        row, other = np.nonzero(far <= limit[:, None])
        exact = np.empty(len(row))
        for i in range(0, len(row), PAIRS):
            some = slice(i, i + PAIRS)
            exact[some] = np.sqrt(((mine[at + row[some]] - theirs[other[some]]) ** 2).sum(axis=1))
        order = np.lexsort((their_keys[other], exact, row))
        row, other, exact = row[order], other[order], exact[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield at + row[best], kept[other[best]], exact[best]


def _shelves(pivots: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First shelf and number of shelves of every cell: near cells share one of at most ``most`` rows, a larger cell has several."""
    order, waiting = [], [np.arange(len(pivots))]
    while waiting:
        some = waiting.pop()
        if len(some) == 1:
            order.append(int(some[0]))
            continue
        some = some[np.argsort(pivots[some, pivots[some].var(axis=0).argmax()], kind="stable")]
        before = np.cumsum(rows[some])
        half = min(max(1, int(np.searchsorted(before, before[-1] / 2))), len(some) - 1)
        waiting += [some[half:], some[:half]]
    start, pieces = np.zeros(len(pivots), np.int64), np.maximum(1, -(-rows // most))
    shelf, filled = -1, most
    for cell in order:
        if filled + rows[cell] > most:
            shelf, filled = shelf + 1, 0
        start[cell] = shelf
        if pieces[cell] > 1:
            shelf += int(pieces[cell]) - 1
        filled = filled + rows[cell] if pieces[cell] == 1 else most
    return start, pieces


def nearest_neighbours(rows: DataFrame, columns: list[str], key: str, k: int = 5, seed: int = SEED,
                       block: int = BLOCK) -> DataFrame:
    """The exact k nearest other rows of every row: ``key``, ``place`` (from 0), ``near`` and its ``_point``.

    Rows are assigned to the nearest of some pivot rows, one for every ``block`` rows, and cells that lie
    near each other share a shelf of bounded size.  A row's k-th neighbour is no further than its k-th
    among some rows of its own shelf, and by the triangle inequality a cell further away than that, less
    its radius, holds no neighbour.  A shelf of rows only meets the shelves that are left for any of them,
    two at a time, as one matrix product; points are sent once for each such pair of shelves, and of the
    answers only keys and distances.  The driver sees the pivots and one row per cell, at most ``PIVOTS``
    or, if that is more, the square root of the number of rows.
    """
    kind = rows.schema[key].dataType.simpleString()
    plain = rows.select(F.col(key).alias("key"),
                        F.array(*[F.col(c).cast("double") for c in columns]).alias("point"))
    total = plain.count()
    most = max(PIVOTS, math.isqrt(total))
    chosen = plain.orderBy(seeded_key("key", seed), "key").limit(min(most, max(1, -(-total // block)))).collect()
    if not chosen:
        return rows.sparkSession.createDataFrame(
            [], f"`{key}` {kind}, place INT, near {kind}, _point ARRAY<DOUBLE>")
    pivots = np.array([r["point"] for r in chosen], float).reshape(len(chosen), -1)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                far = _distances(_points_of(batch.column("point")), pivots)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(far.argmin(axis=1).astype(np.int32)), pa.array(far.min(axis=1))],
                    names=["key", "point", "cell", "far"])

    # The number of a row is written with it: keys may repeat.
    placed = written(plain.mapInArrow(assign, f"key {kind}, point array<double>, cell int, far double").withColumn(
        "row", F.monotonically_increasing_id()), "cells")
    radius, sizes = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    for c in placed.groupBy("cell").agg(F.max(F.nanvl("far", F.lit(0.0))).alias("radius"), F.count("*").alias("rows")).collect():
        radius[c["cell"]], sizes[c["cell"]] = c["radius"], c["rows"]
    start, pieces = _shelves(pivots, sizes, max(1, min(SHELF, -(-total // SHELVES))))
    shelf_of = F.get(F.array(*[F.lit(int(x)) for x in start]), F.col("cell"))
    pieces_of = F.get(F.array(*[F.lit(int(x)) for x in pieces]), F.col("cell"))
    dealt = placed.select((shelf_of + F.col("row") % pieces_of).cast("int").alias("shelf"), "cell", "row", "key", "point")

    holds = np.zeros((len(pivots), int((start + pieces).max())), np.float32)
    for cell in np.flatnonzero(sizes):
        holds[cell, start[cell]:start[cell] + pieces[cell]] = 1
    largest = np.sqrt((pivots ** 2).sum(axis=1)).max()

    def visits(held: pa.Table) -> pa.Table:
        """Every row of a shelf with the shelves that may hold its neighbours."""
        held = held.sort_by("cell")
        points, keys = _points_of(held["point"].combine_chunks()), _key_ranks(held["key"])[0]
        limits, wanted = [], []
        for at in range(0, len(points), STRIPE):
            mine, some = slice(at, at + STRIPE), slice(max(0, at - NEARBY), at + STRIPE + NEARBY)
            bound = np.full(len(points[mine]), np.inf)
            for row, _, far in _closest(points[mine], keys[mine], np.full(len(bound), np.inf), points[some], keys[some], k):
                kth = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
                bound[row[kth]] = far[kth]
            # A short distance is the root of a difference of squares, good to 8 digits of these.
            slack = 1e-6 * (np.sqrt((points[mine] ** 2).sum(axis=1)) + largest)
            seen = _distances(points[mine], pivots) - radius <= (bound + slack)[:, None]
            row, shelf = np.nonzero(seen.astype(np.float32) @ holds)
            limits.append(np.repeat(bound, np.bincount(row, minlength=len(bound))))
            wanted.append((np.bincount(row, minlength=len(bound)), shelf.astype(np.int32)))
        ends = np.cumsum(np.concatenate([[0], *[n for n, _ in wanted]])).astype(np.int32)
        to = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
            [pa.array(np.concatenate([x for _, x in wanted])), pa.array(np.concatenate(limits))], ["shelf", "bound"]))
        return pa.table([held["shelf"], held["row"], held["key"], held["point"], to],
                        names=["part", "row", "key", "point", "to"])

    asking = written(dealt.groupBy("shelf").applyInArrow(
        visits, f"part int, row bigint, key {kind}, point array<double>, to array<struct<shelf:int,bound:double>>"), "asking")
    members = asked_members(dealt.select("shelf", "row", "key", "point"), asking)
    asking = asking.select(F.inline("to"), "part", "row", "key", "point")

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and held.num_rows:
            my_keys, their_keys = _key_ranks(asked["key"], held["key"])
            for row, other, far in _closest(
                    _points_of(asked["point"].combine_chunks()), my_keys, asked["bound"].to_numpy(),
                    _points_of(held["point"].combine_chunks()), their_keys, k):
                out.append(pa.table([asked["key"].take(pa.array(row)), pa.array(far, pa.float64()),
                                     held["key"].take(pa.array(other)), held["row"].take(pa.array(other))],
                                    names=["key", "far", "near", "row"]))
        empty = pa.schema([("key", asked.schema.field("key").type), ("far", pa.float64()),
                           ("near", asked.schema.field("key").type), ("row", pa.int64())]).empty_table()
        return pa.concat_tables(out) if out else empty

    by = ["shelf", "part"]
    found = asking.groupBy(*by).cogroup(members.groupBy(*by)).applyInArrow(
        search, f"key {kind}, far double, near {kind}, row bigint")
    place = F.row_number().over(Window.partitionBy("key").orderBy("far", "near")) - 1
    nearest = found.withColumn("place", place).filter(F.col("place") < k)
    return nearest.join(placed.select("row", F.col("point").alias("_point")), "row").select(
        F.col("key").alias(key), "place", "near", "_point")


def asked_members(dealt: DataFrame, asking: DataFrame) -> DataFrame:
    """The rows of every shelf once for each part that asks for it."""
    wanted = asking.select("part", F.explode(F.transform("to", lambda x: x["shelf"])).alias("shelf")).distinct()
    members = dealt.join(wanted, ["shelf"])
    return members.toDF(*members.columns)  # with columns of its own, since it meets the asking rows


def oversample_minority(
    train: DataFrame, columns: list[str], label: str, key: str, k: int = 5, seed: int = SEED,
) -> DataFrame:
    """Add synthetic minority rows until both classes have the same size.

    A synthetic row lies at a random place on the line from a minority row to one of its k nearest
    minority neighbours, which are exact at every size.  Counting the classes runs a small job.
    """
    counts = {r[label]: r["n"] for r in
              train.filter(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*").alias("n")).collect()}
    plain = train.select(*[F.col(c).cast("double").alias(c) for c in columns], label)
    if len(counts) < 2 or counts[0] == counts[1]:
        return plain
    minority = min(counts, key=counts.get)
    small, missing = counts[minority], abs(counts[0] - counts[1])
    rows = written(train.filter(F.col(label) == minority).select(
        key, *[F.col(c).cast("double").alias(c) for c in columns]), "minority")
    near = written(nearest_neighbours(rows, columns, key, k, seed), "neighbours")
    each, extra = divmod(missing, small)
    ranked = shuffled_rank(rows.withColumn("_one", F.lit(1)), "_one", key, seed)
    copies = F.lit(each) + F.when(F.col("rank") < extra, 1).otherwise(0)
    made = (ranked.withColumn("_copies", copies).filter(F.col("_copies") > 0)
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))))
    width = min(k, small - 1)
    pick = F.floor(hash_uniform(0, 1, F.col(key), F.col("_copy"), F.lit("pick"), seed=seed) * width).cast("int")
    made = made.withColumns({
        "place": pick, "_at": hash_uniform(0, 1, F.col(key), F.col("_copy"), F.lit("at"), seed=seed),
    }).join(near.withColumnRenamed("_point", "_to"), [key, "place"])
    synthetic = made.select(*[
        (F.col(c) + F.col("_at") * (F.col("_to")[i] - F.col(c))).alias(c)
        for i, c in enumerate(columns)
    ], F.lit(minority).cast(train.schema[label].dataType).alias(label))
    return plain.unionByName(synthetic)
