"""Greedy diversity filter, and near-duplicate links of a whole table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rankforge.operators import overlaps
from rankforge.operators.joins import beside
from rankforge.operators.similarity import FINGERPRINT, WORD_COLUMNS, size_class
from rankforge.operators.toplists import top_rows
from rankforge.session import scratch_path, written

KEEP = 100
#: Rows of one range of the diversity filter, and of one block of the near-duplicate join.
RANGE_ROWS, BLOCK_ROWS = 100_000, 8192
#: Rows that one look at the local choices brings to the driver.
LOOK_ROWS = 2000
POS_FINGERPRINT = ["pos", *FINGERPRINT]


def plain_position(pos: object) -> object:
    """A position from Spark or Arrow as one that can be looked up."""
    return tuple(pos.values() if isinstance(pos, dict) else pos) if isinstance(pos, (dict, tuple)) else pos


class Kept:
    """The chosen rows, at most ``KEEP``."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold
        self.words, self.sizes = np.zeros((0, len(WORD_COLUMNS)), np.uint64), np.zeros(0, np.int64)
        self.empty: set = set()  # positions of chosen rows without bits, which are near nothing, themselves included

    def add(self, pos: object, words: np.ndarray, n: int) -> None:
        self.words, self.sizes = np.vstack([self.words, words]), np.append(self.sizes, n)
        if not n:
            self.empty.add(plain_position(pos))

    def open_rows(self, table: pa.Table) -> pa.Table:
        """The rows without those among the chosen ones that have no bits."""
        if not self.empty:
            return table
        there = [n == 0 and plain_position(p) in self.empty
                 for n, p in zip(table.column("n").to_pylist(), table.column("pos").to_pylist())]
        return table.filter(pa.array([not x for x in there]))

    def near(self, words: np.ndarray, n: int) -> bool:
        return bool((overlaps.tanimoto_to(words, n, self.words, self.sizes) > self.threshold).any())

    def far(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Places of the rows that are near none of the chosen ones."""
        left = np.arange(len(sizes))
        for chosen, n in zip(self.words, self.sizes):
            left = left[overlaps.tanimoto_to(chosen, n, words[left], sizes[left]) <= self.threshold]
        return left


def first_choices(words: np.ndarray, sizes: np.ndarray, kept: Kept, room: int) -> list[tuple[int, int]]:
    """The greedy choice among rows in order after ``kept``: places, and how many later rows each one rules out."""
    left, out = kept.far(words, sizes), []
    while len(left) and len(out) < room:
        first = left[0]
        apart = overlaps.tanimoto_to(words[first], sizes[first], words[left], sizes[left]) <= kept.threshold
        apart[0] = False
        out.append((int(first), int(len(left) - 1 - apart.sum())))
        left = left[apart]
    return out


def ordered_ranges(ranked: DataFrame) -> tuple[DataFrame, int]:
    """The rows with a fingerprint, stored in ranges of ``pos`` (``_range`` is a folder each), and the number of ranges."""
    rows = ranked.filter("n IS NOT NULL").select(*POS_FINGERPRINT)
    parts = max(1, -(-rows.count() // RANGE_ROWS))
    path = scratch_path(ranked.sparkSession, "ranges")
    (rows.repartitionByRange(parts, "pos").sortWithinPartitions("pos").withColumn("_range", F.spark_partition_id())
     .write.partitionBy("_range").parquet(path))
    kinds = rows.withColumn("_range", F.lit(0)).schema
    return ranked.sparkSession.read.schema(kinds).parquet(path), parts


def local_choices(ranges: DataFrame, kept: Kept, room: int) -> DataFrame:
    """Of each range (each part of one that a task reads) its own greedy choice after ``kept``."""
    kind = ranges.schema["pos"].dataType.simpleString()
    schema = f"pos {kind}, {', '.join(f'{w} bigint' for w in WORD_COLUMNS)}, n int, _range int, _ruled_out bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and held[0].column("_range")[0] != batch.column("_range")[0]:
                yield from choose(held)
                held = []
            at = np.flatnonzero(np.diff(batch.column("_range").to_numpy())) + 1
            cuts = [0, *at.tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if held and a:
                    yield from choose(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from choose(held)

    def choose(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept.open_rows(pa.Table.from_batches(held).combine_chunks())
        found = first_choices(overlaps.words_of(table, WORD_COLUMNS), table.column("n").to_numpy(), kept, room)
        if found:
            places, out = (pa.array(x) for x in zip(*found))
            yield table.select([*POS_FINGERPRINT, "_range"]).take(places).append_column("_ruled_out", out).combine_chunks(
                ).to_batches()[0]

    return ranges.select(*POS_FINGERPRINT, "_range").mapInArrow(run, schema)


def choose_diverse(ranked: DataFrame, threshold: float = 0.8, keep: int = KEEP) -> DataFrame:
    """The greedy choice over a table with ``pos`` (sortable, unique) and a fingerprint.

    Going by ``pos``, a row is chosen unless an earlier chosen row is more similar than the
    threshold; at most ``keep`` rows are chosen.  Rows are stored in ranges of ``pos``.  In a round
    every range makes its own greedy choice among its rows that are near no row chosen so far.
    Taken in order, these choices are the global ones until one is near a choice of the same round
    and had ruled out rows of its range, whose fate is then open; the next round begins there.
    Rounds look at one range first, then at four times as many, so ranges beyond the last choice
    are seldom read.  Only local choices, ``LOOK_ROWS`` a round, come to the driver.
    """
    return _kept_table(ranked, rounds_of_choice(ranked, threshold, keep)[0])


def rounds_of_choice(ranked: DataFrame, threshold: float, keep: int) -> tuple[list, int]:
    """The chosen rows, and the number of rounds."""
    ranges, parts = ordered_ranges(ranked)
    kept, chosen = Kept(threshold), []
    at, width, rounds = 0, 1, 0
    while at < parts and len(chosen) < keep:
        rounds += 1
        end = min(at + width, parts)
        some = ranges.where((F.col("_range") >= at) & (F.col("_range") < end))
        local = local_choices(some, kept, keep - len(chosen)).orderBy("pos").limit(LOOK_ROWS).collect()
        at, open_at = end, None
        for row in local:
            words = np.array([row[w] for w in WORD_COLUMNS], np.int64).view(np.uint64)
            if kept.near(words, row["n"]):
                if row["_ruled_out"]:
                    open_at = row["_range"]
                    break
            else:
                kept.add(row["pos"], words, row["n"])
                chosen.append(row)
                if len(chosen) == keep:
                    break
        if open_at is None and len(local) == LOOK_ROWS:
            open_at = local[-1]["_range"]
        if open_at is not None:
            at = open_at
        else:
            width *= 4
    return chosen, rounds


def _kept_table(ranked: DataFrame, kept: list) -> DataFrame:
    """The chosen rows (at most KEEP) as a table with their place in the list."""
    schema = ranked.select(*POS_FINGERPRINT).schema
    data = [tuple(r[c] for c in POS_FINGERPRINT) for r in kept]
    table = ranked.sparkSession.createDataFrame(data, schema)
    return table.withColumnsRenamed({c: f"k_{c}" for c in POS_FINGERPRINT})


def diversity_filter(
    df: DataFrame, category: str, order: Column, order_columns: list[Column],
    threshold: float = 0.8, keep: int = KEEP,
) -> DataFrame:
    """Keep a diverse subset, best rows first.

    ``order`` is a sortable unique mark of the wanted order.  Peptides keep their first ``keep``
    rows; a table without fingerprints, or one where nothing is chosen, comes back unchanged.
    """
    if category == "amp":
        return top_rows(df, order_columns, keep)
    if not set(FINGERPRINT) <= set(df.columns):
        return df
    ranked = written(df.select(order.alias("pos"), *FINGERPRINT), "diversity")
    kept = choose_diverse(ranked, threshold, keep)
    if not kept.take(1):
        return df
    # At most ``keep`` rows.
    marks = F.broadcast(kept.select(F.col("k_pos").alias("_pos")))
    return df.withColumn("_pos", order).join(marks, "_pos", "left_semi").drop("_pos")


def dealt_blocks(firsts: DataFrame, threshold: float) -> DataFrame:
    """Rows once for each task they take part in: ``_task`` and ``_side`` (0 the first block, 1 the second, 2 both).

    Near sets lie in one size class or in neighbour classes.  Each class is dealt by hash into blocks
    of about ``BLOCK_ROWS`` rows; a task is a pair of blocks of one class or of neighbour classes.
    """
    classed = firsts.withColumn("_class", size_class(F.col("n"), threshold))
    # At most one row for each class, and there are a few dozen classes.
    sizes = {r["_class"]: r["rows"] for r in classed.groupBy("_class").agg(F.count("*").alias("rows")).collect()}
    blocks = {c: -(-rows // BLOCK_ROWS) for c, rows in sizes.items()}
    known = F.create_map(*[F.lit(x) for c, b in blocks.items() for x in (c, b)]) if blocks else F.lit(None).cast("map<int,int>")
    own, block = F.col("_class"), F.col("_block")
    dealt = classed.withColumn("_block", F.pmod(F.xxhash64("pos"), known[own]).cast("int"))

    def tasks(other: Column, count: Column, make) -> Column:
        numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda j: make(other, j))

    def task(a: Column, i: Column, b: Column, j: Column, side: Column) -> Column:
        return F.struct(F.concat_ws(":", a, i, b, j).alias("_task"), side.alias("_side"))

    def count(c: Column) -> Column:
        return F.coalesce(known[c], F.lit(0))

    same = tasks(own, count(own), lambda c, j: task(
        c, F.least(block, j), c, F.greatest(block, j),
        F.when(block == j, 2).when(block < j, 0).otherwise(1)))
    above = tasks(own + 1, count(own + 1), lambda c, j: task(own, block, c, j, F.lit(0)))
    below = tasks(own - 1, count(own - 1), lambda c, j: task(c, j, own, block, F.lit(1)))
    return dealt.withColumn("_x", F.explode(F.concat(same, above, below))).select(
        *firsts.columns, "_x._task", "_x._side")


def sides(table: pa.Table) -> tuple[pa.Table, overlaps.Sized, pa.Table, overlaps.Sized, bool]:
    """Both blocks of a task, and whether they are one."""
    side = table.column("_side").to_numpy()
    parts = [table.take(pa.array(np.flatnonzero((side == s) | (side == 2)))) for s in (0, 1)]
    sized = [overlaps.Sized(overlaps.words_of(p, WORD_COLUMNS), p.column("n").to_numpy()) for p in parts]
    return parts[0], sized[0], parts[1], sized[1], bool((side == 2).any())


def near_in_blocks(firsts: DataFrame, threshold: float) -> DataFrame:
    """All pairs of distinct fingerprints above the threshold: ``pos``, ``k_pos`` (the earlier one), ``similarity``.

    Blocks meet in tasks of bounded size, where the overlaps of all their rows of like size are
    matrix products, strip by strip; a pair becomes a row once it is above the threshold.
    """
    kind = firsts.schema["pos"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, by_left, right, by_right, one = sides(pa.Table.from_batches(list(batches)))
        for x, y, found in overlaps.near(by_left, by_right, threshold, strict=True):
            if one:
                once = x < y
                x, y, found = x[once], y[once], found[once]
            yield pa.RecordBatch.from_arrays(
                [overlaps.whole(left.column("pos").take(pa.array(x))), overlaps.whole(right.column("pos").take(pa.array(y))),
                 pa.array(found)], names=["a", "b", "similarity"])

    pairs = dealt_blocks(firsts.select(*POS_FINGERPRINT), threshold).groupBy("_task").applyInArrow(
        run, f"a {kind}, b {kind}, similarity double")
    return pairs.select(F.greatest("a", "b").alias("pos"), F.least("a", "b").alias("k_pos"), "similarity")


def links_in_blocks(firsts: DataFrame, threshold: float) -> DataFrame:
    """``pos`` and ``near``: how many rows have a fingerprint near that of ``pos``, ``copies`` counted; parts of the sum."""
    kind = firsts.schema["pos"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, by_left, right, by_right, one = sides(pa.Table.from_batches(list(batches)))
        copies = [t.column("copies").to_numpy() for t in (left, right)]
        counts = [np.zeros(len(c), np.int64) for c in copies]
        for x, y, _ in overlaps.near(by_left, by_right, threshold, strict=True):
            if one:
                other = x != y
                x, y = x[other], y[other]
            np.add.at(counts[0], x, copies[1][y])
            if not one:
                np.add.at(counts[1], y, copies[0][x])
        for table, count in ((left, counts[0]), (right, counts[1])):
            some = pa.array(np.flatnonzero(count))
            yield pa.RecordBatch.from_arrays(
                [overlaps.whole(table.column("pos").take(some)), pa.array(count).take(some)], names=["pos", "near"])
            if one:
                break

    dealt = dealt_blocks(firsts.select(*POS_FINGERPRINT, "copies"), threshold)
    return dealt.groupBy("_task").applyInArrow(run, f"pos {kind}, near bigint")


def distinct_fingerprints(rows: DataFrame) -> DataFrame:
    """Every distinct fingerprint with its first row's ``pos`` and its ``copies``."""
    return written(rows.groupBy(*FINGERPRINT).agg(F.min("pos").alias("pos"), F.count("*").alias("copies")), "firsts")


def with_first(rows: DataFrame, firsts: DataFrame, *columns: str) -> DataFrame:
    """Rows with ``columns`` of their fingerprint's entry; a fingerprint with very many copies is dealt over tasks."""
    named = F.struct(*[F.col(c).alias(f"first_{c}") for c in ("pos", *columns)])
    known = firsts.select(*FINGERPRINT, named.alias("_first"), F.col("copies").alias("_rows"))
    return beside(rows, known, FINGERPRINT, F.col("pos")).select("pos", "_first.*")


def near_duplicate_pairs(ranked: DataFrame, threshold: float = 0.8) -> DataFrame:
    """All links of the table: ``pos``, ``near_pos`` (earlier) and ``similarity``.

    Every pair of distinct fingerprints above the threshold, between their first rows, and every
    copy with the first row of its fingerprint, which has all the copy's other links.
    """
    rows = ranked.filter("n > 0").select(*POS_FINGERPRINT)
    firsts = distinct_fingerprints(rows)
    copies = with_first(rows, firsts).filter("pos > first_pos").withColumnRenamed("first_pos", "near_pos")
    return near_in_blocks(firsts, threshold).withColumnRenamed("k_pos", "near_pos").unionByName(
        copies.withColumn("similarity", F.lit(1.0)))


def near_duplicate_links(ranked: DataFrame, threshold: float = 0.8) -> DataFrame:
    """A row for every row with a fingerprint: ``pos``, ``class_id`` and ``n_links``.

    Rows of equal fingerprints are a class, named by its first row; ``n_links`` counts the other
    rows of the table, copies too, that are more similar than the threshold.  Links are counted in
    the tasks that find them, so a group of n near rows gives n rows, not n * n.
    """
    rows = ranked.filter("n > 0").select(*POS_FINGERPRINT)
    firsts = distinct_fingerprints(rows)
    near = links_in_blocks(firsts, threshold).groupBy("pos").agg(F.sum("near").alias("near"))
    counted = firsts.join(near, "pos", "left").withColumn(
        "links", F.coalesce("near", F.lit(0)) + F.col("copies") - 1)
    return with_first(rows, counted, "links").select(
        "pos", F.col("first_pos").alias("class_id"), F.col("first_links").alias("n_links"))
