"""Hard-negative mining by a vertical scan: dimension by dimension, with bounds on what the other dimensions can add.

Vectors are stored once in blocks, dimension after dimension, with integer components. Anchors come in passes of bounded
size, broadcast, and every task reads its blocks once a pass. For an anchor the dimensions of a block are read in falling
order of the anchor's components' size. After some of them the least and most that the others can add follow from the
block's smallest and largest components; a row goes out of the candidate bitmap once these bounds rule it out. The first
scan finds an anchor's positives: rows of its label whose best score stays below the best ones known go out. The second
finds negatives: rows of other labels that can reach no positive's window, or none of the best places in it, go out.
What is left after the last dimension has exact scores. Tasks hand on the best few for each anchor or window, which are
merged by anchor. No pair of an anchor and a row is ever a row of a table.

Defined results: rows with a null label or vector, or a null, non-finite or very large component (beyond 2^20, whose
scores need not fit a long) take no part. Vectors of different lengths are filled up with zeros. Ties go to the smaller
id, null ids last; a null id is no anchor. Equal anchor rows count once, and a row is no positive or negative of its own
id. Repeated other rows count one by one. An empty table or one without anchors gives no rows; a positive whose window
is empty gives none. Columns but id, label and vector are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankforge.llm import common
from rankforge.session import written

SCALE = 256
LARGEST = 1 << 20
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies within these hundredths of the positive's.
WINDOW = (80, 100)
#: Bytes of anchors that go to the tasks at once.
PASS_BYTES = 16 << 20
ROWS_PER_TASK = 250_000
#: Dimensions between two looks at the bounds.
STRIDE = 8
NO_ID = np.iinfo(np.int64).max
KEYS = ["anchor", "anchor_id"]


def rows_of(vectors: DataFrame, vec_id: str, label: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``id``, ``label`` and ``v`` (integers) of the rows that take part."""
    def fits(x: Column) -> Column:
        return x.isNotNull() & (F.abs(x.cast("double")) <= F.lit(float(LARGEST)))

    return vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, fits)).select(
        F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists as rows, filled up with zeros."""
    offsets = lists.offsets.to_numpy()
    size = np.diff(offsets)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def blocks(rows: DataFrame, tasks: int) -> DataFrame:
    """Arrow batches of rows as one row each: ids, labels and components, dimension after dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("id").fill_null(int(NO_ID)).to_numpy()
                dims = np.ascontiguousarray(matrix(batch.column("v")).T)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()) for x in (ids, batch.column("label").to_numpy(), dims)],
                    names=["ids", "labels", "dims"])

    return rows.repartition(tasks).mapInArrow(run, "ids binary, labels binary, dims binary")


class Block:
    """Columns of one block, and the least and largest component of each."""

    def __init__(self, ids: bytes, labels: bytes, dims: bytes) -> None:
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.dims = np.frombuffer(dims, np.int32).reshape(-1, len(self.ids))
        self.low, self.high = self.dims.min(axis=1).astype(np.int64), self.dims.max(axis=1).astype(np.int64)

    def scan(self, anchor: np.ndarray, rows: np.ndarray,
             possible: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows that ``possible(least, most)`` never rules out, of the given ones, and their exact scores."""
        width = min(len(anchor), len(self.dims))
        order = np.argsort(-np.abs(anchor[:width]), kind="stable")
        q = anchor[order]
        ends = np.stack([q * self.low[order], q * self.high[order]])
        more = ends.max(axis=0)[::-1].cumsum()[::-1]
        less = ends.min(axis=0)[::-1].cumsum()[::-1]
        score = np.zeros(len(rows), np.int64)
        every = len(rows) == len(self.ids)
        for at in range(width):
            if at % STRIDE == 0:
                alive = possible(score + less[at], score + more[at])
                left = np.count_nonzero(alive)
                if left < 0.9 * len(rows):
                    rows, score, every = rows[alive], score[alive], False
                    if not left:
                        break
            column = self.dims[order[at]]
            score += q[at] * (column if every else column[rows])
        alive = possible(score, score)
        return rows[alive], score[alive]


def best(ids: np.ndarray, scores: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` highest scores, ties by id."""
    if len(ids) > count:
        near = scores >= np.partition(scores, -count)[-count]
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:count]
    return ids[order], scores[order]


class Best:
    """The best ids and scores met so far."""

    def __init__(self, count: int) -> None:
        self.count, self.ids, self.scores = count, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def bar(self) -> int | None:
        """What a score must reach to matter; none as long as places are free."""
        return int(self.scores[-1]) if len(self.scores) == self.count else None

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids):
            self.ids, self.scores = best(
                np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores]), self.count)


def window(positive: int) -> tuple[int, int]:
    """Lowest and highest score of a negative; none fits where the first is larger."""
    least, most = WINDOW
    return -(-least * positive // 100), most * positive // 100


def find_positives(block: Block, anchor: dict, known: Best) -> None:
    rows = np.flatnonzero((block.labels == anchor["label"]) & (block.ids != anchor["id"]))

    def possible(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        bar = known.bar()
        if len(least) >= known.count:
            sure = int(np.partition(least, -known.count)[-known.count])
            bar = sure if bar is None else max(bar, sure)
        return most >= bar if bar is not None else np.ones(len(least), bool)

    if len(rows):
        rows, scores = block.scan(anchor["v"], rows, possible)
        known.add(block.ids[rows], scores)


def find_negatives(block: Block, anchor: dict, known: dict[int, Best]) -> None:
    windows = []
    for positive, found in known.items():
        low, high = window(positive)
        if low <= high:
            bar = found.bar()
            windows.append((low if bar is None else max(low, bar), high, found))
    if not windows:
        return
    rows = np.flatnonzero((block.labels != anchor["label"]) & (block.ids != anchor["id"]))

    def possible(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        alive = np.zeros(len(least), bool)
        for low, high, _ in windows:
            alive |= (most >= low) & (least <= high)
        return alive

    rows, scores = block.scan(anchor["v"], rows, possible)
    for low, high, found in windows:
        inside = (scores >= low) & (scores <= high)
        found.add(block.ids[rows[inside]], scores[inside])


def blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Block(*(batch.column(c)[row].as_py() for c in ("ids", "labels", "dims")))


def top(rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The first rows of each key with their ``rank``, by score, then id."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine(vectors: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding",
         anchor_every: int = 100, scale: int = SCALE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores, for each anchor and positive."""
    spark = vectors.sparkSession
    rows = rows_of(vectors, vec_id, label, vector, scale)
    anchors = written(rows.where(F.col("id") % anchor_every == 0).distinct(), "anchors")
    asked, size = anchors.agg(F.count("*"), F.coalesce(F.sum(F.size("v") * 4 + 64), F.lit(0))).first()
    result = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
                                       "positive_score bigint, negative_score bigint")
    if not asked:
        return result
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_TASK))
    stored = written(blocks(rows, tasks), "vectors")
    passes = -(-size // pass_bytes)
    dealt = F.pmod(F.xxhash64("id"), F.lit(passes))
    for i in range(passes):
        result = result.unionByName(mine_pass(stored, anchors.where(dealt == i)))
    return result


def mine_pass(stored: DataFrame, anchors: DataFrame) -> DataFrame:
    """The rows of one pass of anchors."""
    context = stored.sparkSession.sparkContext
    given = anchors.toArrow()
    vectors = given.column("v").combine_chunks()
    listed = [{"id": i, "label": x, "v": v} for i, x, v in zip(
        given.column("id").to_pylist(), given.column("label").to_pylist(), matrix(vectors).astype(np.int64))]
    sent = context.broadcast(listed)

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Best(POSITIVES) for _ in sent.value]
        for block in blocks_in(batches):
            for anchor, each in zip(sent.value, known):
                find_positives(block, anchor, each)
        for at, (anchor, each) in enumerate(zip(sent.value, known)):
            if len(each.ids):
                n = len(each.ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, at)), pa.array(np.full(n, anchor["id"])),
                     pa.array(each.ids, mask=each.ids == NO_ID), pa.array(each.scores)],
                    names=[*KEYS, "id", "score"])

    found = written(top(stored.mapInArrow(positives, "anchor bigint, anchor_id bigint, id bigint, score bigint"), KEYS,
                        POSITIVES), "positives")
    # At most POSITIVES rows for each anchor of the pass.
    scores = found.select("anchor", "score").distinct().toArrow()
    wanted: dict[int, list[int]] = {}
    for at, score in zip(scores.column("anchor").to_pylist(), scores.column("score").to_pylist()):
        wanted.setdefault(at, []).append(score)
    asked = context.broadcast(wanted)

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {at: {s: Best(NEGATIVES) for s in each} for at, each in asked.value.items()}
        for block in blocks_in(batches):
            for at, each in known.items():
                find_negatives(block, sent.value[at], each)
        for at, each in known.items():
            for positive, kept in each.items():
                if n := len(kept.ids):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, at)), pa.array(np.full(n, positive)),
                         pa.array(kept.ids, mask=kept.ids == NO_ID), pa.array(kept.scores)],
                        names=["anchor", "positive_score", "id", "score"])

    near = top(stored.mapInArrow(negatives, "anchor bigint, positive_score bigint, id bigint, score bigint"),
               ["anchor", "positive_score"], NEGATIVES)
    pairs = found.select(*KEYS, F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return written(pairs.join(near, ["anchor", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score")), "negatives")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", moved.alias("label"), "embedding"))


SQL = """
WITH taken AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM taken a JOIN taken b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5"""
