"""SimHash near-duplicates: fingerprints, a binary trie self-join, and the groups their links form.

A text's fingerprint has a bit set where over half of its shingle hashes have it. Equal fingerprints are folded to one
row first, so copies cost nothing. Two fingerprints within ``distance`` bits agree on one of ``distance + 1`` blocks of
bits: for each block the bits are rotated so that it leads, and rows with an equal block meet in one task. There the
sorted keys are a binary trie; pairs of its nodes are followed down together, level by level, with the bits in which
they differ counted, and a pair is dropped once it has more than ``distance``. A task hands on a forest of its links
(which keeps every group whole), and the groups over all tasks are found by large-star and small-star rounds.

Defined results: a null or empty text has fingerprint zero; repeated rows get the same result; a null id stays null and
counts only where a group has no other; an empty table gives no rows; further columns are carried by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm import common
from rankforge.session import written

BITS = 64
SHINGLE, DISTANCE, SEED = 3, 2, 42
#: Keys a task works on at once; more come in several pieces that end where a block ends.
PIECE = 1 << 18
#: Rows of (rotation, key) that one task of the self-join should get.
ROWS_PER_TASK = 2_000_000


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit numbers."""
    n = len(texts)
    words, owner = common.word_arrays(pc.ascii_lower(texts))
    out = np.zeros(n, np.uint64)
    if not len(words):
        return out
    words = words.cast(pa.string())
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join(
        pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_buffer().to_pybytes()
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    ends = starts + size
    count = np.bincount(owner, minlength=n)
    first = np.cumsum(count) - count
    made = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    begin = np.cumsum(made) - made
    own = np.repeat(np.arange(n), made)
    at = first[own] + np.arange(int(made.sum())) - begin[own]
    to = at + np.minimum(shingle, count[own]) - 1
    cut = map(joined.__getitem__, map(slice, starts[at].tolist(), ends[to].tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, len(at))
    as_bytes = hashes.view(np.uint8).reshape(-1, 8)
    step = 1 << 16
    total = np.zeros((n, BITS), np.int32)
    for i in range(0, len(hashes), step):
        part = np.unpackbits(as_bytes[i:i + step], axis=1, bitorder="little")
        ids = own[i:i + step]
        cuts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
        total[ids[cuts]] += np.add.reduceat(part, cuts, axis=0, dtype=np.int32)
    bits = total * 2 > made[:, None]
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view(np.uint64)


def with_fingerprint(docs: DataFrame, carry: list[str], shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """``carry`` columns and ``_fp`` (the 64 bits as a bigint); one row in, one row out, no shuffle."""
    given = docs.select(*dict.fromkeys([*carry, text]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*carry).schema.fields),
                        "`_fp` bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, text):
            found = fingerprints(common.texts_of(part, text), shingle)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(found.view(np.int64))],
                                             names=[*carry, "_fp"])

    return given.mapInArrow(run, schema)


def block_widths(distance: int) -> list[int]:
    """Widths of ``distance + 1`` blocks that together hold all bits."""
    parts = distance + 1
    return [BITS // parts + (i < BITS % parts) for i in range(parts)]


def trie_links(keys: np.ndarray, width: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of sorted distinct ``keys`` with equal leading ``width`` bits and few differing bits.

    A node is a range of the sorted keys; a frontier holds pairs of nodes of one level and their differing bits.
    """
    block = keys >> np.uint64(BITS - width)
    edge = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(keys)]])
    some = np.diff(edge) > 1
    a0, a1 = edge[:-1][some], edge[1:][some]
    b0, b1, wrong = a0, a1, np.zeros(len(a0), np.int8)
    left, right = [], []
    for depth in range(width, BITS):
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():  # two single keys: what is left of the walk is one comparison
            x, y = a0[leaf], b0[leaf]
            near = (np.bitwise_count(keys[x] ^ keys[y]) <= distance) & (x != y)
            left.append(x[near])
            right.append(y[near])
            a0, a1, b0, b1, wrong = (v[~leaf] for v in (a0, a1, b0, b1, wrong))
        if not len(a0):
            break
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        ones = np.concatenate([[0], np.cumsum((keys & bit) != 0)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        kids = [(a0, am, b0, bm, wrong), (am, a1, bm, b1, wrong), (a0, am, bm, b1, wrong + 1),
                (am[~same], a1[~same], b0[~same], bm[~same], wrong[~same] + 1)]
        a0, a1, b0, b1, wrong = (np.concatenate(v) for v in zip(*kids))
        live = (a1 > a0) & (b1 > b0) & (wrong <= distance) & ~((a1 - a0 == 1) & (a0 == b0) & (b1 == a1))
        a0, a1, b0, b1, wrong = (v[live] for v in (a0, a1, b0, b1, wrong))
    if len(a0):  # all bits read: both nodes are single keys
        left.append(a0[a0 != b0])
        right.append(b0[a0 != b0])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` places the smallest place its links reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def near_pairs(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links ``(a, b)``, a > b, between distinct fingerprints: a forest of the links of each task and rotation."""
    spark = prints.sparkSession
    widths = block_widths(distance)
    turns = [sum(widths[:i]) for i in range(len(widths))]
    turned = prints.select(F.explode(F.array(*(
        F.struct(F.lit(i).alias("turn"),
                 (F.shiftleft("fp", t).bitwiseOR(F.shiftrightunsigned("fp", BITS - t)) if t else F.col("fp")).alias("key"),
                 ) for i, t in enumerate(turns)))).alias("x")).select("x.*")
    block = F.shiftrightunsigned("key", BITS - min(widths))
    rows = prints.count() * len(widths)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)) for b in batches if b.num_rows]
        if not got:
            return
        turn, key = (np.concatenate(v) for v in zip(*got))
        for i, (width, by) in enumerate(zip(widths, turns)):
            keys = np.unique(key[turn == i])
            for piece in pieces(keys, width):
                a, b = trie_links(piece, width, distance)
                if not len(a):
                    continue
                root = forest(a, b, len(piece))
                child = np.flatnonzero(root != np.arange(len(piece)))
                plain = (piece >> np.uint64(by)) | (piece << np.uint64(BITS - by)) if by else piece
                x, y = plain[child].view(np.int64), plain[root[child]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))],
                                                 names=["a", "b"])

    return turned.repartition(tasks, "turn", block).mapInArrow(run, "a bigint, b bigint")


def pieces(keys: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Runs of sorted keys of about ``PIECE``, never cut inside a block."""
    at = 0
    while at < len(keys):
        end = min(at + PIECE, len(keys))
        if end < len(keys):
            block = keys >> np.uint64(BITS - width)
            end = int(np.searchsorted(block, block[end - 1], side="right"))
        yield keys[at:end]
        at = end


def groups(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the links: the smallest node it reaches.

    Each round hangs larger neighbours, then all of a node's smaller side, on the smallest one it knows. Minima are
    taken by partial aggregation, so a node with very many links is no unbounded group.
    """
    edges = written(links.distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        new = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))).distinct()
        edges = written(new, "links")
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"groups did not settle in {rounds} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def with_group(thin: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Rows with ``_fp`` get ``_root``: the fingerprint that stands for their group."""
    prints = thin.select(F.col("_fp").alias("fp")).distinct()
    roots = groups(near_pairs(prints, distance))
    return thin.join(roots.select(F.col("node").alias("_fp"), F.col("root").alias("_found")), "_fp", "left").withColumn(
        "_root", F.coalesce("_found", "_fp")).drop("_found")


def components(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id``, ``_fp`` and ``component_id``: the smallest id among all rows that links reach."""
    thin = written(with_fingerprint(docs, ["doc_id"], shingle), "prints")
    prints = thin.groupBy("_fp").agg(F.min("doc_id").alias("low"))
    roots = groups(near_pairs(prints.select(F.col("_fp").alias("fp")), distance))
    known = prints.join(roots, prints["_fp"] == roots["node"], "left").select(
        "_fp", "low", F.coalesce("root", "_fp").alias("root"))
    least = known.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = known.join(least, "root").select("_fp", "component_id")
    return thin.join(labels, "_fp", "left")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each group, with all its columns: the smallest id (nulls last), ties by the rest of the row.

    Chosen on a thin table of ids and row digests; whole rows meet the chosen keys once, rows that share a chosen key
    are equal in every column and one of them stays.
    """
    plain, names = common.neutral(docs)
    digest = F.sha2(F.to_json(F.struct(*plain.columns), {"ignoreNullFields": "false"}), 256)
    marked = plain.withColumn("_digest", digest)
    thin = written(with_fingerprint(marked, [names["doc_id"], "_digest"], shingle, names["text"]), "prints")
    doc_id = F.col(names["doc_id"])
    chosen = with_group(thin, distance).groupBy("_root").agg(
        F.min(F.struct(doc_id.isNull().alias("last"), doc_id.alias("id"), "_digest")).alias("k")).select("k._digest")
    kept = marked.join(chosen, "_digest", "left_semi")
    return kept.dropDuplicates(["_digest"]).select(*plain.columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")
