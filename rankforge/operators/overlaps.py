"""Bit overlaps and cosines of many rows with many others as matrix products, inside Arrow functions.

For every bit there is a list of the right-hand rows that have it; a left-hand row adds up the lists of its own bits and so
gets its overlap with all of them at once. No pair is a row of a table before it has passed its threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Rows whose bits are unpacked at once.
STRIP = 1024
#: Right-hand rows that are sent to the tasks at once.
PASS_ROWS = 16_384


def passes_of(queries: DataFrame, key: str) -> Iterator[pa.Table]:
    """The query table in parts of about ``PASS_ROWS`` rows, dealt by hash of ``key``."""
    parts = max(1, -(-queries.count() // PASS_ROWS))
    for i in range(parts):
        yield queries.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i).toArrow()


def with_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that have a fingerprint."""
    for batch in batches:
        there = batch.filter(pc.is_valid(batch.column("n")))
        if there.num_rows:
            yield there


def words_of(table: pa.RecordBatch | pa.Table, columns: list[str]) -> np.ndarray:
    """Packed bits, a row for a row."""
    return np.stack([np.asarray(table.column(c).to_numpy()) for c in columns], axis=1).view(np.uint64)


def bits_of(words: np.ndarray) -> np.ndarray:
    """A row of zeros and ones for every row of packed bits."""
    plain = np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1)
    return np.unpackbits(plain, axis=1, bitorder="little").astype(np.float32)


def tanimoto_matrix(shared: np.ndarray, left_n: np.ndarray, right_n: np.ndarray) -> np.ndarray:
    """Shared bits over all bits; 0 where both sides are empty."""
    shared = shared.astype(np.float64)
    union = left_n[:, None] + right_n[None, :] - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)


def tanimoto_to(word_row: np.ndarray, n: int, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Similarity of one packed row to many."""
    shared = np.bitwise_count(words & word_row).sum(axis=1, dtype=np.int64)
    union = sizes + n - shared
    return np.divide(shared, union, out=np.zeros(len(words)), where=union > 0)


class Sized:
    """Packed rows sorted by their number of bits, so that those of similar sizes are one range."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.argsort(sizes, kind="stable")
        self.words, self.sizes = words[self.order], sizes[self.order]

    def between(self, low: float, high: float) -> slice:
        return slice(int(np.searchsorted(self.sizes, low)), int(np.searchsorted(self.sizes, high, side="right")))


def near(left: Sized, right: Sized, threshold: float, strict: bool = False,
         ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places on both sides and similarity of all pairs that reach the threshold (``strict``: exceed it), strip by strip.

    Sets of similarity t have sizes within a factor t, so a strip only meets the rows of such sizes; they share at least
    t / (1 + t) of the sum of their sizes, so only such pairs are divided.
    """
    share = np.float32(max(threshold, 0) / (1 + max(threshold, 0)))
    unpacked = bits_of(right.words) if len(right.sizes) <= 16 * STRIP else None
    for at in range(0, len(left.sizes), STRIP):
        sizes, bits = left.sizes[at:at + STRIP], bits_of(left.words[at:at + STRIP])
        there = right.between(np.floor(threshold * sizes[0]), np.ceil(sizes[-1] / threshold))
        for start in range(there.start, there.stop, 8 * STRIP):
            some = slice(start, min(start + 8 * STRIP, there.stop))
            shared = bits @ (bits_of(right.words[some]) if unpacked is None else unpacked[some]).T
            # Less a little, for the rounding of the bound.
            least = (share * sizes - np.float32(0.01)).astype(np.float32)[:, None] + (share * right.sizes[some]).astype(np.float32)
            x, y = np.nonzero(shared >= least)
            both = shared[x, y].astype(np.float64)
            union = sizes[x] + right.sizes[some][y] - both
            found = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
            good = found > threshold if strict else found >= threshold
            x, y, found = x[good], y[good], found[good]
            if len(x):
                yield left.order[at + x], right.order[some][y], found


class TopHits:
    """The best hits of each query over all rows met so far, ties in key order; ``threshold`` may be one for each query."""

    def __init__(self, queries: int, k: int, threshold: float | np.ndarray = -np.inf) -> None:
        self.k = k
        #: What a similarity must reach to matter, for each query.
        self.bars = np.array(np.broadcast_to(threshold, queries), float)
        self.best: list[list[tuple]] = [[] for _ in range(queries)]

    def add(self, query: int, found: np.ndarray, keys: pa.Array, rank: np.ndarray, places: np.ndarray) -> None:
        """Hits of one query: similarities, and the places of their rows; ``rank`` is the place of each key in order."""
        good = np.flatnonzero(found >= self.bars[query])
        if not len(good):
            return
        if len(good) > self.k:
            least = np.partition(found[good], -self.k)[-self.k]
            good = good[found[good] >= least]
            good = good[np.lexsort((rank[places[good]], -found[good]))[:self.k]]
        new = [(float(s), key) for s, key in zip(found[good], keys.take(pa.array(places[good])).to_pylist())]
        best = sorted(self.best[query] + new, key=lambda h: (-h[0], h[1] is None, h[1]))[:self.k]
        self.best[query] = best
        if len(best) == self.k:
            self.bars[query] = max(self.bars[query], best[-1][0])


def key_rank(keys: pa.Array) -> np.ndarray:
    order = pc.array_sort_indices(keys).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank


def bounded_search(words: np.ndarray, sizes: np.ndarray, keys: pa.Array, asked: np.ndarray, asked_n: np.ndarray,
                   hits: TopHits, edges: list[int]) -> int:
    """Add the best rows of every query to ``hits``; returns how many (query, size class) were visited.

    A query takes the classes of row sizes in falling order of the best similarity that their sizes allow (smaller over
    larger), and ends once its k-th hit is better than the next class allows.
    """
    rank = key_rank(keys)
    rows = Sized(words, sizes)
    starts = np.searchsorted(rows.sizes, edges)
    classes = [(a, b) for a, b in zip(starts, [*starts[1:], len(rows.sizes)]) if b > a]
    if not classes:
        return 0
    low = np.array([rows.sizes[a] for a, _ in classes], float)
    high = np.array([rows.sizes[b - 1] for _, b in classes], float)
    n = asked_n[:, None].astype(float)
    bound = np.where(n < low, n / low, np.where(n > high, high / np.maximum(n, 1), 1.0))
    turn = np.argsort(-bound, axis=1, kind="stable")
    open_queries, visited = np.arange(len(asked)), 0
    for step in range(len(classes)):
        here = turn[open_queries, step]
        allowed = bound[open_queries, here]
        bars = hits.bars[open_queries]
        # A class may hold nothing better than the threshold or the k-th hit; later classes allow less.
        going = (allowed >= bars) & (allowed > 0)
        open_queries, here = open_queries[going], here[going]
        visited += len(open_queries)
        for c in np.unique(here):
            some = open_queries[here == c]
            right = bits_of(asked[some]).T
            for a in range(*classes[c], 8 * STRIP):
                part = slice(a, min(a + 8 * STRIP, classes[c][1]))
                found = tanimoto_matrix(bits_of(rows.words[part]) @ right, rows.sizes[part], asked_n[some])
                for column in np.flatnonzero(found.max(axis=0, initial=-np.inf) >= hits.bars[some]):
                    hits.add(some[column], found[:, column], keys, rank, rows.order[part])
        if not len(open_queries):
            break
    return visited


def emitted(hits: TopHits, names: list[pa.Array], kinds: list[pa.DataType], columns: list[str]) -> pa.RecordBatch:
    """All hits: the query's own columns, the row's key, the similarity."""
    count = [len(best) for best in hits.best]
    owner = pa.array(np.repeat(np.arange(len(count)), count))
    flat = [hit for best in hits.best for hit in best]
    return pa.RecordBatch.from_arrays(
        [*(name.take(owner) for name in names), pa.array([h[1] for h in flat], kinds[0]),
         pa.array([h[0] for h in flat], pa.float64())], names=columns)


def whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def map_passes(rows: DataFrame, queries: DataFrame, key: str,
               search: Callable[[pa.Table], Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]],
               schema: str) -> DataFrame:
    """``rows.mapInArrow`` once for each pass of the queries; ``search`` makes its function from the queries' table."""
    found = None
    for asked in passes_of(queries, key):
        part = rows.mapInArrow(search(asked), schema)
        found = part if found is None else found.unionByName(part)
    return found
