"""Quality classifier: Naive Bayes support vectors.

A text is a set of n-gram indicators: byte n-grams of one to three, and n-grams of the flag "this word stood before in
the text" in runs of doubling length. Over all labelled training rows the indicators' class log-count ratios are taken;
they scale the indicators, each row is brought to length one, and a linear hinge-loss model is fitted to a bounded sample
of the rows by dual coordinate descent. A sigmoid over margins of rows that a half model has not seen turns margins into
scores.

Texts are read once: their indicator sets are stored (about a byte for each indicator) and serve training and scoring.

Defined results: a null or empty text has the one indicator "empty"; rows without an id are scored but never learned
from; of several labels for one id the largest counts, labels other than 0 and 1 are ignored; without labels of both
classes every score is the share of label 1 (0.5 without labels); an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm import common
from rankforge.session import written

#: Indicators are hashed to so many numbers; the last ones are kept for runs of repeated words and empty texts.
BUCKETS = 1 << 16
RUNS = tuple(1 << i for i in range(2, 12))
HASHED = BUCKETS - len(RUNS) - 1
EMPTY = BUCKETS - 1
#: The model is fitted to at most so many rows of each class, those with the smallest hash of their id.
SAMPLE_PER_CLASS = 1500
SMOOTHING, COST, EPOCHS, SEED = 1.0, 1.0, 40, 5
THRESHOLD = 0.7


def indicator_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted indicator numbers of each text."""
    raw, ends = common.offsets_of(texts)
    one = raw.astype(np.uint32)
    two = (one[1:] << 8 | one[:-1]) if len(one) > 1 else one[:0]
    three = (two[1:] << 8 | one[:-2]) if len(one) > 2 else one[:0]
    codes = [(c * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF) >> np.uint32(7)) % np.uint32(HASHED)
             for n, c in enumerate((one, two, three), start=1)]
    runs = longest_seen_runs(texts)
    flags = np.zeros(BUCKETS, bool)
    out = []
    for i in range(len(texts)):
        begin, end = ends[i], ends[i + 1]
        if begin == end:
            out.append(np.array([EMPTY], np.uint16))
            continue
        for n, code in enumerate(codes, start=1):
            flags[code[begin:max(begin, end - n + 1)]] = True
        for k, length in enumerate(RUNS):
            if runs[i] >= length:
                flags[HASHED + k] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        out.append(found.astype(np.uint16))
    return out


def packed(found: np.ndarray) -> bytes:
    """Sorted numbers as the gaps between them, a byte each; 255 adds to the gap that follows."""
    gaps = np.diff(found.astype(np.int64), prepend=-1) - 1
    many, rest = gaps // 255, (gaps % 255).astype(np.uint8)
    out = np.full(int(many.sum()) + len(gaps), 255, np.uint8)
    out[np.cumsum(many + 1) - 1] = rest
    return out.tobytes()


def unpacked(raw: bytes | pa.Buffer) -> np.ndarray:
    """The numbers that :func:`packed` wrote."""
    steps = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(steps != 255)
    return np.cumsum(steps, dtype=np.int64)[ends] + np.arange(len(ends))


def longest_seen_runs(texts: pa.Array) -> np.ndarray:
    """The longest run of words that all stood before in their text."""
    words, owner = common.word_arrays(texts)
    out = np.zeros(len(texts), np.int64)
    if not len(words):
        return out
    coded = words.dictionary_encode()
    key = owner.astype(np.int64) * len(coded.dictionary) + coded.indices.to_numpy()
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    # Every text begins with a new word, so a run never passes from one text into the next.
    begin = np.flatnonzero(first)
    np.maximum.at(out, owner[begin], np.diff(np.append(begin, len(key))) - 1)
    return out


def with_indicators(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """``carry`` and ``_set`` (the indicator numbers, packed); one row in, one row out."""
    given = docs.select(*dict.fromkeys([*carry, text]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*carry).schema.fields),
                        "_set binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, text):
            sets = [packed(s) for s in indicator_sets(common.texts_of(part, text))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(sets, pa.binary())],
                                             names=[*carry, "_set"])

    return given.mapInArrow(run, schema)


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each class, and for each class how many rows have each indicator; over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        total = np.zeros(2, np.int64)
        for batch in batches:
            for label, raw in zip(batch.column("label").to_pylist(), batch.column("_set").to_pylist()):
                counts[label, unpacked(raw)] += 1
                total[label] += 1
        at = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[0, at], total[0])),
                                          pa.array(np.append(counts[1, at], total[1]))], names=["at", "n0", "n1"])

    summed = rows.mapInArrow(run, "at bigint, n0 bigint, n1 bigint").groupBy("at").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    got = summed.toArrow()  # at most one row for each indicator number
    at, by = got["at"].to_numpy(), np.stack([got["n0"].to_numpy(), got["n1"].to_numpy()])
    counts = np.zeros((2, BUCKETS))
    counts[:, at[at >= 0]] = by[:, at >= 0]
    total = by[:, at < 0].sum(axis=1) if (at < 0).any() else np.zeros(2)
    return total.astype(float), counts


def log_count_ratios(counts: np.ndarray) -> np.ndarray:
    smooth = counts + SMOOTHING
    share = smooth / smooth.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def hinge_by_dual_descent(sets: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray,
                          cost: np.ndarray) -> np.ndarray:
    """Weights (the bias last) of the linear hinge-loss model, by dual coordinate descent."""
    weights = np.zeros(BUCKETS + 1)
    alpha = np.zeros(len(sets))
    norm = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        worst = 0.0
        for i in rng.permutation(len(sets)):
            x, v, y = sets[i], values[i], signs[i]
            gradient = y * (weights[x] @ v + weights[-1]) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                worst = max(worst, abs(step))
                alpha[i] = new
                weights[x] += step * y * v
                weights[-1] += step * y
        if worst < 1e-3:
            break
    return weights


def scaled(found: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Indicators scaled by the ratios, as a vector of length one."""
    values = ratios[found]
    length = np.sqrt(values @ values)
    return values / length if length else values


def sigmoid_fit(margins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the score over the margin, by Newton steps on the weighted log loss."""
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - label)) + 1e-3 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit_sample(labels: np.ndarray, sets: list[np.ndarray], ratios: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Weights scaled back to the indicators, then slope and offset of the score."""
    values = [scaled(s, ratios) for s in sets]
    signs = labels * 2.0 - 1.0
    share = np.array([(labels == 0).sum(), (labels == 1).sum()]) / len(labels)
    cost = COST * 0.5 / share[labels]
    half = np.arange(len(labels)) % 2
    margins = np.zeros(len(labels))
    for side in (0, 1):
        train, rest = np.flatnonzero(half != side), np.flatnonzero(half == side)
        w = hinge_by_dual_descent([sets[i] for i in train], [values[i] for i in train], signs[train], cost[train])
        margins[rest] = [w[sets[i]] @ values[i] + w[-1] for i in rest]
    weight = (total / np.maximum(1, np.bincount(labels, minlength=2)))[labels]
    slope, offset = sigmoid_fit(margins, labels.astype(float), weight / weight.sum() * len(labels))
    return np.append(hinge_by_dual_descent(sets, values, signs, cost), [slope, offset])


def smallest_hashes(rows: DataFrame, total: int) -> DataFrame:
    """The ``SAMPLE_PER_CLASS`` rows with the smallest hash of their id.

    A bound on the hash that about four times as many rows pass comes first, so that what meets in one task does not
    grow with the input. Where ids repeat so much that too few rows pass it, all rows are candidates.
    """
    share = min(1.0, 4 * SAMPLE_PER_CLASS / total)
    key = F.xxhash64("doc_id")
    some = rows.where(key <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 2048))))
    if some.count() < min(SAMPLE_PER_CLASS, total):
        some = rows
    return some.orderBy(key, "doc_id", "_set").limit(SAMPLE_PER_CLASS)


def train(rows: DataFrame) -> tuple[np.ndarray, np.ndarray] | float:
    """Ratios and model from ``doc_id``, ``label`` (0 or 1) and ``_set``; a plain share if a class is missing."""
    total, counts = class_counts(rows)
    if not total.all():
        return float(total[1] / total.sum()) if total.sum() else 0.5
    ratios = log_count_ratios(counts)
    picked = None
    for label in (0, 1):
        part = smallest_hashes(rows.where(F.col("label") == label), int(total[label]))
        picked = part if picked is None else picked.unionByName(part)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in zip(b.column("key").to_pylist(), b.column("label").to_pylist(),
                                                b.column("_set").to_pylist())]
        held.sort()
        labels = np.array([x[1] for x in held], np.int64)
        model = fit_sample(labels, [unpacked(x[2]) for x in held], ratios, total)
        yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()], pa.binary())], names=["model"])

    sample = picked.select(F.xxhash64("doc_id").alias("key"), "label", "_set").coalesce(1)
    return ratios, np.frombuffer(sample.mapInArrow(fit, "model binary").first()["model"])


def score(rows: DataFrame, model: tuple[np.ndarray, np.ndarray] | float, carry: list[str]) -> DataFrame:
    """``carry`` and ``score`` from ``_set``."""
    if isinstance(model, float):
        return rows.select(*carry, F.lit(model).alias("score"))
    ratios, fitted = model
    weights, bias, slope, offset = fitted[:BUCKETS] * ratios, fitted[BUCKETS], fitted[-2], fitted[-1]
    squares = ratios * ratios
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*carry).schema.fields),
                        "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = np.zeros(batch.num_rows)
            for i, raw in enumerate(batch.column("_set")):
                found = unpacked(raw.as_buffer())
                margins[i] = weights[found].sum() / max(np.sqrt(squares[found].sum()), 1e-300) + bias
            scores = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(scores)],
                                             names=[*carry, "score"])

    return rows.select(*carry, "_set").mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    sets = written(with_indicators(docs, ["doc_id"]).withColumn("held_out", held_out(F.col("doc_id"))), "indicators")
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("label"))
    rows = sets.where(~F.col("held_out")).join(known, "doc_id").select("doc_id", "label", "_set")
    scored = score(sets, train(written(rows, "labelled")), ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
