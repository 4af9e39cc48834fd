"""Secret scans: fixed patterns, and Markov models of characters compared by their log-likelihood ratio.

Two first-order models over the characters of identifiers are trained: one on random strings (the values that the fixed
patterns find in the corpus, and a seeded labelled sample of random strings over usual alphabets), one on ordinary
identifiers (every other run of such characters in the corpus). What fixed patterns leave of a run of such characters is
reported with kind ``markov`` if the first model explains it better by far; else the segments of it are that it explains
better, so that a random value is found behind an ordinary name or path.

Counts are taken over all texts, per task first; what reaches the driver is one table of character pairs.

Defined results: a null or empty text has no spans; repeated rows get equal results; a null id stays null; an empty
table gives no rows (the models then rest on the sample alone); further columns are carried by ``redact``.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm import common

KINDS = ("assign", "access", "hex")
#: Fixed patterns and the least length of what they must hold.
PATTERNS = {
    "assign": (re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                          re.IGNORECASE), 2, 8),
    "access": (re.compile(rb"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(rb"[0-9a-f]+"), 0, 32),
}
#: Texts without a match of this have no match of the patterns.
HINT = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{32}"

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
N = len(ALPHABET) + 1
CODE = np.zeros(256, np.int64)
CODE[list(ALPHABET)] = np.arange(1, N)
IS_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
IS_LETTER = np.isin(np.arange(256), list(range(65, 91)) + list(range(97, 123)))

#: Runs shorter than this are not judged; the ratio (nats) that a run must reach, in all and for each character.
MIN_LENGTH, MIN_RATIO, MIN_RATIO_PER_CHAR = 20, 16.0, 2.75
#: Characters that may end a name or a value inside a run, and how far a segment's ratio may fall before it ends.
IS_MARK = np.isin(np.arange(256), list(b"+/_=-"))
MAX_FALL = 8.0
#: Weight of the characters' own frequencies among those after each character, in counts.
BACK_OFF = 20.0
#: The labelled sample: random strings of each of these alphabets, and their lengths.
SAMPLE_SIZE, SAMPLE_LENGTHS, SEED = 400, (20, 64), 7
SAMPLE_ALPHABETS = (b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:64],
                    ALPHABET[:62], b"abcdefghijklmnopqrstuvwxyz0123456789")


def base_spans(raw: bytes) -> list[tuple[int, int, int, bytes]]:
    """``(start, kind number, end, value)`` in bytes, by start, then kind."""
    out = []
    for number, kind in enumerate(KINDS):
        pattern, group, least = PATTERNS[kind]
        out += [(m.start(), number, m.end(), m[group]) for m in pattern.finditer(raw) if len(m[group]) >= least]
    return sorted(out)


def pair_counts(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Counts of (character before or 0, character) over all runs; ``starts`` marks where a text begins."""
    before = np.concatenate([[0], codes[:-1]])
    before[starts] = 0
    return np.bincount((before * N + codes)[codes > 0], minlength=N * N)


def value_pairs(values: list[bytes]) -> np.ndarray:
    if not values:
        return np.zeros(N * N, np.int64)
    raw = np.frombuffer(b" ".join(values), np.uint8)
    return pair_counts(CODE[raw], np.zeros(1, np.int64))


def random_sample() -> list[bytes]:
    rng = random.Random(SEED)
    return [bytes(rng.choices(a, k=rng.randint(*SAMPLE_LENGTHS))) for a in SAMPLE_ALPHABETS for _ in range(SAMPLE_SIZE)]


def hinted(texts: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.match_substring_regex(texts, HINT).to_numpy(zero_copy_only=False))


def count_pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(random, pair, n)``: character pairs of the found secrets and of all other identifiers, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = np.zeros(N * N, np.int64), np.zeros(N * N, np.int64)
        for part in common.slices(batches, text):
            texts = common.texts_of(part, text)
            raw, ends = common.offsets_of(texts)
            if not len(raw):
                continue
            total += pair_counts(CODE[raw], ends[:-1][ends[:-1] < len(raw)])
            found += value_pairs([s[3] for i in hinted(texts) for s in base_spans(texts[i].as_buffer().to_pybytes())])
        for label, counts in ((1, found), (0, np.maximum(total - found, 0))):
            pair = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pair), label, np.int32)), pa.array(pair.astype(np.int32)),
                 pa.array(counts[pair])], names=["random", "pair", "n"])

    each = docs.select(text).mapInArrow(run, "random int, pair int, n bigint")
    return each.groupBy("random", "pair").agg(F.sum("n").alias("n"))


def ratio_table(rows: list) -> np.ndarray:
    """Log-likelihood ratios of each character after each other: random over ordinary."""
    counts = np.zeros((2, N * N))
    for row in rows:
        counts[row["random"], row["pair"]] = row["n"]
    sample = value_pairs(random_sample()).astype(float)
    found = counts[1].sum()
    # What the corpus gave and the sample weigh alike, whatever the size of the corpus.
    counts[1] = sample + (counts[1] * sample.sum() / found if found else 0)
    tables = []
    for each in counts:
        each = each.reshape(N, N)[:, 1:]
        alone = (each.sum(axis=0) + 0.5) / (each.sum() + 0.5 * (N - 1))
        # A rare character before falls back on the characters' own frequencies.
        tables.append(np.log((each + BACK_OFF * alone) / (each.sum(axis=1, keepdims=True) + BACK_OFF)))
    out = np.zeros((N, N))
    out[:, 1:] = tables[1] - tables[0]
    return out


def train(docs: DataFrame, text: str = "text") -> np.ndarray:
    return ratio_table(count_pairs(docs, text).collect())


def unlikely_runs(raw: np.ndarray, ends: np.ndarray, ratios: np.ndarray,
                  taken: list[tuple[int, int]] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes), outside ``taken``, of what the model of random strings explains better."""
    codes = CODE[raw]
    for a, b in taken:
        codes[a:b] = 0
    inside = codes > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    texts = ends[:-1][ends[:-1] < len(raw)]
    begins[texts] = inside[texts]
    start = np.flatnonzero(begins)
    if not len(start):
        return start, start
    stop = np.append(start[1:], len(raw))
    gap = np.flatnonzero(~inside)
    at = np.searchsorted(gap, start)
    stop = np.minimum(stop, np.append(gap, len(raw))[at])
    long = stop - start >= MIN_LENGTH
    found = [(a + x, a + y) for a, b in zip(start[long].tolist(), stop[long].tolist())
             for x, y in unlikely_parts(raw[a:b], codes[a:b], ratios)]
    return np.array([a for a, _ in found], np.int64), np.array([b for _, b in found], np.int64)


def mixed(raw: np.ndarray) -> bool:
    return len(raw) >= MIN_LENGTH and bool(IS_DIGIT[raw].any() and IS_LETTER[raw].any())


def unlikely_parts(raw: np.ndarray, codes: np.ndarray, ratios: np.ndarray) -> list[tuple[int, int]]:
    """The whole run if it reaches the ratio, else its segments that do."""
    if not mixed(raw):
        return []
    each = ratios[np.concatenate([[0], codes[:-1]]), codes]
    if each.sum() >= max(MIN_RATIO, MIN_RATIO_PER_CHAR * len(raw)):
        return [(0, len(raw))]
    total = np.concatenate([[0.0], np.cumsum(each)])
    least = max(MIN_RATIO, MIN_RATIO_PER_CHAR * MIN_LENGTH)
    if (total - np.minimum.accumulate(total)).max() < least:
        return []
    out, at, n = [], 0, len(raw)
    over = (each - MIN_RATIO_PER_CHAR).tolist()
    while at < n:
        if over[at] <= 0:
            at += 1
            continue
        run, best, end, i = 0.0, 0.0, at, at
        while i < n:
            run += over[i]
            i += 1
            if run > best:
                best, end = run, i
            elif run <= 0 or run < best - MAX_FALL:
                break
        a, b = widened(total, at, end, raw, out[-1][1] if out else 0)
        if total[b] - total[a] >= least and mixed(raw[a:b]):
            out.append((a, b))
            at = max(b, end)
        else:
            at = end
    return out


def widened(total: np.ndarray, a: int, b: int, raw: np.ndarray, low: int) -> tuple[int, int]:
    """A segment with the neighbours that raise its ratio, then whole up to the marks around it."""
    i = best = b
    while i < len(raw) and total[i] > total[best] - MAX_FALL:
        i += 1
        best = i if total[i] > total[best] else best
    b = best
    i = best = a
    while i > low and total[i] < total[best] + MAX_FALL:
        i -= 1
        best = i if total[i] < total[best] else best
    a = best
    while a < b and IS_MARK[raw[a]]:
        a += 1
    while a > low and not IS_MARK[raw[a - 1]]:
        a -= 1
    while b < len(raw) and not IS_MARK[raw[b]] and not IS_MARK[raw[b - 1]]:
        b += 1
    return a, b


def _ratio(codes: np.ndarray, ratios: np.ndarray) -> float:
    return float(ratios[np.concatenate([[0], codes[:-1]]), codes].sum())


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(docs: DataFrame, ratios: np.ndarray, carry: list[str], text: str = "text") -> DataFrame:
    """``carry`` and ``_spans``: (kind, start, end) in code points, by start, then kind; no shuffle."""
    given = docs.select(*dict.fromkeys([*carry, text]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*carry).schema.fields),
                        "_spans array<struct<kind:string,start:int,end:int>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, text):
            texts = common.texts_of(part, text)
            raw, ends = common.offsets_of(texts)
            found: dict[int, list[tuple[int, int, int]]] = {}
            for i in hinted(texts):
                found[int(i)] = [s[:3] for s in base_spans(texts[int(i)].as_buffer().to_pybytes())]
            if len(raw):
                taken = [(int(ends[doc]) + a, int(ends[doc]) + b) for doc, each in found.items() for a, _, b in each]
                starts, stops = unlikely_runs(raw, ends, ratios, taken)
                for a, b, doc in zip(starts.tolist(), stops.tolist(),
                                     (np.searchsorted(ends, starts, side="right") - 1).tolist()):
                    found.setdefault(doc, []).append((a - int(ends[doc]), len(KINDS), b - int(ends[doc])))
            spans = [[]] * len(texts)
            for doc, each in found.items():
                points = code_points(raw[ends[doc]:ends[doc + 1]])
                spans[doc] = [{"kind": (*KINDS, "markov")[k], "start": int(points[a]), "end": int(points[b])}
                              for a, k, b in sorted(each)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(spans, SPANS)],
                                             names=[*carry, "_spans"])

    return given.mapInArrow(run, schema)


def code_points(raw: np.ndarray) -> np.ndarray:
    """For each byte place (and the end) the number of code points before it."""
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])


def redacted(text: str, spans: list[dict], mark: str) -> str:
    out, at = [], 0
    for span in spans:
        if span["start"] >= at:
            out += [text[at:span["start"]], mark]
        at = max(at, span["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, ratios: np.ndarray, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns; found spans are replaced by a mark."""
    plain, names = common.neutral(docs)
    text = names[text]
    schema = plain.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = schema.names.index(text)
        for part in common.slices(batches, text):
            spans = part.column("_spans").to_pylist()
            columns = [part.column(c) for c in schema.names]
            if any(spans):
                columns[at] = pa.array([redacted(t, s, mark) if s else t
                                        for t, s in zip(columns[at].to_pylist(), spans)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return find_secrets(plain, ratios, plain.columns, text).mapInArrow(run, schema).toDF(*docs.columns)


def joined(spans) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = find_secrets(docs, train(docs), ["doc_id"])
    kinds = F.transform("_spans", lambda s: s["kind"])
    count = {k: F.size(F.filter(kinds, lambda x: x == F.lit(k))).cast("bigint") for k in KINDS}  # noqa: B023
    return found.select(
        "doc_id", *(count[k].alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.filter("_spans", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"),
        joined(F.col("_spans")).alias("spans"))
