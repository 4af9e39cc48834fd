"""Benchmark decontamination with an FM-index per training shard.

Each slice of documents is a shard. Its words are coded by the vocabulary of the test phrases; words that no phrase
uses become breaks, and runs of words shorter than the shortest phrase are left out, since no phrase fits in them. Over
the rest a suffix array gives the Burrows-Wheeler transform, which is kept as a wavelet matrix with rank counts. All
phrases are searched backward at once; occurrences are located by walking to the nearest sampled suffix position, and
their spans are merged.

The phrases come to every task in blocks of at most ``BLOCK_BYTES`` of benchmark words, a bound that is measured; a
larger benchmark takes several passes over the documents, whose spans are merged afterwards.

Defined results: a null or empty text, or one without words, has no hit and stays; an item without words has no window
and never occurs; a null item id is left out of the digest but counts; repeated items and rows are judged each for
itself (equal item ids count once); empty tables give no rows or no hits; further columns are carried by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from rankforge.llm import common
from rankforge.llm.suffixes import suffix_ranks
from rankforge.session import written

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Every so many text positions the suffix array is kept.
SAMPLE = 16
#: Benchmark words sent to a task at once, in bytes.
BLOCK_BYTES = 32 << 20

#: Word bytes (ASCII letters lowered, digits, all bytes beyond ASCII); every other byte becomes a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                   for c in range(256))
IS_WORD = np.frombuffer(WORD_BYTES, np.uint8) != 32


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


class Phrases:
    """Windows of benchmark items, coded and deduplicated, and the items each belongs to."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int) -> None:
        self.code: dict[bytes, int] = {}
        self.items: list[int | None] = []
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, words in items:
            if not words:
                continue
            self.items.append(item)
            codes = [self.code.setdefault(w, len(self.code) + 1) for w in words]
            for i in range(max(1, len(codes) - window + 1)):
                owners.setdefault(tuple(codes[i:i + window]), set()).add(len(self.items) - 1)
        self.owners = [sorted(v) for v in owners.values()]
        self.length = np.array([len(k) for k in owners], np.int64)
        self.shortest = int(self.length.min()) if len(owners) else 0
        self.codes = np.zeros((len(owners), window), np.int64)
        for row, key in enumerate(owners):  # right-aligned, as the search goes backward
            self.codes[row, window - len(key):] = key


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector with counts for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.ones, self.zeros = bits, [], []
        for bit in range(bits - 1, -1, -1):
            plane = (symbols >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(plane)]).astype(np.int32))
            self.zeros.append(int(len(plane) - plane.sum()))
            symbols = np.concatenate([symbols[plane == 0], symbols[plane == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        begin = np.zeros_like(at)
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            ones, zeros = self.ones[level], self.zeros[level]
            begin = np.where(one, zeros + ones[begin], begin - ones[begin])
            at = np.where(one, zeros + ones[at], at - ones[at])
        return at - begin

    def symbol(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        out = np.zeros_like(at)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            one = ones[at + 1] > ones[at]
            out = out * 2 + one
            at = np.where(one, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Counts and finds phrases in one shard's text of word codes (0 marks breaks; the text begins and ends with 0).

    Breaks sort before all words and by their place, so no comparison passes one; the first word behind a break is
    always sampled, so no walk passes one either.
    """

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        n = len(text)
        is_break = text == 0
        breaks = np.cumsum(is_break)
        ranks = suffix_ranks(np.where(is_break, breaks - 1, breaks[-1] + text), np.arange(n - 1, -1, -1))[-1]
        order = np.empty(n, np.int64)
        order[ranks] = np.arange(n)
        run_place = np.arange(n) - np.maximum.accumulate(np.where(is_break, np.arange(n) + 1, 0))
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.last = WaveletMatrix(text[order - 1], max(1, int(symbols - 1).bit_length()))
        sampled = run_place[order] % SAMPLE == 0
        self.marks = np.concatenate([[0], np.cumsum(sampled)])
        self.kept = order[sampled]
        self.n = len(text)

    def count(self, codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the suffix array that begin with each phrase (right-aligned codes)."""
        low, high = np.zeros(len(codes), np.int64), np.full(len(codes), self.n, np.int64)
        width = codes.shape[1]
        for back in range(width):
            live = np.flatnonzero((back < length) & (high > low))
            if not len(live):
                break
            symbol = codes[live, width - 1 - back]
            low[live] = self.less[symbol] + self.last.rank(symbol, low[live])
            high[live] = self.less[symbol] + self.last.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: steps back until a sampled position."""
        out = np.zeros(len(rows), np.int64)
        walking, at, steps = np.arange(len(rows)), rows, 0
        while len(walking):
            marked = self.marks[at + 1] > self.marks[at]
            out[walking[marked]] = self.kept[self.marks[at[marked]]] + steps
            walking, at = walking[~marked], at[~marked]
            symbol = self.last.symbol(at)
            at = self.less[symbol] + self.last.rank(symbol, at)
            steps += 1
        return out


def shard_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """All words of a shard, and how many each text has."""
    raw, ends = common.offsets_of(texts)
    is_word = IS_WORD[raw]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    inner = ends[1:-1][ends[1:-1] < len(raw)]
    begins[inner] = is_word[inner]
    count = np.diff(np.searchsorted(np.flatnonzero(begins), ends))
    one_list = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts.cast(pa.string()))
    return pc.binary_join(one_list, " ")[0].as_buffer().to_pybytes().translate(WORD_BYTES).split(), count


def find(words: list[bytes], count: np.ndarray, phrases: Phrases) -> list[tuple[int, int, int, int]]:
    """``(document, first word, end word, phrase)`` of every occurrence in one shard."""
    coded = np.fromiter(map(phrases.code.get, words, repeat(0)), np.int64, len(words))
    owner = np.repeat(np.arange(len(count)), count)
    if not len(coded) or not len(phrases.length):
        return []
    cut = np.concatenate([[True], (owner[1:] != owner[:-1]) | (coded[1:] == 0) | (coded[:-1] == 0)])
    begin = np.flatnonzero(cut)
    size = np.diff(np.append(begin, len(coded)))
    fits = (size >= phrases.shortest) & (coded[begin] != 0)
    begin, size = begin[fits], size[fits]
    if not len(begin):
        return []
    # The indexed text: a break, then each run with a break behind it.
    place = 1 + np.cumsum(size + 1) - (size + 1)
    source = np.repeat(begin - place, size) + (at := np.repeat(place, size) + _within(size))
    text = np.zeros(int(size.sum() + len(size)) + 1, np.int64)
    text[at] = coded[source]
    index = FMIndex(text, len(phrases.code) + 1)
    low, high = index.count(phrases.codes, phrases.length)
    hits = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(hits)), hits)
    rows = np.repeat(low, hits) + _within(hits)
    where = index.locate(rows)
    run = np.searchsorted(place, where, side="right") - 1
    word = begin[run] + where - place[run]
    doc = owner[word]
    first = word - (np.cumsum(count) - count)[doc]
    return list(zip(doc.tolist(), first.tolist(), (first + phrases.length[which]).tolist(), which.tolist()))


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of consecutive groups of the given sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, in order; spans that touch become one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def id_kind(items: DataFrame) -> str:
    """The type that item ids are carried as: whole numbers as such, all others as text."""
    return "bigint" if isinstance(items.schema["item_id"].dataType, IntegralType) else "string"


def item_blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> list[list[tuple[int | str | None, str]]]:
    """The benchmark in blocks of a bounded number of bytes; each is read by the driver on its own."""
    sized = items.select(F.col("item_id").cast(id_kind(items)), F.coalesce("text", F.lit("")).alias("text"))
    total = sized.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(16)), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) * 2 // limit))
    if parts == 1:
        return [[tuple(r) for r in sized.collect()]]
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return [[tuple(r) for r in sized.where(block == i).collect()] for i in range(parts)]


def removal_spans(docs: DataFrame, items: DataFrame, carry: list[str], window: int = WINDOW,
                  text: str = "text") -> DataFrame:
    """``carry``, ``_n_words``, ``_spans`` (merged word ranges inside occurrences) and ``_items`` (their item ids).

    With one block of phrases, one pass without a shuffle. Further blocks are further passes; their rows are joined by
    a row number that is stored with the first pass's input.
    """
    blocks, kind = item_blocks(items), id_kind(items)
    if len(blocks) == 1:
        return _one_pass(docs, Phrases([(i, words_of(t)) for i, t in blocks[0]], window), carry, text, kind)
    kept = written(docs.select(*dict.fromkeys([*carry, text])).withColumn("_row", F.monotonically_increasing_id()),
                   "texts")
    passes = [_one_pass(kept, Phrases([(i, words_of(t)) for i, t in b], window), ["_row"], text, kind) for b in blocks]
    both = reduce(DataFrame.unionByName, passes)
    hit = both.where(F.size("_spans") > 0).groupBy("_row").agg(
        F.flatten(F.collect_list("_spans")).alias("_spans"), F.flatten(F.collect_list("_items")).alias("_items"))
    words = passes[0].select("_row", "_n_words")
    union = F.aggregate(
        F.array_sort("_spans"), F.expr("cast(array() as array<struct<begin:int,end:int>>)"),
        lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] >= x["begin"]), F.concat(
            F.slice(a, 1, F.size(a) - 1), F.array(F.struct(
                F.try_element_at(a, F.lit(-1))["begin"].alias("begin"),
                F.greatest(F.try_element_at(a, F.lit(-1))["end"], x["end"]).alias("end"))))).otherwise(
            F.concat(a, F.array(x))))
    return kept.select("_row", *carry).join(words, "_row").join(hit, "_row", "left").select(
        *carry, "_n_words",
        F.coalesce(union, F.expr("cast(array() as array<struct<begin:int,end:int>>)")).alias("_spans"),
        F.coalesce(F.array_distinct("_items"), F.expr(f"cast(array() as array<{kind}>)")).alias("_items"))


SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def _one_pass(docs: DataFrame, phrases: Phrases, carry: list[str], text: str, kind: str) -> DataFrame:
    given = docs.select(*dict.fromkeys([*carry, text]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*carry).schema.fields),
                        f"_n_words bigint, _spans array<struct<begin:int,end:int>>, _items array<{kind}>"])
    ids = pa.list_(pa.int64() if kind == "bigint" else pa.string())
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in common.slices(batches, text):
            words, count = shard_words(common.texts_of(part, text))
            spans: list[list[tuple[int, int]]] = [[] for _ in count]
            items: list[set[int]] = [set() for _ in count]
            for doc, begin, end, which in find(words, count, known):
                spans[doc].append((begin, end))
                items[doc].update(known.owners[which])
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in carry), pa.array(count, pa.int64()),
                 pa.array([[{"begin": b, "end": e} for b, e in merged(s)] for s in spans], SPANS),
                 pa.array([list({known.items[i] for i in s}) for s in items], ids)],
                names=[*carry, "_n_words", "_spans", "_items"])

    return given.mapInArrow(run, schema)


def cut_words(text: str | None, spans: list[dict]) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if not text or not spans:
        return text
    raw = text.encode()
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 32, [0]])
                                  .astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    out, at = [], 0
    for span in spans:
        out.append(raw[at:starts[span["begin"]]])
        at = ends[span["end"] - 1]
    return b"".join([*out, raw[at:]]).decode()


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """All rows and columns; the words inside benchmark occurrences are cut from the texts."""
    plain, names = common.neutral(docs)
    text = names[text]
    found = removal_spans(plain, items, plain.columns, window, text)
    schema = plain.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, text):
            spans = part.column("_spans").to_pylist()
            columns = [part.column(c) for c in schema.names]
            if any(spans):
                at = schema.names.index(text)
                columns[at] = pa.array([cut_words(t, s) if s else t
                                        for t, s in zip(columns[at].to_pylist(), spans)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return found.mapInArrow(run, schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    found = removal_spans(docs, items, ["doc_id"])
    ids = F.array_sort(F.transform(F.array_compact("_items"), lambda i: i.cast("string")))
    hits = F.aggregate("_spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["begin"])
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), hits.alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS j, item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT j, item_id, least(len(w), {WINDOW}) AS n, list_slice(w, i, i + {WINDOW - 1}) AS g
  FROM (SELECT j, item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT k, n, i, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
o AS (SELECT DISTINCT k, i, dw.n, j, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT k, count(DISTINCT p) AS n_hit
  FROM (SELECT k, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT k, i, n FROM o)) GROUP BY k),
t AS (SELECT k, count(DISTINCT item_id) AS n_items,
  string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar) AS ids FROM o GROUP BY k)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN t USING (k)
"""
