"""Periodic runs of words: an online sparse dynamic program over diagonals.

A run is a stretch of words in which words ``period`` apart are equal, at least four periods and six words long, that
neither neighbour word prolongs. The words of a text are read in order. A diagonal is a lag: its match length is how
many words on end equal the word that far back. Each word prolongs the active lags whose word that far back is equal;
the others end there, and one that is long enough is a run at once. Earlier occurrences of the word make further lags
active. A run of lag d has 3d matches on end or more, so lags of ``[2^k, 2^(k+1))`` need to be looked for only at every
``3 * 2^k``-th word; what matched before that word is counted back. A lag that is a multiple of an active one inside its
stretch has the same stretch and is left out. So a text of one repeated word costs no more than any other.

Defined results: a null, empty or blank text has no words and no runs; repeated rows get the same result; a very long
text stands alone in a slice and is read whole; an empty table gives no rows; carried columns may have any names but
``n_words``, ``runs`` and ``collapsed``; the query leaves the text of a null ``doc_id`` as it is.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.functions.text import bind
from rankforge.llm import common

#: A run has at least this many periods and words.
PERIODS, WORDS = 4, 6
#: Schedules of texts up to this many words are kept.
KEPT_WORDS = 2000
RUNS = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))


def due(n: int) -> list[tuple[int, ...]]:
    """For each of ``n`` words the octaves of lags (their least lag) that are looked for there."""
    at: list[tuple[int, ...]] = [()] * n
    low = 1
    while low <= n // PERIODS:
        for i in range(0, n, max(WORDS - low, (PERIODS - 1) * low)):
            at[i] += (low,)
        low *= 2
    return at


kept_due = lru_cache(KEPT_WORDS)(due)


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of the words, by start, then period."""
    n = len(words)
    if n < WORDS:
        return []
    schedule = kept_due(n) if n <= KEPT_WORDS else due(n)
    longest = n // PERIODS
    places: dict = {}
    active: dict[int, int] = {}  # lag: first of the words that equal the word that far back
    found: dict[tuple[int, int], int] = {}

    def end(lag: int, to: int) -> None:
        start = active.pop(lag) - lag
        if to - start >= max(WORDS, PERIODS * lag):
            found[start, to] = min(lag, found.get((start, to), lag))

    for i, word in enumerate(words):
        if active:
            for lag in [d for d in active if words[i - d] != word]:
                end(lag, i)
        earlier = places.get(word)
        if earlier is None:
            places[word] = [i]
            continue
        for low in schedule[i]:
            most = min(2 * low - 1, longest)
            # A stretch that holds a multiple of its lag has matched for a whole lag.
            steady = [(d, first - d) for d, first in active.items() if i - first >= d]
            for place in earlier[bisect_left(earlier, i - most):bisect_right(earlier, i - low)]:
                lag = i - place
                if lag in active or any(lag % d == 0 and place >= start for d, start in steady):
                    continue
                first = i
                while first > lag and words[first - 1] == words[first - 1 - lag]:
                    first -= 1
                active[lag] = first
        earlier.append(i)
    for lag in list(active):
        end(lag, n)
    return sorted((start, to - start, lag) for (start, to), lag in found.items())


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words but for those that a run holds after its first period."""
    if not runs:
        return words
    kept = bytearray(b"\1" * len(words))
    for start, length, period in runs:
        kept[start + period:start + length] = bytes(length - period)
    return [w for w, k in zip(words, kept) if k]


def with_runs(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """``carry``, ``n_words``, ``runs`` and ``collapsed`` (the text without repeats); a row for a row, no shuffle."""
    given = docs.select(*dict.fromkeys([*carry, text]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*carry).schema.fields),
                        "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, text):
            sizes, runs, left = [], [], []
            for value in common.texts_of(part, text).cast(pa.binary()).to_pylist():
                words = value.split()
                sizes.append(len(words))
                runs.append(runs_of(words))
                left.append(b" ".join(collapse(words, runs[-1])))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in carry), pa.array(sizes, pa.int64()), pa.array(runs, RUNS),
                 pa.array(left, pa.binary()).cast(pa.string())], names=[*carry, "n_words", "runs", "collapsed"])

    return given.mapInArrow(run, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text; of a tenth of the ids its words from some place on repeat with some period."""
    mark = F.crc32(doc_id.cast("string"))
    g = F.floor(mark / 10)
    words = F.filter(F.split(text, "[ \\x09-\\x0D]+"), lambda w: w != "")

    def repeat(known: Column) -> Column:
        n = F.size(known)
        first = (g % n).cast("int")
        period = (1 + F.floor((n - first) / (3 + g % 8))).cast("int")
        return bind(F.struct(first.alias("a"), period.alias("p")), lambda x: F.array_join(F.transform(
            known, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(known, x["a"] + (i - x["a"]) % x["p"]))), " "))

    return F.when(mark % 10 == 0, bind(words, lambda known: F.when(F.size(known) > 0, repeat(known)).otherwise(""))
                  ).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    given = docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = with_runs(given, ["doc_id"]).withColumn("best", F.array_min(F.transform(
        "runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length = -F.col("best.less")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"),
        length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


SQL = """
WITH split AS (
  SELECT doc_id, coalesce(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''), []) AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda s, c: list_reduce(list_prepend(xor(s, c), range(8)),
        lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS h
  FROM documents),
placed AS (
  SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS part FROM split),
planted AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n),
    lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // part) END]) ELSE w END AS w
  FROM placed),
words AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM planted),
equal_words AS (
  SELECT x.doc_id, x.i, x.i - y.i AS d FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i < x.i
  WHERE 4 * (x.i - y.i) <= x.n),
stretches AS (
  SELECT doc_id, d, min(i) - d AS s, count(*) + d AS size
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS k FROM equal_words)
  GROUP BY doc_id, d, k HAVING count(*) + d >= greatest(6, 4 * d)),
runs AS MATERIALIZED (SELECT doc_id, s, size, min(d) AS q FROM stretches GROUP BY doc_id, s, size),
told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || size || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
    max(size) AS length
  FROM runs GROUP BY doc_id),
longest AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, s, q) = 1),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + size)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, size AS length, q AS period, 1000 * size // q AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents LEFT JOIN told USING (doc_id) LEFT JOIN longest USING (doc_id) LEFT JOIN kept USING (doc_id)"""
