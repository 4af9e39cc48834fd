"""Quality rules by suffix-array repetition.

Words are coded per slice of texts, their suffix array is built by prefix doubling (a suffix leaves the sort as soon as
its rank is its own), and the longest common prefixes of neighbours give the maximal repeated word sequences. The union
of their spans is the covered part of a text. Two limits follow: on the covered fraction and on the longest repeat.

Defined results: a null or empty text has no words and fails the base rule (fewer than 10 words); a null id stays null;
repeated rows are judged each for itself; an empty table gives no rows; further columns are carried by ``keep_quality``
and ignored by ``rule_figures``. A text of any length is judged whole, in one slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm import common
from rankforge.llm.suffixes import suffix_ranks

#: Fixed by the contract of the base rule.
MIN_WORDS, BASE_REPEAT, BASE_PERCENT = 10, 5, 20
#: The method's limits: repeats of this many words or more may cover this many percent; the longest may have so many.
MIN_REPEAT, MAX_PERCENT, MAX_REPEAT = 15, 15, 50

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


def byte_table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


IS_SYMBOL = byte_table(SYMBOLS)
#: First bytes of code points that are no white space.
IS_WORD_CHAR = ~(byte_table(WHITE) | byte_table(bytes(range(0x80, 0xC0))))


def longest_matches(levels: list[np.ndarray], after: np.ndarray) -> np.ndarray:
    """For each suffix the longest prefix it shares with another one, from the neighbours in the suffix array."""
    n = len(after)
    place = np.empty(n, np.int64)
    place[levels[-1]] = np.arange(n)
    longest = np.zeros(n, np.int32)
    pair = np.flatnonzero(levels[0][place[1:]] == levels[0][place[:-1]])
    left, right = place[pair], place[pair + 1]
    common_words = np.zeros(len(pair), np.int64)
    for power in range(len(levels) - 1, -1, -1):
        # A rank over 2**power words is only right for suffixes that have so many; shorter ones differ anyway.
        room = np.minimum(after[left], after[right]) + 1 - common_words >= 1 << power
        a, b = np.minimum(left + common_words, n - 1), np.minimum(right + common_words, n - 1)
        common_words += np.where(room & (levels[power][a] == levels[power][b]), 1 << power, 0)
    np.maximum.at(longest, left, common_words)
    np.maximum.at(longest, right, common_words)
    return longest


def covered(longest: np.ndarray, at_least: int) -> np.ndarray:
    """Words inside a repeat of ``at_least`` words or more: the union of all such repeats' spans."""
    n = len(longest)
    starts = np.flatnonzero(longest >= at_least)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + longest[starts], n), -1)
    return np.cumsum(change[:-1]) > 0


def slice_figures(texts: pa.Array, min_repeat: int) -> dict[str, np.ndarray]:
    """The figures of each text of one slice."""
    n = len(texts)
    raw, ends = common.offsets_of(texts)
    words, owner = common.word_arrays(texts)
    n_words = np.bincount(owner, minlength=n)
    out = {"n_words": n_words}
    for name, table in (("word_chars", IS_WORD_CHAR), ("n_symbols", IS_SYMBOL)):
        out[name] = np.diff(np.concatenate([[0], np.cumsum(table[raw], dtype=np.int64)])[ends])
    out["n_dup_lines"] = duplicate_lines(texts)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    if len(codes):
        last = np.cumsum(n_words) - 1
        after = last[owner] - np.arange(len(codes))
        longest = longest_matches(suffix_ranks(owner * np.int64(len(coded.dictionary)) + codes, after), after)
    else:
        longest = np.zeros(0, np.int32)
    out["n_repeat_words"] = np.bincount(owner[covered(longest, BASE_REPEAT)], minlength=n)
    out["n_covered_words"] = np.bincount(owner[covered(longest, min_repeat)], minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, longest)
    out["longest_repeat"] = np.where(top >= BASE_REPEAT, top, 0)
    return out


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lists = pc.split_pattern(texts, "\n")
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(lists.offsets.to_numpy()))
    coded = lists.flatten().dictionary_encode()
    if not len(coded):
        return np.zeros(len(texts), np.int64)
    has_word = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy()
    keep = has_word[codes]
    lines = np.bincount(owner[keep], minlength=len(texts))
    distinct = np.unique(owner[keep] * len(coded.dictionary) + codes[keep]) // max(1, len(coded.dictionary))
    return lines - np.bincount(distinct, minlength=len(texts))


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


def rule_figures(docs: DataFrame, carry: list[str], min_repeat: int = MIN_REPEAT, text: str = "text") -> DataFrame:
    """``carry`` columns and the figures of each row's text; one row in, one row out, no shuffle."""
    names = list(dict.fromkeys([*carry, text]))
    given = docs.select(*names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*carry).schema.fields),
                        *(f"`_{f}` bigint" for f in FIGURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, text):
            figures = slice_figures(common.texts_of(part, text), min_repeat)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in carry), *(pa.array(figures[f].astype(np.int64)) for f in FIGURES)],
                names=[*carry, *(f"_{f}" for f in FIGURES)])

    return given.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > BASE_PERCENT * F.col("_n_words"))


def verdict(max_percent: int = MAX_PERCENT, max_repeat: int = MAX_REPEAT) -> Column:
    """True where the text passes the base rule and both limits on repeats."""
    return ~base_failed() & (100 * F.col("_n_covered_words") <= max_percent * F.col("_n_words")) & (
        F.col("_longest_repeat") <= max_repeat)


def keep_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that pass, with all their columns."""
    plain, names = common.neutral(docs)
    kept = rule_figures(plain, plain.columns, text=names[text]).filter(verdict())
    return kept.select(*plain.columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_figures(common.table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select(
        "doc_id", *(F.col(f"_{f}").alias(f) for f in FIGURES),
        base_failed().alias("base_failed"), verdict().alias("kept"))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS k FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
p AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM w),
h AS (SELECT k, i,
  CASE WHEN i + {BASE_REPEAT - 1} <= len(w) THEN hash(w[i:i + {BASE_REPEAT - 1}]) END AS a,
  CASE WHEN i + {MIN_REPEAT - 1} <= len(w) THEN hash(w[i:i + {MIN_REPEAT - 1}]) END AS b FROM p),
f AS (SELECT k, i, a IS NOT NULL AND count(a) OVER (PARTITION BY k, a) > 1 AS ra,
  b IS NOT NULL AND count(b) OVER (PARTITION BY k, b) > 1 AS rb FROM h),
c AS (SELECT k, i,
  max(ra::int) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN {BASE_REPEAT - 1} PRECEDING AND CURRENT ROW) AS ca,
  max(rb::int) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN {MIN_REPEAT - 1} PRECEDING AND CURRENT ROW) AS cb FROM f),
s AS (SELECT k, sum(ca)::bigint AS n_repeat_words, sum(cb)::bigint AS n_covered_words FROM c GROUP BY k),
x0 AS (SELECT k, a, array_agg(i ORDER BY i) AS places FROM h WHERE a IS NOT NULL GROUP BY k, a HAVING count(*) > 1),
x1 AS (SELECT k, unnest(places) AS i, places FROM x0),
x2 AS (SELECT k, i, unnest(places) AS j FROM x1),
x3 AS (SELECT k, i, j, j - i AS gap FROM x2 WHERE j > i),
x4 AS (SELECT k, gap, i, i - row_number() OVER (PARTITION BY k, gap ORDER BY i) AS run FROM x3),
x5 AS (SELECT k, max(n) + {BASE_REPEAT - 1} AS longest_repeat
  FROM (SELECT k, gap, run, count(*) AS n FROM x4 GROUP BY k, gap, run) GROUP BY k),
l AS (SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  GROUP BY k),
r AS (SELECT w.doc_id, len(w.w)::bigint AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
  coalesce(l.n_dup_lines, 0)::bigint AS n_dup_lines, coalesce(s.n_repeat_words, 0)::bigint AS n_repeat_words,
  coalesce(s.n_covered_words, 0)::bigint AS n_covered_words, coalesce(x5.longest_repeat, 0)::bigint AS longest_repeat
  FROM w LEFT JOIN s USING (k) LEFT JOIN l USING (k) LEFT JOIN x5 USING (k))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words)
  AND 100 * n_covered_words <= {MAX_PERCENT} * n_words AND longest_repeat <= {MAX_REPEAT} AS kept FROM r
"""
