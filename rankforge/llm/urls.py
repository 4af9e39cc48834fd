"""URL filters by Bloom filter cascades.

A cascade answers exactly for every key of a known universe, here all keys that the corpus's own urls give. Its first
level holds the listed keys; the second holds the keys of the universe that the first wrongly passes; the third the
listed keys that the second wrongly passes; and so on until no key is wrong. A key is settled at the first level that
does not pass it. Pages are then judged by bit tests alone, without a join.

Keys are the domains above a host (for listed domains) and ``domain + start of path`` (for rules). Keys are 64-bit
hashes; a seed is used only if no listed key shares its hash with another key of the universe.

The levels are sent to the tasks; their size follows from the counted keys and is checked against ``MAX_BITS``. Beyond
that the same answers come from a join with the listed keys.

Defined results: a url that is null or has no ``://`` has an empty host and path, fits no rule and is on no list;
repeated rows get equal results; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm import common
from rankforge.session import written

#: Bits of all levels of a cascade that may be sent to the tasks.
MAX_BITS = 1 << 30
#: Share of the universe that may pass the first level wrongly; later levels pass half.
FIRST_ERROR, LATER_ERROR = 1 / 16, 1 / 2
#: Rules of the query (verdict by ``host/path``) and the words that list a domain, fixed by contract and parameter.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
LISTED_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """Another well-spread 64-bit number for each key and salt."""
    x = keys.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Level:
    """One Bloom filter."""

    bits: int
    hashes: int
    salt: int
    words: np.ndarray

    def places(self, keys: np.ndarray) -> list[np.ndarray]:
        return [mixed(keys, self.salt * 64 + i) % np.uint64(self.bits) for i in range(self.hashes)]

    def passes(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for place in self.places(keys):
            out &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return out


@dataclass
class Cascade:
    """Exact membership of 64-bit keys, for all keys of the universe it was built over."""

    levels: list[Level]

    def contains(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        open_ = np.arange(len(keys))
        for number, level in enumerate(self.levels):
            passed = level.passes(keys[open_])
            out[open_[~passed]] = number % 2 == 1
            open_ = open_[passed]
        out[open_] = len(self.levels) % 2 == 1
        return out


def new_level(count: int, number: int) -> Level:
    error = LATER_ERROR if number else FIRST_ERROR
    bits = max(64, math.ceil(count * math.log(1 / error) / math.log(2) ** 2))
    return Level(bits, max(1, round(-math.log2(error))), number, np.zeros(-(-bits // 64), np.uint64))


def fill(level: Level, keys: DataFrame) -> Level:
    """Set the bits of all keys: words of bits are combined in each task, then by ``bit_or``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.concatenate(level.places(batch.column(0).to_numpy()))
            if not len(place):
                continue
            place = np.unique(place)
            word, begin = np.unique(place >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), begin)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))],
                                             names=["word", "bits"])

    rows = keys.mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    got = rows.toArrow()  # at most one row for each word of a level whose size was checked
    words = level.words.copy()
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return Level(level.bits, level.hashes, level.salt, words)


def hashed(keys: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), keys)


def universe_of(keys: DataFrame, listed: DataFrame) -> tuple[DataFrame, int]:
    """``(key, listed)`` of all distinct hashed keys, stored, and the seed under which no two of them clash."""
    flagged = written(keys.distinct().join(listed.distinct().withColumn("listed", F.lit(True)), "key", "left").select(
        "key", F.coalesce("listed", F.lit(False)).alias("listed")), "universe")
    for seed in range(16):
        rows = flagged.groupBy(hashed(F.col("key"), seed).alias("key")).agg(
            F.max("listed").alias("listed"), (F.max("listed") != F.min("listed")).alias("clash"))
        rows = written(rows, "hashed")
        if not rows.where("clash").limit(1).count():
            return rows.select("key", "listed"), seed
    raise RuntimeError("no seed separates the listed keys")


def build(keys: DataFrame, listed: DataFrame) -> tuple[Cascade | None, int, DataFrame]:
    """The cascade for ``listed.key`` over the universe ``keys.key``; None if it would be too large.

    Also the seed of its hashes, and the hashed universe with its answers, for the way beyond the size.
    """
    universe, seed = universe_of(keys, listed)
    levels: list[Level] = []
    while True:
        number = len(levels)

        def survivors(batches: Iterator[pa.RecordBatch], before: tuple[Level, ...] = tuple(levels),
                      side: bool = number % 2 == 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = batch.column("key").to_numpy()[batch.column("listed").to_numpy(zero_copy_only=False) == side]
                for level in before:
                    held = held[level.passes(held)]
                yield pa.RecordBatch.from_arrays([pa.array(held)], names=["key"])

        rest = universe.mapInArrow(survivors, "key bigint")
        count = rest.count()
        if not count:
            return Cascade(levels), seed, universe
        level = new_level(count, number)
        if level.bits + sum(x.bits for x in levels) > MAX_BITS:
            return None, seed, universe
        levels.append(fill(level, rest))


def host_of(url: Column) -> Column:
    """What stands behind the first ``://`` up to ``/ ? #``, with A-Z lowered; empty if there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #``; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domains(host: Column, most_labels: int | None = None) -> Column:
    """The host and all domains above it, longest first; at most those of ``most_labels`` labels."""
    labels = F.split(host, r"\.")
    size = F.size(labels)
    first = F.greatest(size - most_labels, F.lit(0)) if most_labels else F.lit(0)
    return F.transform(F.sequence(first, size - 1), lambda i: F.array_join(F.slice(labels, i + 1, size), "."))


def answers(pages: DataFrame, columns: list[str], cascades: list[Cascade], found: list[str]) -> DataFrame:
    """For each array of hashed keys the place (from 0) of its first key on the list, or null."""
    names = [c for c in pages.columns if c not in columns]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*names).schema.fields),
                        *(f"`{f}` int" for f in found)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for column, cascade in zip(columns, cascades):
                lists = batch.column(column)
                owner = pc.list_parent_indices(lists).to_numpy()
                hits = np.flatnonzero(cascade.contains(lists.flatten().to_numpy()))
                size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                begin = np.cumsum(size) - size
                rows, at = np.unique(owner[hits], return_index=True)
                place = np.full(batch.num_rows, -1, np.int32)
                place[rows] = hits[at] - begin[rows]
                out.append(pa.array(place, pa.int32(), mask=place < 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *out], names=[*names, *found])

    return pages.mapInArrow(run, schema)


def judge(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame, url: str = "url") -> DataFrame:
    """All rows with ``host``, ``path``, ``rule`` (or null) and ``verdict``.

    ``rules`` are (``host/path``, block or allow); the longest that fits wins, a longer host breaks ties, and of two equal
    rules the blocking one. Where none fits, a host on or below a domain of ``listed.key`` is blocked.
    """
    plain, names = common.neutral(pages)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    carry = [names[c] for c in kept]
    spark = pages.sparkSession
    address = F.col(names[url])
    placed = plain.select(*carry, host_of(address).alias("host"), path_of(address).alias("path"))
    hosts = [r[: r.index("/")] for r, _ in rules]
    labels = max((h.count(".") + 1 for h in hosts), default=1)
    lengths = sorted({len(r) - len(h) for (r, _), h in zip(rules, hosts)}, reverse=True) or [1]
    starts = F.array_compact(F.array(*(
        F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths)))
    fits = F.flatten(F.transform(domains(F.col("host"), labels), lambda d: F.transform(
        starts, lambda p: F.concat(d, p))))
    keyed = placed.withColumns({"_rules": F.when(F.col("host") != "", F.array_sort(
        fits, lambda a, b: F.char_length(b) - F.char_length(a))).otherwise(F.array().cast("array<string>")),
        "_domains": domains(F.col("host"))})
    thin = keyed.select(F.array_distinct("_rules").alias("_rules"), "_domains")
    rule_keys = thin.select(F.explode("_rules").alias("key"))
    domain_keys = thin.select(F.explode("_domains").alias("key"))
    of = {v: spark.createDataFrame([(r,) for r, w in rules if w == v], "key string") for v in ("block", "allow")}
    built = [build(rule_keys, of["block"]), build(rule_keys, of["allow"]), build(domain_keys, listed)]
    arrays, found = ["_rules", "_rules", "_domains"], ["_block", "_allow", "_listed"]
    if all(cascade is not None for cascade, _, _ in built):
        hashes = {f"{f}_keys": hash_all(a, seed) for f, a, (_, seed, _) in zip(found, arrays, built)}
        judged = answers(keyed.withColumns(hashes), list(hashes), [c for c, _, _ in built], found)
    else:
        judged = joined_answers(keyed, arrays, [(s, u) for _, s, u in built], found)
    at = F.least(F.coalesce("_block", F.lit(1 << 30)), F.coalesce("_allow", F.lit(1 << 30)))
    rule = F.when(at < 1 << 30, F.get("_rules", at))
    verdict = (F.when(rule.isNotNull(), F.when(F.col("_block") == at, "block").otherwise("allow"))
               .when(F.col("_listed").isNotNull(), "block").otherwise("allow"))
    return judged.select(*carry, "host", "path", rule, verdict).toDF(*kept, "host", "path", "rule", "verdict")


def hash_all(column: str, seed: int) -> Column:
    return F.transform(column, lambda k: hashed(k, seed))


def joined_answers(pages: DataFrame, arrays: list[str], built: list[tuple[int, DataFrame]],
                   found: list[str]) -> DataFrame:
    """What :func:`answers` gives, by joins with the stored answers of all keys; for lists beyond the size bound."""
    out = written(pages.withColumn("_row", F.monotonically_increasing_id()), "pages")
    for array, (seed, universe), name in zip(arrays, built, found):
        each = out.select("_row", F.posexplode(hash_all(array, seed)).alias("_at", "key"))
        hit = each.join(universe.where("listed").select("key"), "key", "left_semi").groupBy("_row").agg(
            F.min("_at").alias(name))
        out = out.join(hit, "_row", "left")
    return out.drop("_row")


def listed_domains(pages: DataFrame, words: tuple[str, ...] = LISTED_WORDS, url: str = "url") -> DataFrame:
    """Domains of the corpus that have one of the words, between dots or hyphens, in their first label."""
    pattern = rf"^([^.]*-)?({'|'.join(words)})(-[^.]*)?(\.|$)"
    hosts = pages.select(host_of(F.col(url)).alias("host")).distinct()
    return hosts.select(F.explode(domains(F.col("host"))).alias("key")).distinct().where(F.col("key").rlike(pattern))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, list(RULES), listed_domains(pages)).select("page_id", "host", "path", "rule", "verdict")


SQL = rf"""
WITH p AS (SELECT page_id, url, coalesce(url, '') AS u FROM pages),
h AS (SELECT page_id, translate(regexp_extract(u, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(u, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM p),
r AS (SELECT *, row_number() OVER () AS k, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host, '(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
