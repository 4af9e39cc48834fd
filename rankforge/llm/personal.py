"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Fixed patterns find base spans (email, ip, card, phone); they are the seeds. The word before a seed, the two words before
it, and the word after it are lexical patterns, each with the kind of what it stands at. All other identifier-like parts of
the texts are instances too: tokens with a digit or an at sign, and runs of digits with the separators that a card or phone
number may have. Over this graph two scores feed each other for a few rounds: a pattern is as good as the share of its
instances that are known, an instance as good as the patterns that find it together. Instances of a fitting shape at good
patterns are added as spans; base spans stay.

Limits of what can be found: a pattern's words are letters, ``_`` and ``-``, at most 30 of them each, within ``CONTEXT``
characters, with at most one mark of ``:=`` and one opening quote or bracket between word and instance; a pattern needs
``MIN_SUPPORT`` different known instances and ``MIN_CONFIDENCE`` of its instances known; a digit run has 8 to 19 digits with
at most three separators between two digits. An added email has one at sign and a point, an ip four parts of any size, a
card 16 to 19 digits, a phone 8 to 15.

The graph holds distinct (pattern, instance) pairs over all documents; its sums are partial aggregates. Words and instances
that very many rows have are dealt over tasks where rows meet their scores. Texts are read once: thin rows with spans and
candidates are stored, with a row number, so that ids may repeat or be null.

Positions come from the pieces between matches, summed up in blocks, since no function gives them.

Defined results: a null or empty text has no spans; a very long text is read whole; repeated rows get equal results; a null
id stays null; an empty table gives no rows; further columns are ignored, and carried ones may have any name that does not
begin with ``_``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm import common
from rankforge.operators.joins import beside
from rankforge.session import written

KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns. Possessive repeats and the look behind give the same matches in linear time: a run that failed
#: at its begin fails at every later place, unless a match has ended inside it.
EMAIL_CHARS = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{EMAIL_CHARS})){EMAIL_CHARS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has none of the pattern.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

#: A token between white space that holds a digit or an at sign.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: A run of digits and separators, with the sign that goes on with a word where one does; one loop over characters, so that
#: neither stack nor time grows faster than the run.
DIGIT_RUN = r"(?<![\p{L}0-9@.+(_-])[+(]{0,2}[0-9][0-9\x20().-]*+(?:(?<=[0-9])[\p{L}@_])?+"
#: What no digit run has: too many separators on end, or a word that goes on.
NO_RUN = r"[\x20().-]{4,}+[0-9]|[\p{L}@_]$"
#: Shapes that a discovered identifier must have.
SHAPES = {"email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "ip": r"^[0-9]+(?:\.[0-9]+){3}$", "card": r"^[0-9](?:[\x20-]?[0-9])++$",
          "phone": r"^\+?\(?[0-9][\x20().0-9-]{6,}[0-9]$"}
#: Digits that a discovered identifier must have.
DIGITS = {"card": (16, 19), "phone": (8, 15)}
#: Characters on either side of a span that its patterns are taken from.
CONTEXT = 80
WORD = r"[\p{L}_-]{1,30}+"
BEFORE = rf"(?:(?<!\S)({WORD})[:=,]?\s+)?(?<![^\s\"'(<])({WORD})[:=]?\s*[\"'(<]?$"
AFTER = rf"^[\"')>]?[,;.]?\s+({WORD})(?=[\s.,;:!?]|$)"
ROUNDS = 3
#: What a pattern needs: distinct known instances, and their share; what an instance needs.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_SCORE = 5.0, 0.8, 0.8
BLOCK = 256


def running_totals(values: Column) -> Column:
    """Sums of an array up to each entry, in blocks, so that long arrays are not copied once per entry."""
    none = F.array().cast("array<bigint>")

    def short(x: Column) -> Column:
        return F.aggregate(x, none, lambda a, v: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + v)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")),
                         lambda b: short(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))
    # Bound once, then moved up by the total of the blocks before.
    moved = F.transform(F.array(blocks), lambda bs: F.transform(
        F.array(short(F.transform(bs, lambda b: F.try_element_at(b, F.lit(-1))))), lambda tops: F.flatten(F.transform(
            bs, lambda b, i: F.transform(b, lambda v: v + F.when(i == 0, F.lit(0)).otherwise(F.get(tops, i - 1)))))))
    return F.when(F.size(values) > 0, F.get(F.get(moved, 0), 0)).otherwise(none)


def placed(matches: Column, gaps: Column) -> Column:
    """Spans (start, end, value) in code points from the matches and the pieces between them."""
    steps = F.transform(matches, lambda m, i: (F.char_length(m) + F.char_length(F.get(gaps, i))).cast("bigint"))
    return F.zip_with(matches, running_totals(steps), lambda m, e: F.struct(
        (e - F.char_length(m)).alias("start"), e.alias("end"), m.alias("value")))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    place = F.sequence(F.lit(0), F.char_length(digits) - 1)

    def worth(i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d < 5, d * 2).otherwise(d * 2 - 9)

    return F.aggregate(place, F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.char_length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(digits).between(8, 15)
    return F.lit(True)


def matched(rows: DataFrame, name: str, text: str, pattern: str, hint: Column) -> DataFrame:
    """``name``: all spans of the pattern in the text."""
    none = F.array().cast("array<string>")
    found = rows.withColumns({
        f"{name}_m": F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
        f"{name}_g": F.when(hint, F.split(text, pattern, -1)).otherwise(none)})
    return found.withColumn(name, F.when(F.size(f"{name}_m") > 0, placed(F.col(f"{name}_m"), F.col(f"{name}_g")))
                            .otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))
                            ).drop(f"{name}_m", f"{name}_g")


def base_spans(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """``carry``, ``_text`` and one array of base spans for each kind."""
    rows = docs.select(*carry, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    for kind in KINDS:
        hint = F.contains("_text", F.lit("@")) if kind == "email" else F.col("_text").rlike(HINTS[kind])
        rows = matched(rows, f"_{kind}", "_text", PATTERNS[kind], hint)
        rows = rows.withColumn(f"_{kind}", only_valid(kind))
    return rows


def only_valid(kind: str) -> Column:
    return F.filter(f"_{kind}", lambda s: valid(kind, s["value"]))


def contexts(text: Column, start: Column, end: Column) -> Column:
    """The patterns that a span stands at: one word before it, two words, one word after it, lower-cased."""
    before = F.lower(F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT))))
    after = F.lower(F.substring(text, end + 1, F.lit(CONTEXT)))
    first, second, third = (F.regexp_extract(before, BEFORE, 2), F.regexp_extract(before, BEFORE, 1),
                            F.regexp_extract(after, AFTER, 1))
    return F.filter(F.array(
        F.when(first != "", F.concat(F.lit("<"), first)),
        F.when((first != "") & (second != ""), F.concat(F.lit("<"), second, F.lit(" "), first)),
        F.when(third != "", F.concat(F.lit(">"), third))), lambda p: p.isNotNull())


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return F.filter(spans, lambda t: (t["end"] > t["start"]) & ~F.exists(
        others, lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])))


def shape_of(value: Column) -> Column:
    """The kind whose shape an instance has, else ``other``."""
    digits = F.char_length(F.regexp_replace(value, "[^0-9]", ""))
    out = F.lit("other")
    for kind in reversed(KINDS):
        fits = value.rlike(SHAPES[kind])
        out = F.when(fits & digits.between(*DIGITS[kind]) if kind in DIGITS else fits, kind).otherwise(out)
    return out


def candidates(rows: DataFrame) -> DataFrame:
    """``_seen``: (kind, start, end, patterns, instance, seed) of all base spans and of all other identifiers."""
    with_tokens = matched(rows, "_token", "_text", TOKEN, F.col("_text").rlike("[0-9@]"))
    with_runs = matched(with_tokens, "_run", "_text", DIGIT_RUN, F.col("_text").rlike("[0-9]"))
    lead = r"^[^A-Za-z0-9+(]*"
    trimmed = F.transform("_token", lambda t: F.struct(
        (t["start"] + F.char_length(F.regexp_extract(t["value"], lead, 0))).alias("start"),
        F.regexp_replace(F.regexp_replace(t["value"], lead, ""), r"[^A-Za-z0-9]+$", "").alias("value")))
    spans = F.transform(trimmed, lambda t: F.struct(
        t["start"].alias("start"), (t["start"] + F.char_length(t["value"])).alias("end"), t["value"].alias("value")))
    cut = F.transform(F.filter("_run", lambda r: ~r["value"].rlike(NO_RUN)), lambda r: F.struct(
        r["start"].alias("start"), F.regexp_replace(r["value"], "[^0-9]++$", "").alias("value")))
    long_runs = F.filter(F.transform(cut, lambda r: F.struct(
        r["start"].alias("start"), (r["start"] + F.char_length(r["value"])).alias("end"), r["value"].alias("value"))),
        lambda r: F.char_length(F.regexp_replace(r["value"], "[^0-9]", "")).between(8, 19))
    rows = with_runs.withColumns({"_token": spans, "_run": long_runs}).withColumn(
        "_all", F.flatten(F.array(*(F.col(f"_{k}") for k in KINDS))))
    # Base spans come first, then runs of digits, then tokens.
    rows = rows.withColumn("_run", apart(F.col("_run"), F.col("_all")))
    rows = rows.withColumn("_token", apart(F.col("_token"), F.concat("_all", "_run")))

    def seen(kind: Column, s: Column, seed: bool) -> Column:
        return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                        contexts(F.col("_text"), s["start"], s["end"]).alias("patterns"),
                        F.lower(s["value"]).alias("instance"), F.lit(seed).alias("seed"))

    parts = [_seen_of(k, seen) for k in KINDS]
    return rows.withColumn("_seen", F.concat(*parts, F.transform(
        F.concat("_run", "_token"), lambda s: seen(shape_of(s["value"]), s, False)))).drop("_token", "_run", "_all")


def _seen_of(kind: str, seen) -> Column:
    return F.transform(f"_{kind}", lambda s: seen(F.lit(kind), s, True))


def met(rows: DataFrame, known: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """Rows left-joined with ``known`` (one row for a key); keys of very many rows are dealt by ``spread``."""
    asked = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
    return beside(rows, written(known.join(asked, keys), "known"), keys, spread)


def pattern_scores(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Good patterns ``(word, kind)`` and good instances ``(instance, kind)`` of the graph.

    ``edges``: distinct (word, kind, instance, seed).
    """
    scores = edges.groupBy("instance", "kind").agg(F.max("seed").cast("double").alias("score"))
    total = edges.groupBy("word").agg(F.count("*").alias("total"))
    patterns = None
    for _ in range(rounds):
        known = met(edges, scores, ["instance", "kind"], F.col("word")).groupBy("word", "kind").agg(
            F.sum("score").alias("known"))
        patterns = known.join(total, "word").withColumn("confidence", F.col("known") / F.col("total")).where(
            (F.col("known") >= MIN_SUPPORT) & (F.col("confidence") >= MIN_CONFIDENCE)).select("word", "kind", "confidence")
        scores = met(edges, patterns, ["word", "kind"], F.col("instance")).groupBy("instance", "kind").agg(
            F.max("seed").alias("seed"),
            F.sum(F.log1p(-F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.99)))).alias("missed")).select(
            "instance", "kind", F.when(F.col("seed"), F.lit(1.0)).otherwise(1 - F.exp("missed")).alias("score"))
    return patterns.select("word", "kind"), scores.where(F.col("score") >= MIN_SCORE).select("instance", "kind")


def find_personal(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """``carry``, the base spans of each kind, and ``_new``: spans (kind, start, end) that good patterns introduce."""
    arrays = [f"_{k}" for k in KINDS]
    rows = candidates(base_spans(docs, carry, text)).select(*carry, *arrays, "_seen").withColumn(
        "_row", F.monotonically_increasing_id())
    thin = written(rows, "personal")
    seen = thin.select("_row", F.explode("_seen").alias("s")).select(
        "_row", "s.kind", "s.start", "s.end", "s.instance", "s.seed", F.explode("s.patterns").alias("word"))
    edges = written(seen.groupBy("word", "kind", "instance").agg(F.max("seed").alias("seed")), "graph")
    patterns, instances = pattern_scores(edges)
    free = seen.where("not seed and kind <> 'other'")
    good = met(free, patterns.withColumn("_good", F.lit(True)), ["word", "kind"], F.col("_row")).where("_good").drop("_good")
    new = met(good, instances.withColumn("_good", F.lit(True)), ["instance", "kind"], F.col("_row")).where("_good")
    # A row's new spans are at most its tokens, which already stood together in one row.
    found = new.groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end"))).alias("_new"))
    return thin.drop("_seen").join(found, "_row", "left").drop("_row").withColumn(
        "_new", F.coalesce("_new", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")))


def described(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def all_spans(kind: str) -> Column:
    """Base and new spans of a kind, by start."""
    new = F.transform(F.filter("_new", lambda s: s["kind"] == F.lit(kind)),
                      lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    base = F.transform(f"_{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.array_sort(F.concat(base, new))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(common.table(spark, sf_dir, "documents"), ["doc_id"])

    def joined(parts: list[Column]) -> Column:
        return F.array_join(reduce(lambda a, b: F.concat(a, b), parts), ",")

    return found.select(
        "doc_id", *(F.size(f"_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined([described(k, F.col(f"_{k}")) for k in KINDS]), 256).alias("base_sha256"),
        joined([described(k, all_spans(k)) for k in KINDS]).alias("spans"))
