"""Small documents with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", str(rng.randint(0, 99)) + "x", "é", "."]) for _ in range(n))


def rows(extra: list[str] = (), seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    texts += [None, "", " \t\n", texts[0], texts[0], "Word", "A b", "ÀÉ ß ﬀ 漢字 🙂  x", *extra, prose(rng, 30000)]
    out = [(i, t, rng.choice(["en", None]), rng.choice(["src0", None]), None if t is None else len(t))
           for i, t in enumerate(texts)]
    out += [(None, texts[1], None, None, None), (None, None, None, None, None), out[2], out[2]]
    return out


def docs(spark, extra: list[str] = (), seed: int = 3):
    return spark.createDataFrame(rows(extra, seed), DOCS).repartition(5)


def clashing(spark, extra: list[str] = ()):
    """The documents with further columns named like ones the operators use inside."""
    table = docs(spark, extra)
    names = ["_spans", "_items", "_n_words", "_fp", "_digest", "_root", "_row", "c0", "c1", "ids", "score", "slot", "key",
             "label", "spans", "_set", "_text", "component_id"]
    return table.select("*", *(table["lang"].alias(n) for n in names))


def empty(spark):
    return spark.createDataFrame([], DOCS)


def as_folder(path, **tables) -> str:
    """A folder with the given tables, as the queries read it."""
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}.parquet")
    return str(path)
