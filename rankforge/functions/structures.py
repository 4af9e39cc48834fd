"""Features read from structure text (SMILES).

Toolkit values such as molecular weight or LogP arrive as columns of a descriptor table.  What
is computed here is lexical: it looks at the tokens of the text and does not build a molecule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankforge import config as C
from rankforge.functions.text import (
    bind, count_letters, count_matches, count_text, hash_choice, replace_first,
)

ATOM = r"\[[^\]]+\]|Br|Cl|[BCNOPSFIbcnops]"
TOKEN = ATOM + r"|%[0-9][0-9]|[0-9]|[()=#./\\:~*$+-]"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def atoms(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(ATOM), F.lit(0))


def _balanced(outside: Column) -> Column:
    """Parentheses close in order and none stays open."""
    steps = F.split(F.regexp_replace(outside, r"[^()]", ""), "")
    depth = F.aggregate(
        steps, F.lit(0),
        lambda d, ch: F.when(d < 0, d).when(ch == "(", d + 1).when(ch == ")", d - 1).otherwise(d),
    )
    return depth == 0


def _rings_closed(outside: Column) -> Column:
    """Every ring label occurs an even number of times."""
    found = F.regexp_extract_all(outside, F.lit(r"%[0-9][0-9]|[0-9]"), F.lit(0))
    return bind(found, lambda labels: F.forall(
        F.array_distinct(labels),
        lambda x: F.size(F.filter(labels, lambda y: y == x)) % 2 == 0))


def is_valid_structure(c: Column) -> Column:
    """Lexical validity: known tokens only, balanced parentheses, paired ring labels."""
    known = F.length(F.array_join(tokens(c), "")) == F.length(c)
    shape = bind(
        F.regexp_replace(c, r"\[[^\]]*\]", ""), lambda o: _balanced(o) & _rings_closed(o))
    return F.coalesce(F.length(c) > 0, F.lit(False)) & c.rlike(ATOM) & known & shape


def amide_count(c: Column) -> Column:
    """Both spellings of the amide group are counted and may overlap each other."""
    return count_text(c, "C(=O)N") + count_text(c, "NC(=O)")


def chain_length(c: Column) -> Column:
    """A third of the upper-case C, N, O, P and S letters, at least 1."""
    return F.greatest(F.lit(1), F.floor(count_letters(c, "CNOPS") / 3).cast("int"))


def branching_index(c: Column) -> Column:
    """Share of atoms written with a branch or ring bond right after them (approximation)."""
    forks = count_matches(c, rf"(?:{ATOM})(?:[0-9(]|%[0-9][0-9])")
    return F.coalesce(F.try_divide(forks, F.size(atoms(c))), F.lit(0.0))


def hydroxyl_count(c: Column) -> Column:
    """Oxygen atoms written so that they carry a hydrogen (approximation).

    Counted are an ``O`` before a closing parenthesis, a dot or the end unless it is double
    bonded, an ``O`` that starts a part and is followed by an atom, and ``[OH...]``.
    """
    ends = count_text(c, "O)") - count_text(c, "=O)") + count_text(c, "O.") - count_text(c, "=O.")
    last = F.when(F.endswith(c, F.lit("O")) & ~F.endswith(c, F.lit("=O")), 1).otherwise(0)
    starts = count_matches(c, r"(?:^|\.)O[A-Za-z(\[]")
    return ends + last + starts + count_matches(c, r"\[OH")


def _nitrogen_count(c: Column) -> Column:
    plain = F.filter(atoms(c), lambda a: a.rlike(r"^(N|n|\[[0-9]*[Nn]([^a-z].*)?\])$"))
    return F.size(plain)


def _oxygen_count(c: Column) -> Column:
    plain = F.filter(atoms(c), lambda a: a.rlike(r"^(O|o|\[[0-9]*[Oo]([^a-z].*)?\])$"))
    return F.size(plain)


def hbond_donors(c: Column) -> Column:
    """Every nitrogen plus each oxygen with a hydrogen; 0 for an invalid structure."""
    return F.when(is_valid_structure(c), _nitrogen_count(c) + hydroxyl_count(c)).otherwise(0)


def hbond_acceptors(c: Column) -> Column:
    """Every nitrogen plus each oxygen without a hydrogen; 0 for an invalid structure."""
    return F.when(
        is_valid_structure(c), _nitrogen_count(c) + _oxygen_count(c) - hydroxyl_count(c)
    ).otherwise(0)


def solubility_estimate(logp: Column, tpsa: Column) -> Column:
    return F.lit(-0.65) * logp + F.lit(0.07) * tpsa + F.lit(0.66)


def scaffold_key(c: Column) -> Column:
    """The structure text without stereo marks."""
    return F.regexp_replace(c, r"[@/\\]", "")


def _runs(items: Column, n: int) -> Column:
    """All runs of n neighbouring tokens as texts; empty when there are fewer tokens."""
    starts = F.sequence(F.lit(1), F.size(items) - (n - 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(items, i, n), " "))
    return F.when(F.size(items) >= n, runs).otherwise(F.slice(items, 1, 0))


def token_grams(items: Column, longest: int = 3) -> Column:
    """All runs of 1 to ``longest`` neighbouring tokens, distinct."""
    return F.array_distinct(F.concat(*[_runs(items, n) for n in range(1, longest + 1)]))


def hashed_bits(items: Column, n_bits: int = 1024) -> Column:
    """Distinct bit numbers of a set of texts."""
    return F.array_distinct(F.transform(
        items,
        lambda x: (F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("bigint") % n_bits)
        .cast("int")))


def token_bits(c: Column, n_bits: int = 1024, longest: int = 3) -> Column:
    """Hashed fingerprint of a valid structure as sorted set bits."""
    return F.sort_array(
        bind(tokens(c), lambda t: hashed_bits(token_grams(t, longest), n_bits)))


def structure_bits(c: Column, n_bits: int = 1024, longest: int = 3) -> Column:
    """The same, and null when the structure is invalid."""
    return F.when(is_valid_structure(c), token_bits(c, n_bits, longest))


def structure_keys(c: Column, patterns: list[str] | None = None) -> Column:
    """Numbers of the key patterns found in the structure."""
    patterns = C.STRUCTURE_KEYS if patterns is None else patterns
    return F.array_compact(
        F.array(*[F.when(c.rlike(p), F.lit(i)) for i, p in enumerate(patterns)])
    )


def add_solubility_features(df: DataFrame, structure: str = "smiles") -> DataFrame:
    """Hydroxyl count and solubility estimate next to the LogP and TPSA columns."""
    return df.withColumns({
        "NumPhenolicOH": hydroxyl_count(F.col(structure)),
        "LogS_estimate": solubility_estimate(F.col("LogP"), F.col("TPSA")),
    })


def add_degrader_features(df: DataFrame, structure: str = "smiles") -> DataFrame:
    """Amide bonds, chain length and branching from the structure text."""
    c = F.col(structure)
    return df.withColumns({
        "NumAmideBonds": amide_count(c),
        "ChainLength": chain_length(c),
        "BranchingIndex": branching_index(c),
    })


def apply_rules(c: Column, rules: Column, k: Column) -> Column:
    """Apply the first ``k`` of an array of rules, each to its first occurrence."""
    return F.aggregate(
        F.slice(rules, F.lit(1), k), c,
        lambda acc, rule: replace_first(acc, rule["target"], rule["replacement"]),
    )


def shuffled_rules(rules: list[tuple[str, str]], *parts, **kw) -> Column:
    """The rules in a random order that depends on the parts only."""
    entries = [
        F.struct(
            hash_choice(4294967296, *parts, F.lit(f"rule{i}"), **kw).alias("h"),
            F.lit(i).alias("i"),
            F.lit(target).alias("target"),
            F.lit(replacement).alias("replacement"),
        )
        for i, (target, replacement) in enumerate(rules)
    ]
    return F.sort_array(F.array(*entries))


def add_structure_record(df: DataFrame, structure: str = "smiles") -> DataFrame:
    """Set bits of the 1,024-bit fingerprint and the found keys next to a row's descriptors."""
    c = F.col(structure)
    return df.withColumns({"bits": structure_bits(c), "keys": structure_keys(c)})
