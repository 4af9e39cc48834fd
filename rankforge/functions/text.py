"""Scalar building blocks: indicators, clamps, literal text operations, hashed choices."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rankforge.config import SEED


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def indicator(cond: Column) -> Column:
    """1.0 where the condition holds, else 0.0; an unknown condition counts as false."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def clamp(c: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it.

    A column that is repeated inside a lambda would be computed again for every element.
    """
    return F.get(F.transform(F.array(value), use), 0)


def count_letter(c: Column, letter: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(letter), F.lit("")))


def count_letters(c: Column, letters: str) -> Column:
    """How many characters of ``c`` are among ``letters``."""
    return add_all([count_letter(c, a) for a in letters])


def count_text(c: Column, piece: str) -> Column:
    """Non-overlapping occurrences of a literal piece, as in ``str.count``."""
    removed = F.length(c) - F.length(F.replace(c, F.lit(piece), F.lit("")))
    return (removed / len(piece)).cast("int")


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def replace_first(c: Column, target: Column, replacement: Column) -> Column:
    """Replace the first occurrence only; unchanged when the target is absent."""
    at = F.position(target, c)
    return F.when(at > 0, F.overlay(c, replacement, at, F.length(target))).otherwise(c)


def first_part(c: Column, separator: str = ".") -> Column:
    return F.substring_index(c, separator, 1)


def last_part(c: Column, separator: str = ".") -> Column:
    return F.substring_index(c, separator, -1)


def hash_number(*parts, seed: int = SEED) -> Column:
    """A 32-bit number that depends only on the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_choice(n: int, *parts, seed: int = SEED) -> Column:
    """A number in [0, n) that depends only on the seed and the parts."""
    return hash_number(*parts, seed=seed) % F.lit(n)


def hash_uniform(low: float, high: float, *parts, seed: int = SEED) -> Column:
    """A number in [low, high) that depends only on the seed and the parts."""
    return F.lit(low) + hash_number(*parts, seed=seed) / F.lit(4294967296.0) * (high - low)


def pick_letter(letters: str, number: Column) -> Column:
    return F.substr(F.lit(letters), (number % len(letters) + 1).cast("int"), F.lit(1))


def add_all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def normalize_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column, so that comparisons with it are false."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floats}) if floats else df
