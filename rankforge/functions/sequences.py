"""Peptide features as native column expressions; all of them together as one Arrow function."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rankforge import config as C
from rankforge.functions.text import (
    add_all, bind, count_letter, hash_choice, hash_number, pick_letter, replace_first,
)

DESCRIPTORS = [
    "length", "hydrophobicity", "net_charge", "avg_volume", "hydrophobic_ratio",
    "hydrophilic_ratio", "positive_ratio", "negative_ratio", "aromatic_ratio",
    "charge_density", "net_charge_abs", "charge_balance",
]
EXTENDED = [
    "molecular_weight", "aromaticity", "isoelectric_point", "gravy", "charge_at_pH7",
    "charge_at_pH5", "helix_frac", "turn_frac", "sheet_frac",
] + [f"aa_{a}_ratio" for a in C.AMINO_ACIDS]


def clean_sequence(c: Column) -> Column:
    """Upper-case and keep only the twenty residue letters."""
    return F.regexp_replace(F.upper(c), f"[^{C.AMINO_ACIDS}]+", "")


def _count(letter: str) -> str:
    return f"_n_{letter}"


def _with_counts(df: DataFrame, sequence: str) -> DataFrame:
    """Add the upper-cased text and one count per residue letter as working columns."""
    df = df.withColumn("_s", F.upper(F.col(sequence)))
    return df.withColumns(
        {_count(a): count_letter(F.col("_s"), a) for a in C.AMINO_ACIDS}
        | {"_len": F.length("_s")}
    )


def _drop_counts(df: DataFrame) -> DataFrame:
    return df.drop("_s", "_len", *[_count(a) for a in C.AMINO_ACIDS])


def _sum_counts(letters: str) -> Column:
    return add_all([F.col(_count(a)) for a in letters])


def _weighted(table: dict[str, float]) -> Column:
    return add_all([F.col(_count(a)) * F.lit(float(v)) for a, v in table.items()])


def _per_residue(total: Column) -> Column:
    """Share of the sequence length; null for an empty sequence."""
    return F.when(F.col("_len") > 0, total / F.col("_len"))


def _descriptor_columns() -> dict[str, Column]:
    positive, negative = _sum_counts(C.POSITIVE), _sum_counts(C.NEGATIVE)
    charge = F.when(F.col("_len") > 0, positive - negative)
    balance = F.when(positive + negative > 0, _per_residue(positive) - _per_residue(negative))
    return {
        "length": F.when(F.col("_len") > 0, F.col("_len")),
        "hydrophobicity": _per_residue(_weighted(C.HYDROPATHY)),
        "net_charge": charge,
        "avg_volume": _per_residue(_weighted(C.VOLUME)),
        "hydrophobic_ratio": _per_residue(_sum_counts(C.HYDROPHOBIC)),
        "hydrophilic_ratio": _per_residue(_sum_counts(C.HYDROPHILIC)),
        "positive_ratio": _per_residue(positive),
        "negative_ratio": _per_residue(negative),
        "aromatic_ratio": _per_residue(_sum_counts(C.AROMATIC)),
        "charge_density": _per_residue(positive - negative),
        "net_charge_abs": F.abs(charge),
        "charge_balance": F.when(F.col("_len") > 0, F.coalesce(balance, F.lit(0.0))),
    }


def add_descriptors(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Twelve physicochemical descriptors; all null when the sequence is empty."""
    return _drop_counts(_with_counts(df, sequence).withColumns(_descriptor_columns()))


def add_basic_descriptors(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """The smaller descriptor set: charge without histidine, a polar share, empty rows dropped.

    The sequence comes back upper-cased.
    """
    counted = _with_counts(df, sequence).filter("_len > 0")
    charge = _sum_counts("RK") - _sum_counts("DE")
    out = counted.withColumns({
        "length": F.col("_len"),
        "hydrophobicity": _per_residue(_weighted(C.HYDROPATHY)),
        "net_charge": charge,
        "hydrophobic_ratio": _per_residue(_sum_counts(C.HYDROPHOBIC)),
        "aromatic_ratio": _per_residue(_sum_counts(C.AROMATIC)),
        "polar_ratio": _per_residue(_sum_counts(C.BASIC_POLAR)),
        "charge_density": _per_residue(charge),
        sequence: F.col("_s"),
    })
    return _drop_counts(out)


def _terminal_k(default: float, table: dict[str, float], residue: Column) -> Column:
    """10^pK of a terminal group, which depends on the residue there."""
    k = F.lit(10.0 ** default)
    for letter, pk in table.items():
        k = F.when(residue == letter, F.lit(10.0 ** pk)).otherwise(k)
    return k


def _charge(t: Column) -> Column:
    """Net charge by the Henderson-Hasselbalch relation at t = 10^pH.

    With K = 10^pK a basic group carries K / (K + t) and an acidic one -t / (K + t).
    """
    basic = [(F.col(_count(a)), F.lit(10.0 ** pk)) for a, pk in C.PK_POSITIVE.items()]
    acidic = [(F.col(_count(a)), F.lit(10.0 ** pk)) for a, pk in C.PK_NEGATIVE.items()]
    basic.append((F.lit(1), F.col("_k_n")))
    acidic.append((F.lit(1), F.col("_k_c")))
    return add_all([n * k / (k + t) for n, k in basic]) - add_all(
        [n * t / (k + t) for n, k in acidic])


def _isoelectric_point(steps: int = 17) -> Column:
    """pH of zero charge inside the usual range by interval halving, to two decimals."""
    low, high = C.PI_RANGE
    widths = [(high - low) / 2 ** i for i in range(1, steps + 1)]

    def halve(lower: Column, width: Column) -> Column:
        charge = bind(F.pow(F.lit(10.0), lower + width), _charge)
        return F.when(charge > 0, lower + width).otherwise(lower)

    return F.aggregate(
        F.array(*[F.lit(w) for w in widths]), F.lit(low), halve,
        lambda lower: F.round(lower + widths[-1] / 2, 2),
    )


def _extended_columns(helix: str, turn: str, sheet: str) -> dict[str, Column]:
    present = F.col("_len") > 0
    total = _sum_counts(C.AMINO_ACIDS)
    shares = {
        f"aa_{a}_ratio": F.when(
            present, F.coalesce(F.try_divide(F.col(_count(a)), total), F.lit(0.0)))
        for a in C.AMINO_ACIDS
    }
    return {
        "length": F.when(present, F.col("_len")),
        "molecular_weight": F.when(
            present, _weighted(C.AMINO_ACID_MASS) - F.lit(C.WATER_MASS) * (F.col("_len") - 1)),
        "aromaticity": _per_residue(_sum_counts(C.AROMATIC)),
        "isoelectric_point": F.when(present, _isoelectric_point()),
        "gravy": _per_residue(_weighted(C.HYDROPATHY)),
        "charge_at_pH7": F.when(present, _charge(F.lit(10.0 ** 7))),
        "charge_at_pH5": F.when(present, _charge(F.lit(10.0 ** 5))),
        "helix_frac": _per_residue(_sum_counts(helix)),
        "turn_frac": _per_residue(_sum_counts(turn)),
        "sheet_frac": _per_residue(_sum_counts(sheet)),
    } | shares


def _with_terminal_k(counted: DataFrame) -> DataFrame:
    first, last = F.substring("_s", 1, 1), F.substring("_s", -1, 1)
    return counted.withColumns({
        "_k_n": _terminal_k(C.PK_N_TERMINUS, C.PK_N_TERMINUS_BY_RESIDUE, first),
        "_k_c": _terminal_k(C.PK_C_TERMINUS, C.PK_C_TERMINUS_BY_RESIDUE, last),
    })


def add_extended_descriptors(
    df: DataFrame, sequence: str = "sequence", helix: str = C.HELIX, turn: str = C.TURN,
    sheet: str = C.SHEET,
) -> DataFrame:
    """Mass, charge curve, isoelectric point, structure shares and composition ratios.

    Expects cleaned sequences. The helix, turn and sheet letters are parameters because
    published sets differ.
    """
    counted = _with_terminal_k(_with_counts(df, sequence))
    return _drop_counts(
        counted.withColumns(_extended_columns(helix, turn, sheet))).drop("_k_n", "_k_c")


def _letters(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts of every residue letter, and the length, first and last byte of every text; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    number = np.full(256, len(C.AMINO_ACIDS), np.int64)
    number[[ord(a) for a in C.AMINO_ACIDS]] = np.arange(len(C.AMINO_ACIDS))
    kinds = len(C.AMINO_ACIDS) + 1
    cells = np.repeat(np.arange(n) * kinds, np.diff(ends)) + number[flat]
    counts = np.ascontiguousarray(np.bincount(cells, minlength=n * kinds).reshape(n, kinds).T).astype(np.int32)
    padded = np.concatenate([flat, np.zeros(1, np.uint8)])
    length = pc.utf8_length(texts).to_numpy().astype(np.int32)
    return dict(zip(C.AMINO_ACIDS, counts)), length, padded[ends[:-1]], padded[ends[1:] - 1]


def _terminal_table(default: float, table: dict[str, float]) -> np.ndarray:
    """10^pK by the byte of the residue."""
    k = np.full(256, 10.0 ** default)
    for letter, pk in table.items():
        k[ord(letter)] = 10.0 ** pk
    return k


INTEGERS = ("length", "net_charge", "net_charge_abs")
FEATURES = T.StructType([
    T.StructField(name, T.IntegerType() if name in INTEGERS else T.DoubleType()) for name in DESCRIPTORS + EXTENDED])


@F.arrow_udf(FEATURES)
def _all_features(texts: pa.Array) -> pa.Array:
    """The columns of ``add_descriptors`` and ``add_extended_descriptors`` for upper-cased texts, the point of zero charge unrounded.

    As one expression of some forty columns they make a method that the JVM does not compile.
    """
    counts, length, first, last = _letters(texts)
    present = length > 0
    size = np.where(present, length, 1)
    k_n = _terminal_table(C.PK_N_TERMINUS, C.PK_N_TERMINUS_BY_RESIDUE)[first]
    k_c = _terminal_table(C.PK_C_TERMINUS, C.PK_C_TERMINUS_BY_RESIDUE)[last]

    def total(letters: str) -> np.ndarray:
        return sum(counts[a] for a in letters)

    def weighted(table: dict[str, float]) -> np.ndarray:
        return sum(counts[a] * float(v) for a, v in table.items())

    basic = [(counts[a], 10.0 ** pk) for a, pk in C.PK_POSITIVE.items()] + [(1, k_n)]
    acidic = [(counts[a], 10.0 ** pk) for a, pk in C.PK_NEGATIVE.items()] + [(1, k_c)]

    def charge_at(t) -> np.ndarray:
        return sum(n * k / (k + t) for n, k in basic) - sum(n * t / (k + t) for n, k in acidic)

    low, high = C.PI_RANGE
    lower = np.full(len(length), low)
    for i in range(1, 18):
        middle = lower + (high - low) / 2 ** i
        lower = np.where(charge_at(np.power(10.0, middle)) > 0, middle, lower)

    positive, negative = total(C.POSITIVE), total(C.NEGATIVE)
    hydropathy = weighted(C.HYDROPATHY) / size
    known = total(C.AMINO_ACIDS)
    values = {
        "length": length,
        "hydrophobicity": hydropathy,
        "net_charge": positive - negative,
        "avg_volume": weighted(C.VOLUME) / size,
        "hydrophobic_ratio": total(C.HYDROPHOBIC) / size,
        "hydrophilic_ratio": total(C.HYDROPHILIC) / size,
        "positive_ratio": positive / size,
        "negative_ratio": negative / size,
        "aromatic_ratio": total(C.AROMATIC) / size,
        "charge_density": (positive - negative) / size,
        "net_charge_abs": np.abs(positive - negative),
        "charge_balance": positive / size - negative / size,
        "molecular_weight": weighted(C.AMINO_ACID_MASS) - C.WATER_MASS * (length - 1),
        "aromaticity": total(C.AROMATIC) / size,
        "isoelectric_point": lower + (high - low) / 2 ** 18,
        "gravy": hydropathy,
        "charge_at_pH7": charge_at(10.0 ** 7),
        "charge_at_pH5": charge_at(10.0 ** 5),
        "helix_frac": total(C.HELIX) / size,
        "turn_frac": total(C.TURN) / size,
        "sheet_frac": total(C.SHEET) / size,
    } | {f"aa_{a}_ratio": counts[a] / np.maximum(known, 1) for a in C.AMINO_ACIDS}
    return pa.StructArray.from_arrays(
        [pa.array(values[c], pa.int32() if c in INTEGERS else pa.float64(), mask=~present) for c in FEATURES.names],
        FEATURES.names)


def featurize(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """All peptide features of one sequence; the letters are counted once for both sets."""
    made = df.withColumn("_features", _all_features(F.upper(F.col(sequence))))
    columns = {name: F.col("_features")[name] for name in FEATURES.names}
    columns["isoelectric_point"] = F.round(columns["isoelectric_point"], 2)
    return made.withColumns(columns).drop("_features")


def one_hot_indices(c: Column, max_length: int = 50) -> Column:
    """Sparse one-hot positions ``position * 20 + letter`` of the first residues.

    Cutting at ``max_length`` is the definition of the encoding; unknown letters give no entry.
    """
    letters = F.lit(C.AMINO_ACIDS)
    places = F.sequence(F.lit(0), F.least(F.length(c), F.lit(max_length)) - 1)
    index = F.transform(
        places,
        lambda i: F.struct(
            i.alias("pos"),
            (F.position(F.substr(c, i + 1, F.lit(1)), letters) - 1).alias("idx"),
        ),
    )
    known = F.filter(index, lambda x: x["idx"] >= 0)
    return F.when(F.length(c) > 0, known).otherwise(F.filter(index, lambda x: F.lit(False)))


def random_sequence(row_id: Column, min_length: int = 10, max_length: int = 50, **kw) -> Column:
    """A random sequence for a row: uniform length, uniform letters."""
    length = hash_choice(max_length - min_length + 1, row_id, F.lit("len"), **kw) + min_length
    places = F.sequence(F.lit(1), length.cast("int"))
    return F.array_join(
        F.transform(places, lambda i: pick_letter(C.AMINO_ACIDS, hash_number(row_id, i, **kw))),
        "",
    )


def helical_sequence(row_id: Column, hydrophobic_share: float = 0.4, **kw) -> Column:
    """15-30 letters: 2-5 positive, then a hydrophobic share of the length, then any."""
    length = (hash_choice(16, row_id, F.lit("len"), **kw) + 15).cast("int")
    n_positive = (hash_choice(4, row_id, F.lit("pos"), **kw) + 2).cast("int")

    def letters(length: Column, n_positive: Column) -> Column:
        n_hydrophobic = F.floor(length * F.lit(hydrophobic_share)).cast("int")

        def letter(i: Column) -> Column:
            number = hash_number(row_id, i, **kw)
            return (
                F.when(i <= n_positive, pick_letter(C.POSITIVE, number))
                .when(i <= n_positive + n_hydrophobic, pick_letter(C.HYDROPHOBIC, number))
                .otherwise(pick_letter(C.AMINO_ACIDS, number))
            )

        return F.array_join(F.transform(F.sequence(F.lit(1), length), letter), "")

    return bind(F.struct(length.alias("length"), n_positive.alias("n_positive")),
                lambda drawn: letters(drawn["length"], drawn["n_positive"]))


def cyclic_sequence(c: Column) -> Column:
    """Replace both ends by cysteine when there are more than three letters."""
    inner = F.substr(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))
    return F.when(F.length(c) > 3, F.concat(F.lit("C"), inner, F.lit("C"))).otherwise(c)


def mutate_motif(c: Column, row_id: Column, **kw) -> Column:
    """For each residue letter present at its turn, replace its first occurrence at random."""
    letters = F.array(*[F.lit(a) for a in C.AMINO_ACIDS])
    return F.aggregate(
        letters, c,
        lambda acc, letter: replace_first(
            acc, letter, pick_letter(C.AMINO_ACIDS, hash_number(row_id, letter, **kw))),
    )


def fill_wildcards(c: Column, row_id: Column, **kw) -> Column:
    """Replace every ``X`` by a random residue letter."""
    filled = F.transform(
        F.split(c, ""),
        lambda letter, i: F.when(
            letter == "X", pick_letter(C.AMINO_ACIDS, hash_number(row_id, i, **kw))
        ).otherwise(letter),
    )
    return F.array_join(filled, "")
