import pytest
from pyspark.sql import functions as F

from rankforge.functions import sequences as S, structures as M, text


def one(spark, value, make, name="s"):
    return spark.createDataFrame([(value,)], f"{name} STRING").select(make(F.col(name)).alias("x")).first()["x"]


def test_descriptors_by_hand(spark):
    row = spark.createDataFrame([("KWde",)], "sequence STRING").transform(S.add_descriptors).first()
    assert row["length"] == 4 and row["net_charge"] == -1 and row["net_charge_abs"] == 1
    assert row["hydrophobicity"] == pytest.approx((-3.9 - 0.9 - 3.5 - 3.5) / 4)
    assert row["aromatic_ratio"] == 0.25 and row["charge_balance"] == pytest.approx(0.25 - 0.5)
    assert row["sequence"] == "KWde"


def test_empty_sequence_has_no_features(spark):
    row = spark.createDataFrame([("",)], "sequence STRING").transform(S.featurize).first()
    assert all(v is None for k, v in row.asDict().items() if k != "sequence")


def test_known_peptide_properties(spark):
    row = spark.createDataFrame([("GG",), ("K",)], "sequence STRING").transform(S.featurize).collect()
    assert row[0]["molecular_weight"] == pytest.approx(2 * 75.0666 - 18.0153)
    assert row[0]["isoelectric_point"] == pytest.approx((7.5 + 3.55) / 2, abs=0.02)
    assert row[1]["charge_at_pH7"] == pytest.approx(1.0, abs=0.3)


def test_basic_set_ignores_histidine(spark):
    df = spark.createDataFrame([("HHK",), ("",)], "sequence STRING").transform(S.add_basic_descriptors)
    assert [(r["sequence"], r["net_charge"], r["polar_ratio"]) for r in df.collect()] == [("HHK", 1, 1.0)]


def test_one_hot_stops_at_fifty_and_skips_unknown(spark):
    cells = one(spark, "AX" + "C" * 60, S.one_hot_indices)
    assert (cells[0]["pos"], cells[0]["idx"]) == (0, 0)
    assert (cells[1]["pos"], cells[1]["idx"]) == (2, 1) and len(cells) == 49
    assert one(spark, "", S.one_hot_indices) == []


@pytest.mark.parametrize("smiles,ok", [
    ("c1ccccc1", True), ("CC(C)=O", True), ("C1CC", False), ("C(C", False), (")C(", False), ("", False),
    ("C%12CC%12", True), ("[O-]C", True), ("C C", False), ("()", False), ("C[N+](=O)[O-]", True),
])
def test_structure_validity(spark, smiles, ok):
    assert one(spark, smiles, M.is_valid_structure) is ok


def test_lexical_counts(spark):
    s = "NC(=O)NC(=O)N"
    assert one(spark, s, M.amide_count) == 4
    assert one(spark, "CCl", M.chain_length) == 1
    assert one(spark, "C" * 10, M.chain_length) == 3
    assert one(spark, "OC1=CC=C(O)C(CO)=C1", M.hydroxyl_count) == 3
    assert one(spark, "O=CC1=CC=CC=C1", M.hydroxyl_count) == 0
    assert one(spark, "NCCO", M.hbond_donors) == 2 and one(spark, "NCCO", M.hbond_acceptors) == 1
    assert one(spark, "C1CC", M.hbond_donors) == 0


def test_replace_first_and_counts(spark):
    assert one(spark, "aXbXc", lambda c: text.replace_first(c, F.lit("X"), F.lit("YY"))) == "aYYbXc"
    assert one(spark, "abc", lambda c: text.replace_first(c, F.lit("X"), F.lit("Y"))) == "abc"
    assert one(spark, "aaaa", lambda c: text.count_text(c, "aa")) == 2


def test_generated_sequences_follow_their_rules(spark):
    df = spark.range(200).select(
        S.random_sequence(F.col("id"), 10, 50).alias("r"), S.helical_sequence(F.col("id")).alias("h"))
    rows = df.collect()
    assert all(10 <= len(r["r"]) <= 50 and 15 <= len(r["h"]) <= 30 for r in rows)
    assert all(set(r["h"][:2]) <= set("RKH") for r in rows)
    assert rows == df.repartition(7).collect() or sorted(rows) == sorted(df.repartition(7).collect())


def test_all_features_equal_both_sets(spark):
    """F16: featurize is one Arrow function; odd texts give what the column expressions give."""
    texts = ["KWLKGLFKIASKKCK", "", None, "A", "m", "acdefghiklmnpqrstvwy", "GGGG", "XXBZ", "DKß?", "ÄK", "é", "KRHDECY" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, sequence STRING").repartition(2)
    together = S.featurize(df)
    native = S.add_extended_descriptors(S.add_descriptors(df))
    assert together.schema.simpleString() == native.select(*together.columns).schema.simpleString()
    assert set(together.columns) == set(native.columns) and "ArrowEvalPython" in together._jdf.queryExecution().toString()
    a, b = ({r["id"]: r.asDict() for r in x.collect()} for x in (together, native))
    for i in range(len(texts)):
        for c in together.columns:
            x, y = a[i][c], b[i][c]
            assert x == y or (x is not None and y is not None and x == pytest.approx(y, rel=1e-12, abs=1e-12)), (texts[i], c, x, y)
