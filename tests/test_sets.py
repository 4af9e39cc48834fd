import pytest
from pyspark.sql import functions as F

from rankforge import config as C
from rankforge.functions.structures import add_structure_record, is_valid_structure
from rankforge.operators import generation as G, joins, ranking


def test_training_sets_of_the_structure_categories(spark):
    drugs = G.repurposed_training(spark).groupBy("activity").count().collect()
    assert {r["activity"]: r["count"] for r in drugs} == {1: len(C.NATURAL_PRODUCTS) + len(C.KNOWN_ACTIVES), 0: 60}
    few = G.repurposed_training(spark, 20)
    assert few.count() == 20 and few.filter("activity = 1").count() == min(20, len(C.NATURAL_PRODUCTS) + len(C.KNOWN_ACTIVES))
    hybrids = G.hybrid_training(spark, 5000, 50)
    assert hybrids.filter("activity = 1").count() <= 50 * len(C.STARTING_POINTS) and hybrids.filter("activity = 0").count() == 30
    degraders = G.degrader_training(spark)
    heads = {r["smiles"] for r in degraders.filter("activity = 1").collect()}
    assert len(heads) > 3 and degraders.filter("activity = 0").count() == 60
    for rows in (hybrids, degraders):
        assert rows.filter(~is_valid_structure(F.col("smiles"))).count() == 0
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, rows.collect()))


def test_structure_record(spark):
    rows = spark.createDataFrame([("CCO", 46.0), ("C(", 1.0)], "smiles STRING, MW DOUBLE")
    got = {r["smiles"]: r for r in add_structure_record(rows).collect()}
    assert got["CCO"]["MW"] == 46.0 and max(got["CCO"]["bits"]) < 1024 and got["CCO"]["keys"]
    assert got["C("]["bits"] is None


def test_right_rows_win_with_their_nulls(spark):
    left = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "k STRING, x DOUBLE, y DOUBLE")
    right = spark.createDataFrame([("a", None, 5), ("c", 6.0, 7)], "k STRING, x DOUBLE, z INT")
    got = sorted(tuple(r) for r in joins.merge_features(left, right, "k").select("k", "x", "y", "z").collect())
    assert got == [("a", None, 2.0, 5), ("b", 3.0, 4.0, None), ("c", 6.0, None, 7)]


def test_nan_counts_as_missing_in_rankings(spark):
    columns = "smiles STRING, MW DOUBLE, LogP DOUBLE, TPSA DOUBLE, probability_active DOUBLE"
    nan = float("nan")
    rows = [("a", 300.0, 2.0, 80.0, 0.9), ("b", nan, nan, nan, nan), ("c", 300.0, 2.0, 80.0, 0.5)]
    plain = [tuple(None if v != v else v for v in r) for r in rows]
    rank = lambda data: [tuple(r) for r in ranking.rank_categories(
        {"repurposed": spark.createDataFrame(data, columns)}).select("smiles", "normalized_activity", "final_score").collect()]
    got = rank(rows)
    assert got == rank(plain) and got[0][0] == "a" and got[0][1] == pytest.approx(1.0)
