import math

import pytest
from pyspark.sql import functions as F

from rankforge.operators import joins, ranking, scoring, toplists
from rankforge.operators.cleaning import keep_first
from rankforge.sources.tables import normalize_nan

MOL = "smiles STRING, MW DOUBLE, LogP DOUBLE, probability_active DOUBLE"


def test_unknown_values_count_as_false(spark):
    df = normalize_nan(spark.createDataFrame(
        [("a", float("nan"), float("nan"), 0.5), ("b", None, None, 0.5), ("c", 300.0, 2.0, 0.5)], MOL))
    got = {r["smiles"]: r["druglikeness_score"] for r in scoring.score_category(df, "repurposed").collect()}
    assert got["a"] == got["b"] == 0.5 and math.isclose(got["c"], 1.0)


def test_missing_columns_use_defaults(spark):
    row = scoring.score_category(spark.createDataFrame([("a",)], "smiles STRING"), "protac").first()
    assert (row["activity_score"], row["druglikeness_score"]) == (0.5, 0.5)
    assert row["composite_score"] == pytest.approx(0.5)


def test_unknown_category_is_an_error(spark):
    with pytest.raises(ValueError):
        scoring.score_category(spark.createDataFrame([("a",)], "smiles STRING"), "other")


def test_peptide_rules(spark):
    df = spark.createDataFrame([(20, 0.4, -3, 0.1), (50, 0.7, 0, 0.5)],
                               "length INT, hydrophobic_ratio DOUBLE, net_charge INT, aromatic_ratio DOUBLE")
    got = [r["s"] for r in df.select(scoring.peptide_druglikeness(df).alias("s")).collect()]
    assert got == [1.0, 0.5]


def test_rank_categories_sizes_order_and_scale(spark):
    a = spark.createDataFrame([(f"s{i}", 300.0, 1.0, i / 100) for i in range(100)], MOL)
    b = a.select("smiles", "MW", (F.col("probability_active") / 2).alias("probability_active"))
    out = ranking.rank_categories({"repurposed": a, "protac": b}, {"protac": 1.3}, 10)
    rows = out.collect()
    assert len(rows) == 20
    assert [r["final_score"] for r in rows] == sorted((r["final_score"] for r in rows), reverse=True)
    assert max(r["normalized_activity"] for r in rows) == 1.0
    assert {r["LogP"] for r in rows if r["category"] == "protac"} == {None}


def test_no_activity_gives_zero(spark):
    a = spark.createDataFrame([("x", 300.0, 1.0, 0.0)], MOL)
    row = ranking.rank_categories({"repurposed": a}).first()
    assert row["normalized_activity"] == 0.0 and row["final_score"] == 0.0


def test_ties_do_not_depend_on_partitions(spark):
    a = spark.createDataFrame([(f"s{i:03d}", 300.0, 1.0, 0.5) for i in range(60)], MOL)
    first = [r["smiles"] for r in ranking.rank_categories({"repurposed": a}, None, 7).collect()]
    again = [r["smiles"] for r in ranking.rank_categories({"repurposed": a.repartition(9)}, None, 7).collect()]
    assert first == again == [f"s{i:03d}" for i in range(7)]


def test_hot_keys_in_first_and_top_rows(spark):
    df = spark.range(6000).withColumn("key", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))
    first = keep_first(df, ["key"], ["id"])
    assert first.count() == 4001 and first.filter("key = 0").first()["id"] == 0
    group = df.withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise("cold"))
    for k in (5, 1500):
        top = toplists.top_per_group(group, ["g"], [F.desc("id")], k)
        hot = [r["id"] for r in top.filter("g = 'hot'").collect()]
        assert sorted(hot, reverse=True) == [5997 - 3 * i for i in range(k)]


def test_group_limit_runs_before_the_shuffle(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 2)
    plan = toplists.top_per_group(df, ["g"], [F.desc("id")], 5)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("small", [True, False])
def test_pair_up_gives_the_whole_product(spark, monkeypatch, small):
    monkeypatch.setattr(joins, "fits_broadcast", lambda *a: small)
    left = spark.createDataFrame([(i % 4,) for i in range(12)], "a INT")
    right = spark.createDataFrame([(i % 3,) for i in range(9)], "b INT")
    got = joins.pair_up(left, right, 4)
    assert got.count() == 108
    assert {(r["a"], r["b"]): r["n"] for r in got.groupBy("a", "b").agg(F.count("*").alias("n")).collect()} == {
        (a, b): 9 for a in range(4) for b in range(3)}


def test_attach_hits_is_a_full_outer_join(spark):
    p = spark.createDataFrame([(1, 0.1), (1, 0.2), (2, 0.3)], "k INT, p DOUBLE")
    h = spark.createDataFrame([(1, 0.9), (5, 0.8)], "k INT, s DOUBLE")
    got = sorted(map(tuple, joins.attach_hits(p, h, "k").collect()), key=str)
    expected = sorted(map(tuple, p.join(h, "k", "full_outer").collect()), key=str)
    assert got == expected


def test_reactant_example(spark):
    ald = spark.createDataFrame([("Benzaldehyde", "O=CC1=CC=CC=C1"), ("Salicylaldehyde", "O=CC1=CC=CC=C1O")], "name STRING, smiles STRING")
    amine = spark.createDataFrame([("Aniline", "NC1=CC=CC=C1"), ("p-Toluidine", "NC1=CC=C(C=C1)C")], "name STRING, smiles STRING")
    rows = joins.imines(ald, amine).collect()
    assert len(rows) == 4
    assert {r["product"] for r in rows if r["aldehyde"] == "Benzaldehyde" and r["amine"] == "Aniline"} == {
        "C(=NC1=CC=CC=C1)C1=CC=CC=C1"}
