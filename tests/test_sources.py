import pytest
from pyspark.sql import functions as F

from rankforge.operators import cleaning, joins, models
from rankforge.plans import jobs
from rankforge.session import shared_folder
from rankforge.sources import sinks, tables
from rankforge.streaming import first_rows as first, scoring as stream


def test_fasta(spark, tmp_path):
    path = tmp_path / "a.fasta"
    path.write_text(">one first > record\nKLA\nKLA\r\n>two\n>three x\nGG\n")
    rows = tables.scan_fasta(spark, str(path)).orderBy("ingest_pos").collect()
    assert [(r["name"], r["sequence"], r["length"], r["description"]) for r in rows] == [
        ("one", "KLAKLA", 6, "one first > record"), ("two", "", 0, "two"), ("three", "GG", 2, "three x")]
    assert "length" not in tables.load_sequences(spark, str(path)).columns


def test_csv_order_and_nan(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("sequence,mic,target,activity\n" + "".join(f"S{i},{'NaN' if i == 3 else i},t,active\n" for i in range(50)))
    rows = tables.scan_csv(spark, str(path), tables.PEPTIDES).repartition(5).orderBy("ingest_pos").collect()
    assert [r["sequence"] for r in rows] == [f"S{i}" for i in range(50)]
    assert rows[3]["mic"] is None and rows[4]["mic"] == 4.0


def test_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.load_sequences(spark, str(tmp_path / "a.txt"))
    sinks.write_category(spark.range(3), str(tmp_path / "base"), "amp")
    assert tables.load_category(spark, str(tmp_path / "base"), "amp").count() == 3
    with pytest.raises(FileNotFoundError):
        tables.load_category(spark, str(tmp_path / "base"), "other")
    with pytest.raises(ValueError):
        tables.require_columns(spark.range(1), "sequence")


def test_predictions_of_two_runs_stay_apart(spark, tmp_path):
    base = str(tmp_path / "pred")
    for run in ("r1", "r2"):
        sinks.save_predictions(spark.range(4), base, "amp", run)
    got = spark.read.parquet(base).groupBy("category", "run_id").count().collect()
    assert sorted(map(tuple, got)) == [("amp", "r1", 4), ("amp", "r2", 4)]


def test_model_bundle(spark, tmp_path):
    df = spark.range(60).select("id", (F.col("id") * 1.0).alias("a"), (F.col("id") > 30).cast("int").alias("y"))
    fitted, report = jobs.train_and_evaluate(
        df, ["a"], "y", "id", models.forest(3, 2), save_to=str(tmp_path / "m"))
    model, meta = sinks.load_model(str(tmp_path / "m"))
    # The bundle scales raw rows itself: what is loaded predicts as what was fitted, and well.
    key = ["id", "probability_active", "predicted_activity"]
    loaded = sorted(map(tuple, models.predict(model, df).select(*key).collect()))
    assert loaded == sorted(map(tuple, models.predict(fitted, df).select(*key).collect()))
    assert sum(r[2] == (r[0] > 30) for r in loaded) > 55
    assert meta["feature_columns"] == ["a"] and meta["metrics"]["auc_roc"] > 0.9 and meta["training_date"]
    assert models.predict(model, df).count() == 60 and report.count() == 1


def test_scoring_a_stream_equals_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i}", i * 10.0, i % 7 * 1.0, i / 100) for i in range(100)],
                                 "smiles STRING, MW DOUBLE, LogP DOUBLE, probability_active DOUBLE")
    rows.write.parquet(str(tmp_path / "in"))
    source = stream.stream_files(spark, str(tmp_path / "in"), rows.schema)
    where = str(tmp_path / "out"), str(tmp_path / "progress")
    stream.score_stream(source, "repurposed", *where).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    from rankforge.operators.scoring import score_category
    expected = score_category(rows, "repurposed")
    assert got.count() == 100 and got.exceptAll(expected).count() == 0
    rows.limit(30).write.mode("append").parquet(str(tmp_path / "in"))
    stream.score_stream(source, "repurposed", *where).awaitTermination(120)
    assert spark.read.parquet(where[0]).count() == 130


def test_filters_reach_the_parquet_scan(spark):
    path = "/root/testdata/sf0.001/part.parquet"
    plan = tables.scan_parquet(spark, path).filter("p_size = 3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_size,3)" in plan
    marked = tables.scan_parquet(spark, path, with_pos=True).filter("p_size = 3")
    assert "EqualTo(p_size,3)" in marked._jdf.queryExecution().executedPlan().toString()
    assert marked.select("ingest_pos").distinct().count() == marked.count() > 0


def test_no_temporary_folder_on_a_cluster():
    class Conf:
        get = staticmethod(lambda *a: None)

    class Session:
        conf = Conf
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared_folder(Session)




def test_first_rows_of_a_stream_with_restarts(spark, tmp_path):
    schema = "k STRING, o INT, x STRING"
    where = [str(tmp_path / name) for name in ("in", "target", "progress")]
    batches = [[("a", 5, "late"), ("b", 1, "b1"), (None, 2, "null"), ("a", 7, "worse")],
               [("a", 3, "better"), ("b", 1, "a1"), ("c", 9, "new"), ("b", 4, "worse")], [], [("a", 4, "no"), (None, 1, "yes")]]
    every = []
    for batch in batches:
        every += batch
        if batch:
            spark.createDataFrame(batch, schema).repartition(2).write.mode("append").parquet(where[0])
        source = stream.stream_files(spark, where[0], schema)
        first.keep_first_stream(source, ["k"], ["o"], *where[1:]).awaitTermination(120)
        got = sorted(map(tuple, first.first_rows(spark, where[1], ["k"], ["o"]).collect()), key=str)
        expected = cleaning.keep_first(spark.createDataFrame(every, schema), ["k"], ["o", "x"])
        assert got == sorted(map(tuple, expected.collect()), key=str)
    # Only keys whose best row changed were written again.
    assert spark.read.parquet(where[1]).where("k = 'c'").count() == 1


def test_bucketed_features_meet_without_a_shuffle(spark):
    rows = [(f"s{i % 90}{'x' * (i % 7)}", float(i)) for i in range(300)]
    table = spark.createDataFrame(rows, "smiles STRING, a DOUBLE").dropDuplicates(["smiles"])
    left = sinks.write_features(table, "smiles", 4)
    right = sinks.write_features(table.filter("a > 40").withColumnRenamed("a", "b"), "smiles", 4)
    joined = left.hint("merge").join(right, "smiles", "full_outer")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    expected = table.join(table.filter("a > 40").withColumnRenamed("a", "b"), "smiles", "full_outer")
    assert sorted(map(str, joined.collect())) == sorted(map(str, expected.collect()))
    merged = joins.merge_features(left, right, "smiles")
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString() and merged.count() == expected.count()
