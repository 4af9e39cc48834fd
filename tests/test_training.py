import hashlib
import itertools
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from rankforge.functions.sequences import helical_sequence
from rankforge.operators import forests, metrics, models, training
from rankforge.operators.ordering import running_totals, shuffled_rank
from rankforge.plans.catalog_training import regression_forest


def scored(spark, seed=0, n=300):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 1), 0.5 if rng.random() < 0.4 else round(rng.random(), 2)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "y_true INT, y_prob DOUBLE").repartition(3)


def plain_auc(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def plain_ap(rows):
    total, last, out = sum(y for y, _ in rows), 0.0, 0.0
    for t in sorted({p for _, p in rows}, reverse=True):
        chosen = [y for y, p in rows if p >= t]
        recall = sum(chosen) / total
        out += (recall - last) * sum(chosen) / len(chosen)
        last = recall
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_exact_auc_and_average_precision(spark, seed):
    rows, df = scored(spark, seed)
    assert metrics.roc_auc(df).first()[0] == pytest.approx(plain_auc(rows))
    assert metrics.average_precision(df).first()[0] == pytest.approx(plain_ap(rows))


def test_one_class_and_no_positive_predictions(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y_true INT, y_prob DOUBLE")
    assert metrics.roc_auc(df).first()[0] is None
    df = spark.createDataFrame([(1, 0), (0, 0)], "y_true INT, y_pred INT")
    row = metrics.classification_metrics(df).first()
    assert (row["precision"], row["recall"], row["f1"], row["mcc"], row["accuracy"]) == (0, 0, 0, 0, 0.5)


def test_running_totals(spark):
    df = spark.range(500).select((F.col("id") / 7).alias("v"), F.lit(1).alias("one"))
    got = {r["v"]: r["below_one"] for r in running_totals(df, "v", ["one"]).collect()}
    assert [got[v] for v in sorted(got)] == list(range(500))


def test_constant_truth_has_no_r2(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "y_true DOUBLE, y_pred DOUBLE")
    row = metrics.regression_metrics(df).first()
    assert row["r2"] is None and row["mae"] == 1.0


def test_rank_is_complete_and_repeatable(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") % 3 == 0, 1).otherwise(0))
    first = shuffled_rank(df, "g", "id").collect()
    again = shuffled_rank(df.repartition(11), "g", "id").collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    for g in (0, 1):
        ranks = sorted(r["rank"] for r in first if r["g"] == g)
        assert ranks == list(range(len(ranks))) and {r["size"] for r in first if r["g"] == g} == {len(ranks)}


def test_split_shares(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") < 100).cast("int"))
    split = training.stratified_split(df, "y", "id", 0.2, 0.1)
    got = {(r["split"], r["y"]): r["rows"] for r in training.split_histogram(split, "y").collect()}
    assert got == {("test", 0): 180, ("test", 1): 20, ("validation", 0): 90, ("validation", 1): 10,
                   ("train", 0): 630, ("train", 1): 70}


def points(spark, n_major, n_minor):
    rng = random.Random(5)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1), 0) for i in range(n_major)]
    rows += [(n_major + i, rng.gauss(5, 1), rng.gauss(5, 1), 1) for i in range(n_minor)]
    return spark.createDataFrame(rows, "id BIGINT, a DOUBLE, b DOUBLE, y INT")


@pytest.mark.parametrize("block", [2000, 20, 3])
def test_neighbours_are_exact_at_every_block_size(spark, block):
    rng = random.Random(8)
    rows = [(i, rng.gauss(i % 4 * 9, 1), float(rng.randint(0, 3))) for i in range(130)]
    df = spark.createDataFrame(rows, "id BIGINT, a DOUBLE, b DOUBLE").repartition(4)
    got = {}
    for r in training.nearest_neighbours(df, ["a", "b"], "id", 5, block=block).collect():
        got.setdefault(r["id"], {})[r["place"]] = r["near"]
    for i, a, b in rows:
        order = sorted((((a - x) ** 2 + (b - y) ** 2) ** 0.5, j) for j, x, y in rows if j != i)[:5]
        assert [got[i][k] for k in range(5)] == [j for _, j in order]
    few = training.nearest_neighbours(df.limit(3), ["a", "b"], "id", 5, block=block)
    assert few.count() == 6 and training.nearest_neighbours(df.limit(0), ["a", "b"], "id").count() == 0


def test_synthetic_rows_lie_between_neighbours(spark):
    df = points(spark, 60, 20)
    rows = {r["id"]: (r["a"], r["b"]) for r in df.collect()}
    small = [p for i, p in rows.items() if i >= 60]
    near = {p: sorted(small, key=lambda q: (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2)[1:6] for p in small}
    made = [tuple(r)[:2] for r in training.oversample_minority(df, ["a", "b"], "y", "id").filter("y = 1").collect()]

    def between(x, p, q):
        share = (x[0] - p[0]) / (q[0] - p[0])
        return -1e-9 <= share <= 1 + 1e-9 and abs(p[1] + share * (q[1] - p[1]) - x[1]) < 1e-9

    new = [x for x in made if x not in small]
    assert len(new) == 40 and all(any(between(x, p, q) for p in small for q in near[p]) for x in new)


def test_oversampling_balances_inside_the_minority_range(spark):
    df = points(spark, 300, 90)
    out = training.oversample_minority(df, ["a", "b"], "y", "id")
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {0: 300, 1: 300}
    lo, hi = df.filter("y = 1").agg(F.min("a"), F.max("a")).first()
    assert out.filter("y = 1").filter((F.col("a") < lo) | (F.col("a") > hi)).count() == 0
    again = training.oversample_minority(df.repartition(5), ["a", "b"], "y", "id")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_scaling_and_weights(spark):
    df = points(spark, 30, 10).withColumn("c", F.lit(4.0))
    scaled = training.scale(df, df, ["a", "c"])
    row = scaled.agg(F.avg("a"), F.stddev_pop("a"), F.max("c")).first()
    assert row[0] == pytest.approx(0) and row[1] == pytest.approx(1) and row[2] == 0.0
    weights = {r["y"]: r["weight"] for r in training.class_weights(df, "y").collect()}
    assert weights == {0: pytest.approx(40 / 60), 1: 2.0}
    odd = spark.createDataFrame([(1, 0), (2, 1), (3, None), (4, 7)], "id INT, y INT")
    kept = {r["id"]: r["weight"] for r in training.add_class_weights(odd, "y").collect()}
    assert kept == {1: 1.0, 2: 1.0, 3: None, 4: None}


def test_scores_without_rows_or_numbers(spark):
    empty = spark.createDataFrame([], "y_true INT, y_prob DOUBLE")
    assert metrics.roc_auc(empty).first()[0] is None and metrics.average_precision(empty).first()[0] is None
    assert [tuple(r) for r in metrics.roc_points(empty).collect()] == [(float("inf"), 0.0, 0.0)]
    odd = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, float("nan")), (0, None)], "y_true INT, y_prob DOUBLE")
    assert metrics.roc_auc(odd).first()[0] == 1.0
    points_ = sorted(tuple(r) for r in metrics.precision_recall_points(odd).collect())
    assert points_ == [(0.1, 0.5, 1.0), (0.9, 1.0, 1.0), (float("inf"), 1.0, 0.0)]


def test_permutation_importance(spark):
    df = points(spark, 150, 150).withColumn("noise", F.rand(3))
    model = models.fit(df, ["a", "noise"], "y", models.forest(5, 4))
    fall = {r["feature"]: r["fall"] for r in models.permutation_importance(model, df, ["a", "noise"], "y", "id").collect()}
    assert fall["a"] > 0.3 and abs(fall["noise"]) < 0.05


def test_forest_learns_and_repeats(spark):
    df = points(spark, 100, 60)
    first = models.predict(models.fit(df, ["a", "b"], "y", models.forest(5, 4)), df)
    assert metrics.roc_auc(first, "y", "probability_active").first()[0] > 0.95
    again = models.predict(models.fit(df, ["a", "b"], "y", models.forest(5, 4)), df)
    key = ["id", "probability_active"]
    assert sorted(map(tuple, first.select(key).collect())) == sorted(map(tuple, again.select(key).collect()))
    folds = models.cross_validate(df, ["a", "b"], "y", "id", models.boosting(2, 2), 3)
    assert models.score_summary(folds).first()["mean_score"] > 0.9


@pytest.mark.parametrize("bins,few", [(1024, 4096), (4, 5), (2, 1)])
def test_quantiles_of_any_column(spark, monkeypatch, bins, few):
    monkeypatch.setattr(metrics, "BINS", bins)
    monkeypatch.setattr(metrics, "SORTED_ROWS", few)
    rng = np.random.default_rng(1)
    columns = {
        "skewed": np.exp(rng.normal(0, 9, 400)).tolist(), "few": rng.integers(0, 3, 300).astype(float).tolist(),
        "hot": [5.0] * 200 + rng.normal(5, 1e-9, 150).tolist(), "wide": [-1.7e308, 1.7e308, 0.0, 1e-300, 1.0, -3.0],
        "one": [2.5], "odd": [None, float("nan"), 1.0, 2.0, 4.0]}
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    for name, values in columns.items():
        if bins < 1000 and name in ("wide", "skewed"):
            continue  # many rounds
        table = spark.createDataFrame([(v,) for v in values], "v DOUBLE").repartition(3)
        good = [v for v in values if v is not None and v == v]
        got = metrics.quantiles(table, "v", shares)
        assert np.allclose(got, np.quantile(good, shares), rtol=1e-12, atol=0), name
    assert metrics.quantiles(table.limit(0), "v", [0.5]) == [None]
    plan = metrics.distribution(table, "v")._jdf.queryExecution().toString()
    assert "percentile" not in plan


@pytest.mark.parametrize("parts", [1, 2, 200])
def test_curve_points_between_equal_steps_go(spark, parts):
    rng = np.random.default_rng(3)
    scored = [(int(y), float(s)) for y, s in zip(rng.integers(0, 2, 300), rng.integers(0, 90, 300) / 90)]
    scored += [(1, 2.0 + i) for i in range(6)] + [(0, -1.0 - i) for i in range(5)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        table = spark.createDataFrame(scored, "y_true INT, y_prob DOUBLE")
        got = [tuple(r) for r in metrics.roc_points(table).orderBy(F.desc("threshold")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    scores = sorted({s for _, s in scored}, reverse=True)
    step = [(sum(1 for y, s in scored if s == t and y == 0), sum(1 for y, s in scored if s == t and y == 1)) for t in scores]
    neg, pos = sum(x for x, _ in step), sum(y for _, y in step)
    expected = [(float("inf"), 0.0, 0.0)]
    for i, t in enumerate(scores):
        if i in (0, len(scores) - 1) or step[i] != step[i + 1]:
            fp, tp = (sum(s[k] for s in step[:i + 1]) for k in (0, 1))
            expected.append((t, fp / neg, tp / pos))
    assert got == expected and len(got) < len(scores) - 5


def test_areas_of_groups(spark):
    rows = [(g, *r) for g in range(3) for r in scored(spark, g, 80)[0]]
    table = spark.createDataFrame(rows, "g INT, y_true INT, y_prob DOUBLE")
    got = {r["g"]: r["auc_roc"] for r in metrics.grouped_auc(table, ["g"]).collect()}
    assert got == {g: pytest.approx(plain_auc([(y, p) for k, y, p in rows if k == g])) for g in range(3)}


COLUMNS = ["a", "b", "c", "d"]


def tree_rows(spark, n=160, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 4)).round(2)
    label = (x[:, 0] + 0.5 * x[:, 1] * x[:, 2] > 0).astype(int)
    return x, spark.createDataFrame([(i, int(y), *map(float, r)) for i, (r, y) in enumerate(zip(x, label))],
                                    "k INT, y INT, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE")


def expected_value(trees, tree, row, known, node=0):
    """The value of a tree where only some features are known, by walking both branches of the others."""
    f = trees.feature[tree, node]
    if f < 0:
        return trees.value[tree, node]
    sides = (trees.left[tree, node], trees.right[tree, node])
    if f in known:
        return expected_value(trees, tree, row, known, sides[0] if row[f] <= trees.threshold[tree, node] else sides[1])
    return sum(trees.cover[tree, s] * expected_value(trees, tree, row, known, s) for s in sides) / trees.cover[tree, node]


@pytest.mark.parametrize("kind", ["rf", "gb"])
def test_attributions_equal_all_subsets(spark, kind):
    model = models.forest(5, 4) if kind == "rf" else models.boosting(4, 3)
    x, table = tree_rows(spark)
    fitted = models.fit(table, COLUMNS, "y", model, scaled=False)
    trees = forests.trees_of(fitted)
    some = np.vstack([x[:8], [[np.nan, 0.1, np.nan, -1.0]]])
    got = trees.attributions(some)
    for row, found in zip(some, got):
        for j in range(4):
            others, total = [i for i in range(4) if i != j], 0.0
            for k in range(4):
                for known in itertools.combinations(others, k):
                    size = math.factorial(k) * math.factorial(3 - k) / math.factorial(4)
                    total += size * sum(w * (expected_value(trees, t, row, {*known, j}) - expected_value(trees, t, row, known))
                                        for t, w in enumerate(trees.weights))
            assert found[j] == pytest.approx(total, abs=1e-12)
    attributed = forests.attribute(fitted, table, ["k"])
    both = {r["k"]: r["modelled"] for r in attributed.collect()}
    if kind == "rf":
        plain = {r["k"]: r["probability_active"] for r in models.predict(fitted, table).collect()}
    else:
        plain = dict(zip(range(len(x)), trees.predict(x)))
    assert both == {k: pytest.approx(v, abs=1e-9) for k, v in plain.items()}
    summary = forests.attribution_summary(attributed, COLUMNS).collect()
    assert summary[0]["feature"] == "a" and len(summary) == 4
    assert summary[0]["mean_abs"] == pytest.approx(np.abs(trees.attributions(x)[:, 0]).mean())


def test_cut_trees_give_the_class_shares_of_their_nodes(spark):
    x, table = tree_rows(spark)
    trees = forests.trees_of(models.fit(table, COLUMNS, "y", models.forest(3, 6), scaled=False))
    values = trees.values(x, [0, 2, 6])
    for tree in range(3):
        assert (values[0][:, tree] == trees.value[tree, 0]).all()
        for row, value in zip(x, values[2][:, tree]):
            node = 0
            for _ in range(2):
                if trees.feature[tree, node] >= 0:
                    left = row[trees.feature[tree, node]] <= trees.threshold[tree, node]
                    node = (trees.left if left else trees.right)[tree, node]
            assert value == trees.value[tree, node]
    assert trees.values(x, [3, 60])[60] == pytest.approx(trees.values(x, [60])[60])


def test_shared_grid_scores_every_setting(spark):
    x, table = tree_rows(spark, 240)
    grid = {"numTrees": [3, 9], "maxDepth": [1, 4], "minInstancesPerNode": [1, 30], "minInfoGain": [0.0]}
    found = forests.shared_grid_search(table, COLUMNS, "y", "k", grid, 3).collect()
    assert len(found) == len({tuple(r)[:4] for r in found}) == 8
    assert [r["auc"] for r in found] == sorted((r["auc"] for r in found), reverse=True)
    best, least = found[0], found[-1]
    assert best["maxDepth"] == 4 and best["auc"] > 0.85 and least["maxDepth"] == 1 and least["auc"] < best["auc"]


def test_blocks_go_only_to_parts_that_ask(spark, monkeypatch):
    sent = {}
    real = training.asked_members

    def counted(dealt, asking):
        out = real(dealt, asking)
        sent["rows"] = out.count()
        return out

    monkeypatch.setattr(training, "asked_members", counted)
    rng = np.random.default_rng(8)
    for groups in (4, 16):
        points = np.concatenate([rng.normal(50 * g, 1, (100, 2)) for g in range(groups)])
        table = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "k INT, a DOUBLE, b DOUBLE")
        found = training.nearest_neighbours(table, ["a", "b"], "k", 3, block=20).select("k", "place", "near").collect()
        far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
        np.fill_diagonal(far, np.inf)
        assert {(r["k"], r["place"], r["near"]) for r in found} == {
            (i, place, int(j)) for i in range(len(points)) for place, j in enumerate(np.argsort(far[i], kind="stable")[:3])}
        sent[groups] = sent["rows"]
    assert sent[16] < 8 * sent[4]


def test_forest_grown_in_groups_is_one_forest(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(models, "GROUPED_ROWS", 100)
    monkeypatch.setattr(models, "GROUP_TREES", 4)
    tasks = []
    real = RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df: (tasks.append(df.rdd.getNumPartitions()), real(self, df))[1])
    x, table = tree_rows(spark, 400)
    table = training.add_class_weights(table, "y")
    fitted = models.fit(table, COLUMNS, "y", models.forest(10, 6), weight="weight")
    grown = fitted.stages[-1]
    assert table.rdd.getNumPartitions() > 1 and tasks == [1, 1, 1]
    assert (grown.getNumTrees, grown.getOrDefault("numTrees"), grown.numFeatures, grown.numClasses) == (10, 10, 4, 2)
    assert len({t.toDebugString.split("\n", 1)[1] for t in grown.trees}) == 10
    assert sum(grown.featureImportances) == pytest.approx(1)
    found = {r["k"]: (r["probability_active"], r["predicted_activity"]) for r in models.predict(fitted, table).collect()}
    scaled = np.array([list(r[0]) for r in forests.features_of(fitted, table.orderBy("k"), []).collect()])
    assert [found[k][0] for k in sorted(found)] == pytest.approx(list(forests.trees_of(fitted).predict(scaled)))
    right = np.mean([found[i][1] == (r[0] + 0.5 * r[1] * r[2] > 0) for i, r in enumerate(x)])
    assert right > 0.95
    fitted.save(f"{tmp_path}/model")
    again = models.predict(PipelineModel.load(f"{tmp_path}/model"), table).collect()
    assert {r["k"]: (r["probability_active"], r["predicted_activity"]) for r in again} == found
    same = models.predict(models.fit(table, COLUMNS, "y", models.forest(10, 6), weight="weight"), table).collect()
    assert {r["k"]: r["probability_active"] for r in same} == {k: v[0] for k, v in found.items()}


def deep_trees(depth=13, features=12, trees=2):
    """Complete trees of random cuts, nodes numbered by level."""
    rng, rows = np.random.default_rng(4), []
    for tree in range(trees):
        cover = {0: 2.0 ** (depth + 6)}
        for node in range(2 ** (depth + 1) - 1):
            inner = node < 2 ** depth - 1
            if inner:
                part = rng.uniform(0.2, 0.8)
                cover[2 * node + 1], cover[2 * node + 2] = cover[node] * part, cover[node] * (1 - part)
            rows.append((tree, node, 2 * node + 1 if inner else -1, 2 * node + 2 if inner else -1,
                         int(rng.integers(features)) if inner else -1, rng.normal() if inner else None, cover[node], rng.random()))
    return forests.Trees(pa.table([pa.array(c) for c in zip(*rows)],
                                  names=["tree", "id", "left", "right", "feature", "threshold", "cover", "value"]))


def test_attributions_of_deep_trees(spark):
    trees = deep_trees()
    x = np.random.default_rng(5).normal(0, 1, (1024, 12))
    began = time.process_time()
    found = trees.attributions(x)
    # One pass over the tree's edges; a polynomial for each leaf and feature took 29 seconds.
    assert time.process_time() - began < 12
    assert trees.depth() == 13
    assert trees.base() + found.sum(axis=1) == pytest.approx(trees.predict(x), abs=1e-9)
    small = deep_trees(6, 5, 1)
    row = x[0, :5]
    for j in range(5):
        total, others = 0.0, [i for i in range(5) if i != j]
        for k in range(5):
            for known in itertools.combinations(others, k):
                size = math.factorial(k) * math.factorial(4 - k) / math.factorial(5)
                total += size * (expected_value(small, 0, row, {*known, j}) - expected_value(small, 0, row, known))
        assert small.attributions(row[None])[0, j] == pytest.approx(total, abs=1e-12)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sorted_predictions_are_made_once(spark, tmp_path):
    part = spark.range(200).selectExpr("id p_partkey", "cast(id % 50 as int) p_size", "'Brand#12' p_brand", "'n' p_name")
    part.write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(0, "A"), (3, "B")], "n_nationkey INT, n_name STRING").write.parquet(f"{tmp_path}/nation.parquet")
    found = regression_forest(spark, str(tmp_path))
    plan = plan_of(found)
    assert "Sort" in plan and "UDF" not in plan and "features" not in plan
    rows = found.collect()
    assert len(rows) == 300
    assert rows == sorted(rows, key=lambda r: (-r["predicted_solubility"], r["product"], r["aldehyde"], r["amine"]))


def test_generated_sequences_draw_their_length_once(spark):
    made = spark.range(40).select(F.col("id"), helical_sequence(F.col("id")).alias("s"))
    assert plan_of(made).count("md5(") == 3 + 2  # length, positive letters, and a letter's number in three branches
    for r in made.collect():
        drawn = [int(hashlib.md5(f"42:{r['id']}:{x}".encode()).hexdigest()[:8], 16) for x in ("len", "pos", *range(1, 31))]
        length, positive = 15 + drawn[0] % 16, 2 + drawn[1] % 4
        kinds = ["RKH" if i < positive else "AILMFVWP" if i < positive + int(length * 0.4) else "ACDEFGHIKLMNPQRSTVWY"
                 for i in range(length)]
        assert r["s"] == "".join(k[drawn[2 + i] % len(k)] for i, k in enumerate(kinds))


def test_points_are_sent_once_for_a_pair_of_shelves(spark, monkeypatch):
    """where pivots rule out nothing, points were sent once for every pair of small blocks."""
    sent = []
    real = training.asked_members
    monkeypatch.setattr(training, "asked_members", lambda *a: (sent.append((out := real(*a)).count()), out)[1])
    points = np.random.default_rng(3).normal(size=(600, 16))
    table = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], f"k INT, {', '.join(f'c{i} DOUBLE' for i in range(16))}")
    found = training.nearest_neighbours(table, [f"c{i}" for i in range(16)], "k", 5, block=10).collect()
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    assert {(r["k"], r["place"], r["near"]) for r in found} == {
        (i, place, int(j)) for i in range(600) for place, j in enumerate(np.argsort(far[i], kind="stable")[:5])}
    assert all(r["_point"] == list(points[r["near"]]) for r in found)
    assert sent[0] <= (training.SHELVES + 2) * 600


@pytest.mark.parametrize("shelf", [40, 32768])
def test_copies_are_taken_by_key_and_keys_may_repeat(spark, monkeypatch, shelf):
    monkeypatch.setattr(training, "SHELF", shelf)
    rng = random.Random(4)
    rows = [(i, float(i % 7 == 0), 1e4) for i in range(200)] + [(i, float(i), 0.0) for i in range(0, 200, 3)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "k INT, a DOUBLE, b DOUBLE").repartition(3)
    found = {}
    for r in training.nearest_neighbours(table, ["a", "b"], "k", 4, block=25).collect():
        found.setdefault(r["k"], {})[r["place"]] = (r["near"], tuple(r["_point"]))
    for key in range(200):
        pairs = sorted((math.dist(x[1:], y[1:]), y[0]) for x in rows if x[0] == key for y in rows if y[0] != key)[:4]
        assert [found[key][i][0] for i in range(4)] == [near for _, near in pairs]
