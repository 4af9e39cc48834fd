import itertools
import math
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from rankforge.operators import attributions, forests, growth, models, training
from tests.test_training import COLUMNS, expected_value, plain_auc, tree_rows


@pytest.fixture
def small(monkeypatch):
    """A few rows are enough to grow inside tasks; a fit by Spark is an error."""
    monkeypatch.setattr(growth, "GROWN_ROWS", 100)
    monkeypatch.setattr(models, "GROUPED_ROWS", 100)
    monkeypatch.setattr(models, "GROUP_TREES", 4)

    def no(*args):
        raise AssertionError("not inside tasks")

    monkeypatch.setattr(RandomForestClassifier, "fit", no)


def gini_gain(y, w, left):
    def impurity(some):
        total = w[some].sum()
        return 1 - sum((w[some & (y == c)].sum() / total) ** 2 for c in (0, 1))
    whole = np.ones(len(y), bool)
    return impurity(whole) - sum(w[s].sum() / w.sum() * impurity(s) for s in (left, ~left))


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("cells", [1 << 18, 1])
def test_every_node_takes_the_best_split(monkeypatch, weighted, cells):
    monkeypatch.setattr(growth, "CELLS", cells)
    rng = np.random.default_rng(5)
    bins = rng.integers(0, 6, (300, 3)).astype(np.uint8)
    y = ((bins[:, 0] > 2) ^ (rng.random(300) < 0.2)).astype(float)
    weight = rng.random(300) + 0.1 if weighted else None
    rules = growth.Rules(4, 3, 0.001, 0.0, 3, 1.0, 7)
    tree = growth.grow(bins, y, weight, 6, rules, 2)
    drawn = np.random.default_rng([7, 2]).poisson(1.0, 300)
    w = drawn if weight is None else drawn * weight
    assert tree.feature[0] >= 0 and len(tree.feature) > 5
    at = [np.flatnonzero(drawn)]
    held = {0: at[0]}
    for node in range(len(tree.feature)):
        rows = held[node]
        assert tree.count[node] == drawn[rows].sum()
        assert (tree.negative[node], tree.positive[node]) == pytest.approx((w[rows][y[rows] == 0].sum(), w[rows][y[rows] == 1].sum()))
        if tree.feature[node] < 0:
            continue
        options = [gini_gain(y[rows], w[rows], bins[rows, f] <= c) for f in range(3) for c in range(5)
                   if 3 <= drawn[rows][bins[rows, f] <= c].sum() <= drawn[rows].sum() - 3]
        left = bins[rows, tree.feature[node]] <= tree.cut[node]
        assert tree.gain[node] == pytest.approx(max(options)) == pytest.approx(gini_gain(y[rows], w[rows], left))
        held[tree.left[node]], held[tree.right[node]] = rows[left], rows[~left]
        leaves = [c for c in (tree.left[node], tree.right[node]) if tree.feature[c] < 0]
        assert len({tree.positive[c] > tree.negative[c] for c in leaves}) == len(leaves)
    cut = tree.reached(bins, [0, 1, 4])
    assert (cut[0] == 0).all() and (cut[1] == np.where(bins[:, tree.feature[0]] <= tree.cut[0], tree.left[0], tree.right[0])).all()
    assert all(i in held[cut[4][i]] for i in at[0])


def test_limits_between_bins():
    assert growth.thresholds_of(np.array([3.0, 1.0, 1.0, 2.0]), np.ones(4), 32).tolist() == [1.5, 2.5]
    assert growth.thresholds_of(np.ones(4), np.ones(4), 32).tolist() == []
    many = growth.thresholds_of(np.arange(1000.0), np.ones(1000), 4)
    assert many == pytest.approx([249.5, 499.5, 749.5], abs=1)
    heavy = growth.thresholds_of(np.arange(8.0), np.array([100, 1, 1, 1, 1, 1, 1, 100.0]), 2)
    assert len(heavy) == 1


def test_forest_grows_inside_tasks(spark, small, tmp_path):
    x, table = tree_rows(spark, 400)
    table = training.add_class_weights(table, "y")
    fitted = models.fit(table, COLUMNS, "y", models.forest(10, 6), weight="weight")
    grown = fitted.stages[-1]
    assert (grown.getNumTrees, grown.getOrDefault("numTrees"), grown.numFeatures, grown.numClasses) == (10, 10, 4, 2)
    assert grown.getOrDefault("maxDepth") == 6 and len({t.toDebugString.split("\n", 1)[1] for t in grown.trees}) == 10
    assert max(t.depth for t in grown.trees) <= 6 and sum(grown.featureImportances) == pytest.approx(1)
    found = {r["k"]: r["probability_active"] for r in models.predict(fitted, table).collect()}
    given = np.array([list(r[0]) for r in forests.features_of(fitted, table.orderBy("k"), []).collect()])
    assert [found[k] for k in sorted(found)] == pytest.approx(list(forests.trees_of(fitted).predict(given)))
    assert np.mean([(found[i] >= 0.5) == (r[0] + 0.5 * r[1] * r[2] > 0) for i, r in enumerate(x)]) > 0.95
    fitted.save(f"{tmp_path}/model")
    again = models.predict(PipelineModel.load(f"{tmp_path}/model"), table).collect()
    assert {r["k"]: r["probability_active"] for r in again} == found
    # Scaled values depend on the order of sums in their last digits, so rows are dealt anew without scaling.
    plain = models.fit(table, COLUMNS, "y", models.forest(10, 6), False, "weight")
    dealt = models.fit(table.repartition(7, "b").sortWithinPartitions("c"), COLUMNS, "y", models.forest(10, 6), False, "weight")
    assert models.predict(plain, table).collect() == models.predict(dealt, table).collect()


def test_other_forests_and_too_many_values_grow_by_spark(spark, monkeypatch):
    for name, module, value in (("GROWN_ROWS", growth, 100), ("GROUPED_ROWS", models, 100), ("GROUP_TREES", models, 4)):
        monkeypatch.setattr(module, name, value)
    _, table = tree_rows(spark, 240)
    fits = []
    real = RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df: (fits.append(1), real(self, df))[1])
    three = table.withColumn("y", F.col("k") % 3)
    assert models.fit(three, COLUMNS, "y", models.forest(8, 3)).stages[-1].numClasses == 3 and len(fits) == 2
    models.fit(table, COLUMNS, "y", models.forest(8, 3, impurity="entropy"))
    assert len(fits) == 4
    monkeypatch.setattr(growth, "TASK_VALUES", 900)
    models.fit(table, COLUMNS, "y", models.forest(8, 3))
    assert len(fits) == 6
    monkeypatch.setattr(growth, "TASK_VALUES", 1 << 20)
    models.fit(table, COLUMNS, "y", models.forest(8, 3))
    assert len(fits) == 6


@pytest.mark.parametrize("column, value", [("d", None), ("d", float("inf")), ("y", None)])
def test_values_that_no_forest_takes_are_errors(spark, monkeypatch, column, value):
    for name, module, rows in (("GROWN_ROWS", growth, 100), ("GROUPED_ROWS", models, 100), ("GROUP_TREES", models, 4)):
        monkeypatch.setattr(module, name, rows)
    _, table = tree_rows(spark, 240)
    odd = table.withColumn(column, F.when(F.col("k") != 7, F.col(column)).otherwise(F.lit(value)))
    with pytest.raises(Exception, match="MUST NOT be"):
        models.fit(odd, COLUMNS, "y", models.forest(8, 3), scaled=False)
    if column == "d":
        with pytest.raises(Exception, match="MUST NOT be"):
            models.cross_validate(odd, COLUMNS, "y", "k", models.forest(8, 3), 3).collect()


def plain_scores(folded, model, depth, first, last):
    """Scores of held-out rows with trees grown here: (label, score) for each fold."""
    rows = folded.collect()
    x, y = np.array([[r[c] for c in COLUMNS] for r in rows]), np.array([r["y"] for r in rows], float)
    fold = np.array([r["fold"] for r in rows])
    out = {}
    for i in sorted(set(fold)):
        own = fold != i
        limits = [growth.thresholds_of(x[own, j], np.ones(own.sum()), 32) for j in range(4)]
        bins = np.stack([np.searchsorted(limit, x[:, j]) for j, limit in enumerate(limits)], 1).astype(np.uint8)
        held = growth.Held(y, bins, y, None, fold).only(own).ordered()
        sums = np.zeros((~own).sum())
        for number in range(first, last):
            tree = growth.grow(held.bins, held.y, None, growth.most_bins(limits), growth.Rules.of(model, 4), number)
            sums += tree.share()[tree.reached(bins[~own], [depth])[depth]]
        out[int(i)] = [(int(a), round(b / (last - first), 9)) for a, b in zip(y[~own], sums)]
    return out


def test_folds_are_scored_where_their_forests_grow(spark, small, monkeypatch):
    def no(*args, **kw):
        raise AssertionError("a forest at the driver")

    monkeypatch.setattr(models, "fit", no)
    monkeypatch.setattr(growth, "loaded_forest", no)
    _, table = tree_rows(spark, 300)
    table = table.withColumn("k", F.when(F.col("k") > 5, F.col("k") % 290))  # keys may repeat or be null
    model = models.forest(9, 5)
    found = {r["fold"]: r["score"] for r in models.cross_validate(table, COLUMNS, "y", "k", model, 3).collect()}
    folded = training.stratified_folds(table, "y", "k", 3)
    expected = {i: plain_auc(rows) for i, rows in plain_scores(folded, model, 5, 0, 9).items()}
    assert found == pytest.approx(expected) and min(found.values()) > 0.8


def test_a_fold_without_a_class_has_no_score(spark, small):
    _, table = tree_rows(spark, 300)
    rows = table.withColumn("y", (F.col("k") < 2).cast("int"))
    found = models.cross_validate(rows, COLUMNS, "y", "k", models.forest(6, 3), 3)
    assert found.dtypes == [("fold", "int"), ("score", "double")]
    scores = {r["fold"]: r["score"] for r in found.collect()}
    assert set(scores) == {0, 1, 2} and scores[2] is None and scores[0] is not None


def test_grid_is_scored_where_its_forests_grow(spark, small):
    _, table = tree_rows(spark, 300)
    grid = {"numTrees": [3, 7], "maxDepth": [2, 4], "minInstancesPerNode": [1, 20], "minInfoGain": [0.0, 0.02]}
    found = forests.shared_grid_search(table, COLUMNS, "y", "k", grid, 3).collect()
    assert len(found) == 16 and [r["auc"] for r in found] == sorted((r["auc"] for r in found), reverse=True)
    folded = training.stratified_folds(table, "y", "k", 3)
    for r in found:
        n, depth, leaf, gain, auc = r
        model = models.forest(7, 4, leaf, minInfoGain=gain)
        scores = plain_scores(folded, model, depth, 0, n)
        assert auc == pytest.approx(np.mean([plain_auc(x) for x in scores.values()]))


def grown_trees(x, y, count, depth, features):
    limits = [growth.thresholds_of(c, np.ones(len(x)), 32) for c in x.T]
    bins = np.stack([np.searchsorted(limit, c) for limit, c in zip(limits, x.T)], 1).astype(np.uint8)
    tables = []
    for number in range(count):
        tree = growth.grow(bins, y, None, growth.most_bins(limits), growth.Rules(depth, 1, 0.0, 0.0, features, 1.0, 3), number)
        threshold = [limits[f][c] if f >= 0 else 0.0 for f, c in zip(tree.feature, tree.cut)]
        n = len(threshold)
        tables.append(pa.table({"tree": np.full(n, number), "id": np.arange(n), "left": tree.left, "right": tree.right,
                                "feature": tree.feature, "threshold": threshold, "cover": tree.count, "value": tree.share()}))
    return forests.Trees(pa.concat_tables(tables))


@pytest.mark.parametrize("bits, part", [(16, 7), (3, 1), (1, 1), (4, 3)])
def test_attributions_however_trees_are_cut_into_parts(monkeypatch, bits, part):
    monkeypatch.setattr(attributions, "BITS", bits)
    monkeypatch.setattr(attributions, "PART_BITS", part)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 5))
    trees = grown_trees(x, (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] > 0).astype(float), 3, 6, 3)
    x[3, 0], x[4, 2] = np.nan, np.inf
    found = trees.attributions(x[:12])
    assert found == pytest.approx(trees.attributions(x)[:12])
    assert found == pytest.approx(sum(trees.attributions(x[:12], range(i, i + 1)) for i in range(3)))
    for row, got in zip(np.where(np.isnan(x[:12]), np.inf, x[:12]), found):
        for j in range(5):
            others, total = [i for i in range(5) if i != j], 0.0
            for k in range(5):
                for known in itertools.combinations(others, k):
                    part = sum(w * (expected_value(trees, t, row, {*known, j}) - expected_value(trees, t, row, known))
                               for t, w in enumerate(trees.weights))
                    total += math.factorial(k) * math.factorial(4 - k) / math.factorial(5) * part
            assert got[j] == pytest.approx(total, abs=1e-12)


def test_attributions_of_many_rows_cost_little_more_than_of_few():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(16_000, 20))
    trees = grown_trees(x, (x[:, 0] + x[:, 1] + rng.normal(size=len(x)) > 0).astype(float), 1, 11, 5)
    took = []
    for rows in (x[:1000], x):
        start = time.process_time()
        trees.attributions(rows)
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0]


def test_attributions_by_blocks_and_groups_of_trees(spark, monkeypatch):
    monkeypatch.setattr(forests, "ATTRIBUTED", 50)
    x, table = tree_rows(spark, 120)
    table = table.withColumn("k", F.when(F.col("k") > 3, F.col("k") % 100))  # keys may repeat or be null
    fitted = models.fit(table, COLUMNS, "y", models.forest(5, 4), scaled=False)
    found = forests.attribute(fitted, table, ["k", "a"])
    assert found.dtypes == [("k", "int"), ("a", "double"), ("base", "double"), ("attributions", "array<double>"), ("modelled", "double")]
    trees = forests.trees_of(fitted)
    expected = sorted(zip(x[:, 0].tolist(), map(tuple, trees.attributions(x).round(9).tolist())))
    rows = found.collect()
    assert sorted((r["a"], tuple(round(v, 9) for v in r["attributions"])) for r in rows) == expected
    assert sorted(r["k"] for r in rows if r["k"] is not None) == sorted(i % 100 for i in range(4, 120))
    assert sorted(r["modelled"] for r in rows) == pytest.approx(sorted(trees.predict(x)))
    assert forests.attribute(fitted, table.limit(0), ["k"]).collect() == []
