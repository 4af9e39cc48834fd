"""Classification trees grown inside tasks: a task holds all rows as bin numbers, one byte a value, and grows some trees.

The rules are those of Spark's forests: at most ``maxBins`` bins a feature from a sample of rows, Poisson draws of rows for
every tree, a fresh choice of features for every node, Gini gain, and sibling leaves of one class merged.  A tree is a
function of the set of rows, the seed and its number, whatever the order of rows or the number of tasks.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from rankforge.session import scratch_path, written

#: Rows from which trees grow inside tasks, values (rows times features) that one task holds for that, and cells of counts at a time.
GROWN_ROWS, TASK_VALUES, CELLS = 4000, 128 << 20, 1 << 18
#: Rows that the bins are taken from, as many as Spark takes; gains up to this are none.
SAMPLE_ROWS, NO_GAIN = 10_000, 1e-12


class Rules(NamedTuple):
    """What a tree may look like."""

    depth: int
    min_leaf: int
    min_gain: float
    min_share: float
    features: int
    rate: float
    seed: int

    @classmethod
    def of(cls, model: RandomForestClassifier, width: int) -> Rules:
        return cls(model.getMaxDepth(), model.getMinInstancesPerNode(), model.getMinInfoGain(),
                   model.getMinWeightFractionPerNode(), subset_size(model, width), model.getSubsamplingRate(),
                   model.getSeed() % (1 << 63))


class Tree(NamedTuple):
    """Nodes in an order with parents before children; ``feature`` is -1 at a leaf, a row goes left up to bin ``cut``."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    negative: np.ndarray
    positive: np.ndarray
    count: np.ndarray
    gain: np.ndarray

    def share(self) -> np.ndarray:
        return self.positive / (self.negative + self.positive)

    def reached(self, bins: np.ndarray, depths: list[int]) -> dict[int, np.ndarray]:
        """For each depth the node where a row ends in the tree cut there."""
        flat, width = bins.reshape(-1), bins.shape[1]
        out, at, going = {}, np.zeros(len(bins), np.int32), np.arange(len(bins))
        for depth in range(max(depths) + 1):
            if depth in depths:
                out[depth] = at.copy()
            going = going[self.feature[at[going]] >= 0]
            if not len(going):
                break
            node = at[going]
            left = flat[going * width + self.feature[node]] <= self.cut[node]
            at[going] = np.where(left, self.left[node], self.right[node])
        return out | {d: at for d in depths if d not in out}


def subset_size(model: RandomForestClassifier, width: int) -> int:
    """Features that a node may choose from, by the rules of ``featureSubsetStrategy``."""
    name, several = model.getFeatureSubsetStrategy(), model.getNumTrees() > 1
    if name == "auto":
        name = "sqrt" if several else "all"
    if name == "all":
        return width
    if name == "sqrt":
        return math.ceil(math.sqrt(width))
    if name == "log2":
        return max(1, math.ceil(math.log2(width)))
    if name == "onethird":
        return math.ceil(width / 3)
    return min(width, int(name)) if name.isdigit() and int(name) > 1 else math.ceil(float(name) * width)


def thresholds_of(values: np.ndarray, weight: np.ndarray, bins: int) -> np.ndarray:
    """Limits between the bins of one feature: halfway between all values, or near equal weights if there are too many."""
    numbers, at = np.unique(values, return_inverse=True)
    held = np.bincount(at, weight)
    middle = (numbers[:-1] + numbers[1:]) / 2
    if len(middle) < bins:
        return middle
    stride = held.sum() / bins
    found, so_far, target = [], held[0], stride
    for i, more in enumerate(held[1:].tolist()):
        if abs(so_far - target) < abs(so_far + more - target):
            found.append(middle[i])
            target += stride
        so_far += more
    return np.array(found)


def grow(bins: np.ndarray, y: np.ndarray, weight: np.ndarray | None, sizes: int, rules: Rules, number: int) -> Tree:
    """One tree on rows of bin numbers below ``sizes``; level by level, the open nodes of a level some at a time."""
    draw = np.random.default_rng([rules.seed, number])
    drawn = draw.poisson(rules.rate, len(y))
    row = np.flatnonzero(drawn)
    count = drawn[row].astype(float)
    w, y = count if weight is None else count * weight[row], y[row].astype(np.int64)
    flat, width, k = bins.reshape(-1), bins.shape[1], rules.features
    least = rules.min_share * w.sum()
    totals = np.bincount(y, w, 2)
    feature, cut, left, right, gains = ([np.full(1, v)] for v in (-1, 0, -1, -1, -1.0))
    negative, positive, counted = [totals[:1]], [totals[1:]], [np.array([count.sum()])]
    slot, nodes, made = np.zeros(len(row), np.int64), 1, 1

    def closed(no: np.ndarray, yes: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (no <= 0) | (yes <= 0) | (n < 2 * rules.min_leaf)

    if closed(totals[:1], totals[1:], counted[0])[0]:
        nodes = 0
    for depth in range(rules.depth):
        if not nodes:
            break
        at_once = max(1, CELLS // (k * sizes))
        best = {name: [] for name in ("feature", "cut", "gain", "low", "high")}
        for first in range(0, nodes, at_once):
            some = min(at_once, nodes - first)
            a, b = np.searchsorted(slot, [first, first + some])
            chosen = (np.broadcast_to(np.arange(width), (some, width)) if k == width
                      else np.argpartition(draw.random((some, width)), k, axis=1)[:, :k])
            here = slot[a:b] - first
            cell = np.take(flat, (row[a:b] * width)[:, None] + chosen[here]).astype(np.int64)
            cell += here[:, None] * (k * sizes) + np.arange(k) * sizes
            size = some * k * sizes
            shape = some, k, sizes
            one = np.cumsum(np.bincount((2 * cell + y[a:b, None]).reshape(-1), np.repeat(w[a:b], k), 2 * size).reshape(*shape, 2), axis=2)
            no, yes = one[..., 0], one[..., 1]
            n = no + yes if weight is None else np.cumsum(
                np.bincount(cell.reshape(-1), np.repeat(count[a:b], k), size).reshape(shape), axis=2)
            no_all, yes_all, n_all = no[:, :1, -1:], yes[:, :1, -1:], n[:, :1, -1:]
            low_no, low_yes, low_n = no[..., :-1], yes[..., :-1], n[..., :-1]
            low = low_no + low_yes
            high_no, high_yes = no_all - low_no, yes_all - low_yes
            high = high_no + high_yes
            with np.errstate(divide="ignore", invalid="ignore"):
                score = (low_no * low_no + low_yes * low_yes) / low + (high_no * high_no + high_yes * high_yes) / high
            fits = (low_n >= rules.min_leaf) & (n_all - low_n >= rules.min_leaf) & (low > 0) & (high > 0)
            if least > 0:
                fits &= (low >= least) & (high >= least)
            score = np.where(fits, score, -1.0).reshape(some, -1)
            top = score.argmax(axis=1)
            j, split = np.divmod(top, sizes - 1)
            each = np.arange(some)
            whole = (no_all + yes_all)[:, 0, 0]
            gain = (score[each, top] - (no_all ** 2 + yes_all ** 2)[:, 0, 0] / whole) / whole
            good = (score[each, top] >= 0) & (gain > NO_GAIN) & (gain >= rules.min_gain)
            best["feature"].append(np.where(good, chosen[each, j], -1))
            best["cut"].append(split)
            best["gain"].append(np.where(good, gain, -1.0))
            best["low"].append(np.stack([x[each, j, split] for x in (no, yes, n)]))
            best["high"].append(np.stack([x[:, 0, -1] for x in (no, yes, n)]) - best["low"][-1])
        found = {name: np.concatenate(parts, axis=-1) for name, parts in best.items()}
        inner = found["feature"] >= 0
        pairs = np.cumsum(inner) - 1
        start = made
        # The open nodes of this level, in the order of their slots, get their splits; their children come in pairs.
        places = open_at if depth else np.zeros(1, int)
        for into, values in ((feature, found["feature"]), (cut, found["cut"]), (gains, found["gain"]),
                             (left, np.where(inner, start + 2 * pairs, -1)), (right, np.where(inner, start + 2 * pairs + 1, -1))):
            into[-1][places] = values
        inside = np.stack([found["low"][:, inner], found["high"][:, inner]], axis=2).reshape(3, -1)
        children = inside.shape[1]
        made += children
        for into, values in ((negative, inside[0]), (positive, inside[1]), (counted, inside[2])):
            into.append(values)
        for into, value in ((feature, -1), (cut, 0), (left, -1), (right, -1), (gains, -1.0)):
            into.append(np.full(children, value))
        open_child = ~closed(*inside)
        open_at = np.flatnonzero(open_child)
        nodes = len(open_at)
        number_of = np.cumsum(open_child) - 1
        stay = inner[slot]
        row, slot, y, w, count = row[stay], slot[stay], y[stay], w[stay], count[stay]
        child = 2 * pairs[slot] + (flat[row * width + found["feature"][slot]] > found["cut"][slot])
        stay = np.flatnonzero(open_child[child])
        stay = stay[np.argsort(child[stay], kind="stable")]
        row, slot, y, w, count = row[stay], number_of[child[stay]], y[stay], w[stay], count[stay]
    return pruned(Tree(*(np.concatenate(x) for x in (feature, cut, left, right, negative, positive, counted, gains))),
                  [len(x) for x in feature])


def pruned(tree: Tree, levels: list[int]) -> Tree:
    """The tree with sibling leaves of the same class merged, again and again, and without the nodes that leaves."""
    says, feature = tree.positive > tree.negative, tree.feature.copy()
    ends = np.cumsum(levels)
    for size, end in zip(levels[::-1], ends[::-1]):
        at = np.arange(end - size, end)
        at = at[feature[at] >= 0]
        low, high = tree.left[at], tree.right[at]
        feature[at[(feature[low] < 0) & (feature[high] < 0) & (says[low] == says[high])]] = -1
    kept = np.zeros(len(feature), bool)
    kept[0] = True
    for size, end in zip(levels, ends):
        at = np.arange(end - size, end)
        at = at[kept[at] & (feature[at] >= 0)]
        kept[tree.left[at]] = kept[tree.right[at]] = True
    number = np.cumsum(kept) - 1
    inner = feature >= 0
    return Tree(*(x[kept] for x in (
        feature, tree.cut, np.where(inner, number[tree.left], -1), np.where(inner, number[tree.right], -1),
        tree.negative, tree.positive, tree.count, np.where(inner, tree.gain, -1.0))))


class Held(NamedTuple):
    """The rows of a task. ``fold`` is None where all rows train."""

    row: np.ndarray
    bins: np.ndarray
    y: np.ndarray
    weight: np.ndarray | None
    fold: np.ndarray | None

    @classmethod
    def of(cls, batches: Iterator[pa.RecordBatch], width: int) -> Held:
        kept: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for name in batch.schema.names:
                column = batch.column(name)
                if name == "bins":
                    values = np.frombuffer(column.cast(pa.binary()).buffers()[2], np.uint8)
                    first = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
                    kept.setdefault(name, []).append(values[first:first + len(column) * width].reshape(-1, width).copy())
                else:
                    kept.setdefault(name, []).append(column.to_numpy(zero_copy_only=False))
        whole = {name: np.concatenate(parts) for name, parts in kept.items()}
        return cls(*(whole.get(name) for name in ("row", "bins", "y", "weight", "fold")))

    def only(self, some: np.ndarray) -> Held:
        return Held(*(None if x is None else x[some] for x in self))

    def ordered(self) -> Held:
        """In an order that their values give, so that trees do not depend on how rows came."""
        by = [self.y, np.ascontiguousarray(self.bins).view(f"S{self.bins.shape[1]}")[:, 0]]
        return self.only(np.lexsort(by if self.weight is None else [self.weight, *by]))


def stored_rows(rows: DataFrame, label: str, weight: str | None, fold: str | None = None) -> DataFrame:
    """``row``, ``x`` (the features), ``y``, and ``weight`` and ``fold`` where given, stored once."""
    given = {"weight": F.col(weight).cast("double")} if weight else {}
    given |= {"fold": F.col(fold).cast("bigint")} if fold else {}
    return written(rows.select(
        F.monotonically_increasing_id().alias("row"), vector_to_array("features").alias("x"),
        F.col(label).cast("double").alias("y"), *[c.alias(name) for name, c in given.items()]), "training")


def counted_rows(stored: DataFrame) -> dict[int, tuple[int, int, bool]]:
    """For each fold (0 without folds) its rows, its rows of class 1, and whether all values, labels and weights can be used.

    Spark's own fit says what is wrong with the others.
    """
    good = F.coalesce(F.col("y").isin(0.0, 1.0), F.lit(False))
    # NaN is above all numbers.
    good &= F.coalesce((F.array_max("x") < float("inf")) & (F.array_min("x") > float("-inf")), F.lit(False))
    if "weight" in stored.columns:
        good &= F.coalesce((F.col("weight") >= 0) & ~F.isnan("weight") & (F.col("weight") < float("inf")), F.lit(False))
    fold = F.col("fold") if "fold" in stored.columns else F.lit(0).cast("bigint")
    return {r["fold"]: (r["n"], r["positive"], r["good"]) for r in stored.groupBy(fold.alias("fold")).agg(
        F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("positive"), F.bool_and(good).alias("good")).collect()}


def grows_in_tasks(model, size: int, positive: int, good: bool, width: int) -> bool:
    """Whether this is a forest for two classes whose rows are many enough to be worth it and fit into a task."""
    return (isinstance(model, RandomForestClassifier) and good and positive > 0 and size >= GROWN_ROWS
            and size * width <= TASK_VALUES and model.getMaxBins() <= 256 and model.getImpurity().lower() == "gini"
            and model.getOrDefault("bootstrap"))


def limits_of(stored: DataFrame, size: int, width: int, bins: int) -> list[np.ndarray]:
    """Limits between the bins of every feature, from as large a sample of the rows as Spark takes."""
    wanted = max(SAMPLE_ROWS, bins * bins)
    if size > wanted:
        stored = stored.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < math.ceil(wanted / size * (1 << 20)))
    weighted = "weight" in stored.columns
    sample = stored.select("x", *(["weight"] if weighted else [])).toArrow()
    x = sample["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    weight = sample["weight"].to_numpy() if weighted else np.ones(len(x))
    return [thresholds_of(x[:, i], weight, bins) for i in range(width)]


def binned(stored: DataFrame, limits: list[np.ndarray]) -> DataFrame:
    """The stored rows with ``bins`` in place of ``x``: for each feature a byte, how many limits lie below its value."""
    carry = [c for c in stored.columns if c != "x"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.select(*carry).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            bins = np.stack([np.searchsorted(limit, x[:, i]) for i, limit in enumerate(limits)], axis=1).astype(np.uint8)
            whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1]), len(x), [None, pa.py_buffer(bins)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), whole.cast(pa.binary())], [*carry, "bins"])

    return written(stored.mapInArrow(run, f"{schema}, bins binary"), "bins")


def most_bins(limits: list[np.ndarray]) -> int:
    return max(2, 1 + max(map(len, limits)))


def side_by_side(spark: SparkSession, jobs: list[Callable[[], object]]) -> list:
    """Jobs of one task each, as many at a time as there are cores."""
    with ThreadPoolExecutor(max(1, min(len(jobs), spark.sparkContext.defaultParallelism))) as pool:
        return [x.result() for x in [pool.submit(job) for job in jobs]]


NODES = ("tree bigint, id bigint, feature bigint, threshold double, left bigint, right bigint, negative double, "
         "positive double, count double, gain double")


def grown_forests(rows: DataFrame, label: str, weight: str | None, width: int,
                  model: RandomForestClassifier) -> list[RandomForestClassificationModel] | None:
    """The trees of ``model`` as forests of some trees each, or None if they have to grow otherwise.

    Tasks write their trees in the form of saved models, which are loaded one by one.
    """
    spark = rows.sparkSession
    stored = stored_rows(rows, label, weight)
    size, positive, good = counted_rows(stored).get(0, (0, 0, True))
    if not grows_in_tasks(model, size, positive, good, width):
        return None
    limits = limits_of(stored, size, width, model.getMaxBins())
    table, sizes, rules = binned(stored, limits), most_bins(limits), Rules.of(model, width)
    trees = model.getNumTrees()
    each = min(20, -(-trees // (2 * spark.sparkContext.defaultParallelism)))

    def some(first: int) -> RandomForestClassificationModel:
        numbers = range(first, min(trees, first + each))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Held.of(batches, width).ordered()
            for i, number in enumerate(numbers):
                tree = grow(held.bins, held.y, held.weight, sizes, rules, number)
                n, inner = len(tree.feature), tree.feature >= 0
                threshold = np.zeros(n)
                threshold[inner] = [limits[f][c] for f, c in zip(tree.feature[inner], tree.cut[inner])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                    np.full(n, i), np.arange(n), tree.feature, threshold, tree.left, tree.right, tree.negative,
                    tree.positive, tree.count, tree.gain)], [c.split()[0] for c in NODES.split(", ")])

        return loaded_forest(table.coalesce(1).mapInArrow(run, NODES), len(numbers), width, model)

    return side_by_side(spark, [lambda first=first: some(first) for first in range(0, trees, each)])


def loaded_forest(nodes: DataFrame, trees: int, width: int, model: RandomForestClassifier) -> RandomForestClassificationModel:
    """A forest of tables of nodes, written as Spark saves its forests and loaded."""
    spark = nodes.sparkSession
    path = scratch_path(spark, "forest")
    no, yes, inner = F.col("negative"), F.col("positive"), F.col("feature") >= 0
    whole = no + yes
    stats = F.array(no, yes)
    node = F.struct(
        F.col("id").cast("int").alias("id"), F.when(yes > no, 1.0).otherwise(0.0).alias("prediction"),
        (1 - (no * no + yes * yes) / (whole * whole)).alias("impurity"), stats.alias("impurityStats"),
        F.col("count").cast("bigint").alias("rawCount"), F.col("gain"), F.col("left").cast("int").alias("leftChild"),
        F.col("right").cast("int").alias("rightChild"),
        F.struct(F.col("feature").cast("int").alias("featureIndex"),
                 F.when(inner, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
                 F.lit(-1).alias("numCategories")).alias("split"))
    nodes.select(F.col("tree").cast("int").alias("treeID"), node.alias("nodeData")).write.parquet(f"{path}/data")

    def facts(kind: str, without: tuple[str, ...] = (), **more) -> str:
        given, usual = ({p.name: v for p, v in params.items() if p.name not in without}
                        for params in (model._paramMap, model._defaultParamMap))
        return json.dumps({
            "class": f"org.apache.spark.ml.classification.{kind}", "timestamp": 0, "sparkVersion": spark.version,
            "uid": f"{kind}_{uuid.uuid4().hex[:12]}", "paramMap": given, "defaultParamMap": usual} | more)

    forest_only = ("numTrees", "bootstrap", "subsamplingRate", "featureSubsetStrategy")
    alone = [(i, facts("DecisionTreeClassificationModel", forest_only), 1.0) for i in range(trees)]
    spark.createDataFrame(alone, "_1 INT, _2 STRING, _3 DOUBLE").coalesce(1).write.parquet(f"{path}/treesMetadata")
    whole_facts = facts("RandomForestClassificationModel", numFeatures=width, numClasses=2, numTrees=trees)
    spark.createDataFrame([(whole_facts,)], "value STRING").coalesce(1).write.text(f"{path}/metadata")
    return RandomForestClassificationModel.load(path)


def held_out_sums(tables: dict[int, tuple[DataFrame, int]], units: list[tuple[int, Rules, range]], width: int,
                  depths: list[int]) -> DataFrame:
    """``unit``, ``row``, ``y``, ``sums``: for held-out rows the sums of the class shares of a unit's trees, cut at each depth.

    A unit is a fold, rules and numbers of trees; a fold has a table of its rows in bins and their most bins.  Trees grow
    on the other folds in one task that scores the fold with them, so no forest leaves its task.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    schema = "unit bigint, row bigint, y double, sums array<double>"

    def score(unit: int) -> str:
        fold, rules, numbers = units[unit]
        table, sizes = tables[fold]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Held.of(batches, width)
            train, test = held.only(held.fold != fold).ordered(), held.only(held.fold == fold)
            sums = np.zeros((len(test.row), len(depths)))
            for number in numbers:
                tree = grow(train.bins, train.y, train.weight, sizes, rules, number)
                share, reached = tree.share(), tree.reached(test.bins, depths)
                for i, depth in enumerate(depths):
                    sums[:, i] += share[reached[depth]]
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(sums) + 1) * len(depths), pa.int32()), pa.array(sums.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sums), unit)), pa.array(test.row), pa.array(test.y), lists], ["unit", "row", "y", "sums"])

        path = scratch_path(spark, "sums")
        table.coalesce(1).mapInArrow(run, schema).write.parquet(path)
        return path

    paths = side_by_side(spark, [lambda unit=unit: score(unit) for unit in range(len(units))])
    return spark.read.schema(schema).parquet(*paths)


def fold_tables(rows: DataFrame, label: str, fold: str, folds: int, width: int,
                model: RandomForestClassifier) -> dict[int, tuple[DataFrame, int]] | None:
    """For every fold the rows in bins taken from the other folds, or None if its trees have to grow otherwise."""
    stored = stored_rows(rows, label, None, fold)
    counts = counted_rows(stored)
    sizes = {}
    for i in range(folds):
        others = [counts[j] for j in counts if j != i]
        size = sum(n for n, _, _ in others)
        if not grows_in_tasks(model, size, sum(p for _, p, _ in others), all(c[2] for c in counts.values()), width):
            return None
        sizes[i] = size

    def table(i: int) -> tuple[DataFrame, int]:
        limits = limits_of(stored.where(F.col("fold") != i), sizes[i], width, model.getMaxBins())
        return binned(stored, limits), most_bins(limits)

    return dict(enumerate(side_by_side(rows.sparkSession, [lambda i=i: table(i) for i in range(folds)])))


def slices(trees: range, parts: int) -> list[range]:
    """About so many runs of neighbouring trees."""
    each = -(-len(trees) // max(1, parts))
    return [trees[i:i + each] for i in range(0, len(trees), each)]


def sum_in_order(unit: str, value: str):
    """The sum of a group's values in the order of their units, so equal rows get equal sums."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(unit).alias("unit"), F.col(value).alias("value"))))
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x["value"])
