"""Tree models: fitting, prediction, tuning, cross-validation and importance."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, functions as F

from rankforge.config import SEED
from rankforge.operators import growth
from rankforge.operators.metrics import grouped_auc, roc_auc
from rankforge.operators.ordering import shuffled_rank
from rankforge.operators.scoring import class_from_probability
from rankforge.operators.toplists import best_first, top_rows
from rankforge.operators.training import scaler_statistics, stratified_folds
from rankforge.session import written

#: Training rows from which the trees of a forest grow in groups, trees of a group, and rows that one task holds for a group.
GROUPED_ROWS, GROUP_TREES, PART_ROWS = 4000, 20, 250_000


def forest(trees: int = 200, depth: int = 15, min_leaf: int = 1, seed: int = SEED, **kw):
    return RandomForestClassifier(
        featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf,
        seed=seed, **kw)


def boosting(rounds: int = 100, depth: int = 5, rate: float = 0.1, seed: int = SEED, **kw):
    return GBTClassifier(
        featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, **kw)


def estimator(model_type: str = "rf", **kw):
    if model_type == "rf":
        return forest(**kw)
    if model_type == "gb":
        return boosting(**kw)
    raise ValueError(f"unknown model type {model_type}")


def scaled_name(column: str) -> str:
    return f"_z_{column}"


def scaling_stage(train: DataFrame, columns: list[str]) -> SQLTransformer:
    """Standardizing by mean and population deviation of the training rows, as a stage that is saved with a model.

    One small row of statistics comes to the driver.  A constant column is only centred.
    """
    stats = train.select(scaler_statistics(train, columns).alias("s")).first()
    stats = stats["s"].asDict() if stats else {}
    items = []
    for c in columns:
        mean, std = stats[c]["mean"] or 0.0, stats[c]["std"] or 0.0
        items.append(f"(`{c}` - CAST('{mean!r}' AS DOUBLE)) / CAST('{(std if std > 0 else 1.0)!r}' AS DOUBLE) "
                     f"AS `{scaled_name(c)}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(items)} FROM __THIS__")


def assembler(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")


def fit(train: DataFrame, columns: list[str], label: str, model, scaled: bool = True,
        weight: str | None = None) -> PipelineModel:
    """Fit a tree model on named feature columns; the label is a column of the same row.

    With ``scaled`` the fitted pipeline standardizes raw columns itself.
    """
    model = model.copy().setLabelCol(label)
    if weight:
        model.setWeightCol(weight)
    carried = [label, *([weight] if weight else [])]
    rows = train.select(*columns, *carried)
    stages = [assembler(columns)]
    if scaled:
        stages = [scaling_stage(rows, columns), assembler([scaled_name(c) for c in columns])]
    several = isinstance(model, RandomForestClassifier) and model.getNumTrees() > GROUP_TREES
    size = rows.count() if several else 0
    if size < GROUPED_ROWS:
        return Pipeline(stages=[*stages, model]).fit(rows)
    for stage in stages:
        rows = stage.transform(rows)
    rows = rows.select("features", *carried)
    grown = growth.grown_forests(rows, label, weight, len(columns), model) if size >= growth.GROWN_ROWS else None
    return PipelineModel(stages=[*stages, joined_forest(grown) if grown else fit_in_groups(rows, size, model)])


def fit_in_groups(rows: DataFrame, size: int, model: RandomForestClassifier) -> RandomForestClassificationModel:
    """The forest of ``model``, whose trees grow in groups side by side, every tree on draws from all rows.

    In a pass over the rows every task sends the statistics of every open node, so a forest grown at once takes as long
    as one task needs for all its nodes, on any number of cores, and its shuffle grows with tasks times nodes.  Groups
    share the cores instead, each on as few tasks as hold its rows.
    """
    stored = written(rows, "training")
    parts = -(-size // PART_ROWS)
    trees = model.getNumTrees()

    def grow(first: int) -> RandomForestClassificationModel:
        some = model.copy().setNumTrees(min(GROUP_TREES, trees - first)).setSeed(model.getSeed() + 1_000_003 * first)
        return some.fit(stored.coalesce(parts))

    at_once = max(1, rows.sparkSession.sparkContext.defaultParallelism // parts)
    with ThreadPoolExecutor(at_once) as pool:
        return joined_forest(list(pool.map(grow, range(0, trees, GROUP_TREES))))


def joined_forest(groups: list[RandomForestClassificationModel]) -> RandomForestClassificationModel:
    """One forest of the trees of all groups, in their order."""
    first, own = groups[0], [tree._java_obj for g in groups for tree in g.trees]
    context = SparkSession.active().sparkContext
    kinds = context._jvm.org.apache.spark.ml.classification
    trees = context._gateway.new_array(kinds.DecisionTreeClassificationModel, len(own))
    for i, tree in enumerate(own):
        trees[i] = tree
    forest = kinds.RandomForestClassificationModel(first.uid, trees, first.numFeatures, first.numClasses)
    out = first._copyValues(RandomForestClassificationModel(forest))._set(numTrees=len(own))
    out._transfer_params_to_java()
    return out


def with_scaling(scaling: SQLTransformer, fitted: PipelineModel) -> PipelineModel:
    """A pipeline on raw columns from a scaling stage and a pipeline fitted on scaled ones."""
    return PipelineModel(stages=[scaling, *fitted.stages])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Append ``probability_active`` and ``predicted_activity``."""
    out = model.transform(df)
    out = out.withColumn("probability_active", vector_to_array("probability")[1])
    out = out.withColumn("predicted_activity", class_from_probability(F.col("probability_active")))
    made = [c for c in out.columns if c.startswith("_z_") and c not in df.columns]
    return out.drop("features", "rawPrediction", "probability", "prediction", *made)


def fit_regressor(train: DataFrame, columns: list[str], label: str, trees: int = 100,
                  depth: int = 5, seed: int = SEED, subset: str = "auto") -> PipelineModel:
    model = RandomForestRegressor(
        featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy=subset)
    return Pipeline(stages=[assembler(columns), model]).fit(train.select(*columns, label))


def grid_search(train: DataFrame, columns: list[str], label: str, key: str,
                grid: dict[str, list] | None = None, folds: int = 3, seed: int = SEED,
                parallelism: int = 4):
    """Search forest settings by stratified cross-validation; returns the fitted validator.

    Spark forests have no minimum rows to split a node; the smallest gain of a split takes that
    place in the default grid of 24 settings.
    """
    grid = grid or {"numTrees": [100, 200], "maxDepth": [5, 10, 20],
                    "minInstancesPerNode": [1, 2], "minInfoGain": [0.0, 1e-4]}
    model = forest(seed=seed).setLabelCol(label)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(model.getParam(name), values)
    folded = written(stratified_folds(train, label, key, folds, seed), "folds")
    pipeline = Pipeline(stages=[assembler(columns), model])
    return CrossValidator(
        estimator=pipeline, estimatorParamMaps=builder.build(), numFolds=folds, foldCol="fold",
        evaluator=BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0),
        parallelism=parallelism, seed=seed,
    ).fit(folded.select(*columns, label, "fold"))


def cross_validate(df: DataFrame, columns: list[str], label: str, key: str, model,
                   folds: int = 5, seed: int = SEED) -> DataFrame:
    """Exact AUC per fold, one fitted model each.

    Forests on many rows grow in the tasks that score with them, so the driver holds none.
    """
    folded = written(stratified_folds(df, label, key, folds, seed), "folds")
    if isinstance(model, RandomForestClassifier) and model.getNumTrees() > GROUP_TREES:
        rows = assembler(columns).transform(folded.select(*columns, label, "fold"))
        tables = growth.fold_tables(rows, label, "fold", folds, len(columns), model)
        if tables:
            return cross_validated_forest(tables, len(columns), model)

    def score(i: int) -> DataFrame:
        fitted = fit(folded.filter(F.col("fold") != i), columns, label, model, scaled=False)
        scored = predict(fitted, folded.filter(F.col("fold") == i))
        return roc_auc(scored, label, "probability_active").select(F.lit(i).alias("fold"), F.col("auc_roc").alias("score"))

    with ThreadPoolExecutor(2) as pool:  # the driver's part of one fold beside the tasks of another
        parts = list(pool.map(score, range(folds)))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def cross_validated_forest(tables: dict[int, tuple[DataFrame, int]], width: int, model: RandomForestClassifier) -> DataFrame:
    """Exact AUC of the forest of every fold; a null score where a class is missing."""
    spark = next(iter(tables.values()))[0].sparkSession
    trees, rules = model.getNumTrees(), growth.Rules.of(model, width)
    parts = -(-3 * spark.sparkContext.defaultParallelism // len(tables))
    units = [(fold, rules, some) for fold in tables for some in growth.slices(range(trees), parts)]
    sums = growth.held_out_sums(tables, units, width, [rules.depth])
    fold_of = F.array(*[F.lit(fold) for fold, _, _ in units])
    scored = sums.select(F.get(fold_of, F.col("unit").cast("int")).alias("fold"), "unit", "row", "y", F.col("sums")[0].alias("sum"))
    scored = scored.groupBy("fold", "row", "y").agg((growth.sum_in_order("unit", "sum") / trees).alias("score"))
    every = spark.createDataFrame([(fold,) for fold in tables], "fold INT")
    return every.join(F.broadcast(grouped_auc(scored, ["fold"], "y", "score")), "fold", "left").select(
        "fold", F.col("auc_roc").alias("score"))


def score_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"))


def importance(model: PipelineModel, columns: list[str], n: int = 15) -> DataFrame:
    """The most important features of a fitted forest or boosted model."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    table = SparkSession.active().createDataFrame(
        list(zip(columns, values)), "feature STRING, importance DOUBLE")
    return top_rows(table, best_first("importance", "feature"), n)


def permutation_importance(model: PipelineModel, df: DataFrame, columns: list[str], label: str, key: str,
                           seed: int = SEED) -> DataFrame:
    """How much the exact AUC falls when one feature's values are dealt anew among the rows.

    Values are exchanged by an equi-join of two seeded orders of the rows, once per feature; ranks
    are numbered in buckets, so no task holds the table.
    """
    rows = written(df.select(key, label, *columns).withColumn("_one", F.lit(1)), "rows")
    own = shuffled_rank(rows, "_one", key, seed).drop("size")
    base = roc_auc(predict(model, rows), label, "probability_active").first()["auc_roc"]
    found = []
    for i, column in enumerate(columns):
        other = shuffled_rank(rows.select("_one", key, column), "_one", key, seed + 1 + i)
        dealt = own.drop(column).join(other.select("rank", column), "rank")
        score = roc_auc(predict(model, dealt), label, "probability_active").first()["auc_roc"]
        found.append((column, None if base is None or score is None else base - score))
    return rows.sparkSession.createDataFrame(found, "feature STRING, fall DOUBLE")
