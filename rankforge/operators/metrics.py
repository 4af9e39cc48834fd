"""Exact classification and regression metrics as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from rankforge.functions.text import nan_to_null
from rankforge.operators.ordering import running_totals
from rankforge.session import written

#: Parts that a range of values is cut into in one round, and rows of a range that are looked at one by one.
BINS, SORTED_ROWS = 1024, 4096


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def outcome_counts(df: DataFrame, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """One row with the four outcome counts of a binary prediction."""
    t, g = F.col(truth), F.col(guess)
    return df.agg(
        F.count_if((t == 1) & (g == 1)).alias("tp"), F.count_if((t == 0) & (g == 1)).alias("fp"),
        F.count_if((t == 1) & (g == 0)).alias("fn"), F.count_if((t == 0) & (g == 0)).alias("tn"))


def confusion_matrix(df: DataFrame, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """Four rows (y_true, y_pred, rows); combinations without rows are there with 0."""
    counts = outcome_counts(df, truth, guess)
    cells = F.array(*[
        F.struct(F.lit(t).alias("y_true"), F.lit(g).alias("y_pred"), F.col(c).alias("rows"))
        for t, g, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
    ])
    return counts.select(F.inline(cells))


def classification_metrics(df: DataFrame, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """Accuracy, precision, recall, F1 and Matthews correlation; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    d = [c.cast("double") for c in (tp + fp, tp + fn, tn + fp, tn + fn)]
    mcc = _share(tp.cast("double") * tn - fp.cast("double") * fn,
                 F.sqrt(d[0]) * F.sqrt(d[1]) * F.sqrt(d[2]) * F.sqrt(d[3]))
    return outcome_counts(df, truth, guess).select(
        _share(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        mcc.alias("mcc"))


def class_report(df: DataFrame, truth: str = "y_true", guess: str = "y_pred",
                 classes: tuple = (0, 1)) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    t, g = F.col(truth), F.col(guess)
    counted = df.agg(*[
        F.struct(
            F.count_if((t == c) & (g == c)).alias("hit"), F.count_if(g == c).alias("said"),
            F.count_if(t == c).alias("support")).alias(f"c{c}") for c in classes])
    per_class = F.array(*[
        F.struct(
            F.lit(str(c)).alias("class"),
            _share(F.col(f"c{c}.hit"), F.col(f"c{c}.said")).alias("precision"),
            _share(F.col(f"c{c}.hit"), F.col(f"c{c}.support")).alias("recall"),
            _share(2 * F.col(f"c{c}.hit"), F.col(f"c{c}.said") + F.col(f"c{c}.support")).alias("f1"),
            F.col(f"c{c}.support").alias("support")) for c in classes])
    rows = counted.select(per_class.alias("r"))

    def average(name: str, weight) -> Column:
        def total(value) -> Column:
            return F.aggregate("r", F.lit(0.0), lambda s, x: s + value(x))
        return F.struct(
            F.lit(name).alias("class"),
            *[_share(total(lambda x, m=m: x[m] * weight(x)), total(weight)).alias(m)
              for m in ("precision", "recall", "f1")],
            F.aggregate("r", F.lit(0).cast("bigint"), lambda s, x: s + x["support"]).alias("support"))

    macro = average("macro avg", lambda x: F.lit(1.0))
    weighted = average("weighted avg", lambda x: x["support"].cast("double"))
    return rows.select(F.inline(F.concat("r", F.array(macro, weighted))))


def score_steps(df: DataFrame, truth: str = "y_true", score: str = "y_prob") -> DataFrame:
    """Per distinct score: rows of each class at it, below it and at the next lower score, and the class totals.

    Rows with a null or NaN score are left out.  The counts per score are stored once, so the scored
    table is read in one pass.
    """
    by_score = df.filter(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    run = running_totals(by_score, "score", ["pos", "neg"], ("pos", "neg"))
    totals = run.select(F.struct(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("score").alias("top"))).scalar()
    return run.withColumn("_t", totals).withColumns(
        {"all_pos": F.col("_t.pos"), "all_neg": F.col("_t.neg"), "top_score": F.col("_t.top")}).drop("_t")


def roc_auc(df: DataFrame, truth: str = "y_true", score: str = "y_prob") -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null when a class is missing."""
    steps = score_steps(df, truth, score)
    won = F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2))
    return steps.agg(F.try_divide(
        won, F.max("all_pos").cast("double") * F.max("all_neg")).alias("auc_roc"))


def grouped_auc(df: DataFrame, groups: list[str], truth: str = "y_true", score: str = "y_prob") -> DataFrame:
    """The exact area under the ROC curve of every group, all in one run over ranges of (group, score)."""
    given = df.filter(F.col(score).isNotNull() & ~F.isnan(score)).select(
        F.struct(*groups, F.col(score).alias("_score")).alias("at"), F.col(truth).alias("y"))
    by_score = given.groupBy("at").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    run = running_totals(by_score, "at", ["neg"]).select("at", "pos", "neg", "below_neg")
    # Negatives below count from the start of the group: its least running total.
    won = F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2)) - F.sum("pos") * F.min("below_neg")
    return run.groupBy(*[F.col(f"at.{g}").alias(g) for g in groups]).agg(F.try_divide(
        won, F.sum("pos").cast("double") * F.sum("neg")).alias("auc_roc"))


def average_precision(df: DataFrame, truth: str = "y_true", score: str = "y_prob") -> DataFrame:
    """Precision at each distinct score weighted by the recall gained there."""
    steps = score_steps(df, truth, score)
    found = F.col("all_pos") - F.col("below_pos")
    flagged = found + F.col("all_neg") - F.col("below_neg")
    gained = F.try_divide(F.col("pos").cast("double"), F.col("all_pos"))
    return steps.agg(F.sum(gained * found / flagged).alias("average_precision"))


def curve_points(df: DataFrame, truth: str = "y_true", score: str = "y_prob",
                 drop_collinear: bool = False) -> DataFrame:
    """Both curves at every distinct score, and their common end point above all scores.

    At the end point (threshold infinity) nothing is flagged: rates and recall 0, precision 1.  With
    ``drop_collinear`` points between two equal steps of the ROC curve go: a score stays where its
    rows of both classes are not as many as those of the next lower score, or where it is the highest
    or lowest one.
    """
    steps = score_steps(df, truth, score)
    if drop_collinear:
        steps = steps.where(
            F.col("previous_pos").isNull() | (F.col("score") == F.col("top_score"))
            | (F.col("pos") != F.col("previous_pos")) | (F.col("neg") != F.col("previous_neg")))
    found = F.col("all_pos") - F.col("below_pos")
    false = F.col("all_neg") - F.col("below_neg")
    points = steps.select(
        F.col("score").cast("double").alias("threshold"),
        F.try_divide(false.cast("double"), F.col("all_neg")).alias("fpr"),
        F.try_divide(found.cast("double"), F.col("all_pos")).alias("tpr"),
        F.try_divide(found.cast("double"), found + false).alias("precision"))
    end = df.sparkSession.createDataFrame(
        [(float("inf"), 0.0, 0.0, 1.0)], "threshold DOUBLE, fpr DOUBLE, tpr DOUBLE, precision DOUBLE")
    return points.unionByName(end).withColumn("recall", F.col("tpr"))


def roc_points(df: DataFrame, truth: str = "y_true", score: str = "y_prob",
               drop_collinear: bool = True) -> DataFrame:
    """False and true positive rate at the scores where the curve bends, and at the end point."""
    return curve_points(df, truth, score, drop_collinear).select("threshold", "fpr", "tpr")


def precision_recall_points(df: DataFrame, truth: str = "y_true", score: str = "y_prob") -> DataFrame:
    """Precision and recall at every distinct score and at the end point."""
    return curve_points(df, truth, score).select("threshold", "precision", "recall")


def evaluate_classification(df: DataFrame, truth: str = "y_true", guess: str = "y_pred",
                            score: str | None = None) -> DataFrame:
    """One row with all class metrics and, where a score is given, the area under the curve."""
    out = classification_metrics(df, truth, guess)
    if score is not None:
        out = out.withColumn("auc_roc", roc_auc(df, truth, score).scalar())
    return out


def regression_metrics(df: DataFrame, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """MAE, MSE, RMSE and R2 in one pass; R2 is null when the truth is constant."""
    error = F.col(truth) - F.col(guess)
    return df.agg(
        F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"),
        F.var_pop(truth).alias("_var"),
    ).select(
        "mae", "mse", F.sqrt("mse").alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.col("mse"), F.col("_var"))).alias("r2"))


def values_at(values: DataFrame, ranks: list[int], low: float, high: float, rows: int) -> dict[int, float]:
    """The values of column ``v`` (no nulls) at places of the sorted column, by rounds that narrow ranges of values.

    A round counts the rows of every range that holds a wanted place in ``BINS`` parts, and goes on with
    the parts that hold one, between their own least and greatest value.  A range of one value is done;
    one of few rows is counted value by value.  What a round keeps is bounded by ``BINS`` for each place.
    """
    found: dict[int, float] = {}
    open_ranges = {(low, high): (rows, sorted(set(ranks)))}  # places count from the start of the range
    begin = {(low, high): 0}
    v = F.col("v")
    while open_ranges:
        few, wide = [], []
        for (a, b), (n, wanted) in open_ranges.items():
            if a == b:
                found |= {begin[a, b] + r: a for r in wanted}
            else:
                (few if n <= SORTED_ROWS or not b / 2 - a / 2 > 0 else wide).append((a, b))
        inside = F.lit(None).cast("struct<a:int,part:double>")
        for i, (a, b) in enumerate([*few, *wide]):
            share = (v / 2 - F.lit(a / 2)) / F.lit(b / 2 - a / 2)
            part = v if i < len(few) else F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("double")
            inside = F.when(v.between(F.lit(a), F.lit(b)), F.struct(F.lit(i).alias("a"), part.alias("part"))).otherwise(inside)
        if not (few or wide):
            break
        parts = values.select("v", inside.alias("x")).where("x is not null").groupBy("x.a", "x.part").agg(
            F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("a", "part").collect()
        next_ranges, next_begin = {}, {}
        for i, key in enumerate([*few, *wide]):
            wanted, at = open_ranges[key][1], 0
            for part in (p for p in parts if p["a"] == i):
                mine = [r - at for r in wanted if at <= r < at + part["n"]]
                if mine:
                    next_ranges[part["low"], part["high"]] = (part["n"], mine)
                    next_begin[part["low"], part["high"]] = begin[key] + at
                at += part["n"]
        open_ranges, begin = next_ranges, next_begin
    return found


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles of a column, linear between the two nearest places; nulls and NaN are left out."""
    values = written(df.select(nan_to_null(F.col(value).cast("double")).alias("v")).where("v is not null"), "values")
    rows, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not rows:
        return [None] * len(shares)
    places = [(math.floor((rows - 1) * s), (rows - 1) * s) for s in shares]
    wanted = [p for at, exact in places for p in (at, min(at + (exact > at), rows - 1))]
    known = values_at(values, wanted, low, high, rows)
    return [known[at] if exact == at else known[at] + (exact - at) * (known[at + 1] - known[at]) for at, exact in places]


def distribution(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, deviation, quartiles and range of a column, of one row; quartiles are exact (:func:`quantiles`)."""
    basic = df.agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    names = ["q25", "q50", "q75"]
    return basic.select("count", "mean", "std", "min", *[
        F.lit(q).cast("double").alias(n) for n, q in zip(names, quantiles(df, value, [0.25, 0.5, 0.75]))], "max")


def prediction_summary(df: DataFrame, guess: str = "predicted_activity",
                       probability: str = "probability_active") -> DataFrame:
    """How many rows are predicted active, their share and the mean probability."""
    return df.agg(
        F.sum(guess).alias("active"), (F.count("*") - F.sum(guess)).alias("inactive"),
        F.avg(guess).alias("active_share"), F.avg(probability).alias("mean_probability"))
