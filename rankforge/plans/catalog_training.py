"""Registered queries: splits, scaling, weights, metrics, models and training runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankforge.functions.sequences import add_descriptors
from rankforge.functions.text import add_all
from rankforge.operators import forests, metrics, models, training
from rankforge.operators.cleaning import feature_columns
from rankforge.operators.joins import imines
from rankforge.operators.toplists import best_first
from rankforge.plans import jobs, standins as V
from rankforge.plans.catalog_generation import generated_training_rows
from rankforge.plans.registry import query, rounded, rounded_sql
from rankforge.session import scratch_path, written
from rankforge.sources import sinks

RANKED = """ranked AS (
  SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) - 1 AS r,
    count(*) OVER (PARTITION BY quality) AS n FROM labels)"""
SPLIT = RANKED + """,
splits AS (
  SELECT doc_id, quality, CASE WHEN r < n * 2 // 10 THEN 'test' WHEN r < n * 3 // 10 THEN 'validation' ELSE 'train' END AS split
  FROM ranked)"""


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return V.read(spark, folder, "labels").select("doc_id", "quality")


@query("t01_three_way_split", f"WITH {SPLIT} SELECT * FROM splits")
def three_way(spark: SparkSession, folder: str) -> DataFrame:
    return training.stratified_split(labels(spark, folder), "quality", "doc_id", 0.2, 0.1)


@query("t02_two_way_split", f"""WITH {RANKED}
SELECT doc_id, quality, CASE WHEN r < n * 2 // 10 THEN 'test' ELSE 'train' END AS split FROM ranked""")
def two_way(spark: SparkSession, folder: str) -> DataFrame:
    return training.stratified_split(labels(spark, folder), "quality", "doc_id", 0.2)


@query("w04_stratified_folds", f"WITH {RANKED} SELECT doc_id, quality, CAST(r % 5 AS INT) AS fold FROM ranked")
def folds(spark: SparkSession, folder: str) -> DataFrame:
    return training.stratified_folds(labels(spark, folder), "quality", "doc_id", 5)


@query("a09_split_histogram", f"WITH {SPLIT} SELECT split, quality, count(*) AS rows FROM splits GROUP BY ALL")
def histogram(spark: SparkSession, folder: str) -> DataFrame:
    return training.split_histogram(three_way(spark, folder), "quality")


@query("t03_standard_scaling", rounded_sql(V.sql("molecules", """
SELECT mol_id, ("MW" - avg("MW") FILTER (WHERE brand <= 20) OVER ()) / stddev_pop("MW") FILTER (WHERE brand <= 20) OVER () AS "MW",
  ("TPSA" - avg("TPSA") FILTER (WHERE brand <= 20) OVER ()) / stddev_pop("TPSA") FILTER (WHERE brand <= 20) OVER () AS "TPSA",
  0.0::DOUBLE AS constant FROM molecules"""), "MW TPSA constant"))
def scaling(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.molecules(spark, folder).select("mol_id", "brand", "MW", "TPSA", F.lit(3.0).alias("constant"))
    scaled = training.scale(rows, rows.filter("brand <= 20"), ["MW", "TPSA", "constant"])
    return rounded(scaled.drop("brand"))


@query("t05_class_weights", rounded_sql("""
SELECT doc_id, quality, (SELECT count(*) FROM labels) / (2.0 * count(*) OVER (PARTITION BY quality)) AS weight FROM labels""", "weight"))
def weights(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(training.add_class_weights(labels(spark, folder), "quality"))


OUTCOMES = """counts AS (
  SELECT count(*) FILTER (WHERE y_true = 1 AND y_pred = 1)::DOUBLE AS tp, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1)::DOUBLE AS fp,
    count(*) FILTER (WHERE y_true = 1 AND y_pred = 0)::DOUBLE AS fn, count(*) FILTER (WHERE y_true = 0 AND y_pred = 0)::DOUBLE AS tn
  FROM labelled)"""


@query("t12_confusion_matrix", V.sql("labelled", """
SELECT t AS y_true, p AS y_pred, count(l.doc_id) AS rows FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS c(t, p)
LEFT JOIN labelled l ON l.y_true = t AND l.y_pred = p GROUP BY t, p"""))
def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion_matrix(V.labelled_scores(spark, folder))


AUC_SQL = """(SELECT (sum(CASE WHEN y_true = 1 THEN avg_rank END) - p * (p + 1) / 2) / (p * q) FROM (
  SELECT y_true, rank() OVER (ORDER BY y_prob) + (count(*) OVER (PARTITION BY y_prob) - 1) / 2 AS avg_rank,
    sum(y_true) OVER () AS p, sum(1 - y_true) OVER () AS q FROM labelled) GROUP BY p, q)"""


@query("t13_t15_class_metrics", rounded_sql(V.sql("labelled", f"""
WITH {OUTCOMES}
SELECT (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
  2 * tp / (2 * tp + fp + fn) AS f1, (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc,
  {AUC_SQL} AS auc_roc FROM counts"""), "accuracy precision recall f1 mcc auc_roc"))
def class_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.evaluate_classification(V.labelled_scores(spark, folder), score="y_prob"))


@query("t14_w05_roc_auc", rounded_sql(V.sql("labelled", f"SELECT {AUC_SQL} AS auc_roc"), "auc_roc"))
def auc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.roc_auc(V.labelled_scores(spark, folder)))


STEPS = """steps AS (
  SELECT y_prob, sum(y_true) AS pos, sum(sum(y_true)) OVER w AS tp, sum(count(*)) OVER w AS flagged,
    sum(sum(y_true)) OVER () AS p, sum(sum(1 - y_true)) OVER () AS q
  FROM labelled GROUP BY y_prob WINDOW w AS (ORDER BY y_prob DESC))"""


@query("t16_average_precision", rounded_sql(V.sql("labelled", f"""
WITH {STEPS} SELECT CAST(sum(pos / p * tp / flagged) AS DOUBLE) AS average_precision FROM steps"""), "average_precision"))
def ap(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.average_precision(V.labelled_scores(spark, folder)))


@query("t17_curve_points", rounded_sql(V.sql("labelled", f"""
WITH {STEPS}
SELECT y_prob AS threshold, CAST((flagged - tp) / q AS DOUBLE) AS fpr, CAST(tp / p AS DOUBLE) AS tpr, CAST(tp / flagged AS DOUBLE) AS precision, CAST(tp / p AS DOUBLE) AS recall FROM steps
UNION ALL SELECT 'infinity'::DOUBLE, 0, 0, 1, 0"""),
    "threshold fpr tpr precision recall"))
def curves(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.labelled_scores(spark, folder)
    return rounded(metrics.curve_points(rows))


@query("t17_roc_curve", rounded_sql(V.sql("labelled", f"""
WITH {STEPS},
bends AS (
  SELECT *, flagged - tp AS fp, lag(pos) OVER w AS low_pos, lag(rows) OVER w AS low_rows, lead(pos) OVER w AS high_pos
  FROM (SELECT s.*, n AS rows FROM steps s JOIN (SELECT y_prob, count(*) AS n FROM labelled GROUP BY y_prob) USING (y_prob))
  WINDOW w AS (ORDER BY y_prob))
SELECT y_prob AS threshold, CAST(fp / q AS DOUBLE) AS fpr, CAST(tp / p AS DOUBLE) AS tpr FROM bends
WHERE low_pos IS NULL OR high_pos IS NULL OR pos <> low_pos OR rows - pos <> low_rows - low_pos
UNION ALL SELECT 'infinity'::DOUBLE, 0, 0"""), "threshold fpr tpr"))
def roc_curve(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.roc_points(V.labelled_scores(spark, folder)))


@query("t18_class_report", rounded_sql(V.sql("labelled", """
WITH per AS (
  SELECT c, count(*) FILTER (WHERE y_true = c AND y_pred = c) AS hit, count(*) FILTER (WHERE y_pred = c) AS said,
    count(*) FILTER (WHERE y_true = c) AS support FROM labelled, (VALUES (0), (1)) AS k(c) GROUP BY c),
report AS (
  SELECT CAST(c AS VARCHAR) AS class, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall,
    coalesce(2 * hit / nullif(said + support, 0), 0) AS f1, support FROM per)
SELECT class, precision, recall, f1, support FROM report
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM report
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM report"""), "precision recall f1"))
def report(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.class_report(V.labelled_scores(spark, folder)))


@query("t19_c11_regression_metrics", rounded_sql("""
SELECT avg(abs(y - p)) AS mae, avg((y - p) * (y - p)) / 1e6 AS mse_millions, sqrt(avg((y - p) * (y - p))) AS rmse,
  1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)) AS r2
FROM (SELECT l_extendedprice AS y, l_quantity * 1500 AS p, avg(l_extendedprice) OVER () AS m FROM lineitem)""",
    "mae mse_millions rmse r2", 4))
def regression(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.read(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("y_true"), (F.col("l_quantity") * 1500).alias("y_pred"))
    out = metrics.regression_metrics(rows)
    return rounded(out.select("mae", (F.col("mse") / 1e6).alias("mse_millions"), "rmse", "r2"), 4)


def vector_rows(spark: SparkSession, folder: str, size: int = 64) -> tuple[DataFrame, list[str]]:
    """Embeddings as named columns; the label says whether the class is one of the first three."""
    columns = [f"v{i}" for i in range(size)]
    rows = V.read(spark, folder, "embeddings").select(
        "vec_id", (F.col("label") < 3).cast("int").alias("activity"),
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(columns)])
    return rows, columns


@query("t04_minority_oversampling", "SELECT c AS activity, (SELECT max(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label < 3)) AS rows "
       "FROM (VALUES (0), (1)) AS t(c)")
def oversampling(spark: SparkSession, folder: str) -> DataFrame:
    rows, columns = vector_rows(spark, folder)
    balanced = training.oversample_minority(rows, columns, "activity", "vec_id")
    return balanced.groupBy("activity").agg(F.count("*").alias("rows"))


@query("t04_nearest_minority_rows", """
WITH small AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label < 3),
pairs AS (SELECT a.vec_id, b.vec_id AS near, list_distance(a.v, b.v) AS far FROM small a JOIN small b ON a.vec_id <> b.vec_id)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY far, near) - 1 AS INT) AS place, near FROM pairs
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY far, near) <= 5""")
def nearest(spark: SparkSession, folder: str) -> DataFrame:
    rows, columns = vector_rows(spark, folder)
    return training.nearest_neighbours(rows.filter("activity = 1"), columns, "vec_id", block=100).drop("_point")


@query("t04_synthetic_rows", rounded_sql("""
WITH small AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label < 3),
sizes AS (SELECT count(*) FILTER (WHERE label < 3) AS n, count(*) FILTER (WHERE label >= 3) AS others FROM embeddings),
near AS (
  SELECT a.vec_id, b.v AS near, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) - 1 AS place
  FROM small a JOIN small b ON a.vec_id <> b.vec_id QUALIFY place < 5),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1 AS r FROM small),
copies AS (
  SELECT vec_id, v, n, unnest(range(1, 1 + (others - n) // n + CASE WHEN r < (others - n) % n THEN 1 ELSE 0 END)) AS c
  FROM ranked, sizes),
drawn AS (
  SELECT vec_id, v, CAST(floor(('0x' || substr(md5('42:' || vec_id || ':' || c || ':pick'), 1, 8))::BIGINT / 4294967296.0::DOUBLE
      * least(5, n - 1)) AS BIGINT) AS place,
    ('0x' || substr(md5('42:' || vec_id || ':' || c || ':at'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS way FROM copies),
made AS (
  SELECT list_transform(range(1, 65), lambda i: v[i] + way * (near[i] - v[i])) AS v FROM drawn JOIN near USING (vec_id, place)),
every AS (SELECT v, 1 AS activity FROM made UNION ALL SELECT CAST(embedding AS DOUBLE[]), CAST(label < 3 AS INT) FROM embeddings)
SELECT activity, v[1] AS v0, v[64] AS v63, list_sum(v) AS total FROM every""", "v0 v63 total", 6))
def synthetic(spark: SparkSession, folder: str) -> DataFrame:
    """The balanced rows themselves: first and last column, and the sum of all."""
    rows, columns = vector_rows(spark, folder)
    balanced = training.oversample_minority(rows, columns, "activity", "vec_id")
    return rounded(balanced.select("activity", "v0", "v63", add_all([F.col(c) for c in columns]).alias("total")), 6)


@query("t06_t11_forest_predictions")
def forest(spark: SparkSession, folder: str) -> DataFrame:
    rows, columns = vector_rows(spark, folder)
    rows = training.add_class_weights(rows, "activity")
    model = models.fit(rows, columns, "activity", models.forest(), weight="weight")
    return models.predict(model, rows).select("vec_id", "predicted_activity", "probability_active")


@query("t07_boosting_predictions")
def boosting(spark: SparkSession, folder: str) -> DataFrame:
    rows, columns = vector_rows(spark, folder)
    model = models.fit(rows, columns, "activity", models.boosting())
    return models.predict(model, rows).select("vec_id", "predicted_activity", "probability_active")


@query("t08_l08_regression_forest")
def regression_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Imines with properties taken from the text, ranked by a predicted value."""
    train = V.molecules(spark, folder).na.drop(subset=["MW", "LogP", "TPSA"]).select(
        "MW", "LogP", "TPSA", F.col("FractionCSP3").alias("solubility"))
    model = models.fit_regressor(train, ["MW", "LogP", "TPSA"], "solubility")
    rows = V.reactants(spark, folder)
    made = imines(rows.filter("type = 'aldehyde'"), rows.filter("type = 'amine'"))
    n = F.length("product").cast("double")
    made = made.withColumns({"MW": n * 14, "LogP": n / 10, "TPSA": n % 90})
    out = model.transform(made).withColumnRenamed("prediction", "predicted_solubility").drop("features")
    # Sorting looks at its rows twice, once for the ranges.
    return written(out, "predicted").orderBy(*best_first("predicted_solubility", "product", "aldehyde", "amine"))


@query("t09_grid_search")
def grid(spark: SparkSession, folder: str) -> DataFrame:
    """All 24 settings of the default grid; trees are shared between settings."""
    rows, columns = vector_rows(spark, folder)
    return forests.shared_grid_search(rows, columns, "activity", "vec_id")


@query("t10_cross_validation")
def cross_validation(spark: SparkSession, folder: str) -> DataFrame:
    rows, columns = vector_rows(spark, folder)
    scores = models.cross_validate(rows, columns, "activity", "vec_id", models.forest(), 5)
    return models.score_summary(scores)


@query("t20_l09_feature_importance")
def importance(spark: SparkSession, folder: str) -> DataFrame:
    rows, columns = vector_rows(spark, folder)
    return models.importance(models.fit(rows, columns, "activity", models.forest()), columns)


@query("t21_train_peptide_model")
def train(spark: SparkSession, folder: str) -> DataFrame:
    rows = generated_training_rows(spark, folder)
    return jobs.train_peptides(rows, "activity", "row_id", models.forest())[1]


@query("s17_s18_saved_model", V.sql("peptides", """
SELECT pep_id, true AS same, true AS probable FROM peptides WHERE sequence <> ''"""))
def saved_model(spark: SparkSession, folder: str) -> DataFrame:
    rows = generated_training_rows(spark, folder)
    path = scratch_path(spark, "bundle")
    fitted, _ = jobs.train_peptides(rows, "activity", "row_id", models.forest(5, 4), save_to=path)
    model, meta = sinks.load_model(path)
    features = add_descriptors(V.peptides(spark, folder).filter("sequence <> ''"))
    typed = features.withColumns({c: F.col(c).cast("double") for c in meta["feature_columns"]})
    names = ["probability_active", "predicted_activity"]
    before = models.predict(fitted, typed.drop(*names)).withColumnsRenamed({n: f"{n}_0" for n in names})
    both = models.predict(model, before)
    same = (F.col("probability_active") == F.col("probability_active_0")) & (
        F.col("predicted_activity") == F.col("predicted_activity_0"))
    return both.select("pep_id", same.alias("same"), F.col("probability_active").between(0, 1).alias("probable"))
