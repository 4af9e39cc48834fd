"""Registered queries: structure screens and records, training sets, and facts about fitted models.

What a model predicts on noisy data has no SQL form.  The ``exact`` queries train models of default
size on parts whose label follows from one column, which every tree must find, so SQL states each
predicted value; the others return facts that SQL can state for every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankforge.functions import structures as M
from rankforge.operators import diversity, forests, generation as G, metrics, models, similarity, training
from rankforge.operators.cleaning import valid_structures
from rankforge.operators.similarity import add_fingerprint
from rankforge.plans import jobs, standins as V
from rankforge.plans.catalog_scoring import DEGRADER, DEGRADER_SCORE, LOGS, bonus
from rankforge.plans.catalog_structures import BASE, TABLE_SQL, descriptor_table
from rankforge.plans.catalog_training import vector_rows
from rankforge.plans.registry import query, rounded, rounded_sql
from rankforge.session import written
from rankforge.sources import dimensions


def bits_sql(name: str, key: str, table: str) -> str:
    """Hashed bits (1024) of the structures of a table, one row per bit, and their number."""
    return f"""{name}_toks AS (
  SELECT {key}, regexp_extract_all(smiles,
    '\\[[^\\]]+\\]|Br|Cl|[BCNOPSFIbcnops]|%[0-9][0-9]|[0-9]|[()=#./\\\\:~*$+-]') AS t
  FROM {table} WHERE {V.valid_sql('smiles')}),
{name}_grams AS (
  SELECT {key}, unnest(t) AS g FROM {name}_toks
  UNION SELECT {key}, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM {name}_toks
  UNION SELECT {key}, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))
    FROM {name}_toks),
{name}_bits AS (
  SELECT DISTINCT {key}, CAST(CAST(('0x' || substr(md5(g), 1, 8)) AS BIGINT) % 1024 AS INT) AS bit FROM {name}_grams),
{name}_fp AS MATERIALIZED (
  SELECT {key}, bitstring_agg(bit, 0, 1023) AS b, count(*) AS n FROM {name}_bits GROUP BY {key})"""


ACTIVES = """actives AS (SELECT * FROM (VALUES
  (0, 'Halicin', 'CS(=O)(=O)N1CCN(CC1)C1=NC(=O)N(C(=O)N1)C1=CC=C(C=C1)Cl'),
  (1, 'Metronidazole', 'CC1=NC=C(N1CCO)[N+](=O)[O-]'),
  (2, 'Nitrofurantoin', 'CC1C(OC(=O)C1N2C(=O)C3C2C=CC3=O)C=O')) AS t(pos, name, smiles))"""

SIMILARITY = "bit_count(m.b & a.b) / (m.n + a.n - bit_count(m.b & a.b))"
HITS = f"""{ACTIVES}, {bits_sql('mol', 'mol_id', 'molecules')}, {bits_sql('ref', 'pos', 'actives')},
pairs AS (
  SELECT m.mol_id, a.pos, {SIMILARITY} AS similarity FROM mol_fp m JOIN ref_fp a ON true WHERE {SIMILARITY} >= 0.2),
top_hits AS (
  SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY pos ORDER BY similarity DESC, mol_id) <= 50),
best AS (
  SELECT mol_id, max(similarity) AS similarity, arg_min(name, pos) AS reference FROM top_hits JOIN actives USING (pos)
  GROUP BY mol_id)"""


def structure_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.molecules(spark, folder).select("mol_id", "smiles")
    return written(add_fingerprint(rows, M.structure_bits(F.col("smiles"))).drop("smiles"), "structures")


def known_actives(spark: SparkSession) -> DataFrame:
    """The three reference actives with fingerprints."""
    rows = dimensions.reference_actives(spark)
    return add_fingerprint(rows, M.structure_bits(F.col("smiles"))).withColumnsRenamed(
        {"name": "query", "pos": "query_pos"}).drop("smiles")


@query("x03_structure_screen", rounded_sql(V.sql("molecules", f"""
WITH {HITS}
SELECT mol_id, similarity, reference, similarity AS probability_active, similarity AS combined_score FROM best
ORDER BY similarity DESC, mol_id LIMIT 50"""), "similarity probability_active combined_score"))
def structure_screen(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(similarity.screen(
        structure_fingerprints(spark, folder), known_actives(spark), "mol_id", 50))


@query("r11_structure_screen_with_predictions", rounded_sql(V.sql("molecules", f"""
WITH {HITS}
SELECT mol_id, similarity, reference, probability_active,
  0.5 * coalesce(probability_active, 0) + 0.5 * coalesce(similarity, 0) AS combined_score
FROM best FULL JOIN (SELECT mol_id, probability_active FROM molecules) USING (mol_id)
ORDER BY round(combined_score, 12) DESC, mol_id LIMIT 20"""), "similarity probability_active combined_score"))
def structure_screen_predicted(spark: SparkSession, folder: str) -> DataFrame:
    predictions = V.molecules(spark, folder).select("mol_id", "probability_active")
    return rounded(similarity.screen(
        structure_fingerprints(spark, folder), known_actives(spark), "mol_id", 20, predictions=predictions))


@query("x02_structure_search", rounded_sql(V.sql("molecules", f"""
WITH {HITS}
SELECT name AS query, mol_id, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY pos ORDER BY similarity DESC, mol_id) AS r FROM pairs WHERE similarity >= 0.3)
JOIN actives USING (pos) WHERE r <= 10"""), "similarity"))
def structure_search(spark: SparkSession, folder: str) -> DataFrame:
    hits = similarity.top_similar(
        structure_fingerprints(spark, folder), known_actives(spark), "mol_id", 10, 0.3)
    return rounded(hits.drop("query_pos"))


@query("x04_structure_diversity", V.sql("molecules", f"""
WITH {bits_sql('mol', 'mol_id', 'molecules')},
ranked AS MATERIALIZED (SELECT mol_id, n, b, row_number() OVER (ORDER BY mol_id) AS r FROM mol_fp),
walk AS (
  SELECT 0::BIGINT AS r, []::STRUCT(mol_id BIGINT, n BIGINT, b BIT)[] AS kept
  UNION ALL
  SELECT x.r, CASE WHEN len(list_filter(kept, lambda k: bit_count(k.b & x.b) / (k.n + x.n - bit_count(k.b & x.b)) > 0.8)) > 0
    THEN kept ELSE list_append(kept, {{'mol_id': x.mol_id, 'n': x.n, 'b': x.b}}) END
  FROM walk w JOIN ranked x ON x.r = w.r + 1 WHERE len(kept) < 100),
final AS MATERIALIZED (SELECT kept FROM walk ORDER BY r DESC LIMIT 1)
SELECT unnest(list_transform(kept, lambda k: k.mol_id)) AS mol_id FROM final""", recursive=True))
def structure_diversity(spark: SparkSession, folder: str) -> DataFrame:
    rows = structure_fingerprints(spark, folder).filter("n IS NOT NULL")
    return diversity.diversity_filter(rows, "repurposed", F.col("mol_id"), [F.asc("mol_id")]).select("mol_id")


@query("m11_structure_record", V.sql("molecules", f"""
WITH {TABLE_SQL}, {bits_sql('mol', 'mol_id', 'molecules')},
keys AS (
  SELECT mol_id, len(list_filter(range(1, len(p) + 1), lambda i: regexp_matches(smiles, p[i]))) AS n_keys
  FROM molecules, (SELECT ['\\[', 'Cl', 'Br', 'F', 'I', 'S', 'P', 'N', 'O', 'n', 'o', 's', '=O', '=N', '#', 'C\\(=O\\)O',
    'C\\(=O\\)N', 'NC\\(=O\\)', 'S\\(=O\\)', 'c1', 'C1', '2', '3', '\\(C\\)', 'OC', 'CO', 'NC', 'CN', 'C=C', '\\.', 'CCC',
    '\\(O\\)'] AS p))
SELECT mol_id, d.* EXCLUDE (smiles, base_name, brand, probability_active, r), list_sort(bits) AS bits,
  CAST(n_keys AS INT) AS n_keys
FROM (SELECT mol_id, smiles FROM molecules) m JOIN (SELECT * EXCLUDE (mol_id) FROM descriptors) d USING (smiles)
JOIN (SELECT mol_id, list(bit) AS bits FROM mol_bits GROUP BY mol_id) USING (mol_id) JOIN keys USING (mol_id)"""))
def structure_record(spark: SparkSession, folder: str) -> DataFrame:
    rows = valid_structures(V.molecules(spark, folder).select("mol_id", "smiles"))
    record = M.add_structure_record(rows.join(descriptor_table(spark, folder), "smiles"))
    return record.select("mol_id", *BASE, "bits", F.size("keys").alias("n_keys"))


@query("g16_repurposed_training_set", V.sql("molecules", f"""
WITH {TABLE_SQL},
actives AS (SELECT mol_id, smiles FROM molecules WHERE {V.valid_sql('smiles')})
SELECT smiles, 1 AS activity FROM actives UNION ALL
SELECT s, 0 FROM (VALUES ('CC(C)Cc1ccc(cc1)C(C)C(O)=O'), ('CC(N)C(=O)O'), ('c1ccccc1')) AS t(s), range(20)"""))
def repurposed_training(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.molecules(spark, folder).select("mol_id", "smiles")
    return G.structure_training_set(valid_structures(rows).select("smiles"), 20)


@query("t22_hybrid_model_path", rounded_sql(V.sql("molecules", f"""
WITH {TABLE_SQL}
SELECT mol_id, true AS consistent,
  CAST(0.3 * coalesce(CASE WHEN d."LogP" IS NOT NULL THEN least(greatest(-{LOGS.replace('"Log', 'd."Log').replace('"TPSA', 'd."TPSA')}, 0.0), 1.0) END, 0)
  + 0.2 * ({bonus(0.33, 'd."MW" < 500')} + {bonus(0.33, 'd."LogP" < 5')} + {bonus(0.34, 'd."TPSA" < 140')}) AS DOUBLE) AS rest
FROM (SELECT mol_id, smiles FROM molecules WHERE {V.valid_sql('smiles')}) m
JOIN (SELECT * EXCLUDE (mol_id) FROM descriptors) d USING (smiles) WHERE d."LogP" IS NOT NULL"""), "rest"))
def hybrid_path(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.molecules(spark, folder).select("mol_id", "smiles")
    found = jobs.screen_hybrids(rows, descriptor_table(spark, folder), screen_model(spark, folder))
    return facts_of(found.filter("LogP IS NOT NULL"))


@query("t22_degrader_model_path", rounded_sql(V.sql("molecules", f"""
WITH {TABLE_SQL}, {DEGRADER}
SELECT m.mol_id, true AS consistent, 0.3 * {DEGRADER_SCORE.replace('"Num', 'd."Num')}
  + 0.2 * CAST({bonus(0.4, 'd."MW" < 800')} + {bonus(0.3, 'd."LogP" < 5')} + {bonus(0.3, 'd."TPSA" < 150')} AS DOUBLE) AS rest
FROM degraders m JOIN descriptors d USING (smiles) WHERE {V.valid_sql('m.smiles')}"""), "rest"))
def degrader_path(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.molecules(spark, folder).select("mol_id", "smiles")
    return facts_of(jobs.screen_degraders(rows, descriptor_table(spark, folder), screen_model(spark, folder)))


def screen_model(spark: SparkSession, folder: str):
    """A forest on the screen's descriptors; the label is whether a structure has two rings or more."""
    rows = V.molecules(spark, folder).na.drop(subset=["MW", "LogP", "TPSA"]).select(
        *jobs.SCREEN_FEATURES, (F.col("NumRings") >= 2).cast("int").alias("activity"))
    return models.fit(rows, jobs.SCREEN_FEATURES, "activity", models.forest())


def facts_of(found: DataFrame) -> DataFrame:
    """Whether class, probability and viability fit together, and the part of viability that no model gives."""
    p = F.col("probability_active")
    consistent = p.between(0, 1) & (F.col("predicted_activity") == (p >= 0.5).cast("int"))
    return rounded(found.select("mol_id", consistent.alias("consistent"),
                                (F.col("viability_score") - 0.5 * p).alias("rest")))


SPLIT_SQL = """marked AS (
  SELECT vec_id, CAST(CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE) > 0 AS INT) AS activity FROM embeddings),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY activity ORDER BY md5('42:' || vec_id), vec_id) - 1 AS r,
    count(*) OVER (PARTITION BY activity) AS n FROM marked)"""


def learnable_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """Embeddings with a label that follows from two of their columns."""
    rows, columns = vector_rows(spark, folder)
    return rows.withColumn("activity", (F.col("v0") + F.col("v1") > 0).cast("int")), columns


@query("t06_held_out_forest", f"""WITH {SPLIT_SQL}
SELECT vec_id, activity, true AS consistent, true AS better_than_chance FROM ranked WHERE r < n * 2 // 10""")
def held_out_forest(spark: SparkSession, folder: str) -> DataFrame:
    return held_out_facts(spark, folder, models.forest())


@query("t07_held_out_boosting", f"""WITH {SPLIT_SQL}
SELECT vec_id, activity, true AS consistent, true AS better_than_chance FROM ranked WHERE r < n * 2 // 10""")
def held_out_boosting(spark: SparkSession, folder: str) -> DataFrame:
    return held_out_facts(spark, folder, models.boosting())


def held_out_facts(spark: SparkSession, folder: str, model) -> DataFrame:
    """Predictions of the rows outside the training part, and whether their order is better than chance."""
    rows, columns = learnable_rows(spark, folder)
    split = written(training.stratified_split(rows, "activity", "vec_id", 0.2), "split")
    train = training.add_class_weights(split.filter("split = 'train'"), "activity")
    fitted = models.fit(train, columns, "activity", model, weight="weight")
    test = written(models.predict(fitted, split.filter("split = 'test'")), "tested")
    p = F.col("probability_active")
    good = metrics.roc_auc(test, "activity", "probability_active").scalar() > 0.7
    return test.select("vec_id", "activity", (p.between(0, 1) & (
        F.col("predicted_activity") == (p >= 0.5).cast("int"))).alias("consistent"), good.alias("better_than_chance"))


@query("t09_grid_facts", "SELECT 24::BIGINT AS settings, 24::BIGINT AS different, true AS sane")
def grid_facts(spark: SparkSession, folder: str) -> DataFrame:
    """All 24 settings of the default grid's shape, with smaller forests, on all columns and three folds."""
    rows, columns = vector_rows(spark, folder)
    found = models.grid_search(rows, columns, "activity", "vec_id", {
        "numTrees": [3, 6], "maxDepth": [2, 3, 4], "minInstancesPerNode": [1, 2], "minInfoGain": [0.0, 1e-4]})
    settings = [(str(sorted((p.name, v) for p, v in m.items())), float(score))
                for m, score in zip(found.getEstimatorParamMaps(), found.avgMetrics)]
    table = spark.createDataFrame(settings, "setting STRING, auc DOUBLE")
    return table.agg(F.count("*").alias("settings"), F.countDistinct("setting").alias("different"),
                     F.bool_and(F.col("auc").between(0.4, 1)).alias("sane"))


@query("t10_fold_facts", "SELECT CAST(unnest(range(5)) AS INT) AS fold, true AS probable")
def fold_facts(spark: SparkSession, folder: str) -> DataFrame:
    rows, columns = learnable_rows(spark, folder)
    scores = models.cross_validate(rows, columns, "activity", "vec_id", models.forest(), 5)
    return scores.select("fold", F.col("score").between(0.7, 1).alias("probable"))


@query("t20_importance_facts", "SELECT 64::BIGINT AS features, 1.0::DOUBLE AS total, true AS all_positive")
def importance_facts(spark: SparkSession, folder: str) -> DataFrame:
    rows, columns = vector_rows(spark, folder)
    found = models.importance(models.fit(rows, columns, "activity", models.forest()), columns, len(columns))
    return rounded(found.agg(F.countDistinct("feature").alias("features"), F.sum("importance").alias("total"),
                             F.bool_and(F.col("importance") >= 0).alias("all_positive")))


EXACT_COLUMNS = ["bucket", "price", "turn"]
EXACT_SQL = """marked AS (SELECT p_partkey, CAST(p_size // 10 >= 3 AS INT) AS activity FROM part),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY activity ORDER BY md5('42:' || p_partkey), p_partkey) - 1 AS r,
    count(*) OVER (PARTITION BY activity) AS n FROM marked)"""


def exact_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Parts with a label that follows from one of three columns, divided into a training and a test part."""
    part = V.read(spark, folder, "part")
    bucket = F.floor(F.col("p_size") / 10)
    rows = part.select(
        "p_partkey", bucket.cast("double").alias("bucket"), F.col("p_retailprice").alias("price"),
        (F.col("p_partkey") % 17).cast("double").alias("turn"), (bucket >= 3).cast("int").alias("activity"))
    return written(training.stratified_split(rows, "activity", "p_partkey", 0.2), "split")


def exact_predictions(spark: SparkSession, folder: str, model) -> DataFrame:
    split = exact_rows(spark, folder)
    fitted = models.fit(split.filter("split = 'train'"), EXACT_COLUMNS, "activity", model)
    return models.predict(fitted, split.filter("split = 'test'"))


@query("t06_exact_forest", f"""WITH {EXACT_SQL}
SELECT p_partkey, activity, activity AS predicted_activity, CAST(activity AS DOUBLE) AS probability_active
FROM ranked WHERE r < n * 2 // 10""")
def exact_forest(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_predictions(spark, folder, models.forest(featureSubsetStrategy="all"))
    return rounded(found.select("p_partkey", "activity", "predicted_activity", "probability_active"))


@query("t07_exact_boosting", f"""WITH {EXACT_SQL}
SELECT p_partkey, activity, activity AS predicted_activity FROM ranked WHERE r < n * 2 // 10""")
def exact_boosting(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_predictions(spark, folder, models.boosting())
    return found.select("p_partkey", "activity", "predicted_activity")


@query("t08_l08_exact_regression", """
SELECT p_partkey, CASE WHEN p_size // 10 >= 3 THEN 10.0 ELSE 2.5 END::DOUBLE AS predicted_solubility FROM part""")
def exact_regression(spark: SparkSession, folder: str) -> DataFrame:
    """Every part, by a regression forest of default size fitted on four fifths of them."""
    split = exact_rows(spark, folder).withColumn("solubility", F.when(F.col("activity") == 1, 10.0).otherwise(2.5))
    model = models.fit_regressor(split.filter("split = 'train'"), ["bucket", "turn"], "solubility", subset="all")
    return rounded(model.transform(split).select("p_partkey", F.col("prediction").alias("predicted_solubility")))


@query("t10_exact_folds", f"""WITH {EXACT_SQL},
folds AS (SELECT activity, r % 5 AS fold, count(*) AS n FROM ranked GROUP BY ALL)
SELECT CAST(fold AS INT) AS fold, CASE WHEN min(n) > 0 AND count(*) = 2 THEN 1.0 END::DOUBLE AS score FROM folds GROUP BY fold""")
def exact_folds(spark: SparkSession, folder: str) -> DataFrame:
    rows = exact_rows(spark, folder).drop("split")
    return rounded(models.cross_validate(rows, EXACT_COLUMNS, "activity", "p_partkey",
                                         models.forest(featureSubsetStrategy="all"), 5))


@query("t09_exact_grid", """
WITH parts AS (SELECT CASE WHEN count(DISTINCT p_size // 10 >= 3) = 2 THEN 1.0 END::DOUBLE AS auc FROM part)
SELECT CAST(n AS INT) AS "numTrees", CAST(d AS INT) AS "maxDepth", CAST(l AS INT) AS "minInstancesPerNode",
  CAST(g AS DOUBLE) AS "minInfoGain", auc
FROM parts, (VALUES (100), (200)) a(n), (VALUES (5), (10), (20)) b(d), (VALUES (1), (2)) c(l), (VALUES (0.0), (0.0001)) e(g)""")
def exact_grid(spark: SparkSession, folder: str) -> DataFrame:
    """All 24 settings of the default grid, in three folds, where every forest can find the label."""
    rows = exact_rows(spark, folder).drop("split")
    return rounded(forests.shared_grid_search(rows, EXACT_COLUMNS, "activity", "p_partkey", subset="all"))


@query("t20_exact_attributions", f"""WITH {EXACT_SQL}
SELECT p_partkey, CAST(activity AS DOUBLE) AS modelled, true AS by_bucket, 0.0::DOUBLE AS others FROM ranked WHERE r < n * 2 // 10""")
def exact_attributions(spark: SparkSession, folder: str) -> DataFrame:
    """What each column adds to the prediction: all of it comes from the one that makes the label."""
    split = exact_rows(spark, folder)
    fitted = models.fit(split.filter("split = 'train'"), EXACT_COLUMNS, "activity", models.forest(featureSubsetStrategy="all"))
    found = forests.attribute(fitted, split.filter("split = 'test'"), ["p_partkey", "activity"])
    own, others = F.get("attributions", F.lit(0)), F.abs(F.get("attributions", F.lit(1))) + F.abs(F.get("attributions", F.lit(2)))
    # The base is the share of active parts among the rows that the trees drew, near a half.
    by_bucket = (F.abs(own) > 0.25) & ((own > 0) == (F.col("activity") == 1)) & F.col("base").between(0.25, 0.75)
    return rounded(found.select("p_partkey", "modelled", by_bucket.alias("by_bucket"), others.alias("others")))


@query("t20_attribution_summary")
def attribution_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Mean size of every column's contribution over all rows, for a forest of default size."""
    rows, columns = learnable_rows(spark, folder)
    fitted = models.fit(rows, columns, "activity", models.forest())
    return forests.attribution_summary(forests.attribute(fitted, rows, ["vec_id"]), columns)
