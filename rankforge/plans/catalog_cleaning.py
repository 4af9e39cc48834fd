"""Registered queries: cleaning, filters, labels, de-duplication, counts and text primitives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankforge.functions import text
from rankforge.functions.structures import is_valid_structure
from rankforge.operators import cleaning, metrics, toplists
from rankforge.plans import standins as V
from rankforge.plans.registry import query, rounded, rounded_sql
from rankforge.session import scratch_path
from rankforge.streaming import first_rows, scoring as stream


@query("f01_c01_clean_sequence", V.sql("peptides", "SELECT pep_id, sequence FROM peptides"))
def clean(spark: SparkSession, folder: str) -> DataFrame:
    return V.peptides(spark, folder).select("pep_id", "sequence")


@query("f02_c02_length_filter", V.sql("peptides", """
SELECT pep_id, sequence FROM peptides WHERE length(sequence) >= 10 AND length(sequence) <= 50"""))
def length_filter(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.keep_length(V.peptides(spark, folder), "sequence").select("pep_id", "sequence")


@query("f03_f04_labels", V.sql("segments", """
SELECT pep_id, CASE WHEN mic IS NOT NULL AND mic <= 32.0 THEN 1 ELSE 0 END AS by_mic,
  CASE activity_text WHEN 'active' THEN 1 WHEN 'inactive' THEN 0 END AS by_text FROM segments"""))
def labels(spark: SparkSession, folder: str) -> DataFrame:
    return V.segments(spark, folder).select(
        "pep_id", cleaning.threshold_label(F.col("mic")).alias("by_mic"),
        cleaning.text_label(F.col("activity_text")).alias("by_text"))


@query("f05_w03_keep_first", V.sql("peptides", """
SELECT sequence, pep_id, target FROM (
  SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY pep_id) AS r FROM peptides) WHERE r = 1"""))
def keep_first(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.peptides(spark, folder).select("sequence", "pep_id", "target")
    return cleaning.keep_first(rows, ["sequence"], ["pep_id"])


@query("f05_w03_u04_first_rows_of_a_stream", V.sql("peptides", """
SELECT sequence, pep_id, target FROM (
  SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY pep_id) AS r FROM peptides) WHERE r = 1"""))
def keep_first_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same over files that arrive in two parts, the better rows of many keys in the second one, with a restart between."""
    rows = V.peptides(spark, folder).select("sequence", "pep_id", "target")
    source, target, progress = (scratch_path(spark, name) for name in ("arriving", "first", "progress"))
    for part in (1, 0):
        rows.filter(F.col("pep_id") % 2 == part).write.mode("append").parquet(source)
        arriving = stream.stream_files(spark, source, rows.schema)
        first_rows.keep_first_stream(arriving, ["sequence"], ["pep_id"], target, progress).awaitTermination()
    return first_rows.first_rows(spark, target, ["sequence"], ["pep_id"])


@query("f06_f07_drop_nulls", V.sql("molecules segments", """
SELECT 'some' AS kind, mol_id AS id FROM molecules WHERE "LogP" IS NOT NULL AND "TPSA" IS NOT NULL
UNION ALL SELECT 'any', pep_id FROM segments WHERE mic IS NOT NULL"""))
def drop_nulls(spark: SparkSession, folder: str) -> DataFrame:
    some = V.molecules(spark, folder).na.drop(subset=["LogP", "TPSA"])
    whole = V.segments(spark, folder).na.drop()
    return some.select(F.lit("some").alias("kind"), F.col("mol_id").alias("id")).union(
        whole.select(F.lit("any"), "pep_id"))


@query("f08_f16_optional_columns", V.sql("molecules", """
SELECT mol_id, "MW", 0.5::DOUBLE AS diversity FROM molecules WHERE "MW" <= 1000"""))
def optional_columns(spark: SparkSession, folder: str) -> DataFrame:
    rows = cleaning.at_most(V.molecules(spark, folder), "MW", 1000)
    rows = cleaning.at_most(rows, "no_such_column", 1)
    return rows.select("mol_id", "MW", cleaning.column_or(rows, "diversity_score", 0.5).alias("diversity"))


PREPROCESSED = """pre AS (
  SELECT sequence, pep_id, CASE WHEN mic <= 32.0 THEN 1 ELSE 0 END AS activity, mic, target
  FROM peptides WHERE length(sequence) BETWEEN 10 AND 50),
prepared AS (
  SELECT sequence, pep_id, activity, target FROM (
    SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY pep_id) AS r FROM pre) WHERE r = 1)"""


def prepared_peptides(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.segments(spark, folder).select(
        F.col("raw").alias("sequence"), "pep_id", "mic", "target", "probability_active")
    return cleaning.preprocess_peptides(rows, ["pep_id"])


@query("f10_f11_preprocess_peptides", V.sql("peptides", f"""
WITH {PREPROCESSED}
SELECT sequence, pep_id, activity, target FROM prepared"""))
def preprocess(spark: SparkSession, folder: str) -> DataFrame:
    return prepared_peptides(spark, folder).select("sequence", "pep_id", "activity", "target")


@query("f11_preprocess_by_text_label", V.sql("peptides", """
SELECT sequence, pep_id, activity FROM (
  SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY pep_id) AS r FROM (
    SELECT sequence, pep_id, CASE activity_text WHEN 'active' THEN 1 WHEN 'inactive' THEN 0 END AS activity
    FROM peptides WHERE length(sequence) BETWEEN 10 AND 50) WHERE activity IS NOT NULL) WHERE r = 1"""))
def preprocess_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.segments(spark, folder).select(
        F.col("raw").alias("sequence"), "pep_id", F.col("activity_text").alias("activity"))
    return cleaning.preprocess_peptides(rows, ["pep_id"]).select("sequence", "pep_id", "activity")


@query("f13_valid_structures", V.sql("molecules", f"""
SELECT mol_id, smiles FROM molecules WHERE {V.valid_sql('smiles')}"""))
def valid(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.valid_structures(V.molecules(spark, folder)).select("mol_id", "smiles")


@query("f13_validity_of_segments", V.sql("segments", """
WITH outside AS (
  SELECT pep_id, raw, regexp_replace(raw, '\\[[^\\]]*\\]', '', 'g') AS o FROM segments),
steps AS (
  SELECT pep_id, i, CASE ch WHEN '(' THEN 1 ELSE -1 END AS d
  FROM (SELECT pep_id, unnest(range(len(l))) AS i, unnest(l) AS ch
        FROM (SELECT pep_id, string_split(regexp_replace(o, '[^()]', '', 'g'), '') AS l FROM outside
              WHERE contains(o, '(') OR contains(o, ')')))),
depths AS (
  SELECT pep_id, min(run) AS lowest, sum(d) AS final
  FROM (SELECT pep_id, d, sum(d) OVER (PARTITION BY pep_id ORDER BY i) AS run FROM steps) GROUP BY pep_id),
odd AS (
  SELECT DISTINCT pep_id FROM (
    SELECT pep_id, unnest(regexp_extract_all(o, '%[0-9][0-9]|[0-9]')) AS label FROM outside)
  GROUP BY pep_id, label HAVING count(*) % 2 = 1)
SELECT s.pep_id, length(raw) > 0
  AND len(regexp_extract_all(raw, '\\[[^\\]]+\\]|Br|Cl|[BCNOPSFIbcnops]')) > 0
  AND length(array_to_string(regexp_extract_all(raw,
    '\\[[^\\]]+\\]|Br|Cl|[BCNOPSFIbcnops]|%[0-9][0-9]|[0-9]|[()=#./\\\\:~*$+-]'), '')) = length(raw)
  AND coalesce(lowest, 0) >= 0 AND coalesce(final, 0) = 0 AND odd.pep_id IS NULL AS valid
FROM segments s LEFT JOIN depths USING (pep_id) LEFT JOIN odd USING (pep_id)"""))
def validity(spark: SparkSession, folder: str) -> DataFrame:
    return V.segments(spark, folder).select("pep_id", is_valid_structure(F.col("raw")).alias("valid"))


@query("f14_feature_columns", V.sql("molecules", """
SELECT mol_id, "BertzCT", "FractionCSP3", "LogP", "MW", "NumAromaticRings", "NumHAcceptors", "NumHDonors",
  "NumHeavyAtoms", "NumRings", "NumRotatableBonds", "NumValenceElectrons", "TPSA" FROM molecules"""))
def features(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.molecules(spark, folder).drop("brand", "base_name")
    keep = cleaning.feature_columns(rows, ("smiles", "activity", "name", "mol_id", "probability_active"))
    return rows.select("mol_id", *sorted(keep))


@query("a02_value_counts", """
SELECT 'event' AS kind, event_type AS value, count(*) AS count FROM events GROUP BY ALL
UNION ALL SELECT 'label', CAST(quality AS VARCHAR), count(*) FROM labels GROUP BY ALL""")
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    events = toplists.value_counts(V.read(spark, folder, "events"), "event_type")
    quality = toplists.value_counts(V.read(spark, folder, "labels"), "quality")
    return events.select(F.lit("event").alias("kind"), F.col("event_type").alias("value"), "count").union(
        quality.select(F.lit("label"), F.col("quality").cast("string"), "count"))


@query("a03_distribution", rounded_sql(V.sql("peptides", """
SELECT count(l) AS "count", avg(l) AS mean, stddev_samp(l) AS std, min(l) AS "min",
  quantile_cont(l, 0.25) AS q25, quantile_cont(l, 0.5) AS q50, quantile_cont(l, 0.75) AS q75, max(l) AS "max"
FROM (SELECT CAST(length(sequence) AS INT) AS l FROM peptides)"""), "mean std q25 q50 q75", 6))
def distribution(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.peptides(spark, folder).select(F.length("sequence").alias("length"))
    return rounded(metrics.distribution(rows, "length"), 6)


@query("a03_event_values", rounded_sql("""
SELECT count(value) AS "count", avg(value) AS mean, stddev_samp(value) AS std, min(value) AS "min",
  quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, max(value) AS "max"
FROM events""", "mean std q25 q50 q75", 6))
def event_values(spark: SparkSession, folder: str) -> DataFrame:
    """A column of nearly all different values."""
    return rounded(metrics.distribution(V.read(spark, folder, "events").select("value"), "value"), 6)


@query("a06_c03_symbol_counts", V.sql("peptides molecules", """
SELECT 'pep' AS kind, pep_id AS id, CAST(length(sequence) - length(replace(sequence, 'K', '')) AS INT) AS n1,
  CAST(length(sequence) - length(replace(replace(sequence, 'A', ''), 'L', '')) AS INT) AS n2 FROM peptides
UNION ALL SELECT 'mol', mol_id, CAST(len(regexp_extract_all(smiles, 'CC')) AS INT),
  CAST(len(regexp_extract_all(smiles, 'C\\(=O\\)')) AS INT) FROM molecules"""))
def symbol_counts(spark: SparkSession, folder: str) -> DataFrame:
    pep = V.peptides(spark, folder).select(
        F.lit("pep").alias("kind"), F.col("pep_id").alias("id"),
        text.count_letters(F.col("sequence"), "K").alias("n1"),
        text.count_letters(F.col("sequence"), "AL").alias("n2"))
    mol = V.molecules(spark, folder).select(
        F.lit("mol"), "mol_id", text.count_text(F.col("smiles"), "CC"), text.count_text(F.col("smiles"), "C(=O)"))
    return pep.union(mol)


@query("a07_prediction_summary", rounded_sql(V.sql("molecules", """
SELECT CAST(sum(p) AS BIGINT) AS active, CAST(count(*) - sum(p) AS BIGINT) AS inactive,
  avg(p) AS active_share, avg(probability_active) AS mean_probability
FROM (SELECT CAST(probability_active >= 0.5 AS INT) AS p, probability_active FROM molecules)"""),
    "active_share mean_probability"))
def summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.molecules(spark, folder).withColumn(
        "predicted_activity", F.when(F.col("probability_active") >= 0.5, 1).otherwise(0))
    return rounded(metrics.prediction_summary(rows))


@query("a08_step_sizes", V.sql("peptides", f"""
WITH {PREPROCESSED}
SELECT 'loaded' AS step, count(*) AS rows FROM peptides
UNION ALL SELECT 'length', count(*) FROM pre
UNION ALL SELECT 'prepared', count(*) FROM prepared"""))
def step_sizes(spark: SparkSession, folder: str) -> DataFrame:
    loaded = V.peptides(spark, folder)
    steps = {"loaded": loaded, "length": cleaning.keep_length(loaded, "sequence"),
             "prepared": prepared_peptides(spark, folder)}
    out = None
    for step, df in steps.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(step).alias("step"), "rows")
        out = row if out is None else out.union(row)
    return out


@query("c04_c08_c16_text_primitives", V.sql("molecules", """
SELECT mol_id,
  CASE WHEN instr(smiles, 'O') > 0 THEN substr(smiles, 1, instr(smiles, 'O') - 1) || 'NCCO'
       || substr(smiles, instr(smiles, 'O') + 1) ELSE smiles END AS first_replaced,
  string_split(dotted, '.')[1] AS first_part, string_split(dotted, '.')[-1] AS last_part,
  substr(smiles, 2, length(smiles) - 2) AS inner_text,
  array_to_string(list_sort(list_distinct(string_split(smiles, ''))), '') AS letters,
  CAST(length(smiles) // 3 AS BIGINT) AS third, round(sqrt("MW"), 6) AS root,
  CASE WHEN "LogP" IS NOT NULL THEN least(greatest(-"LogP", 0.0), 1.0) END AS clamped, abs("LogP") AS size,
  CASE WHEN "LogP" > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS high, coalesce("LogP", 0.0) AS filled
FROM (SELECT *, smiles || '.' || base_name || '.' || brand AS dotted FROM molecules)"""))
def primitives(spark: SparkSession, folder: str) -> DataFrame:
    m = V.molecules(spark, folder).withColumn(
        "dotted", F.concat_ws(".", "smiles", "base_name", F.col("brand").cast("string")))
    s = F.col("smiles")
    return m.select(
        "mol_id", text.replace_first(s, F.lit("O"), F.lit("NCCO")).alias("first_replaced"),
        text.first_part(F.col("dotted")).alias("first_part"), text.last_part(F.col("dotted")).alias("last_part"),
        F.substr(s, F.lit(2), F.length(s) - 2).alias("inner_text"),
        F.array_join(F.array_sort(F.array_distinct(F.split(s, ""))), "").alias("letters"),
        F.floor(F.length(s) / 3).alias("third"), F.round(F.sqrt("MW"), 6).alias("root"),
        text.clamp(-F.col("LogP"), 0.0, 1.0).alias("clamped"), F.abs("LogP").alias("size"),
        text.indicator(F.col("LogP") > 1).alias("high"), F.coalesce("LogP", F.lit(0.0)).alias("filled"))


@query("u01_union_of_shapes", V.sql("peptides molecules", """
SELECT 'amp' AS category, sequence, NULL AS smiles, probability_active FROM peptides
UNION ALL SELECT 'polyphenol', NULL, smiles, probability_active FROM molecules"""))
def union_shapes(spark: SparkSession, folder: str) -> DataFrame:
    a = V.peptides(spark, folder).select(F.lit("amp").alias("category"), "sequence", "probability_active")
    b = V.molecules(spark, folder).select(F.lit("polyphenol").alias("category"), "smiles", "probability_active")
    return a.unionByName(b, allowMissingColumns=True)


@query("u02_c17_union_distinct", V.sql("molecules", """
SELECT smiles FROM molecules WHERE brand <= 15 UNION SELECT smiles FROM molecules WHERE brand >= 10"""))
def union_distinct(spark: SparkSession, folder: str) -> DataFrame:
    m = V.molecules(spark, folder)
    return m.filter("brand <= 15").select("smiles").union(m.filter("brand >= 10").select("smiles")).distinct()


@query("u04_distinct_records", V.sql("landed", """
SELECT DISTINCT cid, name, smiles, molecular_weight FROM landed"""))
def distinct_records(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.distinct_records(V.landed(spark, folder), ["cid", "name", "smiles", "molecular_weight"])
