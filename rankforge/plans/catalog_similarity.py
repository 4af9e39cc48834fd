"""Registered queries: similarity search, screens, diversity and vector similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankforge.operators import cleaning, diversity, joins, similarity, vector_index
from rankforge.operators.toplists import best_first, top_rows
from rankforge.plans import standins as V
from rankforge.plans.registry import query, rounded, rounded_sql
from rankforge.session import written

PAIRS = """shared AS (
  SELECT d.doc_id, i.item_id, count(*) AS inter FROM doc_bits d JOIN item_bits i USING (bit) GROUP BY ALL),
pairs AS (
  SELECT s.doc_id, s.item_id, 'item' || s.item_id AS query, inter / (d.n + i.n - inter) AS similarity
  FROM shared s JOIN doc_sizes d USING (doc_id) JOIN item_sizes i USING (item_id)),
top_hits AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS r
  FROM pairs WHERE similarity >= 0.2)"""


@query("x01_m10_fingerprint_sizes", V.sql("doc_fp", "SELECT doc_id, CAST(n AS INT) AS n, "
       "CAST((SELECT count(*) FROM doc_bits b WHERE b.doc_id = s.doc_id AND bit < 64) AS INT) AS first_word FROM doc_sizes s"))
def sizes(spark: SparkSession, folder: str) -> DataFrame:
    rows = written(V.document_fingerprints(spark, folder), "fingerprints").filter("n > 0")
    return rows.select("doc_id", "n", F.bit_count("w0").alias("first_word"))


@query("j03_x01_similar_pairs", rounded_sql(V.sql("doc_fp item_fp", f"""
WITH {PAIRS} SELECT query, doc_id, similarity FROM pairs WHERE similarity >= 0.2"""), "similarity"))
def similar_pairs(spark: SparkSession, folder: str) -> DataFrame:
    hits = similarity.find_similar(
        V.document_fingerprints(spark, folder), V.benchmark_fingerprints(spark, folder), "doc_id", 0.2)
    return rounded(hits.drop("query_pos"))


@query("x02_w02_l03_similarity_search", rounded_sql(V.sql("doc_fp item_fp", f"""
WITH {PAIRS}
SELECT query, doc_id, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS r2
  FROM pairs WHERE similarity >= 0.3) WHERE r2 <= 10"""), "similarity"))
def search(spark: SparkSession, folder: str) -> DataFrame:
    hits = similarity.top_similar(
        V.document_fingerprints(spark, folder), V.benchmark_fingerprints(spark, folder), "doc_id", 10, 0.3)
    return rounded(hits.drop("query_pos"))


@query("a01_best_reference", rounded_sql(V.sql("doc_fp item_fp", f"""
WITH {PAIRS}
SELECT doc_id, max(similarity) AS similarity, arg_min(query, item_id) AS reference FROM top_hits WHERE r <= 50 GROUP BY doc_id"""),
    "similarity"))
def best_reference(spark: SparkSession, folder: str) -> DataFrame:
    hits = similarity.top_similar(
        V.document_fingerprints(spark, folder), V.benchmark_fingerprints(spark, folder), "doc_id", 50, 0.2)
    return rounded(similarity.best_reference(hits, "doc_id"))


BEST = """best AS (
  SELECT doc_id, max(similarity) AS similarity, arg_min(query, item_id) AS reference FROM top_hits WHERE r <= 50 GROUP BY doc_id)"""


@query("x03_l04_reference_screen", rounded_sql(V.sql("doc_fp item_fp", f"""
WITH {PAIRS}, {BEST}
SELECT doc_id, similarity, reference, similarity AS probability_active, 0.5 * similarity + 0.5 * similarity AS combined_score
FROM best ORDER BY similarity DESC, doc_id LIMIT 20"""), "similarity probability_active combined_score"))
def screen(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(similarity.screen(
        V.document_fingerprints(spark, folder), V.benchmark_fingerprints(spark, folder), "doc_id", 20))


def probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """A probability for every labelled document."""
    return V.labelled_scores(spark, folder).select("doc_id", F.col("y_prob").alias("probability_active"))


JOINED = """joined AS (
  SELECT doc_id, similarity, reference, probability_active FROM best
  FULL JOIN (SELECT doc_id, (n_chars * 31 % 997) / 997.0::DOUBLE AS probability_active FROM labels JOIN documents USING (doc_id))
  USING (doc_id))"""


@query("j02_full_outer_join", rounded_sql(V.sql("doc_fp item_fp", f"WITH {PAIRS}, {BEST}, {JOINED} SELECT * FROM joined"),
       "similarity probability_active"))
def full_outer(spark: SparkSession, folder: str) -> DataFrame:
    hits = similarity.best_reference(similarity.top_similar(
        V.document_fingerprints(spark, folder), V.benchmark_fingerprints(spark, folder), "doc_id", 50, 0.2), "doc_id")
    return rounded(joins.attach_hits(probabilities(spark, folder), hits, "doc_id"))


@query("r11_l05_screen_with_predictions", rounded_sql(V.sql("doc_fp item_fp", f"""
WITH {PAIRS}, {BEST}, {JOINED}
SELECT *, 0.5 * coalesce(probability_active, 0) + 0.5 * coalesce(similarity, 0) AS combined_score FROM joined
ORDER BY round(combined_score, 12) DESC, doc_id LIMIT 50"""), "similarity probability_active combined_score"))
def screen_predicted(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(similarity.screen(
        V.document_fingerprints(spark, folder), V.benchmark_fingerprints(spark, folder), "doc_id", 50,
        predictions=probabilities(spark, folder)))


GREEDY = """ranked AS MATERIALIZED (
  SELECT doc_id, n, b, row_number() OVER (ORDER BY doc_id) AS r
  FROM (SELECT doc_id, bitstring_agg(CAST(bit AS INT), 0, 1023) AS b, count(*) AS n FROM doc_bits GROUP BY doc_id)),
walk AS (
  SELECT 0::BIGINT AS r, []::STRUCT(doc_id BIGINT, n BIGINT, b BIT)[] AS kept
  UNION ALL
  SELECT x.r, CASE WHEN len(list_filter(kept, lambda k: bit_count(k.b & x.b) / (k.n + x.n - bit_count(k.b & x.b)) > 0.8)) > 0
    THEN kept ELSE list_append(kept, {'doc_id': x.doc_id, 'n': x.n, 'b': x.b}) END
  FROM walk w JOIN ranked x ON x.r = w.r + 1 WHERE len(kept) < 100),
final AS MATERIALIZED (SELECT r AS last_r, kept FROM walk ORDER BY r DESC LIMIT 1),
chosen AS MATERIALIZED (SELECT unnest(kept, recursive := true) FROM final)"""


@query("x04_diversity_filter", V.sql("doc_fp", f"WITH {GREEDY} SELECT doc_id FROM chosen", recursive=True))
def diverse(spark: SparkSession, folder: str) -> DataFrame:
    rows = written(V.document_fingerprints(spark, folder), "fingerprints").filter("n > 0")
    kept = diversity.diversity_filter(rows, "polyphenol", F.col("doc_id"), [F.asc("doc_id")])
    return kept.select("doc_id")


@query("j04_near_duplicate_links", V.sql("doc_fp", """
WITH packed AS MATERIALIZED (
  SELECT doc_id, bitstring_agg(CAST(bit AS INT), 0, 1023) AS b, count(*) AS n FROM doc_bits GROUP BY doc_id),
near AS (
  SELECT x.doc_id, count(*) AS n_links
  FROM packed x JOIN packed c ON c.doc_id <> x.doc_id
  WHERE bit_count(c.b & x.b) / (c.n + x.n - bit_count(c.b & x.b)) > 0.8 GROUP BY ALL)
SELECT doc_id AS pos, min(doc_id) OVER (PARTITION BY CAST(b AS VARCHAR)) AS class_id, coalesce(n_links, 0) AS n_links
FROM packed LEFT JOIN near USING (doc_id)"""))
def links(spark: SparkSession, folder: str) -> DataFrame:
    rows = written(V.document_fingerprints(spark, folder), "fingerprints").filter("n > 0")
    return diversity.near_duplicate_links(rows.withColumnRenamed("doc_id", "pos"))


@query("j04_near_duplicate_pairs", rounded_sql(V.sql("doc_fp", """
WITH packed AS MATERIALIZED (
  SELECT doc_id, bitstring_agg(CAST(bit AS INT), 0, 1023) AS b, count(*) AS n FROM doc_bits GROUP BY doc_id),
folded AS MATERIALIZED (SELECT *, min(doc_id) OVER (PARTITION BY CAST(b AS VARCHAR)) AS first FROM packed),
near AS (
  SELECT x.doc_id AS pos, c.doc_id AS near_pos, bit_count(c.b & x.b) / (c.n + x.n - bit_count(c.b & x.b)) AS similarity
  FROM folded x JOIN folded c ON c.doc_id < x.doc_id WHERE x.first = x.doc_id AND c.first = c.doc_id)
SELECT * FROM near WHERE similarity > 0.8
UNION ALL SELECT doc_id, first, 1.0::DOUBLE FROM folded WHERE first < doc_id"""), "similarity"))
def all_links(spark: SparkSession, folder: str) -> DataFrame:
    rows = written(V.document_fingerprints(spark, folder), "fingerprints").filter("n > 0")
    return rounded(diversity.near_duplicate_pairs(rows.withColumnRenamed("doc_id", "pos")))


@query("x05_vector_similarity", rounded_sql("""
SELECT q.vec_id AS query, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity
FROM embeddings e JOIN (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) q ON true
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY similarity DESC, e.vec_id) <= 10""", "similarity", 6))
def vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.read(spark, folder, "embeddings")
    first = cleaning.keep_first(rows, ["label"], ["vec_id"])
    asked = first.select(F.col("vec_id").alias("query"), F.col("embedding").alias("query_vector"))
    return rounded(similarity.cosine_top_k(rows, asked, "vec_id", "embedding", 10), 6)


@query("x05_vector_search", rounded_sql("""
SELECT q.vec_id AS query, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity
FROM embeddings e JOIN (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q ON true
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY similarity DESC, e.vec_id) <= 10""", "similarity", 6))
def vector_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.read(spark, folder, "embeddings")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("query_vector"))
    index = vector_index.build_index(rows, "vec_id", "embedding")
    return rounded(vector_index.search_index(index, asked, 10)[0], 6)
