"""Vectors: making, re-using, scoring and matching them."""

from __future__ import annotations

from pyspark.sql import functions as F

from shortlist.functions.vectors import decode_vector, encode_vector, l2_normalise, vector_length
from shortlist.operators import embed as ops
from shortlist.operators.embed import HashedWords
from shortlist.operators.match import match_profiles
from shortlist.operators.ranking import cosine_scores
from shortlist.plans.refresh import refresh_vectors, write_vector_table
from shortlist.session import scratch_path
from workload.letters import LETTERS, letters_sql
from workload.registry import query
from workload.tables import postings, profile_vector, scored, table, texts, with_postings, with_scored

WORDS = HashedWords(dims=256, stop_words=False)


@query("embed_texts", f"""
SELECT doc_id, {WORDS.dims} AS dims, CASE WHEN regexp_matches(text, '[\\p{{L}}\\p{{N}}+#]') THEN 1.0::DOUBLE
  ELSE 0.0::DOUBLE END AS length, '{WORDS.name}' AS embedding_model FROM documents""")
def _embed_texts(spark, d):
    rows = ops.embed(texts(spark, d, "documents", "doc_id", "text"), "text", WORDS)
    return rows.select("doc_id", F.size("embedding").alias("dims"),
                       F.round(vector_length("embedding"), 4).alias("length"), "embedding_model")


@query("l2_normalise", """
SELECT vec_id, CASE WHEN label = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS length,
  CASE WHEN label = 0 THEN 0.0::DOUBLE ELSE round(embedding[1]::DOUBLE / sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])), 5) END AS first
FROM embeddings""")
def _l2_normalise(spark, d):
    scaled = F.transform("embedding", lambda x: (x * F.col("label")).cast("float"))
    unit = table(spark, d, "embeddings").select("vec_id", l2_normalise(scaled).alias("unit"))
    return unit.select("vec_id", F.round(vector_length("unit"), 4).alias("length"),
                       F.round(F.col("unit")[0].cast("double"), 5).alias("first"))


_MODEL = "CASE WHEN id % 5 = 0 THEN 'older-model' WHEN id % 7 = 0 THEN NULL ELSE 'current' END"
_STALE = f"(embedding IS NULL OR ({_MODEL}) IS DISTINCT FROM 'current')"


@query("stale_embeddings", with_postings(f"SELECT id, {_STALE} AS stale FROM postings"))
def _stale_embeddings(spark, d):
    rows = postings(spark, d, "embedding").withColumn("embedding_model", F.expr(_MODEL))
    return ops.stale_embeddings(rows, "current").select("id", "stale")


@query("embedding_coverage", with_postings(f"""
SELECT count(*) FILTER ({_STALE}) AS embedded, count(*) FILTER (NOT {_STALE}) AS skipped_cached,
  'current' AS model_used FROM postings"""))
def _embedding_coverage(spark, d):
    rows = postings(spark, d, "embedding").withColumn("embedding_model", F.expr(_MODEL))
    return ops.embedding_coverage(rows, "current")


_FRESH = f"(embedding IS NULL OR (CASE WHEN id % 3 = 0 THEN 'older-model' ELSE '{LETTERS.name}' END) <> '{LETTERS.name}')"


@query("write_embedded", with_postings(f"""
SELECT count(*) FILTER (fresh) AS embedded, count(*) FILTER (NOT fresh) AS skipped_cached,
  count(*) FILTER (fresh) AS rows_renewed, CAST(sum(id) AS BIGINT) AS sum_id FROM (SELECT id, {_FRESH} AS fresh FROM postings)"""))
def _write_embedded(spark, d):
    rows = postings(spark, d, "embedding", "description_text").withColumn(
        "embedding_model", F.when(F.col("id") % 3 == 0, "older-model").otherwise(LETTERS.name))
    path = scratch_path(spark, "embedded")
    counts = ops.write_embedded(rows, LETTERS, "description_text", path)
    return spark.read.parquet(path).agg(
        *[F.lit(counts[c]).cast("long").alias(c) for c in ("embedded", "skipped_cached")],
        F.count_if("embedded_now").alias("rows_renewed"), F.sum("id").cast("long").alias("sum_id"))


_OLD = f"CASE WHEN id % 3 = 0 THEN 'older-model' ELSE '{LETTERS.name}' END"
_NEW = f"(embedding IS NULL OR ({_OLD}) <> '{LETTERS.name}')"
_RENEWED = f"""len(w) AS dims, round(w[1], 5) AS first, round(w[5], 5) AS fifth, round(list_sum(w), 4) AS total, '{LETTERS.name}' AS embedding_model
FROM (SELECT id, fresh, CASE WHEN fresh THEN v ELSE embedding::DOUBLE[] END AS w FROM (
  SELECT id, embedding, {_NEW} AS fresh, {letters_sql('description_text')} AS v FROM postings))"""


def _renewed(out, *columns: str):
    value = F.transform("embedding", lambda x: x.cast("double"))
    return out.select("id", *columns, F.size("embedding").cast("long").alias("dims"), F.round(value[0], 5).alias("first"), F.round(value[4], 5).alias("fifth"),
                      F.round(F.aggregate(value, F.lit(0.0), lambda a, x: a + x), 4).alias("total"), "embedding_model")


_OLD_WORDS = "CASE WHEN id % 3 = 0 THEN 'older-model' ELSE '" + WORDS.name + "' END"


@query("embed_incremental", with_postings(f"""
SELECT id, embedding IS NULL OR ({_OLD_WORDS}) <> '{WORDS.name}' AS embedded_now, '{WORDS.name}' AS embedding_model,
  CASE WHEN embedding IS NULL OR ({_OLD_WORDS}) <> '{WORDS.name}' THEN {WORDS.dims} ELSE 64 END AS dims FROM postings"""))
def _embed_incremental(spark, d):
    rows = postings(spark, d, "description_text", "embedding").withColumn("embedding_model", F.expr(_OLD_WORDS))
    out = ops.embed_incremental(rows, WORDS, "description_text")
    return out.select("id", "embedded_now", "embedding_model", F.size("embedding").alias("dims"))


@query("embed_incremental_values", with_postings(f"SELECT id, fresh AS embedded_now, {_RENEWED}"))
def _embed_incremental_values(spark, d):
    """The vectors themselves, with a vectoriser that SQL can repeat."""
    rows = postings(spark, d, "description_text", "embedding").withColumn("embedding_model", F.expr(_OLD))
    return _renewed(ops.embed_incremental(rows, LETTERS, "description_text"), "embedded_now")


@query("refresh_vectors", with_postings(f"SELECT id, {_RENEWED}"))
def _refresh_vectors(spark, d):
    """A table of vectors whose outdated partitions are written again, read back."""
    rows = postings(spark, d, "description_text", "embedding").withColumn("embedding_model", F.expr(_OLD))
    path = write_vector_table(rows, scratch_path(spark, "vectors"), parts=8)
    refresh_vectors(spark, path, LETTERS, "description_text")
    return _renewed(spark.read.parquet(path))


@query("reuse_vectors", with_postings("""
SELECT id, id % 4 <> 0 AND embedding IS NOT NULL AS reused FROM postings"""))
def _reuse_vectors(spark, d):
    rows = postings(spark, d, "description_text", "embedding")
    changed = F.when(F.col("id") % 4 == 0, F.concat("description_text", F.lit(" changed"))).otherwise(
        F.col("description_text"))
    today = rows.select("id", changed.alias("description_text"))
    out = ops.reuse_vectors(today, rows.withColumn("embedding_model", F.lit("current")), "description_text")
    return out.select("id", F.col("embedding").isNotNull().alias("reused"))


_SCORED = "SELECT id, round(similarity_score, 6) AS similarity_score FROM scored"


@query("cosine_to_profile", with_scored(_SCORED))
def _cosine_to_profile(spark, d):
    return scored(spark, d).select("id", F.round("similarity_score", 6).alias("similarity_score"))


@query("cosine_to_profile_arrow", with_scored(_SCORED))
def _cosine_to_profile_arrow(spark, d):
    rows = cosine_scores(postings(spark, d, "embedding"), profile_vector(spark, d), kernel="arrow")
    return rows.select("id", F.round("similarity_score", 6).alias("similarity_score"))


@query("decode_vectors", """
SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN NULL ELSE len(embedding) END AS dims,
  CASE WHEN vec_id % 9 = 0 THEN NULL ELSE round(list_sum([x::DOUBLE for x in embedding]), 5) END AS total FROM embeddings"""
.replace("len(embedding)", "CAST(len(embedding) AS INTEGER)"))
def _decode_vectors(spark, d):
    text = F.when(F.col("vec_id") % 18 == 0, "not a list").when(F.col("vec_id") % 9 == 0, '[1.0, "x"]').otherwise(
        encode_vector("embedding"))
    rows = table(spark, d, "embeddings").select("vec_id", decode_vector(text).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("vec_id", F.when(F.col("v").isNotNull(), F.size("v")).alias("dims"),
                       F.round(total, 5).alias("total"))


@query("match_profiles", with_postings("""
SELECT profile_id, id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT profile_id, id, round(exact, 6) AS score, row_number() OVER (PARTITION BY profile_id ORDER BY exact DESC, id) AS rank FROM (
    SELECT v.vec_id AS profile_id, p.id,
      round(list_cosine_similarity(v.embedding::DOUBLE[], p.embedding::DOUBLE[]), 12) AS exact
    FROM embeddings v, postings p WHERE p.embedding IS NOT NULL)) WHERE rank <= 5"""))
def _match_profiles(spark, d):
    profiles = table(spark, d, "embeddings").select(F.col("vec_id").alias("profile_id"), "embedding")
    return match_profiles(postings(spark, d, "embedding"), profiles, k=5)


@query("match_profiles_text_ids", with_postings("""
SELECT profile_id, id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT profile_id, id, round(exact, 6) AS score, row_number() OVER (PARTITION BY profile_id ORDER BY exact DESC, id) AS rank FROM (
    SELECT 'v' || v.vec_id AS profile_id, 'p' || p.id AS id,
      round(list_cosine_similarity(v.embedding::DOUBLE[], p.embedding::DOUBLE[]), 12) AS exact
    FROM embeddings v, postings p WHERE p.embedding IS NOT NULL)) WHERE rank <= 3"""))
def _match_profiles_text_ids(spark, d):
    profiles = table(spark, d, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("profile_id"), "embedding")
    rows = postings(spark, d, "embedding").select(F.concat(F.lit("p"), "id").alias("id"), "embedding")
    return match_profiles(rows, profiles, k=3)
