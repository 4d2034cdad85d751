"""Sources and sinks, as round trips through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from shortlist.operators.ranking import top_k
from shortlist.session import scratch_path
from shortlist.sources import ingest, sinks
from workload.adverts import profiles
from workload.registry import query
from workload.tables import postings, scored, with_postings, with_scored

_COLUMNS = ("title", "company", "location", "description_text", "source", "url", "salary_min")


@query("scan_postings", with_postings("""
SELECT CAST(id AS VARCHAR) AS id, title, company, location, nullif(trim(description_text), '') AS description_text,
  source, nullif(url, '') AS url, nullif(salary_min, '') AS salary_min FROM postings"""))
def _scan_postings(spark, d):
    path = sinks.write_raw(postings(spark, d, *_COLUMNS), scratch_path(spark, "scan"))
    return ingest.blanks_to_null(ingest.scan_postings(spark, path))


@query("scan_profiles", """
SELECT c_custkey AS profile_id, c_name AS full_name, lower(c_mktsegment) || ' specialist' AS headline,
  'languages,sector' AS skill_groups, 5 AS roles, 'tool5' AS last_tool FROM customer""")
def _scan_profiles(spark, d):
    path = scratch_path(spark, "profiles")
    profiles(spark, d).write.json(path)
    out = ingest.scan_profiles(spark, path, multi_line=False)
    return out.select(
        "profile_id", "identity.full_name", "summary.headline",
        F.array_join(F.map_keys("technical_skills"), ",").alias("skill_groups"), F.size("experience").alias("roles"),
        F.element_at("experience", -1)["tech_used"][1].alias("last_tool"))


@query("file_inventory", with_postings("""
SELECT DISTINCT source AS location, true AS has_files, true AS sized FROM postings"""))
def _file_inventory(spark, d):
    base = scratch_path(spark, "inventory")
    rows = postings(spark, d, "source", "title")
    names = [r[0] for r in rows.select("source").distinct().collect()]     # the four sources
    for name in names:
        rows.filter(F.col("source") == name).write.csv(f"{base}/{name}", header=True)
    found = ingest.file_inventory(spark, [*(f"{base}/{name}" for name in names), f"{base}/missing"])
    return found.groupBy("location").agg((F.count("*") > 0).alias("has_files"), (F.max("size_kb") > 0).alias("sized"))


@query("write_ranked", with_scored("""
SELECT CAST(id AS VARCHAR) AS id, title, round(similarity_score, 6) AS similarity_score FROM scored
ORDER BY scored.similarity_score DESC NULLS LAST, id LIMIT 10"""))
def _write_ranked(spark, d):
    top = top_k(scored(spark, d, "title"), 10).withColumn("embedding_model", F.lit("dropped"))
    path = sinks.write_ranked(top, scratch_path(spark, "ranked"))
    back = ingest.scan_postings(spark, path)
    return back.withColumn("similarity_score", F.round(F.col("similarity_score").cast("double"), 6))


@query("write_scored", with_postings("""
SELECT id, source, CAST(len(embedding) AS INTEGER) AS dims FROM postings"""))
def _write_scored(spark, d):
    path = sinks.write_scored(postings(spark, d, "source", "embedding"), scratch_path(spark, "scored"))
    back = spark.read.parquet(path)
    return back.select("id", "source", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims"))


@query("write_raw", with_postings("SELECT id, source, url FROM postings"))
def _write_raw(spark, d):
    path = sinks.write_raw(postings(spark, d, "source", "url"), scratch_path(spark, "raw"), "parquet")
    return ingest.scan_postings(spark, path, "parquet")
