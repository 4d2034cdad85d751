"""Streaming queries, run over what has arrived and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from shortlist.lookups import SOURCE_PRIORITY
from shortlist.session import scratch_path
from shortlist.streaming.arrivals import first_arrivals, run_available, stream_dedup_url, stream_first_by_event, stream_score
from workload.registry import query
from workload.tables import profile_vector, table


def stream_of(spark, d, name):
    # a pattern, so that both one file and a folder of files can be followed
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}[.]parquet")


@query("stream_score", """
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[],
  (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity_score FROM embeddings""")
def _stream_score(spark, d):
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "state")
    run_available(stream_score(stream_of(spark, d, "embeddings"), profile_vector(spark, d)), out, state)
    return spark.read.parquet(out).select("vec_id", F.round("similarity_score", 6).alias("similarity_score"))


_EVENT_SOURCE = "CASE event_id % 4 WHEN 0 THEN 'builtin' WHEN 1 THEN 'linkedin' WHEN 2 THEN 'serper' ELSE 'japan_boards' END"
_EVENT_PRIORITY = f"CASE {_EVENT_SOURCE} " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SOURCE_PRIORITY)) + " END"


@query("stream_dedup_url", f"""
SELECT url, id, CAST(epoch_us(ts) AS BIGINT) AS at_us, source FROM (
  SELECT concat('https://jobs.example.com/u/', user_id) AS url, event_id AS id, ts, {_EVENT_SOURCE} AS source,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, {_EVENT_PRIORITY}, event_id) AS rn FROM events) WHERE rn = 1""")
def _stream_dedup_url(spark, d):
    """The arrival that wins for each url: the earliest event, then the source of higher priority."""
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "state")
    arrivals = stream_of(spark, d, "events").select(
        F.concat(F.lit("https://jobs.example.com/u/"), F.col("user_id").cast("string")).alias("url"), F.col("event_id").alias("id"), "ts",
        F.expr(_EVENT_SOURCE).alias("source"), F.expr(_EVENT_PRIORITY).alias("priority"))
    run_available(stream_first_by_event(arrivals, "ts", "400 days", ["priority", "id"]), out, state)
    return first_arrivals(spark.read.parquet(out)).select("url", "id", F.unix_micros("ts").alias("at_us"), "source")


@query("stream_repeats_dropped", "SELECT count(DISTINCT user_id) AS urls FROM events")
def _stream_repeats_dropped(spark, d):
    """How many rows pass when the first to arrive wins."""
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "state")
    arrivals = stream_of(spark, d, "events").withColumn(
        "url", F.concat(F.lit("https://jobs.example.com/u/"), F.col("user_id").cast("string")))
    run_available(stream_dedup_url(arrivals, "ts", "400 days"), out, state)
    return spark.read.parquet(out).agg(F.count("url").alias("urls"))
