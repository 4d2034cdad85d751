"""A table of vectors in partitions by key, of which only those with outdated rows are written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shortlist.operators.embed import Vectoriser, embed_incremental, stale_embeddings, with_vector_columns
from shortlist.session import staged

PARTS = 64      # a refresh reads and writes whole partitions, so more parts make smaller refreshes


def write_vector_table(df: DataFrame, path: str, key: str = "id", parts: int = PARTS) -> str:
    """Postings with or without vectors as a new table, partitioned by the hash of their key."""
    rows = with_vector_columns(df).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    by_part(rows).write.mode("errorifexists").partitionBy("part").parquet(path)
    return path


def by_part(rows: DataFrame) -> DataFrame:
    """Rows brought together by partition: a small partition becomes one file, a large one is split over tasks of even size."""
    return rows.hint("rebalance", "part")


def outdated(table: DataFrame, model: str, force: bool = False) -> DataFrame:
    """Per partition the rows that need a vector; a row that this model has met without a text needs none."""
    met = F.col("embedding").isNull() & F.col("embedding_model").eqNullSafe(F.lit(model))
    due = stale_embeddings(table, model, force).filter(F.col("stale") & (F.lit(force) | ~met))
    return due.groupBy("part").agg(F.count("*").alias("renewed"))


def refresh_vectors(spark: SparkSession, path: str, vectoriser: Vectoriser, text: str, force: bool = False) -> DataFrame:
    """Give all outdated rows of a table a vector of this model; returns (part, renewed) of the partitions written again.

    Finding them reads the vectors' model and whether they are null. Then only partitions with such rows are read whole, made
    anew, written to the shared folder and put in place of the old ones by a dynamic partition overwrite; all other files
    stay as they are. A run that ended early is repeated: what it finished is no longer outdated.
    """
    due = outdated(spark.read.parquet(path), vectoriser.name, force).collect()       # a number a partition
    report = spark.createDataFrame([(r["part"], r["renewed"]) for r in due], "part int, renewed long")
    if due:
        table = spark.read.parquet(path)
        rows = embed_incremental(table.filter(F.col("part").isin([r["part"] for r in due])), vectoriser, text, force)
        fresh = staged(rows.select(table.columns), "renewed")
        (by_part(fresh).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("part").parquet(path))
    return report
