"""Preparing a corpus in five stages; each works on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.llm.common import written
from shortlist.llm.fuzzy_lines import dedup_lines
from shortlist.llm.identifiers import redact
from shortlist.llm.language import predict_language, train_language
from shortlist.llm.near_copies import near_components
from shortlist.llm.packing import pack_tokens
from shortlist.llm.queries import bpe_files

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, with that language; without text or letters they go.

    The model learns from all documents that have a language. Every row has the language of its own text, whatever its id.
    """
    kept = docs.select(COLUMNS).filter(F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False)))
    known = predict_language(kept, train_language(docs), keep=("text", "source", "n_chars")).filter("lang_pred <> 'und'")
    return known.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from every document but the first that has them; a document left without a line goes too."""
    lines = dedup_lines(docs.select(COLUMNS))
    return with_length(lines.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays: the smallest id, then text hash.

    Rows that repeat an id and text stay once; texts that share an id are judged each by itself. Rows without an id stand
    alone and all stay.
    """
    named = docs.filter("doc_id IS NOT NULL").withColumn("_hash", F.xxhash64("text"))
    ids = named.groupBy("doc_id").agg(F.count("*").alias("_n"), F.min("_hash").alias("_low"), F.max("_hash").alias("_high"))
    several = written(ids.filter("_n > 1").select("doc_id", (F.col("_low") < F.col("_high")).alias("_shared")), "near_dedup")
    # a text of a shared id goes by a number of its own, all others by their id
    own = F.when(F.col("_shared"), F.xxhash64("doc_id", "_hash")).otherwise(F.col("doc_id"))
    keyed = named.join(several, "doc_id", "left").withColumn("_key", own)
    once = keyed.filter("_shared IS NOT NULL").groupBy("_key", "doc_id", "_hash", "text").agg(
        F.min(F.struct("lang", "source", "n_chars")).alias("_rest")).select("_key", "_hash", "doc_id", "text", "_rest.*")
    rows = keyed.filter("_shared IS NULL").select("_key", "_hash", *COLUMNS).unionByName(once.select("_key", "_hash", *COLUMNS))
    found = near_components(rows.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "component_id")
    named_by = keyed.filter("_shared").select("_key", F.col("doc_id").alias("_id"), "_hash").distinct()
    order = F.struct(F.coalesce("_id", "_key").alias("id"), F.coalesce("_hash", F.lit(0)).alias("hash"), F.col("_key").alias("key"))
    kept = found.join(named_by, "_key", "left").groupBy("component_id").agg(F.min(order)["key"].alias("_key")).select("_key")
    return rows.join(kept, "_key", "left_semi").select(COLUMNS).unionByName(docs.filter("doc_id IS NULL").select(COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in all texts is replaced by the name of its kind."""
    return with_length(redact(docs.select(COLUMNS)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of full sequences, with their ids."""
    packed = pack_tokens(docs, **bpe_files())
    return packed.select("doc_id", "start", "length", F.crc32("ids_le").alias("ids_crc32"), "ids_le", "doc_tokens",
                         "sequence_id", "offset", "tier", "step_group")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("personal_data", personal_data), ("packing", packing)]

#: The stages' decisions come from models and sketches, which SQL can't express; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written and read again for the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
