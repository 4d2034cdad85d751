"""Vectorise postings and score them against one profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shortlist.functions.text import best_text
from shortlist.functions.vectors import with_vectors
from shortlist.operators.embed import Vectoriser, embed, embed_incremental
from shortlist.operators.profile import profile_skills, profile_text
from shortlist.sources.ingest import normalise_columns


def posting_text(df: DataFrame) -> Column:
    """Text to vectorise, from the columns the frame has."""
    def have(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    return best_text(have("title"), have("company"), have("description_text"), have("description"))


def score_postings(df: DataFrame, vectoriser: Vectoriser, force: bool = False) -> DataFrame:
    """Give every posting a valid vector; `embedded_now` marks the rows that needed one."""
    rows = with_vectors(normalise_columns(df))
    rows = rows.withColumn("_text", posting_text(rows))
    return embed_incremental(rows, vectoriser, "_text", force).drop("_text")


def embed_postings(df: DataFrame, vectoriser: Vectoriser) -> DataFrame:
    """Vectorise all postings anew, keeping the cleaned text."""
    return embed(df.withColumn("clean_text", posting_text(df)), "clean_text", vectoriser)


def profile_row(profile: DataFrame, vectoriser: Vectoriser) -> dict:
    """Vector, skills, pitch and name of a single profile (one row comes to the driver)."""
    full = profile_skills(profile_text(profile))
    row = embed(full.select(
        "profile_text", "profile_skills", F.col("summary.elevator_pitch").alias("pitch"),
        F.col("identity.full_name").alias("name"), F.col("_meta.version").alias("version")),
        "profile_text", vectoriser).first()
    if row is None:
        raise ValueError("profile not found")
    found = row.asDict()
    found["vector"] = [float(x) for x in found.pop("embedding")]
    return found
