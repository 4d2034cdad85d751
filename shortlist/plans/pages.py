"""Score fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shortlist.functions.text import best_text, gate_status, page_text, page_title
from shortlist.operators.embed import Vectoriser, embed
from shortlist.operators.enrich import rule_extract
from shortlist.operators.explain import explain_overlap
from shortlist.operators.ranking import SCORE, cosine_scores


def page_postings(pages: DataFrame) -> DataFrame:
    """Title, text and status of every page, as a posting without company."""
    return pages.select(
        "page_id", "url", page_title("html").alias("title"), F.lit("").alias("company"),
        page_text("html").alias("page_text"), F.lit("snipe").alias("source"),
    ).withColumn("page_status", gate_status(F.col("page_text")))


def score_pages(pages: DataFrame, vector: list[float], vectoriser: Vectoriser,
                skills: list[str]) -> DataFrame:
    """Extract, vectorise, score and explain a table of pages, each by its whole text.

    Pages with too little text keep a row with status 'error' and no score.
    """
    rows = page_postings(pages).withColumn("description_text", F.col("page_text"))
    rows = rule_extract(rows, "any").withColumn(
        "clean_text", best_text("title", "company", "description_text", "description_text"))
    scored = cosine_scores(embed(rows, "clean_text", vectoriser), vector)
    usable = F.col("page_status") != "error"
    scored = scored.withColumn(SCORE, F.when(usable, F.round(SCORE, 4)))
    explained = explain_overlap(scored, skills)
    return explained.select(
        "page_id", "url", "title", "company", "seniority", "employment_type", "tech_stack",
        "min_years_exp", "is_relevant", SCORE, "fit_explanation",
        F.col("page_text").alias("description_text"), "page_status", "source")
