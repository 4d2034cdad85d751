"""Ranked results: pre-filter, score, rank, explain, summarise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from shortlist.functions.text import word_count
from shortlist.functions.vectors import with_vectors
from shortlist.operators.embed import Vectoriser
from shortlist.operators.explain import explain_overlap, match_digest, token_estimate
from shortlist.operators.filters import (Prefilter, filter_min_score, prefilter, require_embeddings,
                                         short_text_report)
from shortlist.operators.ranking import cosine_scores, rank_by_score, score_summary, top_k
from shortlist.plans.score import embed_postings, profile_row
from shortlist.session import pin, spread, staged
from shortlist.sources.ingest import normalise_columns, scan_postings
from shortlist.sources.sinks import project_result


@dataclass(frozen=True)
class Ranking:
    scored: DataFrame       # all pre-filtered rows with their scores
    top: DataFrame          # the best rows with all their columns
    result: DataFrame       # the output columns of those
    summary: DataFrame      # range and median over all scores


def top_jobs(df: DataFrame, vector: list[float], n: int | None = None, min_score: float = 0.0,
             rules: Prefilter | None = None, skills: list[str] | None = None, explain: bool = True,
             offset: int = 0, ties: tuple[str, ...] = ("id",), kernel: str = "expression",
             check: bool = True) -> Ranking:
    """Best postings for a profile vector. Explanations are made for the top rows only.

    Vectors may be JSON text, as a delimited file has them. Equal scores go by `ties`, or by title, company and url
    where these columns are absent.
    """
    rows = prefilter(with_vectors(normalise_columns(df)), rules or Prefilter())
    ties = tuple(c for c in ties if c in rows.columns) or tuple(c for c in ("title", "company", "url") if c in rows.columns)
    if check:
        require_embeddings(rows)
    scored = cosine_scores(rows, vector, kernel=kernel)
    top = top_k(filter_min_score(scored, min_score), n, offset, ties)
    if explain:
        if "tech_stack" not in top.columns:
            top = top.withColumn("tech_stack", F.array().cast("array<string>"))
        elif dict(top.dtypes)["tech_stack"] == "string":
            top = top.withColumn("tech_stack", F.from_json("tech_stack", "array<string>"))
        top = explain_overlap(top, skills or [""])
    return Ranking(scored, top, project_result(top, explain), score_summary(scored))


@dataclass(frozen=True)
class FileRanking:
    scored: DataFrame       # address, tie columns and score of all rows with a high enough score
    top: DataFrame          # the best rows with all their columns
    summary: DataFrame
    short_texts: DataFrame
    digest: DataFrame
    tokens: DataFrame


ADDRESS = ("_file", "_row")


def rank_file(spark: SparkSession, path: str, profile: DataFrame, vectoriser: Vectoriser, n: int = 10,
              min_score: float = 0.0, fmt: str = "csv", ties: tuple[str, ...] = ("title", "company")
              ) -> FileRanking:
    """Rank a file of postings without pre-filters; scores below min_score are always dropped."""
    return rank_frame(scan_postings(spark, path, fmt, file="_file"), profile, vectoriser, n, min_score, ties)


def with_address(df: DataFrame) -> DataFrame:
    """The rows with their file (empty where none is known) and a hash of all their values."""
    values = [F.to_json(c) if kind.startswith("map") else F.col(f"`{c}`") for c, kind in df.dtypes if c != "_file"]
    rows = df if "_file" in df.columns else df.withColumn("_file", F.lit(""))
    return rows.withColumn("_row", F.xxhash64(*values))


def fetch_rows(df: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of df at the addresses of `found`, a limited result, with its score.

    Only files in which something was found are read again. Rows that agree in file and hash are the same row repeated;
    each address is fetched once and serves all its repeats.
    """
    files = [r[0] for r in found.select("_file").distinct().collect()]
    rows = with_address(df.filter(F.col("_file").isin(files)) if "_file" in df.columns else df)
    once = rows.join(F.broadcast(found.select(*ADDRESS).distinct()), list(ADDRESS), "left_semi").dropDuplicates(list(ADDRESS))
    return once.join(F.broadcast(found.select(*ADDRESS, "similarity_score")), list(ADDRESS)).drop(*ADDRESS)


def rank_frame(df: DataFrame, profile: DataFrame, vectoriser: Vectoriser, n: int = 10,
               min_score: float = 0.0, ties: tuple[str, ...] = ("title", "company")) -> FileRanking:
    """Rank postings that need not have ids.

    Address, ties, score and text sizes of all rows are written once and serve every result; texts and vectors are not
    written. The best rows are fetched by their address.
    """
    me = profile_row(profile, vectoriser)
    texts = cosine_scores(embed_postings(with_address(spread(df)), vectoriser), me["vector"])
    ties = tuple(c for c in ties if c in df.columns)
    everything = staged(texts.select(
        *ADDRESS, *ties, "similarity_score", word_count(F.col("clean_text")).alias("_words"), F.length("clean_text").alias("_chars")), "ranked")
    scored = filter_min_score(everything.drop("_words", "_chars"), min_score, strict=True)
    best = pin(top_k(scored, n, ties=ties))
    top = pin(rank_by_score(fetch_rows(df, best), ties))
    digest = match_digest(top, me["name"] or "", me["version"] or "")
    return FileRanking(scored, top, score_summary(everything),
                       short_text_report(everything, F.col("_chars")), digest,
                       token_estimate(everything.select("_words"), digest, words="_words"))
