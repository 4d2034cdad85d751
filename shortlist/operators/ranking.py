"""Scoring, ranking and score statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shortlist.functions.text import blank_to_null
from shortlist.functions.vectors import cosine, cosine_arrow
from shortlist.operators.dedup import source_rank
from shortlist.operators.groups import value_stats

DEFAULT_TOP = 10
SCORE = "similarity_score"


def cosine_scores(df: DataFrame, vector: list[float], col: str = "embedding",
                  kernel: str = "expression") -> DataFrame:
    """Score every vector against one profile vector; rows without vector stay unscored."""
    score = {"expression": cosine, "arrow": cosine_arrow}[kernel]
    return df.withColumn(SCORE, score(col, vector))


def score_order(ties: tuple[str, ...] = ("id",), score: str = SCORE) -> list[Column]:
    return [F.desc_nulls_last(score), *[F.asc(t) for t in ties]]


def rank_by_score(df: DataFrame, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    return df.orderBy(*score_order(ties))


def top_k(df: DataFrame, n: int | None = DEFAULT_TOP, offset: int = 0,
          ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """The best n rows, or the n after the first offset rows; 0 and None mean the default n."""
    ranked = rank_by_score(df, ties)
    return (ranked.offset(offset) if offset else ranked).limit(n or DEFAULT_TOP)


def score_summary(df: DataFrame, score: str = SCORE) -> DataFrame:
    """Range, exact median and tenth best of all scores, with the counts of rows and of scored rows."""
    stats = value_stats(df.select(F.lit(1).alias("_all"), score), ["_all"], score, nth=10)
    # an aggregate without keys gives its one row for an empty input, too
    return stats.agg(
        F.coalesce(F.max("rows"), F.lit(0)).alias("total_filtered"),
        F.coalesce(F.max(F.col("rows") - F.col("missing")), F.lit(0)).alias("total_scored"),
        *[F.coalesce(F.max(c), F.lit(0.0)).alias(f"{c}_score") for c in ("max", "min", "median")],
        F.max("nth_best").alias("tenth_best"))


def source_counts(df: DataFrame) -> DataFrame:
    """Per source: rows, and rows that stay when urls are unique across sources."""
    keyed = df.select("source", source_rank().alias("_rank"),
                      F.coalesce(blank_to_null("url"), F.lit("")).alias("_url"))
    before = keyed.groupBy("source").agg(F.count("*").alias("rows_before"))
    # the minimum combines before the shuffle, so a shared url costs one row per task
    after = (keyed.groupBy("_url").agg(F.min(F.struct("_rank", "source")).alias("_w"))
             .groupBy(F.col("_w.source").alias("source")).agg(F.count("*").alias("rows_after")))
    return before.join(after, "source", "left").select(
        "source", "rows_before", F.coalesce("rows_after", F.lit(0)).alias("rows_after"))


def collection_summary(df: DataFrame, grid: DataFrame) -> DataFrame:
    one, none = F.lit(1), F.lit(0)
    rows = df.select(one.alias("jobs"), none.alias("queries")).unionByName(
        grid.select(none.alias("jobs"), one.alias("queries")))
    return rows.agg(F.coalesce(F.sum("jobs"), none).alias("jobs_collected"),
                    F.coalesce(F.sum("queries"), none).alias("queries_run"))


def tier_quality(df: DataFrame, tier: str = "expected_rank_tier", score: str = SCORE,
                 gate: float = 0.05) -> DataFrame:
    """Mean score per tier beside the margin of top over bottom."""
    means = df.groupBy(tier).agg(F.avg(score).alias("mean_score"))
    everything = Window.partitionBy(F.lit(1))       # over one row per tier

    def mean_of(name: str) -> Column:
        return F.max(F.when(F.col(tier) == name, F.col("mean_score"))).over(everything)

    return (means.withColumn("margin", mean_of("top") - mean_of("bottom"))
            .withColumn("passes", F.col("margin") > gate))


def tier_hits_at_k(df: DataFrame, k: int = 10, tier: str = "expected_rank_tier",
                   gate: int = 4) -> DataFrame:
    return (top_k(df.select("id", tier, SCORE), k)
            .agg(F.count_if(F.col(tier) == "top").alias("top_hits"))
            .withColumn("passes", F.col("top_hits") >= gate))


def score_bounds(df: DataFrame, score: str = SCORE, slack: float = 1e-4) -> DataFrame:
    col = F.col(score)
    return df.agg(
        F.count_if(col.isNull() | F.isnan(col)).alias("missing"),
        F.count_if(~F.isnan(col) & ((col < -slack) | (col > 1 + slack))).alias("out_of_range"))
