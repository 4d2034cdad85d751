"""Comparison of search strategies on their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shortlist.functions.numbers import three_decimals
from shortlist.operators.groups import first_per_group, top_n_per_group, value_stats
from shortlist.operators.ranking import SCORE, score_order

HIGH, MIDDLE = 0.55, 0.45


def strategy_stats(scored: DataFrame, key: str = "strategy") -> DataFrame:
    """Rows and rounded median, mean and maximum score per strategy."""
    return value_stats(scored.select(key, SCORE), [key], SCORE).select(
        key, F.col("rows").alias("jobs"),
        *[F.coalesce(F.round(c, 4), F.lit(0.0)).alias(f"{c}_score") for c in ("median", "mean", "max")])


def score_distribution(scored: DataFrame, key: str = "strategy") -> DataFrame:
    score = F.col(SCORE)
    return scored.groupBy(key).agg(
        F.count_if(score >= HIGH).alias("high"),
        F.count_if((score >= MIDDLE) & (score < HIGH)).alias("middle"),
        F.count_if(score < MIDDLE).alias("low"))


def top_n_per_strategy(scored: DataFrame, n: int = 5, key: str = "strategy",
                       ties: tuple[str, ...] = ("id",)) -> DataFrame:
    columns = ["title", "company", F.round(SCORE, 4).alias("score"), "url", key, "rank"]
    narrow = scored.select("title", "company", SCORE, "url", key, *ties)
    return top_n_per_group(narrow, [key], score_order(ties), n).select(*columns)


def merged_top_k(per_strategy: DataFrame, k: int = 10, key: str = "strategy",
                 positions: DataFrame | None = None) -> DataFrame:
    """Best row per url over the per-strategy leaders, then the first k by rounded score."""
    rows = per_strategy
    if positions is not None:
        rows = rows.join(positions, key, "left")
    place = "position" if positions is not None else key
    order = [F.desc_nulls_last("score"), F.asc(place), F.asc("rank")]
    best = first_per_group(rows, [F.coalesce("url", F.lit(""))], order)
    return best.orderBy(*order).limit(k).select("title", "company", "score", "url", key)


def strategy_winner(stats: DataFrame, strategies: DataFrame, key: str = "strategy") -> DataFrame:
    """Highest rounded median, ties to the earlier strategy; null when none returned rows."""
    joined = strategies.join(stats, key, "left").filter(F.col("jobs") > 0)
    best = joined.orderBy(F.desc("median_score"), F.asc("position")).limit(1)
    return best.agg(F.max(key).alias("winner"), F.max("median_score").alias("median_score"))


def strategy_report(stats: DataFrame, strategies: DataFrame, key: str = "strategy") -> DataFrame:
    """Every requested strategy, with an error note for those without rows."""
    return strategies.join(stats, key, "left").select(
        "position", key, F.coalesce("jobs", F.lit(0)).alias("jobs"),
        "median_score", "mean_score", "max_score",
        F.when(F.coalesce("jobs", F.lit(0)) == 0, "no results").alias("error"))


def strategy_uplift(stats: DataFrame, strategies: DataFrame, key: str = "strategy") -> DataFrame:
    """Best strategy against the second, as a percentage and a sentence."""
    two = (strategies.join(stats, key, "left").filter(F.col("jobs") > 0)
           .orderBy(F.desc("median_score"), F.asc("position")).limit(2)
           .select("position", key, "median_score"))
    # at most two rows reach this aggregate
    pair = two.agg(F.array_sort(
        F.collect_list(F.struct((-F.col("median_score")).alias("minus"), "position",
                                F.col(key).cast("string").alias("name"), "median_score"))).alias("p"))
    best, second = F.try_element_at("p", F.lit(1)), F.try_element_at("p", F.lit(2))
    pair = pair.withColumn("_best", three_decimals(best["median_score"])).withColumn(
        "_second", three_decimals(second["median_score"]))
    b, s = best["median_score"], second["median_score"]
    percent = F.when(s > 0, F.bround((b - s) / s * 100, 0).cast("long"))
    # fixed values: wording of the recommendation
    sentence = (
        F.when(s.isNull(), "Only one strategy returned results — no comparison available.")
        .when(s <= 0, F.format_string("'%s' is the only strategy with positive scores.", best["name"]))
        .otherwise(F.format_string(
            "'%s' returns %d%% higher median score (%s) than '%s' (%s). "
            "Prioritise '%s' for future scrapes.",
            best["name"], percent, F.col("_best"), second["name"], F.col("_second"), best["name"])))
    return pair.select(best["name"].alias("best"), second["name"].alias("second"),
                       percent.alias("percent"), sentence.alias("recommendation"))
