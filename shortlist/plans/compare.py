"""Compare search strategies on the postings each of them finds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from shortlist.operators import compare as ops
from shortlist.operators.embed import Vectoriser
from shortlist.operators.ranking import cosine_scores
from shortlist.plans.collect import collect_postings
from shortlist.plans.score import embed_postings
from shortlist.session import pin, staged


@dataclass(frozen=True)
class Comparison:
    scored: DataFrame
    strategies: DataFrame
    distribution: DataFrame
    leaders: DataFrame
    winner: DataFrame
    merged: DataFrame
    recommendation: DataFrame


def compare_scored(scored: DataFrame, strategies: DataFrame, n: int = 5) -> Comparison:
    """Statistics of scored rows (strategy, id, title, company, url, similarity_score).

    `strategies` has one row (strategy, position) per strategy, also for those without rows. The
    narrow scored rows are written once and read by every statistic.
    """
    rows = staged(scored.select("strategy", "id", "title", "company", "url", "similarity_score"), "compared")
    stats = pin(ops.strategy_stats(rows))
    leaders = ops.top_n_per_strategy(rows, n)
    return Comparison(
        rows, ops.strategy_report(stats, strategies), ops.score_distribution(rows), leaders,
        ops.strategy_winner(stats, strategies),
        ops.merged_top_k(leaders, positions=strategies), ops.strategy_uplift(stats, strategies))


def compare_searches(landed: dict[str, DataFrame], strategies: DataFrame, vector: list[float],
                     vectoriser: Vectoriser, n: int = 5, cap: int | None = None, **collect_options) -> Comparison:
    """Run all strategies in one plan, score what each finds and compare the scores.

    `strategies` has columns strategy, position, keywords, locations and optionally job_domain,
    which is 'any' unless given.
    """
    found = collect_postings(landed, strategies, cap=cap, detect=False, **collect_options)
    scored = cosine_scores(embed_postings(found, vectoriser), vector)
    return compare_scored(scored, strategies.select("strategy", "position"), n)
