"""Filters, ranking, score statistics and strategy comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from shortlist.functions.text import best_text, page_text
from shortlist.operators import compare, filters, ranking
from shortlist.operators.filters import Prefilter
from shortlist.session import scratch_path
from shortlist.sources.sinks import project_result
from workload.registry import query
from workload.sqltext import best_text_sql, page_text_sql
from workload.tables import postings, scored, table, texts, with_postings, with_scored

RULES = Prefilter(relevant_only=True, exclude_seniority=["Internship", "Entry level"],
                  employment_types=["Full-time"], min_salary=60000, seniority_column="seniority_raw")
_RELEVANT = "lower(coalesce(is_relevant, '')) = 'true'"
_SENIOR = "lower(coalesce(seniority_raw, '')) NOT IN ('internship', 'entry level')"
_EMPLOYED = "lower(coalesce(employment_type, '')) = 'full-time'"
_PAID = "coalesce(try_cast(trim(salary_min) AS DOUBLE), 0) >= 60000"


@query("filter_relevant", with_postings(f"SELECT id, is_relevant FROM postings WHERE {_RELEVANT}"))
def _filter_relevant(spark, d):
    return filters.filter_relevant(postings(spark, d, "is_relevant"))


@query("exclude_seniority", with_postings(f"SELECT id, seniority_raw FROM postings WHERE {_SENIOR}"))
def _exclude_seniority(spark, d):
    return filters.exclude_seniority(
        postings(spark, d, "seniority_raw"), ["Internship", "Entry level"], "seniority_raw")


@query("filter_employment", with_postings(f"SELECT id, employment_type FROM postings WHERE {_EMPLOYED}"))
def _filter_employment(spark, d):
    return filters.filter_employment(postings(spark, d, "employment_type"), ["Full-time"])


@query("filter_min_salary", with_postings(f"SELECT id, salary_min FROM postings WHERE {_PAID}"))
def _filter_min_salary(spark, d):
    return filters.filter_min_salary(postings(spark, d, "salary_min"), 60000)


_FILTER_COLUMNS = ("is_relevant", "seniority_raw", "employment_type", "salary_min")


@query("prefilter", with_postings(
    f"SELECT id FROM postings WHERE {_RELEVANT} AND {_SENIOR} AND {_EMPLOYED} AND {_PAID}"))
def _prefilter(spark, d):
    return filters.prefilter(postings(spark, d, *_FILTER_COLUMNS), RULES).select("id")


@query("prefilter_funnel", with_postings(f"""
SELECT count(*) AS total, count(*) FILTER ({_RELEVANT}) AS after_relevant,
  count(*) FILTER ({_RELEVANT} AND {_SENIOR}) AS after_seniority,
  count(*) FILTER ({_RELEVANT} AND {_SENIOR} AND {_EMPLOYED}) AS after_employment,
  count(*) FILTER ({_RELEVANT} AND {_SENIOR} AND {_EMPLOYED} AND {_PAID}) AS after_salary,
  count(*) FILTER ({_RELEVANT} AND {_SENIOR} AND {_EMPLOYED} AND {_PAID}) AS remaining
FROM postings"""))
def _prefilter_funnel(spark, d):
    return filters.prefilter_funnel(postings(spark, d, *_FILTER_COLUMNS), RULES)


@query("write_prefiltered", with_postings(f"""
SELECT CAST(count(*) AS BIGINT) AS total, count(*) FILTER ({_RELEVANT}) AS after_relevant,
  count(*) FILTER ({_RELEVANT} AND {_SENIOR} AND {_EMPLOYED} AND {_PAID}) AS remaining,
  count(*) FILTER ({_RELEVANT} AND {_SENIOR} AND {_EMPLOYED} AND {_PAID}) AS rows_written,
  CAST(sum(id) FILTER ({_RELEVANT} AND {_SENIOR} AND {_EMPLOYED} AND {_PAID}) AS BIGINT) AS sum_id FROM postings"""))
def _write_prefiltered(spark, d):
    path = scratch_path(spark, "prefiltered")
    counts = filters.write_prefiltered(postings(spark, d, *_FILTER_COLUMNS), RULES, path)
    return spark.read.parquet(path).agg(
        *[F.lit(counts[c]).cast("long").alias(c) for c in ("total", "after_relevant", "remaining")],
        F.count("*").alias("rows_written"), F.sum("id").cast("long").alias("sum_id"))


def _rounded(df, *columns):
    return df.select(*columns, F.round("similarity_score", 6).alias("similarity_score"))


@query("filter_min_score", with_scored(
    "SELECT id, round(similarity_score, 6) AS similarity_score FROM scored WHERE similarity_score >= 0.1"))
def _filter_min_score(spark, d):
    return _rounded(filters.filter_min_score(scored(spark, d), 0.1), "id")


@query("filter_has_url", with_postings("SELECT id, url FROM postings WHERE trim(coalesce(url, '')) <> ''"))
def _filter_has_url(spark, d):
    return filters.filter_has_url(postings(spark, d, "url"))


@query("short_text_report", with_postings(f"""
SELECT count(*) AS total, count(*) FILTER (length({best_text_sql()}) < 50) AS short_texts FROM postings"""))
def _short_text_report(spark, d):
    rows = postings(spark, d, "title", "company", "description_text")
    return filters.short_text_report(rows, F.length(best_text(fallback=None)))


@query("gate_page_text", f"""
SELECT page_id, CASE WHEN n < 100 THEN 'error' WHEN n < 1000 THEN 'thin' ELSE 'ok' END AS page_status
FROM (SELECT page_id, length({page_text_sql('html')}) AS n FROM pages)""")
def _gate_page_text(spark, d):
    rows = texts(spark, d, "pages", "page_id", "html").select("page_id", page_text("html").alias("page_text"))
    return filters.gate_page_text(rows).drop("page_text")


@query("require_embeddings", with_postings("SELECT id FROM postings WHERE embedding IS NOT NULL"))
def _require_embeddings(spark, d):
    rows = postings(spark, d, "embedding")
    filters.require_embeddings(rows)
    return rows.filter(F.col("embedding").isNotNull()).select("id")


@query("rank_by_score", with_scored(
    "SELECT id, round(similarity_score, 6) AS similarity_score FROM scored ORDER BY similarity_score DESC NULLS LAST, id"))
def _rank_by_score(spark, d):
    return _rounded(ranking.rank_by_score(scored(spark, d)), "id")


_TOP = "SELECT id, title, round(similarity_score, 6) AS similarity_score FROM scored ORDER BY scored.similarity_score DESC NULLS LAST, id"


@query("top_k", with_scored(_TOP + " LIMIT 10"))
def _top_k(spark, d):
    return _rounded(ranking.top_k(scored(spark, d, "title"), 10), "id", "title")


@query("next_page", with_scored(_TOP + " LIMIT 10 OFFSET 10"))
def _next_page(spark, d):
    return _rounded(ranking.top_k(scored(spark, d, "title"), 10, offset=10), "id", "title")


@query("project_result", with_scored("""
SELECT title, company, location, employment_type, url, round(similarity_score, 6) AS similarity_score
FROM scored ORDER BY scored.similarity_score DESC NULLS LAST, id LIMIT 10"""))
def _project_result(spark, d):
    rows = scored(spark, d, "title", "company", "location", "employment_type", "url", "is_relevant")
    top = project_result(ranking.top_k(rows, 10))
    return top.withColumn("similarity_score", F.round("similarity_score", 6))


@query("score_summary", with_scored("""
SELECT count(*) AS total_filtered, count(similarity_score) AS total_scored,
  round(coalesce(max(similarity_score), 0), 6) AS max_score, round(coalesce(min(similarity_score), 0), 6) AS min_score,
  round(coalesce(median(similarity_score), 0), 6) AS median_score,
  round((SELECT similarity_score FROM scored WHERE similarity_score IS NOT NULL
         ORDER BY similarity_score DESC LIMIT 1 OFFSET 9), 6) AS tenth_best
FROM scored"""))
def _score_summary(spark, d):
    out = ranking.score_summary(scored(spark, d))
    return out.select("total_filtered", "total_scored",
                      *[F.round(c, 6).alias(c) for c in ("max_score", "min_score", "median_score", "tenth_best")])


@query("source_counts", with_postings("""
SELECT a.source, a.n AS rows_before, coalesce(b.n, 0) AS rows_after
FROM (SELECT source, count(*) AS n FROM postings GROUP BY source) a
LEFT JOIN (SELECT source, count(*) AS n FROM (
  SELECT source, row_number() OVER (PARTITION BY trim(coalesce(url, '')) ORDER BY
    CASE source WHEN 'builtin' THEN 1 WHEN 'linkedin' THEN 2 WHEN 'serper' THEN 3 ELSE 4 END) AS rn
  FROM postings) WHERE rn = 1 GROUP BY source) b ON a.source = b.source"""))
def _source_counts(spark, d):
    return ranking.source_counts(postings(spark, d, "source", "url"))


_TIERED = ("expected_rank_tier",)


@query("tier_quality", with_scored("""
SELECT expected_rank_tier, round(mean_score, 6) AS mean_score,
  round((SELECT mean_score FROM m WHERE expected_rank_tier = 'top')
      - (SELECT mean_score FROM m WHERE expected_rank_tier = 'bottom'), 6) AS margin,
  (SELECT mean_score FROM m WHERE expected_rank_tier = 'top')
      - (SELECT mean_score FROM m WHERE expected_rank_tier = 'bottom') > 0.05 AS passes
FROM m""", "m AS (SELECT expected_rank_tier, avg(similarity_score) AS mean_score FROM scored GROUP BY 1)"))
def _tier_quality(spark, d):
    out = ranking.tier_quality(scored(spark, d, *_TIERED))
    return out.select("expected_rank_tier", F.round("mean_score", 6).alias("mean_score"),
                      F.round("margin", 6).alias("margin"), "passes")


@query("tier_hits_at_k", with_scored("""
SELECT count(*) FILTER (expected_rank_tier = 'top') AS top_hits,
  count(*) FILTER (expected_rank_tier = 'top') >= 4 AS passes
FROM (SELECT expected_rank_tier FROM scored ORDER BY similarity_score DESC NULLS LAST, id LIMIT 10)"""))
def _tier_hits_at_k(spark, d):
    return ranking.tier_hits_at_k(scored(spark, d, *_TIERED), 10)


@query("score_bounds", with_scored("""
SELECT count(*) FILTER (similarity_score IS NULL) AS missing,
  count(*) FILTER (similarity_score < -0.0001 OR similarity_score > 1.0001) AS out_of_range FROM scored"""))
def _score_bounds(spark, d):
    return ranking.score_bounds(scored(spark, d))


# -- strategies: the labels of the vectors, in their own order ----------------

def _scored_by_strategy(spark, d):
    return scored(spark, d, "strategy", "title", "company", "url").filter("strategy IS NOT NULL")


def _strategies(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("label").alias("strategy")).distinct()
    return labels.withColumn("position", F.col("strategy"))


_COMPARED = [
    "s AS (SELECT * FROM scored WHERE strategy IS NOT NULL)",
    """stats AS (SELECT strategy, count(*) AS jobs, round(coalesce(median(similarity_score), 0), 4) AS median_score,
      round(coalesce(avg(similarity_score), 0), 4) AS mean_score, round(coalesce(max(similarity_score), 0), 4) AS max_score
      FROM s GROUP BY strategy)""",
    "strategies AS (SELECT DISTINCT label AS strategy, label AS position FROM embeddings)",
    """leaders AS (SELECT title, company, round(similarity_score, 4) AS score, url, strategy, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY similarity_score DESC NULLS LAST, id) AS rank FROM s)
      WHERE rank <= 5)""",
]


@query("strategy_stats", with_scored("SELECT * FROM stats", *_COMPARED))
def _strategy_stats(spark, d):
    return compare.strategy_stats(_scored_by_strategy(spark, d))


@query("score_distribution", with_scored("""
SELECT strategy, count(*) FILTER (similarity_score >= 0.55) AS high,
  count(*) FILTER (similarity_score >= 0.45 AND similarity_score < 0.55) AS middle,
  count(*) FILTER (similarity_score < 0.45) AS low FROM s GROUP BY strategy""", *_COMPARED))
def _score_distribution(spark, d):
    return compare.score_distribution(_scored_by_strategy(spark, d))


@query("top_n_per_strategy", with_scored("SELECT * FROM leaders", *_COMPARED))
def _top_n_per_strategy(spark, d):
    return compare.top_n_per_strategy(_scored_by_strategy(spark, d), 5)


@query("merged_top_k", with_scored("""
SELECT title, company, score, url, strategy FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, strategy, rank) AS rn FROM leaders)
WHERE rn = 1 ORDER BY score DESC, strategy, rank LIMIT 10""", *_COMPARED))
def _merged_top_k(spark, d):
    return compare.merged_top_k(compare.top_n_per_strategy(_scored_by_strategy(spark, d), 5), 10)


@query("strategy_winner", with_scored("""
SELECT strategy AS winner, median_score FROM stats JOIN strategies USING (strategy)
ORDER BY median_score DESC, position LIMIT 1""", *_COMPARED))
def _strategy_winner(spark, d):
    stats = compare.strategy_stats(_scored_by_strategy(spark, d))
    return compare.strategy_winner(stats, _strategies(spark, d))


@query("strategy_uplift", with_scored("""
SELECT CAST(b.strategy AS VARCHAR) AS best, CAST(c.strategy AS VARCHAR) AS second,
  CASE WHEN c.median_score > 0 THEN CAST(round_even((b.median_score - c.median_score) / c.median_score * 100, 0) AS BIGINT) END AS percent,
  CASE WHEN c.median_score <= 0 THEN printf('''%s'' is the only strategy with positive scores.', CAST(b.strategy AS VARCHAR))
  ELSE printf('''%s'' returns %d%% higher median score (%.3f) than ''%s'' (%.3f). Prioritise ''%s'' for future scrapes.',
    CAST(b.strategy AS VARCHAR), CAST(round_even((b.median_score - c.median_score) / c.median_score * 100, 0) AS BIGINT),
    b.median_score, CAST(c.strategy AS VARCHAR), c.median_score, CAST(b.strategy AS VARCHAR)) END AS recommendation
FROM r b, r c WHERE b.rn = 1 AND c.rn = 2""", *_COMPARED,
    "r AS (SELECT *, row_number() OVER (ORDER BY median_score DESC, strategy) AS rn FROM stats)"))
def _strategy_uplift(spark, d):
    stats = compare.strategy_stats(_scored_by_strategy(spark, d))
    return compare.strategy_uplift(stats, _strategies(spark, d))
