import pytest
from pyspark.sql import functions as F

from shortlist.operators import compare, filters, ranking
from shortlist.operators.filters import Prefilter
from shortlist.plans.compare import compare_scored
from shortlist.plans.rank import top_jobs
from shortlist.sources.sinks import project_result


@pytest.fixture(scope="module")
def jobs(spark):
    return spark.createDataFrame([
        (1, "True", "Senior", "Full-time", "90000", [1.0, 0.0]), (2, "true", None, "full-time", "n/a", [0.0, 1.0]),
        (3, "False", "Junior", None, "", [1.0, 1.0]), (4, None, "JUNIOR", "Contract", "7d", None),
        (5, "", "", "Full-time", " 120000 ", [-1.0, 0.0]), (6, "TRUE", "Intern", None, "1e5", [0.0, 0.0])],
        "id long, is_relevant string, seniority string, employment_type string, salary_min string, embedding array<double>")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_filters_treat_absent_values_each_in_their_way(jobs):
    assert ids(filters.filter_relevant(jobs)) == [1, 2, 6]
    assert ids(filters.filter_relevant(jobs, on=False)) == [1, 2, 3, 4, 5, 6]
    assert ids(filters.filter_relevant(jobs.drop("is_relevant"))) == [1, 2, 3, 4, 5, 6]
    assert ids(filters.exclude_seniority(jobs, ["Junior", "intern"])) == [1, 2, 5]
    assert ids(filters.exclude_seniority(jobs, [])) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(Exception):
        filters.exclude_seniority(jobs.drop("seniority"), ["Junior"]).collect()
    assert ids(filters.filter_employment(jobs, ["FULL-TIME"])) == [1, 2, 5]
    assert ids(filters.filter_min_salary(jobs, 95000)) == [5, 6]
    assert ids(filters.filter_min_salary(jobs, 0)) == [1, 2, 3, 4, 5, 6]


def test_funnel_equals_chained_filters(jobs):
    rules = Prefilter(True, ["intern"], ["full-time"], 80000)
    row = filters.prefilter_funnel(jobs, rules).first().asDict()
    assert row == {"total": 6, "after_relevant": 3, "after_seniority": 2, "after_employment": 2, "after_salary": 1, "remaining": 1}
    assert ids(filters.prefilter(jobs, rules)) == [1]


def test_scores_order_and_pages(jobs):
    for kernel in ("expression", "arrow"):
        scored = ranking.cosine_scores(jobs, [1.0, 0.0], kernel=kernel)
        got = [(r["id"], r["similarity_score"]) for r in ranking.rank_by_score(scored).collect()]
        assert [i for i, _ in got] == [1, 3, 2, 6, 5, 4]
        assert got[-1][1] is None and abs(got[1][1] - 0.5 ** 0.5) < 1e-12
    assert [r["id"] for r in ranking.top_k(scored, 2).collect()] == [1, 3]
    assert [r["id"] for r in ranking.top_k(scored, 2, offset=2).collect()] == [2, 6]
    assert ranking.top_k(scored, 0).count() == 6
    assert ids(filters.filter_min_score(scored, 0.0)) == [1, 2, 3, 4, 5, 6]
    assert ids(filters.filter_min_score(scored, 0.0, strict=True)) == [1, 2, 3, 6]
    assert ids(filters.filter_min_score(scored, 0.5)) == [1, 3]


def test_summary_counts_and_empty(jobs):
    scored = ranking.cosine_scores(jobs, [1.0, 0.0])
    row = ranking.score_summary(scored).first()
    assert (row["total_filtered"], row["total_scored"], row["max_score"], row["min_score"], row["median_score"]) == (6, 5, 1.0, -1.0, 0.0)
    assert row["tenth_best"] is None
    none = ranking.score_summary(scored.filter("id > 100")).first()
    assert (none["total_filtered"], none["total_scored"], none["max_score"], none["median_score"]) == (0, 0, 0.0, 0.0)
    bounds = ranking.score_bounds(scored.withColumn("similarity_score", F.col("similarity_score") * 2)).first()
    assert (bounds["missing"], bounds["out_of_range"]) == (1, 3)


def test_embeddings_are_required_only_when_there_are_rows(jobs):
    assert filters.require_embeddings(jobs)
    assert not filters.require_embeddings(jobs.filter("id > 9"))
    assert not filters.require_embeddings(jobs.drop("embedding").filter("id > 9"))
    for broken in (jobs.drop("embedding"), jobs.filter("id = 4")):
        with pytest.raises(ValueError):
            filters.require_embeddings(broken)


def test_top_jobs(jobs):
    out = top_jobs(jobs.withColumn("title", F.lit("T")), [1.0, 0.0], 2, min_score=0.1,
                   rules=Prefilter(relevant_only=False), skills=["python"])
    assert [r["similarity_score"] for r in out.result.collect()][0] == 1.0
    assert out.result.columns == ["title", "seniority", "employment_type", "tech_stack", "similarity_score", "fit_explanation"]
    assert out.summary.first()["total_scored"] == 5
    assert project_result(jobs, False).columns == ["seniority", "employment_type"]


STRATEGIES = [("A", 0), ("B", 1), ("C", 2)]


def comparison(spark, rows, strategies=STRATEGIES[:2]):
    scored = spark.createDataFrame(rows, "strategy string, id long, title string, company string, url string, similarity_score double")
    return compare_scored(scored, spark.createDataFrame(strategies, "strategy string, position int"))


def test_winner_has_the_higher_median(spark):
    out = comparison(spark, [("A", 1, "A1", "c", "url1", 0.6), ("A", 2, "A2", "c", "url2", 0.5), ("B", 3, "B1", "c", "url3", 0.7)], STRATEGIES)
    assert out.winner.first()["winner"] == "B"
    assert [r["title"] for r in out.merged.collect()] == ["B1", "A1", "A2"]
    assert out.recommendation.first()["recommendation"] == (
        "'B' returns 27% higher median score (0.700) than 'A' (0.550). Prioritise 'B' for future scrapes.")
    report = {r["strategy"]: (r["jobs"], r["error"]) for r in out.strategies.collect()}
    assert report == {"A": (2, None), "B": (1, None), "C": (0, "no results")}


def test_recommendation_rounds_exact_values(spark):
    out = comparison(spark, [("A", 1, "A1", "c", "url1", 0.5125), ("B", 2, "B1", "c", "url2", 0.0625)])
    assert "(0.512)" in out.recommendation.first()["recommendation"] and "(0.062)" in out.recommendation.first()["recommendation"]


def test_statistics_move_no_value_by_its_group(spark):
    from shortlist.operators.groups import value_stats

    rows = spark.range(5000).select(F.lit("all").alias("g"), F.when(F.col("id") % 10 > 0, (F.col("id") * 7919 % 3001) / 8).alias("x"))
    out = value_stats(rows, ["g"], "x", 10)
    values = sorted(r["x"] for r in rows.collect() if r["x"] is not None)
    row = out.first()
    assert (row["rows"], row["missing"], row["min"], row["max"]) == (5000, 500, values[0], values[-1])
    assert row["median"] == (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2 and row["nth_best"] == values[-10]
    assert abs(row["mean"] - sum(values) / len(values)) < 1e-9
    two = value_stats(rows.select((F.col("x") > 100).alias("g"), "x"), ["g"], "x").collect()
    assert {r["g"]: r["rows"] for r in two} == {None: 500, True: sum(v > 100 for v in values), False: sum(v <= 100 for v in values)}


def test_ties_go_to_the_earlier_strategy_and_urls_are_merged(spark):
    out = comparison(spark, [("A", 1, "A1", "c", "u", 0.5), ("B", 2, "B1", "c", "u", 0.5), ("B", 3, "B2", "c", "v", 0.5)])
    assert out.winner.first()["winner"] == "A"
    assert [(r["title"], r["strategy"]) for r in out.merged.collect()] == [("A1", "A"), ("B2", "B")]


def test_recommendation_without_comparison(spark):
    one = comparison(spark, [("A", 1, "A1", "c", "u", 0.5)])
    assert one.recommendation.first()["recommendation"].startswith("Only one strategy returned results")
    flat = comparison(spark, [("A", 1, "A1", "c", "u", 0.5), ("B", 2, "B1", "c", "v", -0.1)])
    assert flat.recommendation.first()["recommendation"] == "'A' is the only strategy with positive scores."
    none = comparison(spark, [])
    assert none.winner.first()["winner"] is None and none.merged.count() == 0


def test_distribution_edges(spark):
    scored = spark.createDataFrame([("A", s) for s in (0.55, 0.549, 0.45, 0.449, None)], "strategy string, similarity_score double")
    row = compare.score_distribution(scored).first()
    assert (row["high"], row["middle"], row["low"]) == (1, 2, 1)


def test_funnel_is_counted_by_the_job_that_writes(spark, jobs, tmp_path):
    rules = Prefilter(min_salary=1)
    spark.sparkContext.setJobGroup("funnel", "counted write")
    counts = filters.write_prefiltered(jobs, rules, str(tmp_path / "kept"))
    spark.sparkContext._jsc.clearJobGroup()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("funnel")) == 1
    assert counts == filters.prefilter_funnel(jobs, rules).first().asDict()
    assert ids(spark.read.parquet(str(tmp_path / "kept"))) == ids(filters.prefilter(jobs, rules))
    none = filters.write_prefiltered(jobs.filter("id < 0"), rules, str(tmp_path / "none"))
    assert set(none.values()) == {0} and spark.read.parquet(str(tmp_path / "none")).isEmpty()
