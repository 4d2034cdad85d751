"""Every registered query against its SQL at the smallest scale, and the shape of some plans."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect
from workload import load

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 10


SHRINK_FIRST = {"dedup_url", "dedup_title_company_url", "top_n_per_strategy", "match_profiles"}
BUILT_IN = {"html_to_text", "rule_extract", "embed_texts", "embed_incremental", "cosine_to_profile", "profile_text"}
TOP_ONLY = {"top_k", "next_page", "project_result", "top_jobs", "merged_top_k"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name in SHRINK_FIRST:            # before and after the shuffle
        assert text.count("WindowGroupLimit") >= 2
    if name in BUILT_IN:
        assert "EvalPython" not in text and "MapIn" not in text
    if name in TOP_ONLY:
        assert "TakeOrderedAndProject" in text
    assert compare(df, con, SQL[name]) is None


@pytest.mark.parametrize("name", ["filter_relevant", "prefilter_funnel", "cosine_to_profile", "dedup_url", "source_counts"])
def test_texts_are_not_read_without_need(spark, name):
    for line in plan(QUERIES[name](spark, SF)).split("\n"):
        if "documents.parquet" in line:
            assert "text" not in line.split("ReadSchema")[1]
