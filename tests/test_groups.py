"""Selection, positions and medians against plain Python, with one group holding most rows."""

import random
import statistics

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shortlist.operators.dedup import dedup_url, source_rank
from shortlist.operators.groups import numbered, sliced, top_n_per_group, value_stats

values = st.lists(st.tuples(st.sampled_from("abz"), st.one_of(st.none(), st.floats(-1, 1), st.just(0.5))),
                  min_size=1, max_size=60)


@settings(max_examples=6, deadline=None)
@given(values)
def test_value_stats(spark, rows):
    got = {r["k"]: r for r in value_stats(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", nth=3).collect()}
    for key in {k for k, _ in rows}:
        known = sorted(v for k, v in rows if k == key and v is not None)
        row = got[key]
        assert row["rows"] - row["missing"] == len(known)
        if known:
            assert row["median"] == statistics.median(known)
            assert (row["min"], row["max"]) == (known[0], known[-1])
            assert abs(row["mean"] - statistics.fmean(known)) < 1e-9
        assert row["nth_best"] == (known[-3] if len(known) >= 3 else None)


def hot_rows(n=6000):
    rng = random.Random(1)
    return [(i, "hot" if i % 3 else f"g{i % 50}", round(rng.uniform(-1, 1), 2)) for i in range(n)]


def test_numbering_of_a_hot_group(spark):
    rows = hot_rows()
    out = numbered(spark.createDataFrame(rows, "id long, k string, v double").select("k", "id"), ["k"], ["id"])
    place = {r["id"]: r["position"] for r in out.collect()}
    seen = {}
    for i, k, _ in rows:
        assert place[i] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + 1


def test_median_of_a_hot_value(spark):
    rows = [(1, 0.25)] * 3000 + [(1, v / 1000) for v in range(1000)]
    row = value_stats(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").first()
    assert row["median"] == statistics.median(v for _, v in rows)


def test_top_n_above_and_below_the_group_limit(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "id long, k string, v double")
    for n in (5, 1500):
        got = {}
        for r in top_n_per_group(df, ["k"], [F.desc("v"), F.asc("id")], n).collect():
            got.setdefault(r["k"], []).append((r["rank"], r["id"]))
        for key in {k for _, k, _ in rows}:
            best = sorted(((-v, i) for i, k, v in rows if k == key))[:n]
            assert sorted(got[key]) == [(p + 1, i) for p, (_, i) in enumerate(best)]


def test_group_limit_runs_before_the_shuffle(spark):
    df = spark.createDataFrame(hot_rows(100), "id long, k string, v double")
    plan = top_n_per_group(df, ["k"], [F.desc("v")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


sources = st.sampled_from(["builtin", "linkedin", "serper", "japan_boards", "other"])
postings = st.lists(st.tuples(sources, st.sampled_from(["", " ", None, "u1", "u2", "u3"])), min_size=1, max_size=40)


@settings(max_examples=6, deadline=None)
@given(postings, st.booleans())
def test_dedup_url(spark, rows, keep_blank):
    rank = {"builtin": 1, "linkedin": 2, "serper": 3, "japan_boards": 4, "other": 5}
    data = [(i, s, u) for i, (s, u) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, source string, url string").repartition(3)
    got = sorted(r["id"] for r in dedup_url(df, [F.asc(source_rank()), F.asc("id")], keep_blank=keep_blank).collect())
    best = {}
    for i, s, u in data:
        key = (u or "").strip()
        key = f"#{i}" if keep_blank and not key else key
        best[key] = min(best.get(key, (9, 0)), (rank[s], i))
    assert got == sorted(i for _, i in best.values())


def test_slices_cover_everything_once(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    parts = sliced(df, ["k"], 100)
    counts = [p.count() for p in parts]
    assert sum(counts) == 1000 and max(counts) <= 100
    assert len(sliced(df, ["k"], 1000)) == 1
