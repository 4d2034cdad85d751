import random
import re

import pytest
from pyspark.sql import functions as F

from shortlist.plans.collect import collect_postings, search_plan
from shortlist.operators.needles import occurrences
from shortlist.operators.search import (expand_countries, filter_sites, plan_sources, route_locations, search_grid,
                                        search_postings)


def strategies(spark, keywords, locations, **extra):
    names = "".join(f", {k} string" for k in extra)
    return spark.createDataFrame([("s", keywords, locations, *extra.values())],
                                 "strategy string, keywords array<string>, locations array<string>" + names)


def plan(spark, keywords, locations, sources=None):
    return sorted((r["source"], r["keyword"], r["location"])
                  for r in plan_sources(search_grid(strategies(spark, keywords, locations)), sources).collect())


def test_grid_is_keyword_major(spark):
    rows = search_grid(strategies(spark, ["a", "b"], ["x", "y"])).orderBy("position").collect()
    assert [(r["keyword"], r["location"], r["position"]) for r in rows] == [("a", "x", 0), ("a", "y", 1), ("b", "x", 2), ("b", "y", 3)]


def test_default_sources(spark):
    assert plan(spark, ["kw"], ["Berlin"]) == [(s, "kw", "Berlin") for s in ("builtin", "linkedin", "serper")]


def test_only_requested_sources(spark):
    assert plan(spark, ["kw"], ["Berlin"], ["BuiltIn"]) == [("builtin", "kw", "Berlin")]
    assert plan(spark, ["kw"], ["Berlin"], ["japan"]) == []


def test_japan_is_routed_and_searched_by_keyword_only(spark):
    assert plan(spark, ["k1", "k2", "k3"], ["Tokyo", "Japan"]) == [("japan_boards", f"k{i}", None) for i in (1, 2, 3)]
    assert plan(spark, ["kw"], ["Remote"], ["builtin"]) == []       # 'Remote' is inside a watched name


@pytest.mark.parametrize("mode, want", [("substring", ["japan", "japan", "other", "japan"]), ("exact", ["japan", "other", "other", "other"])])
def test_routing_modes(spark, mode, want):
    df = spark.createDataFrame([(0, "tokyo"), (1, "Remote"), (2, "Berlin"), (3, "")], "i int, location string")
    assert [r["route"] for r in route_locations(df, mode=mode).orderBy("i").collect()] == want


def test_countries(spark):
    df = spark.createDataFrame([("Germany",), ("EMEA wide",), ("Porto",), (None,)], "location string")
    rows = expand_countries(df).collect()
    assert len(rows) == 1 + 8 + 1 + 1
    assert {r["location_key"] for r in rows if r["location"] == "Germany"} == {"DEU"}


def test_sites(spark):
    urls = ["https://jobs.lever.co/x", "https://a.jobs.lever.co", "https://notjobs.lever.co/x", "https://ycombinator.com/jobs/1",
            "https://www.ycombinator.com/jobs", "https://ycombinator.com/jobsearch", "https://ycombinator.com/about", "", None,
            "https://user@thehub.io:8080/p?q=1", "https://evil.com/jobs.lever.co", "HTTPS://WELLFOUND.COM/a"]
    out = filter_sites(spark.createDataFrame([(u,) for u in urls], "url string"))
    assert [r["url"] for r in out.collect()] == [urls[0], urls[1], urls[3], urls[4], urls[9], urls[11]]


def test_search_caps_a_hot_keyword_and_splits_large_grids(spark):
    posts = spark.range(3000).select("id", F.lit("serper").alias("source"), F.concat(F.lit("Engineer w"), F.col("id") % 7).alias("title"),
                                     F.lit("in BERLIN").alias("description_text"), F.lit(None).cast("string").alias("location"))
    grid = spark.createDataFrame(
        [("serper", "engineer", "berlin", 0), ("serper", "W3", None, 1), ("linkedin", "engineer", "berlin", 2), ("serper", "absent", "berlin", 3)],
        "source string, keyword string, location string, position int")
    want = [("W3", None, 7 * i + 3) for i in range(5)] + [("engineer", "berlin", i) for i in range(5)]
    for limit in (100, 2):
        hits = search_postings(posts, grid, 5, max_words=limit)
        assert sorted(((r["keyword"], r["location"], r["id"]) for r in hits.collect()), key=str) == sorted(want, key=str)
    assert search_postings(posts, grid.filter("false"), 5).count() == 0
    assert search_postings(posts, grid).count() == 3000 + sum(i % 7 == 3 for i in range(3000))


def test_a_large_grid_reads_the_postings_once_and_is_not_broadcast_by_hand(spark):
    posts = spark.range(50).select("id", F.lit("serper").alias("source"), F.lit("engineer").alias("title"),
                                   F.concat(F.lit("in place"), F.col("id")).alias("description_text"), F.lit(None).cast("string").alias("location"))
    grid = spark.range(20_000).select(F.lit("serper").alias("source"), F.lit("engineer").alias("keyword"),
                                      F.concat(F.lit("place"), F.col("id")).alias("location"), F.col("id").alias("position"))
    hits = search_postings(posts, grid)
    text = hits._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Range (0, 50") == 1 and "broadcast" not in text.lower()
    assert hits.count() == sum(1 for i in range(50) for p in range(20_000) if f"place{p}" in f"engineer in place{i}")


def test_search_equals_testing_every_keyword(spark):
    draw = random.Random(7)
    syllables = ["da", "ta", "ing", "é", "x", " ", "-", "eng", "I", "B\n"]
    word = lambda n: "".join(draw.choice(syllables) for _ in range(draw.randint(1, n)))     # noqa: E731
    posts = [(i, draw.choice("ab"), word(6), draw.choice([None, "", word(30)]), draw.choice([None, word(2)])) for i in range(120)] + [(7, "a", "dup", "dating x", None)]
    grid = [(draw.choice("ab"), draw.choice([word(4), "", None]), draw.choice([None, "", word(2)]), i) for i in range(150)]
    hits = search_postings(spark.createDataFrame(posts, "id long, source string, title string, description_text string, location string"),
                           spark.createDataFrame(grid, "source string, keyword string, location string, position int"), max_words=60)
    want = []
    for i, source, title, text, place in posts:
        t, w = " ".join(x for x in (title, text) if x is not None).lower(), (place or "").lower()
        want += [(i, *g) for g in grid if g[0] == source and g[1] is not None and g[1].lower() in t
                 and (not g[2] or g[2].lower() in t or g[2].lower() in w)]
    assert len(want) > 500 and sorted(map(str, map(tuple, hits.collect()))) == sorted(map(str, want))


def test_a_hundred_thousand_keywords_cost_an_index_lookup(spark):
    posts = spark.range(2000).select("id", F.lit("serper").alias("source"), F.concat(F.lit("skill "), F.col("id") * 37, F.lit(" wanted")).alias("title"),
                                     F.concat(F.lit("in place "), F.col("id")).alias("description_text"), F.lit(None).cast("string").alias("location"))
    grid = spark.range(100_000).select(F.lit("serper").alias("source"), F.concat(F.lit("skill "), F.col("id"), F.lit(" ")).alias("keyword"),
                                       F.concat(F.lit("place "), F.col("id") % 5000).alias("location"), F.col("id").alias("position"))
    hits = search_postings(posts, grid)
    text = hits._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Range (0, 2000") == 1 and "from_json" not in text and "skill 99" not in text and len(text) < 60_000
    assert "BroadcastHashJoin [gram" in hits._jdf.queryExecution().executedPlan().toString()     # the texts do not move
    want = [i for i in range(2000) if i * 37 < 100_000 and f"place {i * 37 % 5000}" in f"skill {i * 37} wanted in place {i}"]
    assert sorted(r["id"] for r in hits.collect()) == want and want


def test_needles_are_found_by_bytes_in_any_script(spark):
    words = ["go", "r", "é", "añb", "日本", "日本語 x", "data eng", "a b", "\n", " ", "𝄞y", "zzzz"]
    texts = ["go data engineer r", "日本語 xé", "日", "añbañb 𝄞y", "", None, "da", "ta eng", "line\nline", "zzz", "a b"] * 700
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    needles = spark.createDataFrame([(w,) for w in words], "needle string")
    got = sorted((r["id"], r["needle"]) for r in occurrences(rows, "t", needles).collect())
    assert got == sorted((i, w) for i, t in enumerate(texts) if t is not None for w in words if w in t)


def test_a_posting_of_several_strategies_is_read_once(spark, landed):
    two = strategies(spark, ["data"], ["Berlin"]).unionByName(strategies(spark, ["engineer"], ["Berlin"]).withColumn("strategy", F.lit("t")))
    out = collect_postings(landed, two)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Generate explode(_searched") < text.index("AS _found")       # the rules are below the strategies
    assert sorted((r["strategy"], r["id"]) for r in out.collect()) == [("s", 1), ("s", 4), ("t", 1), ("t", 4)]


def test_sources_of_a_strategy(spark):
    both = strategies(spark, ["kw"], ["Berlin", "Tokyo"]).withColumn("sources", F.array(F.lit("LinkedIn"), F.lit("japan"))).unionByName(
        strategies(spark, ["other"], ["Berlin"]).withColumn("strategy", F.lit("t")).withColumn("sources", F.array(F.lit("builtin"))))
    rows = search_plan(both).collect()
    assert sorted((r["strategy"], r["source"]) for r in rows) == [("s", "japan_boards"), ("s", "linkedin"), ("t", "builtin")]


@pytest.fixture(scope="module")
def landed(spark):
    core = "id long, title string, company string, location string, description_text string, url string"
    return {
        "builtin": spark.createDataFrame([(1, "data engineer", "b1", "Berlin", "text", "shared"), (2, "data engineer", "b2", "Berlin", "text", "")], core),
        "linkedin": spark.createDataFrame([(3, "data engineer", "l1", "Berlin", "text", "shared"), (4, "data engineer", "l2", "Berlin", "text", ""),
                                           (5, "data engineer", "l3", "Berlin", "text", None)], core),
        "japan_boards": spark.createDataFrame([(6, "data engineer", "", "Osaka", "text", "jp")], core),
    }


def test_collect_prefers_the_earlier_source(spark, landed):
    plan_ = strategies(spark, ["Data Engineer"], ["Berlin", "Tokyo"])
    rows = collect_postings(landed, plan_).collect()
    assert sorted((r["id"], r["source"]) for r in rows) == [(1, "builtin"), (4, "linkedin"), (6, "japan_boards")]
    assert {r["job_domain"] for r in rows} == {"data"} and {r["is_relevant"] for r in rows} == {"true"}
    kept = collect_postings(landed, plan_, keep_blank=True)
    assert sorted(r["id"] for r in kept.collect()) == [1, 4, 5, 6]


def test_collect_only_some_sources_and_domain(spark, landed):
    rows = collect_postings(landed, strategies(spark, ["engineer"], ["Berlin"], job_domain="gtm"), ["builtin"]).collect()
    assert [(r["id"], r["is_relevant"]) for r in rows] == [(1, "false")]
    assert {r["job_domain"] for r in search_plan(strategies(spark, ["GTM"], ["x"]), detect=False).collect()} == {"any"}


def test_collect_parses_a_page_once_and_fetches_without_moving_rows(spark, landed):
    pages = spark.createDataFrame([(1, "jp", "<nav>menu</nav><p>" + "Data engineer wanted in Osaka. " * 9 + "</p>"), (2, "no", "<p>data engineer</p>"),
                                   (0, "jp2", "<p>short</p>")], "page_id long, url string, html string")
    hits = {"serper": spark.createDataFrame([(1, "x", "https://jobs.lever.co/a", "data engineer Berlin snippet"), (2, "x", "https://other.com/a", "data engineer Berlin")],
                                            "id long, title string, url string, description_snippet string").withColumn("location", F.lit("Berlin")),
            "japan_boards": spark.createDataFrame([(1, "x", "jp", "snippet"), (2, "data engineer", "jp2", "kept snippet")],
                                                  "id long, title string, url string, description_snippet string").withColumn("location", F.lit("Berlin"))}
    plan_ = strategies(spark, ["Data Engineer"], ["Berlin", "Tokyo"])
    out = collect_postings(hits, plan_, pages=pages, domains={"serper": ["jobs.lever.co"]}, detect=False)
    rows = {(r["source"], r["id"]): r["description_text"] for r in out.collect()}
    assert set(rows) == {("serper", 1), ("japan_boards", 1), ("japan_boards", 2)}
    assert rows["japan_boards", 1].startswith("Data engineer wanted") and "menu" not in rows["japan_boards", 1]
    assert rows["japan_boards", 2] == "kept snippet"
    text = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"(?<!_)html#", text)      # pages were parsed when the table was written
    lines = [x for x in text.split("\n") if x.strip()]
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "description_text" in x)
    assert "Bucketed: true" in lines[scan]
    above, level = [], depth[scan]
    for i in range(scan, -1, -1):
        if depth[i] < level:
            above.append(lines[i])
            level = depth[i]
    assert any("SortMergeJoin" in x for x in above) and not any("Exchange" in x for x in above)     # the wide rows stay in their buckets
