import json

import pytest
from pyspark.sql import functions as F

from shortlist.operators import enrich, explain


def test_batches_of_a_hot_source(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "small").otherwise("hot").alias("source"), F.lit("t").alias("title"),
                                  F.lit(None).cast("string").alias("company"), F.repeat(F.lit("x"), 5000).alias("description_text"))
    rows = enrich.extraction_batches(df).collect()
    assert sorted({r["postings"] for r in rows}) == [6, 14, 20] and sum(r["postings"] for r in rows) == 1000
    items = json.loads(next(r for r in rows if r["source"] == "hot" and r["batch"] == 1)["payload"])
    assert [i["idx"] for i in items] == list(range(20)) and len(items[0]["description"]) == 5000 and items[0]["company"] == ""


@pytest.mark.parametrize("response, want", [
    ('[{"seniority":"Senior"},{"seniority":"Mid"}]', [(False, 0, "Senior"), (False, 1, "Mid")]),
    ('{"note":"x","jobs":[{"seniority":"Lead"}]}', [(False, 0, "Lead")]),
    ('{"seniority":"VP","tech_stack":["a","b"]}', [(False, 0, "VP")]),
    ('{"tech_stack":["a"],"items":[{"seniority":"Mid"}]}', [(False, 0, "Mid")]),
    ("not json", [(True, None, None)]), ('{"a": ', [(True, None, None)]), (None, [(True, None, None)]), ("[]", [(False, None, None)])])
def test_response_shapes(spark, response, want):
    df = spark.createDataFrame([(1, response)], "batch int, response string")
    assert [(r["failed"], r["idx"], r["fields"] and r["fields"]["seniority"]) for r in enrich.parse_extraction(df).collect()] == want


def test_first_list_by_text_and_fields_of_another_type(spark):
    text = '{"z":[{"seniority":"Lead","min_years_exp":"many","salary_min":9,"tech_stack":"x"}],"a":[{"seniority":"Mid"}]}'
    out = enrich.parse_extraction(spark.createDataFrame([(1, text)], "batch int, response string"))
    row = out.first()
    assert row["fields"].asDict() == {**dict.fromkeys(row["fields"].asDict()), "seniority": "Lead", "salary_min": 9.0}
    assert sorted(row["returned"]) == ["min_years_exp", "salary_min", "seniority", "tech_stack"]
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parse_json") + plan.count("parsejson") == 1 and "from_json" not in plan


def test_merge_keeps_postings_of_short_and_failed_batches(spark):
    raw = spark.createDataFrame([("s", 0, 0, "raw", 1.0), ("s", 0, 1, "raw", 2.0), ("s", 1, 0, "raw", 3.0)],
                                "source string, batch long, idx int, seniority string, salary_min double")
    answers = spark.createDataFrame([("s", 0, '[{"seniority":null,"tech_stack":["x"],"salary_min":9}]'), ("s", 1, "oops")],
                                    "source string, batch long, response string")
    out = enrich.merge_extraction(raw, enrich.parse_extraction(answers))
    assert sorted((r["batch"], r["idx"], r["seniority"], r["salary_min"], r["tech_stack"]) for r in out.collect()) == [
        (0, 0, None, 9.0, ["x"]), (0, 1, "raw", 2.0, None), (1, 0, "raw", 3.0, None)]


@pytest.mark.parametrize("title, text, want", [
    ("Senior Data Engineer", "5+ years of Python, SQL. USD 90,000 - 120,000", ("Senior", "Full-time", 5, 90000.0, 120000.0, ["python", "sql"], "true")),
    ("Engineer", "part-time, node.js. Pay $75000", ("Mid", "Part-time", 0, 75000.0, None, ["node.js"], "false")),
    ("Engineer", "3-5 years, 150 years of history; go to market. $90k - $120k", ("Mid", "Full-time", 3, 90000.0, 120000.0, [], "false")),
    ("Engineer", "150 years old firm, 5 years of sql, 90000 EUR", ("Mid", "Full-time", 5, 90000.0, None, ["sql"], "false")),
    ("Engineer", "7 yrs or 4 to 6 years. 85.5k eur", ("Mid", "Full-time", 4, 85500.0, None, [], "false")),
    ("Seniority analyst", "internal leader; 2019 yearslong", ("Mid", "Full-time", 0, None, None, [], "false")),
    (None, None, ("Mid", "Full-time", 0, None, None, [], "false"))])
def test_rules(spark, title, text, want):
    df = spark.createDataFrame([(title, text)], "title string, description_text string")
    row = enrich.rule_extract(df, "data").first()
    assert tuple(row[c] for c in ("seniority", "employment_type", "min_years_exp", "salary_min", "salary_max", "tech_stack", "is_relevant")) == want
    assert enrich.rule_extract(df).first()["is_relevant"] == "true"


def test_page_text_replaces_short_snippets_only(spark):
    hits = spark.createDataFrame([(1, "u1", "s1"), (2, "u2", "s2"), (3, "", "s3"), (4, None, "s4"), (5, "u1", "s5")],
                                 "id long, url string, description_snippet string")
    pages = spark.createDataFrame([(1, "u1", "<p>" + "long " * 30 + "</p>"), (2, "u2", "<p>short</p>"), (3, "u1", "<p>later copy" + "x" * 200), (4, "", "y" * 300)],
                                  "page_id long, url string, html string")
    out = {r["id"]: r["description_text"] for r in enrich.enrich_descriptions(hits, pages).collect()}
    assert out == {1: ("long " * 30).strip(), 2: "s2", 3: "s3", 4: "s4", 5: ("long " * 30).strip()}


def test_explanations_fill_gaps_only(spark):
    top = spark.createDataFrame([("T", 0.5, ["Python", "Go"], None), ("U", 0.4, [], "kept")],
                                "title string, similarity_score double, tech_stack array<string>, fit_explanation string")
    rows = explain.explain_overlap(top, ["python"]).collect()
    assert [r["fit_explanation"] for r in rows] == ["Matching skills: python. Missing skills: go.", "kept"]
    request = explain.explain_requests(top, "pitch").collect()
    sent = json.loads(request[0]["request"])
    assert len(request) == 1 and (sent["title"], sent["company"], sent["score"], sent["candidate"]) == ("T", "", "0.500", "pitch")


def test_digest_lines(spark):
    top = spark.createDataFrame([("T", "nan", "", 0.123456, "d" * 900), ("B", "C", "L", 0.9, None)],
                                "title string, company string, location string, similarity_score double, description_text string")
    lines = [json.loads(r["line"]) for r in explain.match_digest(top, "Robin", "2").collect()]
    assert lines[0] == {"candidate": {"name": "Robin", "profile_version": "2"}}
    assert lines[1] == {"title": "B", "company": "C", "location": "L", "similarity_score": 0.9, "description_snippet": ""}
    assert lines[2] == {"title": "T", "similarity_score": 0.1235, "description_snippet": "d" * 900}
    cut = [json.loads(r["line"]) for r in explain.match_digest(top, "Robin", "2", chars=800).collect()]
    assert cut[2]["description_snippet"] == "d" * 800
    row = explain.token_estimate(spark.createDataFrame([("a b c",), ("d",)], "clean_text string"),
                                 spark.createDataFrame([("x y",)], "line string")).first()
    assert (row["full_tokens"], row["digest_tokens"], row["percent"]) == (5, 2, 40.0)
