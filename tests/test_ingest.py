import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shortlist.lookups import CANONICAL_COLUMNS
from shortlist.sources import ingest, sinks


def test_normalise_names(spark):
    df = spark.createDataFrame([], "salary_json_min string, workplace_type_enum string, `description_text ` string")
    assert ingest.normalise_columns(df).columns == ["salary_min", "workplace_type", "description_text"]


def test_duplicate_columns_first_or_filled(spark):
    df = spark.createDataFrame([("", 5.0), ("7", 6.0), (None, None)], "salary_json_min string, `Salary Min` double")
    assert [r[0] for r in ingest.normalise_columns(df).collect()] == ["", "7", None]
    assert [r[0] for r in ingest.normalise_columns(df, "coalesce").collect()] == ["5.0", "7", None]


def test_canonical_columns_and_duplicates(spark):
    df = spark.createDataFrame([(2, "t", "c", "u"), (1, "t", "c", "u"), (3, "t", "c", None)],
                               "id long, title string, company string, url string")
    out = ingest.conform_canonical(df, [F.asc("id")])
    assert set(out.columns) == set(CANONICAL_COLUMNS)
    assert sorted(r["id"] for r in out.collect()) == [1, 3]
    assert out.first()["reason"] == ""


@pytest.mark.parametrize("raw, want", [
    ({"jobUrl": "https://x/123"}, {"url": "https://x/123"}), ({"link": "https://x/456"}, {"url": "https://x/456"}),
    ({"title": "T", "url": "u"}, {"source": "linkedin", "url": "u"}),
    ({"descriptionText": "Job description here"},
     {"description_text": "Job description here", "description": "Job description here"}),
    ({"descriptionHtml": "<b>"}, {"description_text": "<b>", "description_html": "<b>"}),
    ({"url": " ", "link": "l"}, {"url": "l"}), ({"contractType": "Full"}, {"employment_type": "Full"}),
    ({"seniorityLevel": "Executive"}, {"seniority": "VP"}), ({"seniorityLevel": "", "seniority": "Senior"}, {"seniority": "Senior"})])
def test_linkedin_aliases(spark, raw, want):
    df = spark.createDataFrame([tuple(raw.values())], ", ".join(f"{k} string" for k in raw))
    row = ingest.alias_cascade_linkedin(df).first().asDict()
    assert {k: row[k] for k in want} == want


def test_builtin_aliases(spark):
    df = spark.createDataFrame([("", "remote", "text", "1000", "2000")],
                               "workplace_type string, workType string, description_text string, salary_json_min string, salary_json_max string")
    row = ingest.alias_cascade_builtin(df).first()
    assert (row["workplace_type"], row["description"], row["salary"]) == ("remote", "text", "USD 1,000 - 2,000")


def test_search_hits_first_snippet_wins(spark):
    from shortlist.operators.dedup import dedup_source_hits

    hits = spark.createDataFrame(
        [(0, [("Job 1", "u1", "Snippet 1"), ("Copy", "u1", "Snippet 2")]), (1, [("Job 2", "u2", "Snippet 3"), ("No", None, "x")])],
        "q int, organic array<struct<title:string,link:string,snippet:string>>")
    rows = ingest.search_hits_to_postings(hits, "serper")
    out = dedup_source_hits(rows, [F.asc("q"), F.asc("hit")])
    assert sorted((r["url"], r["description_snippet"], r["source"]) for r in out.collect()) == [
        ("u1", "Snippet 1", "serper"), ("u2", "Snippet 3", "serper")]


def test_union_skips_missing_sources(spark):
    a = spark.createDataFrame([("u1", "t")], "url string, title string")
    b = spark.createDataFrame([("u2", 1)], "url string, extra int")
    out = ingest.union_sources({"linkedin": b, "builtin": a, "serper": None}, ["builtin", "linkedin", "serper"])
    assert {(r["url"], r["priority"], r["title"], r["extra"]) for r in out.collect()} == {("u1", 0, "t", None), ("u2", 1, None, 1)}
    with pytest.raises(ValueError):
        ingest.union_sources({"builtin": None}, ["builtin"])


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok\nnext line', None, ["a", "b"])], "id long, t string, n string, tags array<string>")
    path = sinks.write_raw(df, str(tmp_path))
    row = ingest.blanks_to_null(ingest.scan_postings(spark, path)).first()
    assert (row["id"], row["t"], row["n"], row["tags"]) == ("1", 'say "hi", ok\nnext line', None, '["a","b"]')


def test_sinks_refuse_to_overwrite_and_drop_vectors(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0], "m", "s")], "title string, embedding array<double>, embedding_model string, source string")
    path = sinks.write_ranked(df, str(tmp_path), "parquet")
    assert spark.read.parquet(path).columns == ["title", "source"]
    with pytest.raises(Exception):
        sinks._write(df, path, "parquet")
    version = sinks.write_scored(df, str(tmp_path / "scored"))
    assert any(n.startswith("source=") for n in os.listdir(version))


def test_inventory(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "a.csv").write_text("x" * 2048)
    (tmp_path / "data" / "b.txt").write_text("x")
    (tmp_path / "data" / "deep").mkdir()
    (tmp_path / "data" / "deep" / "c.csv").write_text("x")
    rows = ingest.file_inventory(spark, [str(tmp_path / "data"), str(tmp_path / "none")]).collect()
    assert [(r["name"], r["location"], r["size_kb"]) for r in rows] == [("a.csv", "data", 2.0)]
    assert ingest.file_inventory(spark, [str(tmp_path / "none")]).count() == 0


def test_files_of_other_headers_keep_their_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title,company,url\nA,CoA,http://a\n")
    (tmp_path / "b.csv").write_text("company,url,title,salary\nCoB,http://b,\"B\nb\",7\n")
    rows = sorted(tuple(r) for r in ingest.scan_postings(spark, str(tmp_path)).select("title", "company", "url", "salary").collect())
    assert rows == [("A", "CoA", "http://a", None), ("B\nb", "CoB", "http://b", "7")]
    typed = ingest.scan_postings(spark, str(tmp_path), schema=T.StructType([T.StructField("url", T.StringType()), T.StructField("salary", T.DoubleType())]))
    assert sorted(tuple(r) for r in typed.collect()) == [("http://a", None), ("http://b", 7.0)]
