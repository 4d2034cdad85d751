import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shortlist.functions.fields import (canonical_seniority, detect_domain, parse_tech_stack, safe_number,
                                        salary_display, taxonomy_tags)


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "v string").select(fn("v")).first()[0]


@pytest.mark.parametrize("raw, want", [
    ("Mid-Senior level", "Senior"), ("Entry level", "Junior"), ("Director", "Director"), ("Internship", "Intern"),
    ("Not Applicable", None), ("", None), (None, None), (" Senior ", "Senior"), ("Staff", "Staff")])
def test_seniority(spark, raw, want):
    assert one(spark, canonical_seniority, raw) == want


@pytest.mark.parametrize("keywords, want", [
    ("gtm engineer", "gtm"), ("account executive", "sales"), ("bioinformatics scientist", "biotech"),
    ("machine learning engineer", "data"), ("civil engineer", "any"), ("Clinical GTM", "gtm")])
def test_domain(spark, keywords, want):
    assert one(spark, detect_domain, keywords) == want


@pytest.mark.parametrize("text, want", [
    ("7d", None), ("7f", None), ("USD 90000", None), ("1,000", None), ("", None), (None, None), (" 7 ", 7.0),
    ("9e4", 90000.0), ("-1.5", -1.5), (".5", 0.5), ("5.", 5.0), ("NaN", None), ("Infinity", None), ("1e", None)])
def test_safe_number(spark, text, want):
    assert one(spark, safe_number, text) == want


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=20))
def test_safe_number_reads_all_floats(spark, values):
    rows = spark.createDataFrame([(i, repr(v)) for i, v in enumerate(values)], "i int, v string")
    assert [r[0] for r in rows.orderBy("i").select(safe_number("v")).collect()] == values


def test_salary_display(spark):
    rows = spark.createDataFrame(
        [("EUR", "1000", "2000", ""), ("", "90000", None, None), (None, "0", "5", ""), ("USD", "1234567.5", "0", " "),
         ("USD", "1", "2", "by arrangement")], "c string, lo string, hi string, s string")
    assert [r[0] for r in rows.select(salary_display("c", "lo", "hi", "s")).collect()] == [
        "EUR 1,000 - 2,000", "USD 90,000+", None, "USD 1,234,567.5+", "by arrangement"]


def test_tech_stack_and_taxonomy(spark):
    assert one(spark, parse_tech_stack, "['Python', 'SQL']") == ["Python", "SQL"]
    assert one(spark, parse_tech_stack, '["a"]') == ["a"]
    assert one(spark, taxonomy_tags, "Senior Applied AI Engineer") == ["fde", "presales"]
    assert one(spark, taxonomy_tags, "Welder") == []
