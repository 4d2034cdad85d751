import html
import random
import re

import pytest
from pyspark.sql import functions as F

from shortlist.functions.text import (best_text, collapse, decode_entities, gate_status, html_to_text, page_text,
                                      page_title, word_count)


def apply(spark, fn, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


@pytest.mark.parametrize("given, want", [
    (None, ""), ("", ""), ("plain  text\n here", "plain text here"),
    ("<p>Hello<b>big</b></p><p>world</p>", "Hello big world"),
    ("a &lt;b&gt; &amp;amp; c&nbsp;d", "a <b> &amp; c d"),
    ("<!-- hidden <p> --><p>seen</p>", "seen"),
    ("<script>if (a < b) { x = '</p>' }</script>after", "after"),
    ("before<script>never closed <p>x</p>", "before"),
    ("<style type='a'>p{}</style >kept", "kept"),
    ("<!-- <script> -->kept", "kept"), ("salary < 100 and > 50", "salary < 100 and > 50"),
    ("a  b\x0bc", "a b c"), ("<header>stays here</header>", "stays here"),
])
def test_html_to_text(spark, given, want):
    assert apply(spark, html_to_text, given) == [want]


def test_page_text_drops_furniture(spark):
    page = ("<html><head><title>T</title><style>x</style></head><body><nav><a>menu</a></nav><header><h1>Head</h1></header>"
            "<main><p>Body text</p></main><noscript>no</noscript><footer>foot</footer></body></html>")
    assert apply(spark, page_text, page) == ["T Body text"]
    assert apply(spark, page_title, page, "<title>A &amp; B</title>", "<p>none</p>", None) == ["Head", "A & B", "", ""]


def plain_page_text(page):
    """The same rules, one character after the other: a list of tags with their places, then pairs by a stack."""
    page = re.sub(r"(?is)<(?:!--.*?--|script(?:[\s/][^>]*)?>.*?(?:</script\s*|\Z)|style(?:[\s/][^>]*)?>.*?(?:</style\s*|\Z))(?:>|\Z)", " ", page)
    tags, at = [], 0
    while (at := page.find("<", at)) >= 0:
        end, quote = at + 1, ""
        while end < len(page) and (quote or page[end] != ">"):
            if quote:
                quote = "" if page[end] == quote else quote
            elif page[end] in "\"'" and page[at:end].rstrip().endswith("=") and page[end] in page[end + 1:]:
                quote = page[end]
            end += 1
        if end < len(page) and re.match("[a-zA-Z/!?]", page[at + 1:]) and end > at + 1:
            tags.append((at, end + 1, page[at + 1:end]))
            at = end + 1
        else:
            at += 1
    forward, backward = [], []
    for order, out in ((tags, forward), (tags[::-1], backward)):
        stack = []
        for _, _, inner in order:
            name = re.match(r"(/?)(noscript|header|footer|nav)(?=[\s/]|$)", inner, re.I)
            if name:
                word, ends = name[2].lower(), bool(name[1]) != (out is backward)
                if not ends:
                    stack.append(word)
                elif word in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(word):]
            out.append(bool(stack))
    backward = backward[::-1]
    pieces, last = [], 0
    for i, (start, end, _) in enumerate([*tags, (len(page), len(page), "")]):
        if not (i and forward[i - 1] and i < len(tags) and backward[i]):
            pieces.append(page[last:start])
        last = end
    return " ".join(html.unescape(" ".join(pieces)).split())


@pytest.mark.parametrize("page, want", [
    ("<nav><nav>a</nav>b</nav><p>c</p>", "c"), ('<p title="a>b">c</p>', "c"), ("<nav data-x='</nav>'>a</nav>b", "b"),
    ("<header><nav>a</nav>b<header>c</header>d</header>e", "e"), ("a</nav>b<nav>c", "a b c"), ("<nav><header>a</nav>b</header>c", "b c"),
    ("<p class=it's>one 'two' <b>three</b>", "one 'two' three"), ("<nav>" * 50 + "x" + "</nav>" * 50 + "y", "y"),
    ("<NAV class=a><Footer/>x</NAV >y", "y"), ("<nav>a</nav>" * 3000 + "z", "z")])
def test_nested_furniture_and_quoted_signs(spark, page, want):
    assert apply(spark, page_text, page) == [want] == [plain_page_text(page)]


def test_page_text_equals_reading_by_character(spark):
    draw = random.Random(11)
    bits = ["<nav>", "</nav>", "<header class='x>y'>", "</header>", "<footer id=\"</nav>\">", "</footer>", "<noscript>", "</noscript>", "<p title=a'b>", "</p>",
            "word ", "x", "<navy>", "<!-- <nav> -->", "&amp;", "<b data = \"1 > 0\">", " ", "< nav", ">"]
    pages = ["".join(draw.choice(bits) for _ in range(draw.randint(1, 14))) for _ in range(400)]
    bad = [(p, a, plain_page_text(p)) for p, a in zip(pages, apply(spark, page_text, *pages)) if a != plain_page_text(p)]
    assert not bad, bad[:3]


def test_given_pages_equal_reading_by_character(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html", page_text("html").alias("t")).collect()
    assert [r["t"] for r in rows] == [plain_page_text(r["html"]) for r in rows]


def test_similar_tag_names_stay(spark):
    assert apply(spark, page_text, "<navigator>a</navigator><headers>b</headers>") == ["a b"]


def test_entities_follow_the_standard_library(spark):
    texts = ["&eacute;&#233;&#xE9;", "&copy; &middot; &hellip;", "&#128512;", "&unknown; &", "AT&T", "&amp;lt;", "&#39;&quot;"]
    assert apply(spark, decode_entities, *texts) == [html.unescape(t) for t in texts]


def test_collapse_equals_unicode_rule(spark):
    texts = ["a \t\n b", "　x y", " lead", "z\x1c\x1fz"]
    assert apply(spark, collapse, *texts) == [re.sub(r"\s+", " ", t).strip() for t in texts]


def test_best_text_fallback(spark):
    long = "word " * 30
    rows = spark.createDataFrame(
        [("T", "C", long, "spare"), ("T", "C", "short", "spare <b>text</b>"), (None, None, None, None)],
        "title string, company string, description_text string, description string")
    assert [r[0] for r in rows.select(best_text()).collect()] == [
        "T at C. " + long.strip(), "T at C. spare text", "at ."]


def test_whole_long_text_is_kept(spark):
    text = "<p>" + "abc " * 200_000 + "end</p>"
    out = apply(spark, html_to_text, text)[0]
    assert out.endswith("end") and len(out) == 4 * 200_000 + 3


def test_word_count_and_gate(spark):
    assert apply(spark, word_count, "a b  c", "", None, " x ") == [3, 0, 0, 1]
    assert apply(spark, gate_status, "x" * 99, "x" * 100, "x" * 999, "x" * 1000) == ["error", "thin", "thin", "ok"]
