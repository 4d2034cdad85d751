"""Spelling variants, ranked lexical search and URL filters against plain versions, on random and on awkward rows."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shortlist.llm.lexical import fp_tree, item_groups, known_terms, lexical_search, scores, term_spans, vocabulary
from shortlist.llm.queries import QUERIES
from shortlist.llm.spelling import boundary_paths, number_part, spelling_variants
from shortlist.llm.url_filter import cascade, holds, judge_urls, junk_hosts, key_hash, members, with_members
from tests.llm import brute

EXTRA = "p s key kind n best nodes id fresh form_id _keys _hosts h codes tfs item rank score part word host path rule verdict".split()


def docs_of(spark, rows):
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], schema).repartition(3)


def texts(seed, n, letters="abcà", length=(3, 8), words=60):
    draw = random.Random(seed)
    known = ["".join(draw.choice(letters) for _ in range(draw.randint(*length))) for _ in range(150)]
    return [(i, " ".join(draw.choice(known).title() if draw.random() < .2 else draw.choice(known) for _ in range(words))) for i in range(n)]


AWKWARD = [(None, "aaaaa aaaab aaaab aaaab"), (7, None), (8, ""), (9, " \n"), (9, "aaaaa aaaa aaaa aaaaaa"), (9, "aaaaa aaaa aaaa aaaaaa"),
           (10, "aaaaaa 12 é😀é " * 40), (11, "x" * 3000 + " " + "x" * 3001), (12, "x" * 3000 + " " + "x" * 3001), (13, "x" * 3000 + " " + "x" * 3001)]


@pytest.mark.parametrize("part_words", [3, 50_000])
@pytest.mark.parametrize("rows", [texts(1, 40), texts(2, 60, "ab", (4, 9)), AWKWARD, texts(3, 20, "aÀÿz×") + AWKWARD])
def test_spelling_equals_comparing_all(spark, rows, part_words):
    found = spelling_variants(docs_of(spark, rows), part_words=part_words).collect()
    assert len(found) == len({r.word for r in found})
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found} == brute.spelling(rows)


def test_spelling_chains(spark):
    counts = {"abcde": 3, "abcdx": 6, "abcyx": 12, "abzyx": 24, "auzyx": 48, "wuzyx": 96, "wuzyxq": 192}
    rows = [(None, " ".join([w] * n)) for w, n in counts.items()]
    assert {r.word: r.root for r in spelling_variants(docs_of(spark, rows)).collect()} == dict.fromkeys(counts, "wuzyxq")
    assert spelling_variants(docs_of(spark, rows).limit(0)).collect() == []
    with pytest.raises(ValueError):
        spelling_variants(docs_of(spark, rows), ratio=1)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("ab", min_size=1, max_size=6), min_size=1, max_size=40), st.integers(1, 7))
def test_trie_numbers(words, size):
    words = sorted(words)
    parts = [words[i:i + size] for i in range(0, len(words), size)]
    paths = boundary_paths([p[0] for p in parts])
    seen = {}
    for i, part in enumerate(parts):
        more = i + 1 < len(parts)
        for word, nodes in zip(part, number_part(part, i, paths[i], parts[i - 1][-1] if i else None,
                                                 parts[i + 1][0] if more else None, paths[i + 1] if more else None)):
            shared = [p for p in range(len(word) + 1) if any(v != word and v.startswith(word[:p]) for v in words)]
            assert list(range(len(nodes))) == shared
            for p, node in enumerate(nodes):
                assert seen.setdefault(word[:p], node) == node
    assert len(set(seen.values())) == len(seen)


ITEMS = [(1, "alpha beta 12"), (2, None), (None, "alpha"), (3, ""), (4, "Alpha, GAMMA; é😀é"), (4, "delta"), (5, "nothing-known"), (6, "the the")]


def search(spark, docs, items, k):
    table = spark.createDataFrame([(*i, "x", "y") for i in items], "item_id long, text string, doc_id string, score string")
    return [(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical_search(docs_of(spark, docs), table, k).collect()]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_lexical_search_equals_scoring_all(spark, k):
    draw = random.Random(k)
    names = "alpha beta gamma delta 12 é😀é the other Words-of x_y".split()
    rows = [(d, " ".join(draw.choices(names, k=draw.randint(1, 30)))) for d in draw.sample(range(10_000), 400)]
    rows += [(None, "alpha beta"), (20_000, None), (20_001, ""), (20_002, "!? ..."), (20_003, "alpha " * 30_000)]
    found = search(spark, rows, ITEMS, k)
    assert len(found) == len(set(found)) and set(found) == brute.lexical(rows, ITEMS, k)


def test_lexical_ties_copies_and_empty(spark):
    rows = [(d, "alpha beta") for d in range(300, 0, -1)] + [(1000 + d, "gamma") for d in range(300)]
    found = search(spark, rows, ITEMS[:1], 50)
    assert sorted(found) == [(1, i + 1, i + 1, found[0][3]) for i in range(50)]
    copies = search(spark, [(5, "alpha")] * 3 + [(6, "beta x")] + [(7, "x")] * 9, ITEMS[:1], 50)
    assert sorted(c[1] for c in copies) == [1, 2, 3, 4] and [c[2] for c in copies].count(5) == 3
    assert search(spark, [], ITEMS, 5) == [] and search(spark, rows, [], 5) == []


def test_lexical_passes_and_trees_of_few_terms(spark, monkeypatch):
    from shortlist.llm import lexical

    rows = texts(5, 150, "abc", (1, 4), 40)
    items = [(i, t[:60]) for i, t in texts(6, 12, "abc", (1, 4), 40)]
    monkeypatch.setattr(lexical, "PASS_TERMS", 30)
    assert set(search(spark, rows, items, 4)) == brute.lexical(rows, items, 4)


def test_item_groups(monkeypatch):
    from shortlist.llm import lexical

    monkeypatch.setattr(lexical, "TREE_TERMS", 3)
    codes = [np.array(c) for c in ([0, 1], [1, 2], [5], [0, 1, 2, 3, 4], [], [4])]
    assert list(item_groups(codes)) == [[0, 1], [2], [3], [4, 5]]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 120), st.integers(1, 9), st.integers(0, 10**6))
def test_tree_bounds(n, width, seed):
    draw = np.random.default_rng(seed)
    table = (draw.integers(0, 4, (n, width)) * (draw.random((n, width)) < .5)).astype(np.int32)
    m, ids = draw.integers(50, 90, n), draw.permutation(n)
    tree = fp_tree(table, m, ids)
    weights = draw.integers(0, 50, width)
    bounds, exact = scores(tree.most, tree.least_m, weights), scores(table, m, weights)
    assert sorted(tree.order.tolist()) == list(range(n))
    leaves = sorted((lo, hi) for lo, hi, c in zip(tree.low.tolist(), tree.high.tolist(), tree.children) if not c)
    assert leaves[0][0] == 0 and leaves[-1][1] == n and all(a[1] == b[0] for a, b in zip(leaves, leaves[1:]))
    for node in range(len(tree.low)):
        rows = tree.order[tree.low[node]:tree.high[node]]
        assert len(rows) and bounds[node] >= exact[rows].max() and tree.least_id[node] == ids[rows].min()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB9é-_ 😀\x7f{[`@/", max_size=12), min_size=1, max_size=5))
def test_term_spans(rows):
    coded = [r.encode() for r in rows]
    data, offsets = np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)])
    starts, ends, bounds = term_spans(data, offsets)
    found = [[data[a:b].tobytes().decode() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(bounds, bounds[1:])]
    assert found == [brute.TERMS.findall(r) for r in rows]
    words = sorted({brute.low(t) for ts in found[:2] for t in ts})
    if words:
        at, codes = known_terms(vocabulary(words), data, starts, ends)
        flat = [brute.low(t) for ts in found for t in ts]
        assert sorted(zip(at.tolist(), (words[c] for c in codes))) == [(i, t) for i, t in enumerate(flat) if t in words]


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
         ("org", None, "allow"), ("a.org", "/e", "block"), ("a.org", "/e", "allow"), (None, "/", "block"), ("", "/", "block"), ("x.de", "/", "ask")]
URLS = ["http://www.example.com/en/x", "https://EXAMPLE.com/EN/x?/en/", "example.com/en/", None, "", "://", "a://b://net/es/", "http://net/es/", "http://x.net/es",
        "http://notnet/fr/", "http://x.NET/fr/?q#r", "http://com", "http://com?x/", "http://com#/", "https://b.a.org/e", "https://b.a.org/f", "http://spam.de/", "http://u.spam.de",
        "http://spam-it.de/ä😀", "http://myspam.de/", "http://x.de/", "http://.com/", "http://com./", "http://" + "a." * 2000 + "net/fr/", "http://ads." + "a." * 2000 + "be/"]


@pytest.mark.parametrize("most", [2, 100])
def test_urls_equal_plain_rules(spark, most):
    rows = [(i % 20 if i % 5 else None, u) for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], "page_id long, url string, " + ", ".join(f"{c} string" for c in EXTRA)).repartition(3)
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    hosts = junk_hosts(pages)
    names = {r.key for r in hosts.collect()}
    assert names == {"spam.de", "spam-it.de"}
    found = judge_urls(pages, rules, hosts, most=most)
    want = [(i, *brute.judged(u, RULES, names)) for i, u in rows]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert judge_urls(pages.limit(0), rules, hosts).collect() == []
    assert {(r.rule, r.verdict) for r in judge_urls(pages, rules.limit(0), hosts.limit(0)).collect()} == {(None, "allow")}


def test_cascade_is_exact(spark, monkeypatch):
    from shortlist.llm import url_filter

    monkeypatch.setattr(url_filter, "BITS", 2)       # many false positives, so many levels
    keys = spark.range(5_000).selectExpr("concat('host', id) AS key")
    listed = keys.filter("key LIKE '%7'").unionByName(spark.createDataFrame([("elsewhere",)], "key string"))
    levels = cascade(listed.unionByName(listed), keys.unionByName(keys))
    assert len(levels) >= 4
    hashed = keys.unionByName(listed).select("key", *[key_hash(keys["key"], i).alias(f"h{i}") for i in range(len(levels))]).toPandas()
    hashes = hashed.iloc[:, 1:].to_numpy()
    assert (members(levels, hashes) == (hashed["key"].str.endswith("7") | (hashed["key"] == "elsewhere"))).all()
    wrong = holds(levels[0], hashes[:, 0]) & ~hashed["key"].str.endswith("7")
    assert wrong.sum() > 250 and cascade(listed.limit(0), keys) == []
    rows = keys.selectExpr("array(key, 'nothing') AS ks", "key")
    marked = with_members(rows, "ks", "flags", listed, keys.unionByName(spark.createDataFrame([("nothing",)], "key string")), most=300)
    assert marked.filter("flags[0] <> (key LIKE '%7') OR flags[1]").count() == 0 and marked.count() == 5_000


def test_registered(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {(r.item_id, r["rank"], r.doc_id, r.score) for r in QUERIES["op12_lexical_search"](spark, sf).collect()} == brute.lexical(docs, items[:400], 50)
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in QUERIES["op11_spelling_variants"](spark, sf).collect()} == brute.spelling(docs)
    verdicts = QUERIES["op13_url_filter"](spark, sf)
    assert verdicts.count() == spark.read.parquet(f"{sf}/pages.parquet").count() and verdicts.columns == ["page_id", "host", "path", "rule", "verdict"]
