"""Each operator against a plain version, on whole small tables."""

import hashlib
import time
import zlib

import pytest

from shortlist.llm.components import components
from shortlist.llm.fuzzy_lines import dedup_lines
from shortlist.llm.hamming import nearest_codes
from shortlist.llm.identifiers import find_identifiers, redact
from shortlist.llm.labelled_pages import labelled_pages
from shortlist.llm.main_text import TRAINING_PAGES, extract, forest_of, labels_of, marginals, train
from shortlist.llm.near_copies import near_components
from shortlist.llm.page_tree import parse
from shortlist.llm.pieces import transducer
from shortlist.llm.quality import quality_rules
from shortlist.llm.queries import QUERIES, bpe_files
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe_files()["tokenizer_file"])
    brute.check_pieces(result(spark, "op1_packing"), {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()})


def test_special_token_in_text(spark):
    from tokenizers import Tokenizer

    from shortlist.llm.packing import byte_bpe

    files = bpe_files()
    tokenizer = Tokenizer.from_file(files["tokenizer_file"])
    for text in ("a <|endoftext|> b", "x  y\n z", " lead", "trail ", "don't  we'll\x1c go 12 34", "a  b"):
        for ranks in (files["ranks_file"], None):
            ids = byte_bpe(files["tokenizer_file"], ranks, files["pattern"])([text])[0]
            assert ids == b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids)


def test_language(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = result(spark, "op2_language_id")
    held = [r for r in out if r["held_out"]]
    assert len(out) == len(truth) and all(r["held_out"] == brute.held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in out)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_scores(spark, texts):
    """Predictions and scores of every document, and of texts between languages, by a plain naive Bayes."""
    from shortlist.llm.language import BUCKETS, predict_language, train_language

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    learned = [(r.lang, r.text) for r in rows if not brute.held_out(r.doc_id)]
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in result(spark, "op2_language_id")}
    want = dict(zip(texts, brute.naive_bayes(learned, list(texts.values()), BUCKETS), strict=True))
    assert all(out[d][0] == lang and abs(out[d][1] - score) < 1e-4 for d, (lang, score) in want.items())
    odd = [None, "", "12 34", "a", "Das the de", "la die", "\u0130stanbul \u00df", "x" * 5000]
    model = train_language(spark.createDataFrame(learned, "lang string, text string"))
    some = predict_language(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model)
    got = {r.doc_id: (r.lang_pred, r.score) for r in some.collect()}
    for i, (lang, score) in enumerate(brute.naive_bayes(learned, odd, BUCKETS)):
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-4


def test_lines(spark, texts):
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in result(spark, "op3_line_dedup")} == brute.deduped_lines(texts)


def test_lines_link_through_a_third(spark):
    line = "the quick brown fox jumps over the lazy dog and then walks slowly back to its den in the old forest by the river " * 2
    docs = [(1, line + "aaaa"), (2, "zz" + line), (3, "zz" + line[:-9] + "\nsomething else that is not like the others"), (4, "aaaa")]
    out = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {d: t[2] for d, t in brute.deduped_lines(dict(docs)).items()}


def test_identifiers(spark, texts):
    for r in result(spark, "op4_pii"):
        base = brute.base_identifiers(texts[r["doc_id"]])
        told = ",".join(f"{k}:{a}:{b}" for k, v in base.items() for a, b in v)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest() and r["spans"].startswith(told)
        assert [r[f"n_{k}"] for k in base] == [len(v) for v in base.values()]


@pytest.mark.parametrize("text", [
    "a@b.c_d@e.f", "x@y", "@a.b", "a..b@c-.d..e", "1.2.3.4.5", "1.2.3.4.5.6.7.8", "01.002.3.0004", "256.1.1.1", "1.2.3", "4111-1111 1111-1111",
    "4111  1111 1111 1111", "41111111111111112", "5 4111111111111111", "+1--2", "+12345678", "+1 (2) 3456789.", "++49 30 1234567", "é+49 30 1234567é",
    "+1234567890123456", "9" * 5000, "1 " * 5000, "a" * 50_000, "." * 3000 + "@x.y", "😀a@b.co😀1.1.1.1",
])
def test_identifier_patterns(spark, text):
    r = find_identifiers(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert {k: [tuple(s) for s in r[k]] for k in ("email", "ip", "card", "phone")} == brute.base_identifiers(text)


def test_identifiers_are_learned(spark):
    rows = [(i, f"please write to the account holder {4000000000000002 + 0 * i} now") for i in range(3)]
    rows = [(i, f"filler words customer number {n} more filler") for i, n in enumerate(luhn_numbers(40))]
    rows += [(100, "filler words customer number 1234567812345678 more"), (101, "in the year 20240101 nothing"), (102, "nothing at all")]
    out = {r.doc_id: r.id for r in find_identifiers(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in out[100]] == [(29, 45)] and all(not v for k, v in out.items() if k != 100)


def found_ids(spark, texts):
    out = find_identifiers(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.id] for r in out}


def test_contexts_reach_other_shapes(spark):
    """What follows a context of seeds is found, whatever its shape and words; what follows a common word is not.

    A quote belongs to the context: `member "` is another one than `member `, and has no seeds here.
    """
    texts = [f"write to member x{i}@mail.example please" for i in range(60)]
    texts += ["write to member 0706 555 3138 please", 'write to member "smith" please', "write to the 12 members", "the 7 days", "the day"]
    texts += [f"the x{i}@other.example" for i in range(6)] + ["the day the night the week"] * 20 + ["the 99999999"]
    out = found_ids(spark, texts)
    assert out.pop(60) == ["0706 555 3138"]
    assert not any(out.values())


def test_contexts_found_in_one_round_serve_in_the_next(spark):
    """Values found behind one context are the seeds of another, to the right of them."""
    texts = [f"zeilen card holder a{i}@m.example ende" for i in range(60)] + [f"zeilen card holder user-{i}-name wird geprobt" for i in range(6)]
    texts += ["etwas user-77-x wird geprobt", "nichts 88 sonst"]
    out = found_ids(spark, texts)
    assert all(out[60 + i] == [f"user-{i}-name"] for i in range(6)) and out[67] == []


def test_secrets_behind_a_key(spark):
    secrets = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(12)]
    texts = [f'some words token = "{s}" and more' for s in secrets] + ['some token = "sw0rdf1sh" here', "a token of love", f"commit {secrets[0]}"]
    out = found_ids(spark, texts)
    assert all(out[i] == [s] for i, s in enumerate(secrets)) and out[12] == ["sw0rdf1sh"] and out[13] == out[14] == []


def test_many_matches_in_a_text(spark):
    """The work grows with the text: 100,000 spans and their marks in well under a minute of one task."""
    text = "é😀 a@b.co +1 (706) 555-3138 x 10.0.0.1 y " * 33_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    started = time.time()
    found = find_identifiers(docs).first()
    assert [len(found[k]) for k in ("email", "phone", "ip")] == [33_000] * 3
    assert [tuple(s) for s in found["ip"]] == brute.base_identifiers(text)["ip"]
    assert redact(docs).first().text == "é😀 <EMAIL> <PHONE> x <IP> y " * 33_000 and time.time() - started < 150


def luhn_numbers(n):
    made = []
    for i in range(n):
        head = f"4{i:014d}"
        made.append(next(head + c for c in "0123456789" if brute.base_identifiers(head + c)["card"]))
    return made


def test_near_copies(spark, texts):
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in result(spark, "op5_minhash_near_dedup")}
    assert out == brute.near_components(texts)


def test_near_copies_of_a_family(spark):
    import random

    rng = random.Random(3)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    docs = {500: " ".join(words)}
    for i in range(120):  # each near the base, most not near each other
        own = list(words)
        for p in rng.sample(range(150), 3):
            own[p] = f"x{i}_{p}"
        docs[i] = " ".join(own)
    for i in range(60):  # one passage in different texts
        docs[1000 + i] = " ".join(words[:40] + [f"y{i}_{k}" for k in range(rng.randint(5, 200))])
    out = near_components(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), size=3, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute.near_components(docs)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_copies_sketch_miss_rate(percent):
    from math import comb

    from shortlist.llm.near_copies import RETAINED, least_shared

    least, p = round(least_shared(percent, RETAINED) * RETAINED), percent / 100
    assert 0.4 * RETAINED < least and 2 * sum(comb(RETAINED, c) * p ** c * (1 - p) ** (RETAINED - c) for c in range(least)) < 1e-6


def test_components(spark):
    import random

    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(200)] + [(7, 7), (None, 3), (500, 900)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    clean = [(a, b) for a, b in edges if a is not None and a != b]
    assert out == brute.groups({x for e in clean for x in e}, clean)


def test_pieces(spark, texts):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library, machine = sentencepiece.SentencePieceProcessor(model_file=model), transducer(model)
    for text in [*texts.values(), "  a  b\n\tc　é ﬁ 中文字 😀 ▁x", "a" * 300, "<s> </s> <unk> <0x41>", " ", "\x00\x01"]:
        ids = machine.encode(text).tolist()
        assert ids == library.encode(text) and machine.decode(ids) == library.decode(ids)
    out = result(spark, "op6_sentencepiece")
    assert all(r["decoded_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["n_ids"] == len(r["ids"]) for r in out)


def test_unigram_paths():
    """In a unigram model the path of the smallest cost is taken: all segmentations of short texts are compared."""
    from shortlist.llm.pieces import INFINITE, PieceTransducer

    machine = PieceTransducer.__new__(PieceTransducer)
    pieces = {"a": -3.0, "b": -2.0, "ab": -4.5, "ba": -4.2, "aba": -6.9, "bb": -5.0}
    machine.merges, machine.ids, machine.scores = False, {p: i for i, p in enumerate(pieces)}, list(pieces.values())
    machine.trie, machine.bytes = {}, {ord("c"): 99}
    for p, i in machine.ids.items():
        node = machine.trie
        for c in p:
            node = node.setdefault(c, {})
        node[None] = i

    def best(text):
        if not text:
            return 0.0
        return min([-pieces[text[:n]] + best(text[n:]) for n in range(1, 4) if text[:n] in pieces], default=INFINITE)

    for text in ("a", "abab", "bbaba", "ababbab", "bbbb"):
        assert abs(-sum(machine.scores[i] for i in machine.shortest_path(text)) - best(text)) < 1e-9
    assert 99 in machine.shortest_path("acb")


def test_pages_held_out():
    model = train(labelled_pages(TRAINING_PAGES))
    pages = [parse(p) for p in labelled_pages(200, seed=11)]
    forest, truth = forest_of(pages), [labels_of(p) for p in pages]
    main, _ = marginals(forest, model.own(pages, forest, {}), model.pairs)
    right = sum(((main[a:a + len(y)] >= 0.5) == y).sum() for a, y in zip([0, *__import__("itertools").accumulate(map(len, truth))], truth, strict=False))
    assert right >= 0.95 * len(main)
    para = "<p>A paragraph of the article, which goes on for a while, so that it can be told from other parts of a page.</p>"
    page = (f"<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><header><nav><a href=/>Home</a></nav></header>"
            f"<div class='cookie-notice'><p>We use cookies.</p></div><article><h1>Title &amp;  more</h1>{para}<div class=ad>Buy it now</div>{para}</article>"
            f"<section class=comments><div class=comment><p>I liked this very much, thank you.</p></div></section><footer>&copy; us</footer></body></html>")
    body = para[3:-4]
    assert extract(model, [page], {}) == [f"Title & more\n\n{body}\n\n{body}"]


@pytest.mark.parametrize("tag", ["button", "object", "select", "svg", "video", "noscript", "iframe", "canvas"])
def test_elements_without_end_tag_lose_no_article(tag):
    def told(page):
        return [t for _, t, _ in parse(page).blocks]

    article = "<article><p>first part</p><p>second part</p></article>"
    for page in (f"<body><{tag}>menu{article}</body>", f"<body><header><{tag}>menu</header>{article}", f"<body><p>x <{tag}>menu</p>{article}"):
        assert [t for t in told(page) if t != "x"] == ["first part", "second part"]
    nested = f"<div>a <{tag}>b<div>c</div><{tag}>d</{tag}>e</{tag}> f</div>{article}"
    page = parse(nested)
    assert told(nested) == ["a f", "first part", "second part"] and page.tags == ["#page", "div", "article", "p", "p"]
    assert told("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["so x=2 holds"]
    assert told(f"<body><script>var a = 1; {article}") == []


def test_marginals_are_exact():
    """Messages give the marginals that adding up all labellings gives."""
    import itertools

    import numpy as np

    page = parse("<div><p>a</p><div class=x><p>b</p><p>c</p></div></div>")
    forest, rng = forest_of([page]), np.random.default_rng(0)
    own, pairs = rng.normal(size=(len(page.tags), 2)), rng.normal(size=(4, 2, 2))
    total, on = 0.0, np.zeros(len(page.tags))
    for labels in itertools.product((0, 1), repeat=len(page.tags)):
        weight = np.exp(sum(own[i, y] for i, y in enumerate(labels)) + sum(
            pairs[forest.kinds[i], labels[p], labels[i]] for i, p in enumerate(page.parents) if p >= 0))
        total += weight
        on += weight * np.array(labels)
    assert np.allclose(marginals(forest, own, pairs)[0], on / total)


def test_passages(spark, texts):
    out = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in result(spark, "op8_substring_dedup")}
    assert out == {d: (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
                   for d, (w, gone) in brute.repeated_windows(texts).items()}


def test_quality(spark, texts):
    out = {r["doc_id"]: r for r in result(spark, "op9_quality_rules")}
    for d, t in texts.items():
        assert {k: out[d][k] for k in brute.quality(t)} == brute.quality(t)
        assert not (out[d]["base_failed"] and out[d]["kept"])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1 and not out[d]["base_failed"]]
    assert sum(out[d]["kept"] for d in good) >= 0.97 * len(good)


@pytest.mark.parametrize("size, skew", [("sf0.001", "lang"), ("sf0.01", "lang"), ("sf0.01", "source")])
def test_quality_of_withheld_documents(spark, size, skew):
    """Clean documents that were not learned from stay, also of a language or source with few or no labels."""
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"/root/testdata/{size}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    if skew == "source":  # a third of the rows, with words of its own, and no label
        docs = spark.createDataFrame([(d, " ".join(f"{w}q" for w in r.text.split()) if d % 3 == 0 else r.text, r.lang, "hot" if d % 3 == 0 else r.source)
                                      for d, r in rows.items()], "doc_id long, text string, lang string, source string")
    few = {d for d, r in rows.items() if (r.lang != "en" and zlib.crc32(str(d).encode()) % 5) or zlib.crc32(f"h{d}".encode()) % 3 == 0} if skew == "lang" else {
        d for d in rows if d % 3 == 0}
    known = spark.createDataFrame([(d, q) for d, q in labels.items() if d not in few], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_rules(docs, known).collect()}
    clean = [d for d in few if labels.get(d) == 1 and not out[d].base_failed]
    assert len(clean) >= 20 and sum(out[d].kept for d in clean) >= 0.97 * len(clean)
    assert sum(out[d].kept for d, q in labels.items() if q == 0) <= 0.35 * sum(q == 0 for q in labels.values())


def test_nearest_codes(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 40))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    out = {}
    for r in nearest_codes(df, df.filter("vec_id % 50 = 0"), k=7).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.distance, r.id))
    bits = vectors > 0
    for q in range(0, 300, 50):
        assert out[q] == sorted((int((bits[q] != b).sum()), i) for i, b in enumerate(bits))[:7]
