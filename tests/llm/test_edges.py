"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for each operator."""

import numpy as np
import pytest

from shortlist.llm.common import unused
from shortlist.llm.fuzzy_lines import dedup_lines
from shortlist.llm.hamming import nearest_codes
from shortlist.llm.identifiers import find_identifiers, redact
from shortlist.llm.language import predict_language, train_language
from shortlist.llm.main_text import main_text, train
from shortlist.llm.labelled_pages import labelled_pages
from shortlist.llm.near_copies import near_components
from shortlist.llm.packing import pack_tokens
from shortlist.llm.passages import drop_repeated_passages
from shortlist.llm.pieces import decode_pieces, encode_pieces
from shortlist.llm.quality import quality_rules
from shortlist.llm.queries import bpe_files

COPY = "one two three four five six seven eight nine ten " * 7
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
ROWS = [(1, COPY), (2, COPY), (2, COPY), (None, COPY), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, "two words"), (8, "é😀ß"), (9, "1234 5678")]
#: Names that the operators use inside.
CLASHES = "node v digest start spans _key _text_key _gone n_lines line component class bucket n known trusted a b sketch value"


@pytest.fixture(scope="module")
def docs(spark):
    extra = CLASHES.split()
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in extra)
    return spark.createDataFrame([(*r, None if i % 3 == 2 else "en", *["x"] * len(extra)) for i, r in enumerate(ROWS)], schema).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_packing(docs, none):
    packed = pack_tokens(docs, **bpe_files()).collect()
    whole = {}
    for r in packed:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    assert whole[3] == whole[4] == 1 and whole[1] * 2 == whole[2] and whole[None] == whole[1]
    assert pack_tokens(none, **bpe_files()).count() == 0
    with pytest.raises(ValueError):
        pack_tokens(docs, **bpe_files(), tiers=(100,))


def test_language(docs, none):
    found = {r.doc_id: r for r in predict_language(docs, train_language(docs)).collect()}
    assert {found[i].lang_pred for i in (3, 4, 5, 9)} == {"und"} and found[3].score == 0
    assert {found[i].lang_pred for i in (1, 2, None, 6, 7, 8)} == {"en"} and found[6].score == 1
    assert predict_language(docs, train_language(none)).filter("lang_pred = 'und'").count() == len(ROWS)
    assert predict_language(none, train_language(docs)).count() == 0


def test_lines(docs, none):
    out = {(r.doc_id, r.text): r for r in dedup_lines(docs).collect()}
    names = unused(docs.columns, "n_lines", "n_removed")
    assert names == ["_n_lines", "n_removed"]
    assert out[(1, COPY)].n_removed == 0 and out[(2, "")].n_removed == 1 and out[(None, "")].n_removed == 1
    assert out[(3, None)]["_n_lines"] == 0 and out[(5, " \n\t ")]["_n_lines"] == 0 and out[(6, LONG)].n_removed == 0
    assert all(r.n_lines == "x" and r["_gone"] == "x" for r in out.values())
    assert len(dedup_lines(docs).collect()) == len(ROWS) and dedup_lines(none).count() == 0


def test_identifiers(spark, docs, none):
    assert rows(find_identifiers(docs).filter("size(card) + size(email) + size(ip) + size(phone) + size(id) > 0"), "doc_id") == []
    assert find_identifiers(none).count() == 0 and redact(none).columns == docs.columns
    text = "mail a.b@c.de, or +1 (706) 555-3138 and 4111 1111 1111 1111."
    some = spark.createDataFrame([(1, text, "k"), (None, None, "k"), (2, "é😀 10.0.0.1 end 300.1.1.1", "k"), (1, "x@y.z", "k")],
                                 "doc_id long, text string, _spans string")
    assert rows(redact(some), "doc_id", "text", "_spans") == sorted(
        [(1, "mail <EMAIL>, or <PHONE> and <CARD>.", "k"), (None, None, "k"), (2, "é😀 <IP> end 300.1.1.1", "k"), (1, "<EMAIL>", "k")], key=str)


def test_near_copies(docs, none):
    out = rows(near_components(docs), "doc_id", "component_id", "kept")
    assert out.count((2, 1, False)) == 2 and (1, 1, True) in out and (None, None, True) in out
    assert all((i, i, True) in out for i in (3, 4, 5, 6, 7, 8, 9)) and len(out) == len(ROWS)
    assert near_components(none).count() == 0


def test_pieces(docs, none):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    back = rows(decode_pieces(encode_pieces(docs, model), model), "doc_id", "decoded")
    assert back == sorted([(i, t or "") for i, t in ROWS], key=str)
    assert decode_pieces(encode_pieces(none, model), model).count() == 0
    with pytest.raises(ValueError):
        decode_pieces(encode_pieces(docs, model), model, out_column="ids")


def test_pages(spark):
    model = train(labelled_pages(40), steps=40)
    deep = "<div>" * 3000 + "<p>text"
    pages = spark.createDataFrame(
        [(1, None, None, "k"), (None, "u", "", "k"), (2, "u", "<script>x</script>", "k"), (3, "u", "<" * 50_000, "k"), (4, "u", deep, "k"),
         (5, "u", "<article><p>a &amp;\n b</article>", "k"), (5, "u", "<article><p>a &amp;\n b</article>", "k")],
        "page_id long, url string, html string, text string")
    out = main_text(pages, model).collect()
    assert len(out) == 7 and all(r.text == "" for r in out if r.page_id in (1, 2, None)) and all(r.n_chars == len(r.text) for r in out)
    assert len({r.text for r in out if r.page_id == 5}) == 1
    assert main_text(pages.limit(0), model).count() == 0


def test_passages(docs, none):
    out = rows(drop_repeated_passages(docs), "doc_id", "n_words", "n_removed")
    assert out.count((2, 70, 70)) == 2 and (1, 70, 0) in out and (None, 70, 0) in out and (3, 0, 0) in out and (6, 60_000, 0) in out
    assert drop_repeated_passages(none).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, "k"), (None, 1, "k"), (6, None, "k"), (1, 1, "k")], "doc_id long, quality int, trusted string")
    out = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    assert out[3].n_words == 0 and out[3].base_failed and not out[4].kept and out[1].n_words == 70 and out[1].base_failed
    assert all(r.ratio == 0 for r in quality_rules(docs, labels.limit(0)).collect())
    assert quality_rules(none, labels).count() == 0


def test_hamming(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=20)], 0) for i in range(30)]
    vectors += [(100, vectors[0][1], 0), (100, vectors[0][1], 0), (101, None, 0), (None, vectors[1][1], 0), (102, [], 0), (103, [None] * 20, 0)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, id int")
    out = nearest_codes(df, df.filter("vec_id in (0, 101)"), k=3).orderBy("rank").collect()
    assert [(r.query_id, r.id, r.distance) for r in out][:2] == [(0, 0, 0), (0, 100, 0)] and len(out) == 3
    assert nearest_codes(df, df.filter("vec_id = 0"), k=50).count() == 31
    assert nearest_codes(df.limit(0), df.limit(0)).count() == 0


def test_hamming_repeated_ids(spark):
    """More copies of an id than k in one batch take no other id's place, and an id with several codes counts once."""
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=32)]) for i in range(40)]
    rows = [v for v in vectors for _ in range(2)] + [vectors[3]] * 60
    rows += [(3, [x if j != p else -x for j, x in enumerate(vectors[0][1])]) for p in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([vectors[i] for i in (0, 3, 7)], df.schema)
    bits = {}
    for i, v in rows:
        bits.setdefault(i, []).append(np.array(v) > 0)
    out = {}
    for r in nearest_codes(df, asked, k=5).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.distance, r.id))
    for q in (0, 3, 7):
        own = np.array(vectors[q][1]) > 0
        assert out[q] == sorted((min(int((own != b).sum()) for b in codes), i) for i, codes in bits.items())[:5]


def test_hamming_vectors_of_different_lengths(spark):
    draw = np.random.default_rng(8)
    rows = [(i, [float(x) for x in draw.normal(size=(20, 16, 40, 64)[i % 4])]) for i in range(120)] + [(500, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in nearest_codes(df, df.filter("vec_id < 8"), k=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.distance, r.id))
    signs = {i: [x > 0 for x in v] for i, v in rows}
    for q in range(8):
        same = sorted((sum(a != b for a, b in zip(signs[q], s)), i) for i, s in signs.items() if len(s) == len(signs[q]))
        assert got[q] == same[:4]
