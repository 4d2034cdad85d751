"""The stages of the pipeline, each against a plain version of it on its own input."""

import pytest

import corpus_pipeline
from shortlist.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        rows = [r.asDict() for r in after.collect()]
        out.append((({r.doc_id: r.text for r in docs.collect()}), rows, after.columns))
        docs = after.cache()
    return out


def test_names_and_columns(stages, spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "personal_data", "packing"]
    names = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(columns == names for _, _, columns in stages[:-1])


def test_language(stages):
    before, rows, _ = stages[0]
    assert {r["doc_id"] for r in rows} == {d for d, t in before.items() if any(c.isalpha() for c in t or "")}
    assert all(r["text"] == before[r["doc_id"]] for r in rows)


def test_lines(stages):
    before, rows, _ = stages[1]
    plain = brute.deduped_lines(before)
    assert {r["doc_id"]: r["text"] for r in rows} == {d: t for d, (n, gone, t) in plain.items() if gone < n or not n}
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_near(stages):
    before, rows, _ = stages[2]
    sets = {}
    for d, t in before.items():
        words = brute.word_list((t or "").lower())
        sets[d] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {r["doc_id"] for r in rows} == {d for d, c in brute.groups(ids, links).items() if c == d}


def test_personal_data(stages):
    before, rows, _ = stages[3]
    assert {r["doc_id"] for r in rows} == set(before)
    for r in rows:
        found = brute.base_identifiers(before[r["doc_id"]])
        assert not any(brute.base_identifiers(r["text"]).values())
        if not any(found.values()):
            assert r["text"] == before[r["doc_id"]]


def test_packing(stages):
    from tokenizers import Tokenizer

    from shortlist.llm.queries import bpe_files

    before, rows, _ = stages[4]
    tokenizer = Tokenizer.from_file(bpe_files()["tokenizer_file"])
    brute.check_pieces(rows, {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for d, t in before.items()})


def test_null_and_shared_ids(spark):
    """Rows without an id go through all stages; rows that share an id have the language of their own text."""
    rows = [(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate([
        ("the house stands by the river and the people of the town walk there", "en"),
        ("das Haus steht am Fluss und die Leute der Stadt gehen dort spazieren", "de")] * 3)]
    english, german = "where the river and the town people walk", "wo die Leute der Stadt und des Flusses gehen"
    others = ["my sister bought seven apples at this market before noon", "heute regnet es und wir bleiben lieber im warmen Zimmer"]
    rows += [(90, english, None, "s", 9), (90, german, None, "s", 9), *[(None, t, None, "s", 9) for t in others]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    told = corpus_pipeline.language_id(spark, docs, SF).collect()
    assert len(told) == len(rows) and all(r.lang == {english: "en", german: "de"}[r.text] for r in told if r.doc_id == 90)
    near = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted(r.text for r in near if r.doc_id is None) == sorted(others)
    packed = docs
    for _, stage in corpus_pipeline.STAGES:
        packed = stage(spark, packed, SF)
    assert packed.filter("doc_id IS NULL").count() >= 2


def test_repeated_rows_stay_once(spark):
    rows = [(1, "one two three four five six seven", "en", "s", 33)] * 3 + [(2, "a text of its own that is not like the first", "en", "s", 44)]
    docs = spark.createDataFrame([*rows, (1, "other words under the same id as before", "en", "s", 39)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_dedup(spark, docs, SF)
    assert sorted(map(tuple, out.collect())) == sorted({tuple(r) for r in docs.collect()}) and out.columns == docs.columns


def test_texts_that_share_an_id_are_judged_apart(spark):
    """Of (1, a), (5, a), (5, b) the copy under 5 goes and the other text under 5 stays; ids that stand alone too."""
    a, b = "one two three four five six seven eight", "a text of its own that is not like the first"
    rows = [(1, a), (5, a), (5, b), (5, b), (7, a + " "), (8, "x"), (9, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    assert sorted(out, key=str) == sorted([(1, a), (5, b), (8, "x"), (9, None), (9, "")], key=str)
    other = spark.createDataFrame([(3, a, "en", "s", 1), (3, b, "en", "s", 1), (4, a, "en", "s", 1)], docs.schema)
    assert sorted(r.text for r in corpus_pipeline.near_dedup(spark, other, SF).collect()) == sorted([a, b])


def test_run_and_sql(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert set(ORACLE_SQL) <= set(QUERIES) and [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 14)]


def test_sql_of_search(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    sql = sorted(con.sql(ORACLE_SQL["op10_exact_topk"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["op10_exact_topk"](spark, SF).select("query_id", "id", "distance", "rank").collect()) == sql
