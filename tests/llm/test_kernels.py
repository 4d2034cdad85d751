"""Helpers of the operators against plain versions, on rows made here."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from shortlist.llm import language, near_copies
from shortlist.llm.blocks import FEW_PAIRS, MATRIX_MEMBERS, joined, reaches
from shortlist.llm.fuzzy_lines import BANDS, BLOCK_BITS, ROW_KEYS, band_keys, line_sets, shared_keys
from shortlist.llm.pieces import PieceTransducer, decode_pieces, encode_pieces
from tests.llm import brute


class Untouched:
    """A set of which only the size may be asked."""

    def __init__(self, n):
        self.n = n

    def __len__(self):
        return self.n


def test_sizes_decide_before_elements():
    assert not reaches(Untouched(79), Untouched(100), 80)
    assert joined(np.array([1, 2, 3]), np.array([1, 2, 2]), [Untouched(79), Untouched(100), Untouched(0)], 80) == []
    x = np.arange(100, dtype=np.uint64)
    assert reaches(x, x[:80], 80) and reaches(x[:80], x, 80) and not reaches(x, x[:80], 81)


def plainly_joined(nodes, component, sets, percent):
    """Every pair, members outside the largest component first."""
    component, links = list(component), []
    values, counts = np.unique(component, return_counts=True)
    largest = values[counts.argmax()]
    for i in [k for k, c in enumerate(component) if c != largest]:
        near = []
        for j in range(len(sets)):
            both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            if both and component[i] != component[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                near.append(j)
        for j in near:
            if component[i] != component[j]:
                links.append((nodes[i], nodes[j]))
                old = component[j]
                component = [component[i] if c == old else c for c in component]
    return links


@pytest.mark.parametrize("members", [3, 2 * FEW_PAIRS + 4, MATRIX_MEMBERS, MATRIX_MEMBERS + 5])
def test_joined_as_all_pairs(members):
    rng = np.random.default_rng(members)
    base, linked = np.arange(60, dtype=np.uint64), 0
    for _ in range(20):
        sets = [np.unique(np.concatenate([base[rng.random(60) < 0.93], rng.integers(1000, 2000, rng.integers(0, 9)).astype(np.uint64)]))
                for _ in range(members)]
        sets[1] = sets[1][:0]
        component = rng.integers(0, max(2, members // 2), members)
        links = joined(np.arange(members), component.copy(), sets, 80)
        assert links == plainly_joined(np.arange(members), component, sets, 80)
        linked += len(links)
    assert linked


def test_line_sets_of_lines_of_any_length():
    lines = ["ab", "aaaaaaaaaaaa", " leading blank", "äöü" * 9, "12345678", "x\U0001f600" * 6, "ab"]
    sets = line_sets(pa.array(lines))
    assert [len(s) for s in sets] == [len({t[i:i + 8] for i in range(max(1, len(t) - 7))}) for t in lines]
    assert all((s[1:] > s[:-1]).all() for s in sets) and sets[0].tolist() == sets[-1].tolist()


def key_pairs(rows):
    return [p for r in rows for p in zip(np.frombuffer(r["keys"], np.int64).tolist(), np.frombuffer(r["nodes"], np.int64).tolist(), strict=True)]


def with_several_nodes(pairs):
    nodes = {}
    for v, node in pairs:
        nodes.setdefault(v, set()).add(node)
    return {(v, node) for v, several in nodes.items() if len(several) > 1 for node in several}


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_keys_travel_many_to_a_row(spark):
    texts = ["\n".join(f"line {i * j} of {i} documents, {'x' * (j % 9)}" for j in range(60)) for i in range(1, 40)] + [None, "", " \n"]
    lines = {x for t in texts if t for x in t.split("\n") if x.strip()}
    keys = band_keys(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1))
    rows = keys.collect()
    pairs = key_pairs(rows)
    assert len(pairs) == BANDS * len(lines) and len({node for _, node in pairs}) == len(lines)
    assert len(rows) <= (1 << BLOCK_BITS) + len(pairs) // ROW_KEYS < len(pairs) / 5
    assert all((np.frombuffer(r["keys"], np.uint64) >> np.uint64(64 - BLOCK_BITS) == r["block"]).all() and len(r["keys"]) <= 8 * ROW_KEYS for r in rows)
    found = [tuple(r) for r in shared_keys(keys).collect()]
    assert set(found) == with_several_nodes(pairs) and len(found) == len(set(found)) > 0


def test_shared_keys_over_many_batches(spark, small_batches):
    rng, rows = np.random.default_rng(3), []
    for block in (0, 1, 1, (1 << BLOCK_BITS) - 1) * 12:
        low = rng.integers(0, 40, rng.integers(1, 9)).astype(np.uint64)
        keys = (np.uint64(block) << np.uint64(64 - BLOCK_BITS)) + low
        rows.append((block, keys.tobytes(), rng.integers(-6, 6, len(low)).tobytes()))
    hot = np.full(4, 7, np.uint64).tobytes()        # one key of block 0 in every batch
    rows += [(0, hot, np.arange(4 * i, 4 * i + 4).tobytes()) for i in range(40)] + [(2, hot[:8], np.arange(1).tobytes())]
    found = {tuple(r) for r in shared_keys(spark.createDataFrame(rows, "block int, keys binary, nodes binary")).collect()}
    expected = with_several_nodes(key_pairs([{"keys": k, "nodes": n} for b, k, n in rows if b != 2]))
    assert found == expected and sum(v == 7 for v, _ in found) >= 160


TEXTS = ["", None, " ", "  a  b\n\tc\u3000\u4e2d\u6587 \U0001f600 \u2581x", "\u2581\u2581a \u2581 b\u2581", "the cat and the cat", "ends in a blank ", " the"]


def piece_model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_equal_parts_are_looked_up_once():
    machine, asked = PieceTransducer(piece_model()), []
    path = machine.path
    machine.path = lambda part: asked.append(part) or path(part)
    data = np.frombuffer(b" the cat the cat the cat", np.uint8)
    ids, bounds = machine.encode_texts(np.concatenate([data, data]), np.array([0, len(data), len(data), 2 * len(data)]))
    assert sorted(asked) == [b" cat", b" the"]
    one = machine.encode("the cat the cat the cat").tolist()
    assert ids.tolist() == one * 2 and bounds.tolist() == [0, len(one), len(one), 2 * len(one)]


def test_pieces_of_whole_batches(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 40)], "doc_id long, text string")
    rows = decode_pieces(encode_pieces(docs, piece_model()), piece_model()).collect()
    assert len(rows) == len(docs.collect())
    for r in rows:
        ids = library.encode(TEXTS[r.doc_id % len(TEXTS)] or "")
        assert r.ids == ids and r.n_ids == len(ids) and r.decoded == library.decode(ids)


def test_broken_bytes_and_null_ids():
    machine = PieceTransducer(piece_model())
    broken = [machine.bytes[0xF0], machine.bytes[0x9F], *machine.encode("the")]
    assert machine.decode(broken) == "\ufffd the" and machine.decode([]) == ""
    with pytest.raises(ValueError):
        machine.decode([None])


def grams_by_row(texts):
    out = [[] for _ in texts]
    for first, codes, bounds in language.gram_parts(pa.array(texts, pa.string()), language.BUCKETS):
        for i in range(len(bounds) - 1):
            out[first + i] += codes[bounds[i]:bounds[i + 1]].tolist()
    return [sorted(x) for x in out]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 13, 100_000])
def test_grams_of_texts_in_parts(size, monkeypatch):
    monkeypatch.setattr(language, "PART_BYTES", size)
    texts = ["abc", None, "  Ab  \n  12 c   d", "", "\u00e4\U0001f600\u00d6 \u4e2d\u6587\u4e2d   x", "         ", "a" * 30, "1 2 3", "\u0130x  ", "q",
             "one two\tthree   four five six " * 4]
    assert grams_by_row(texts) == [sorted(brute.language_grams(t or "", language.BUCKETS)) for t in texts]


@pytest.mark.parametrize("texts", [["many short texts " * 10] * 20_000, ["one long text " * 250_000]])
def test_grams_take_little_memory(texts):
    """However much text there is, and in texts of any length: 135 MB for each million bytes when these were taken together."""
    column = pa.array(texts, pa.string())
    language.letters_table()
    tracemalloc.start()
    try:
        assert sum(len(codes) for _, codes, _ in language.gram_parts(column, language.BUCKETS))
        assert tracemalloc.get_traced_memory()[1] < 20_000_000
    finally:
        tracemalloc.stop()


def test_shingles_take_little_memory():
    texts = [f"some words of text {i} and more of them again" for i in range(40_000)]
    column = pa.array(texts)
    tracemalloc.start()
    try:
        assert sum(len(sets) for _, sets in near_copies.shingle_sets(column, 3)) == len(texts)
        assert tracemalloc.get_traced_memory()[1] < 10_000_000
    finally:
        tracemalloc.stop()
