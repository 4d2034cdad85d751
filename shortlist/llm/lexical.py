"""Ranked lexical search by branch and bound over FP-trees of documents (operator 12)."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shortlist.llm.common import byte_chunks, byte_values, range_hashes, written

#: (item, term) pairs whose items are searched for in one pass over the texts; their terms are broadcast.
PASS_TERMS = 200_000
#: Terms of the items that share a tree, and cells (documents x terms) of a tree's table of counts.
TREE_TERMS, TREE_CELLS = 4096, 4_000_000
#: A node with at most so many documents is not split.
LEAF = 16
#: One in so many documents is ranked first, so that the others are measured against a threshold from the start.
FIRST_SHARE = 64
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VECTORS = "doc_id long, n long, codes array<int>, tfs array<int>"
FOUND = "item int, doc_id long, score long"


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): byte spans of all terms (digits, letters, all beyond ASCII) and where each row's terms begin in them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(256, bool)
    inside[48:58] = inside[65:91] = inside[97:123] = inside[128:] = True
    full = np.zeros(len(data) + 2, bool)
    full[1:-1] = inside[data]
    starts, ends = full[1:-1] & ~full[:-2], full[1:-1] & ~full[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    starts[edges] = inside[data[edges]]
    ends[edges - 1] = inside[data[edges - 1]]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


class Vocabulary(NamedTuple):
    """Terms in the order of their hashes, with their bytes one after another."""

    hashes: np.ndarray
    codes: np.ndarray
    offsets: np.ndarray
    data: np.ndarray


def vocabulary(terms: list[str]) -> Vocabulary:
    """Code i is terms[i]; terms are lower-cased already."""
    coded = [t.encode() for t in terms]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in coded])]).astype(np.int64)
    data = np.frombuffer(b"".join(coded), np.uint8)
    hashes = range_hashes(byte_values(True)[data], offsets[:-1], offsets[1:])
    order = np.argsort(hashes, kind="stable")
    return Vocabulary(hashes[order], order, offsets, data)


def known_terms(words: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, codes) of the spans that are terms of the vocabulary; hashes propose, the bytes decide."""
    hashes = range_hashes(byte_values(True)[data], starts, ends)
    low = np.zeros(1 << 16, bool)
    low[(words.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(low[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    first, last = np.searchsorted(words.hashes, hashes[at]), np.searchsorted(words.hashes, hashes[at], "right")
    found_at, found_codes = [], []
    while len(at):                                  # more than one round only for terms of equal hashes
        more = first < last
        at, first, last = at[more], first[more], last[more]
        if not len(at):
            break
        codes = words.codes[first]
        sizes = ends[at] - starts[at]
        fits = sizes == words.offsets[codes + 1] - words.offsets[codes]
        sure, of = at[fits], codes[fits]
        total = np.concatenate([[0], np.cumsum(sizes[fits])])
        if len(sure):
            step = np.arange(total[-1])
            here = data[np.repeat(starts[sure] - total[:-1], sizes[fits]) + step]
            here = np.where((here >= 65) & (here <= 90), here + 32, here)
            there = words.data[np.repeat(words.offsets[of] - total[:-1], sizes[fits]) + step]
            equal = np.logical_and.reduceat(here == there, total[:-1])
            found_at.append(sure[equal])
            found_codes.append(of[equal])
        first = first + 1
    if not found_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_at), np.concatenate(found_codes)


def restricted_vectors(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """doc_id, n, codes, tfs for every row: how many terms its whole text has, and how often each term of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        size = len(words.hashes)
        for batch in batches:
            for row, end, data, offsets in byte_chunks(batch.column(1)):
                starts, ends, bounds = term_spans(data, offsets)
                at, codes = known_terms(words, data, starts, ends)
                rows = np.searchsorted(bounds, at, "right") - 1
                cells, tfs = np.unique(rows * max(size, 1) + codes, return_counts=True)
                rows, codes = np.divmod(cells, max(size, 1))
                cuts = pa.array(np.searchsorted(rows, np.arange(end - row + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(cuts, pa.array(codes.astype(np.int32))),
                     pa.ListArray.from_arrays(cuts, pa.array(tfs.astype(np.int32)))], names=["doc_id", "n", "codes", "tfs"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, VECTORS)


class Tree(NamedTuple):
    """An FP-tree over sorted rows. Nodes come parents first; a node's documents are rows low[i]:high[i]."""

    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    children: list[list[int]]
    most: np.ndarray
    least_m: np.ndarray
    least_id: np.ndarray


def fp_tree(table: np.ndarray, m: np.ndarray, ids: np.ndarray) -> Tree:
    """The tree of rows of counts (documents x terms, most frequent term first).

    Rows are sorted so that those whose term lists begin alike stand together: a node is a run of rows that share a path. A path on
    which all rows go on alike is one node. Each node has, over its documents, the largest count of every term, the smallest m and the
    smallest id.
    """
    held = table > 0
    packed = np.ascontiguousarray(np.packbits(held, axis=1))
    order = np.argsort(packed.view(f"S{packed.shape[1]}").ravel(), kind="stable")[::-1].copy()
    held = held[order]
    width = held.shape[1]
    low, high, children, depth = [0], [len(order)], [[]], [0]
    at = 0
    while at < len(low):
        lo, hi, start = low[at], high[at], depth[at]
        if hi - lo > LEAF:
            # rows are sorted, so the first and the last part at the first term that splits them
            apart = np.flatnonzero(held[lo, start:] != held[hi - 1, start:])
            if len(apart):
                term = start + int(apart[0])
                with_term = lo + int(held[lo:hi, term].sum())
                for a, b in ((lo, with_term), (with_term, hi)):
                    children[at].append(len(low))
                    low.append(a)
                    high.append(b)
                    children.append([])
                    depth.append(min(term + 1, width))
        at += 1
    most = np.empty((len(low), width), table.dtype)
    least_m, least_id = np.empty(len(low), np.int64), np.empty(len(low), np.int64)
    for node in range(len(low) - 1, -1, -1):
        below = children[node]
        if below:
            most[node] = np.maximum(most[below[0]], most[below[1]])
            least_m[node], least_id[node] = least_m[below].min(), least_id[below].min()
        else:
            rows = order[low[node]:high[node]]
            most[node] = table[rows].max(axis=0)
            least_m[node], least_id[node] = m[rows].min(), ids[rows].min()
    return Tree(order, np.array(low), np.array(high), children, most, least_m, least_id)


def scores(tfs: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Score of every row of counts: the sum over terms of weight x (10^9 tf div (1000 tf + 20 m))."""
    tf = tfs.astype(np.int64)
    return (1_000_000_000 * tf // (1000 * tf + 20 * m[:, None])) @ weights


class Best:
    """The k best (score, id) of one item so far, as far as they are at least its threshold."""

    def __init__(self, k: int, least: int):
        self.k, self.scores, self.ids, self.least, self.last = k, np.zeros(0, np.int64), np.zeros(0, np.int64), max(least, 1), None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        stays = scores >= self.least
        if not stays.any():
            return
        scores, ids = np.concatenate([self.scores, scores[stays]]), np.concatenate([self.ids, ids[stays]])
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least, self.last = int(self.scores[-1]), int(self.ids[-1])


def search_tree(tree: Tree, table: np.ndarray, m: np.ndarray, ids: np.ndarray, columns: np.ndarray, weights: np.ndarray, best: Best) -> None:
    """Depth first, the child of higher bound first; a node is left out when its bound can't reach the k-th score so far.

    A node's bound takes each term's largest count in its subtree with the smallest m; it never falls below a score there. At a bound
    equal to the k-th score the node is searched only if it has a smaller id.
    """
    bounds = scores(tree.most[:, columns], tree.least_m, weights)
    stack, waiting, rows = [0], [], 0

    def hopeless(node: int) -> bool:
        bound = bounds[node]
        return bound < best.least or (best.last is not None and bound == best.least and tree.least_id[node] > best.last)

    def score_waiting() -> None:
        at = np.concatenate([tree.order[tree.low[n]:tree.high[n]] for n in waiting if not hopeless(n)] or [np.zeros(0, np.int64)])
        if len(at):
            best.add(scores(table[at[:, None], columns], m[at], weights), ids[at])

    while stack:
        node = stack.pop()
        if hopeless(node):
            continue
        below = tree.children[node]
        if below:
            stack.extend(sorted(below, key=bounds.__getitem__))
            continue
        waiting.append(node)
        rows += tree.high[node] - tree.low[node]
        if rows >= 8 * LEAF:
            score_waiting()
            waiting, rows = [], 0
    score_waiting()


class Items(NamedTuple):
    """Items of one pass: for each its term codes; weights and order by code; the m of a document from its n."""

    codes: list[np.ndarray]
    weights: np.ndarray
    rank: np.ndarray
    n: int
    total: int


def item_groups(codes: list[np.ndarray]) -> Iterator[list[int]]:
    """Items in groups of at most TREE_TERMS different terms (or a single item)."""
    group, terms = [], set()
    for item, own in enumerate(codes):
        united = terms | set(own.tolist())
        if group and len(united) > TREE_TERMS:
            yield group
            group, united = [], set(own.tolist())
        group.append(item)
        terms = united
    if group:
        yield group


def best_documents(vectors: DataFrame, items: Items, k: int, least: dict[int, int]) -> DataFrame:
    """item, doc_id, score: of every task's documents the k best of each item that reach its threshold in `least`."""
    shared = vectors.sparkSession.sparkContext.broadcast((items, least))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, least = shared.value
        groups = []
        for group in item_groups(items.codes):
            terms = np.unique(np.concatenate([items.codes[i] for i in group]))
            terms = terms[np.argsort(items.rank[terms], kind="stable")]
            column = np.full(len(items.rank), -1, np.int64)
            column[terms] = np.arange(len(terms))
            groups.append((group, terms, column))
        best = {i: Best(k, least.get(i, 1)) for i in range(len(items.codes))}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            m = 50 + 50 * batch.column(1).to_numpy(zero_copy_only=False) * items.n // max(items.total, 1)
            starts = np.asarray(batch.column(2).offsets).astype(np.int64)
            codes = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            tfs = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            starts = starts - starts[0]
            for group, terms, column in groups:
                step = max(LEAF, TREE_CELLS // max(len(terms), 1))
                for lo in range(0, len(ids), step):
                    hi = min(lo + step, len(ids))
                    table = np.zeros((hi - lo, len(terms)), np.int32)
                    part = slice(starts[lo], starts[hi])
                    at = column[codes[part]]
                    rows = np.repeat(np.arange(hi - lo), np.diff(starts[lo:hi + 1]))
                    table[rows[at >= 0], at[at >= 0]] = tfs[part][at >= 0]
                    tree = fp_tree(table, m[lo:hi], ids[lo:hi])
                    for i in group:
                        own = items.codes[i]
                        search_tree(tree, table, m[lo:hi], ids[lo:hi], column[own], items.weights[own], best[i])
        for i, found in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found.ids), i, np.int32)), pa.array(found.ids), pa.array(found.scores)], names=["item", "doc_id", "score"])

    return vectors.filter("doc_id IS NOT NULL AND size(codes) > 0").mapInArrow(run, FOUND)


def item_terms(items: DataFrame, id_column: str) -> DataFrame:
    """id, term: the different terms of every item."""
    low = F.translate(items["text"], UPPER, LOWER)
    return items.select(items[id_column].cast("long").alias("id"), F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term")).filter(
        "id IS NOT NULL").distinct()


def search_pass(docs: DataFrame, wanted: dict[int, list[str]], k: int, id_column: str) -> DataFrame:
    """The result for the items of one pass; `wanted` has their terms."""
    spark = docs.sparkSession
    terms = sorted({t for own in wanted.values() for t in own})
    code = {t: i for i, t in enumerate(terms)}
    vectors = written(restricted_vectors(docs, vocabulary(terms)), "vectors")
    n, total = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)
    counted = vectors.select(F.explode("codes").alias("code")).groupBy("code").count().toArrow()
    df[counted.column("code").to_numpy()] = counted.column("count").to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    rank = np.empty(len(terms), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(terms))
    ids = sorted(wanted)
    items = Items([np.array([code[t] for t in sorted(wanted[i])], np.int64) for i in ids], weights, rank, n, total)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first = F.pmod(F.xxhash64("doc_id"), F.lit(FIRST_SHARE)) == 0
    early = ranked(best_documents(vectors.filter(first), items, k, {})).filter(F.col("rank") == k).toArrow()
    least = dict(zip(early.column("item").to_pylist(), early.column("score").to_pylist(), strict=True))
    names = spark.createDataFrame([(i, item) for i, item in enumerate(ids)], f"item int, {id_column} long")
    return ranked(best_documents(vectors, items, k, least)).join(F.broadcast(names), "item").select(id_column, "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 50, id_column: str = "item_id") -> DataFrame:
    """item id, rank, doc_id, score: the k documents of highest score above 0 for every item, ties by ascending doc_id.

    Terms are runs of ASCII letters (lower-cased) and digits and of all characters beyond ASCII, in whole texts. Documents (columns
    doc_id and text) are restricted to the items' terms and kept as vectors in frequency order. In blocks, vectors that begin alike share
    the paths of an FP-tree, whose nodes know each term's largest count and the smallest m below them; items are searched in it depth first
    by branch and bound. A share of the documents is ranked first: an item's k-th score there is a lower bound for all, so what later
    tasks send on does not grow with their number. Items are taken in passes of about PASS_TERMS terms (at least one item), whose terms are broadcast.

    A null text has no terms. Every row counts as a document: repeated rows count repeatedly and have ranks of their own. Rows without a
    doc_id count in the statistics and are not found. Items without an id or term find nothing; the terms of items with equal ids are
    united; empty tables give no rows; other columns are ignored.
    """
    wanted = written(item_terms(items, id_column), "terms")
    passes = max(1, -(-wanted.count() // PASS_TERMS))
    result = docs.sparkSession.createDataFrame([], f"{id_column} long, rank int, doc_id long, score long")
    for number in range(passes):
        rows = wanted.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == number).toArrow()
        terms = defaultdict(list)
        for item, term in zip(rows.column("id").to_pylist(), rows.column("term").to_pylist(), strict=True):
            terms[item].append(term)
        if terms:
            result = result.unionByName(search_pass(docs, terms, k, id_column))
    return result
