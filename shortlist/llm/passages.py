"""Removal of passages that repeat across documents, located with sharded Aho-Corasick automata (operator 8)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import byte_chunks, byte_values, range_hashes, windows_of, word_spans, written

#: Words of an anchor phrase; every window of `size` words holds the anchor that is smallest by hash among its own.
ANCHOR_WORDS = 10
DIGEST = "doc_id long, n_words long, digest binary, anchors array<long>"
WINDOWS = "w1 long, w2 int, doc_id long, digest binary, start int"
KEPT = "doc_id long, digest binary, n_removed long, kept binary, spans array<int>"
EMPTY_DIGEST = hashlib.sha256(b"").digest()


def smallest_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours, by doubling."""
    have, low = 1, values
    while have * 2 <= width:
        low, have = np.minimum(low[:-have], low[have:]), have * 2
    return np.minimum(low[:len(values) - width + 1], low[width - have:]) if have < width else low


def joined_words(data: np.ndarray) -> tuple[int, bytes]:
    words = data.tobytes().split()
    return len(words), b" ".join(words)


def digests(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_words, SHA-256 of the words joined by a blank, and the hashes of the anchors of all its windows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = byte_values(False)
        for batch in batches:
            for first, end, data, offsets in byte_chunks(batch.column(1)):
                starts, ends, bounds = word_spans(data, offsets)
                grams, at = windows_of(bounds, ANCHOR_WORDS)
                hashes = range_hashes(range_hashes(values[data], starts, ends), grams, grams + ANCHOR_WORDS).view(np.int64)
                sums, counts, anchors = [], [], []
                for i in range(end - first):
                    n, text = joined_words(data[offsets[i]:offsets[i + 1]])
                    counts.append(n)
                    sums.append(hashlib.sha256(text).digest())
                    anchors.append(np.unique(smallest_in_windows(hashes[at[i]:at[i + 1]], size - ANCHOR_WORDS + 1))
                                   if n >= size else hashes[:0])
                offs = np.concatenate([[0], np.cumsum([len(a) for a in anchors])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(counts, pa.int64()), pa.array(sums, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(anchors)))],
                    names=["doc_id", "n_words", "digest", "anchors"])

    return docs.mapInArrow(run, DIGEST)


def phrase_occurrences(texts: list[str], phrases: dict[str, int]) -> Iterator[tuple[int, int]]:
    """(text number, index of the first character) of every occurrence of the phrases, by one automaton for all of them."""
    automaton = ahocorasick.Automaton()
    for phrase in phrases:
        automaton.add_word(phrase, len(phrase))
    automaton.make_automaton()
    for k, text in enumerate(texts):
        for last, length in automaton.iter(text):
            yield k, last - length + 1


def candidate_windows(candidates: DataFrame, size: int) -> DataFrame:
    """Hashes of the windows whose anchor recurs, found where the automaton of the batch's phrases stops.

    Each batch of documents is a shard: the confirmed phrases its documents carry make its automaton, through which all
    its documents are streamed, so neither phrases nor automata are ever held for the whole corpus.
    """
    width = size - ANCHOR_WORDS + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = byte_values(False), byte_values(False, 77)
        for batch in batches:
            for first, end, data, offsets in byte_chunks(batch.column(1)):
                starts, ends, bounds = word_spans(data, offsets)
                words = range_hashes(one[data], starts, ends)
                second = range_hashes(two[data], starts, ends, 1)
                wanted = batch.column(2).slice(first, end - first)
                digest = batch.column(3).slice(first, end - first).to_pylist()
                texts, found, phrases = [], [], {}
                for i in range(end - first):
                    n, text = joined_words(data[offsets[i]:offsets[i + 1]])
                    lo = bounds[i]
                    if hashlib.sha256(text).digest() != digest[i] or n < size:
                        texts.append("")
                        found.append(None)
                        continue
                    grams = np.arange(n - ANCHOR_WORDS + 1) + lo
                    hashes = range_hashes(words, grams, grams + ANCHOR_WORDS).view(np.int64)
                    text = f" {text.decode()} "
                    heads = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
                    texts.append(text)
                    found.append((hashes, heads))
                    confirmed = np.flatnonzero(np.isin(hashes, np.asarray(wanted[i].values)))
                    for p in confirmed[np.unique(hashes[confirmed], return_index=True)[1]]:
                        phrases[text[heads[p]:heads[p + ANCHOR_WORDS] + 1]] = 1
                marks: dict[int, list[int]] = {}
                if phrases:
                    for i, at in phrase_occurrences(texts, phrases):
                        marks.setdefault(i, []).append(at)
                for i, chars in marks.items():
                    hashes, heads = found[i]
                    smallest = smallest_in_windows(hashes, width)
                    holds = np.zeros(len(smallest), bool)
                    for p in np.searchsorted(heads, chars):
                        lo = max(0, p - width + 1)
                        holds[lo:p + 1] |= smallest[lo:p + 1] == hashes[p]
                    at = np.flatnonzero(holds)
                    if len(at):
                        g = at + bounds[i]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(range_hashes(words, g, g + size).view(np.int64)),
                             pa.array((range_hashes(second, g, g + size, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                             pa.array([batch.column(0)[first + i].as_py()] * len(at), pa.int64()),
                             pa.array([digest[i][:8]] * len(at), pa.binary()),
                             pa.array(at.astype(np.int32))], names=["w1", "w2", "doc_id", "digest", "start"])

    return candidates.select("doc_id", "text", "anchors", "digest").mapInArrow(run, WINDOWS)


def cut_windows(candidates: DataFrame, size: int) -> DataFrame:
    """What is left of each document whose windows at `starts` go."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for k in range(batch.num_rows):
                words = batch.column(1)[k].as_py().encode().split()
                digest = hashlib.sha256(b" ".join(words)).digest()
                if digest != batch.column(3)[k].as_py():
                    continue
                edge = np.zeros(len(words) + 1, np.int64)
                starts = np.asarray(batch.column(2)[k].values)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + size, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                kept = b" ".join([words[j] for j in np.flatnonzero(~gone)])
                for column, value in zip(out, (batch.column(0)[k].as_py(), digest, int(gone.sum()),
                                               hashlib.sha256(kept).digest(), turns.tolist()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()),
                 pa.array(out[3], pa.binary()), pa.array(out[4], pa.list_(pa.int32()))], names=names)

    names = [x.split()[0] for x in KEPT.split(", ")]
    return candidates.select("doc_id", "text", "starts", "digest").mapInArrow(run, KEPT)


def drop_repeated_passages(docs: DataFrame, size: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Cut every word covered by a window of `size` words that also starts in a document with a smaller id.

    Recurring passages are confirmed first: the anchors of all documents are counted by the different texts that hold
    them. Only documents with a recurring anchor go on; automata of the confirmed phrases locate every occurrence in
    them, and only windows around these are compared. Exact copies of a smaller document are settled by their digest.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a blank) and spans (word numbers where
    removed runs begin and end, in turn). Null and empty texts have no words and an empty digest; texts of fewer than
    `size` words lose nothing; a row with a null id is compared with nothing; rows that share an id never remove from
    each other, and repeated rows give repeated results; other columns are ignored.
    """
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    stats = written(digests(rows, size), "passages")
    known = stats.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= size))
    owners = written(known.groupBy("digest").agg(F.min("doc_id").alias("owner")), "passages")

    anchors = known.select("digest", F.substring("digest", 1, 8).alias("short"), F.explode("anchors").alias("anchor"))
    # what is counted by key is written before it is joined by that key: then Spark can split the rows of a frequent key
    recurring = anchors.groupBy("anchor").agg(F.min("short").alias("a"), F.max("short").alias("b")).filter("a < b")
    carried = anchors.join(written(recurring.select("anchor"), "passages"), "anchor").groupBy("digest").agg(F.collect_set("anchor").alias("anchors"))
    carried = carried.join(owners, "digest").select(F.col("owner").alias("doc_id"), "digest", "anchors")
    candidates = written(rows.join(carried, "doc_id"), "passages")

    windows = written(candidate_windows(candidates, size), "passages")
    first = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    hit = windows.join(written(first.select("w1", "w2", "low"), "passages"), ["w1", "w2"]).filter("doc_id > low")
    starts = hit.groupBy("doc_id", F.col("digest").alias("short")).agg(F.collect_set("start").alias("starts"))
    affected = candidates.join(starts, "doc_id").filter(F.substring("digest", 1, 8) == F.col("short"))
    cut = cut_windows(affected, size).dropDuplicates(["doc_id", "digest"])

    out = stats.select("doc_id", "n_words", "digest").join(owners, "digest", "left").join(cut, ["doc_id", "digest"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("owner"), F.lit(False))
    return out.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.lower(F.hex(F.when(copy, F.lit(EMPTY_DIGEST)).otherwise(F.coalesce("kept", "digest")))).alias("kept_sha256"),
        F.when(copy, F.array(F.lit(0), F.col("n_words").cast("int"))).otherwise(
            F.coalesce("spans", F.array().cast("array<int>"))).alias("spans"))
