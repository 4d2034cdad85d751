"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 2)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from shortlist.llm.common import byte_chunks, process_cache
from shortlist.llm.counts import COUNTS, TaskCounts, count_matrix

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
#: Bytes of text whose n-grams are in memory at a time: about 140 bytes for each. Longer texts come in parts.
PART_BYTES = 100_000
#: Rows that go back to Spark in one batch.
RETURNED = 1000
PREDICTED = "doc_id long, lang_pred string, score double"
NOTHING = np.zeros(0, np.uint32)


def letters_table() -> np.ndarray:
    """For every code point its lower-case letter, or a blank for what is no letter."""
    cache = process_cache("letters")
    if "table" not in cache:
        table = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        cache["table"] = table
    return cache["table"]


def grams(data: np.ndarray, offsets: np.ndarray, buckets: int, before: np.ndarray = NOTHING) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every n-gram of 1 to 3 letters and blanks, bounds by row, last letters); no n-gram crosses rows or is all blank.

    before: the last letters of the part that the only row of `data` goes on from; n-grams that end there are left out.
    """
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    heads[1:] += len(before)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(heads))
    low = np.concatenate([before, letters_table()[points]])
    blank = low == 32
    stays = np.ones(len(low), bool)
    stays[1:] = ~(blank[1:] & blank[:-1] & (row[1:] == row[:-1]))
    last = low[stays][-2:]
    low, row, blank = low[stays].astype(np.uint64), row[stays], blank[stays]
    codes, rows = [], []
    value = np.zeros(len(low), np.uint64)
    with np.errstate(over="ignore"):
        for n in SIZES:
            m = len(low) - n + 1
            if m <= 0:
                break
            value = value[:m] * np.uint64(0x100000001B3) + low[n - 1:] + np.uint64(n)
            whole = row[:m] == row[n - 1:]
            if n == 1:
                whole &= ~blank
            whole[:max(len(before) - n + 1, 0)] = False
            codes.append(((value[whole] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets)
            rows.append(row[:m][whole])
    if not codes:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), last
    codes, rows = np.concatenate(codes), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return codes[order], np.searchsorted(rows[order], np.arange(len(offsets))), last


def gram_parts(column: pa.Array, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, buckets of n-grams, bounds by row) of consecutive rows; a long text comes in several parts of its row."""
    for first, _, data, offsets in byte_chunks(column, PART_BYTES):
        if len(data) <= PART_BYTES:
            codes, bounds, _ = grams(data, offsets, buckets)
            yield first, codes, bounds
            continue
        at, last = 0, NOTHING
        while at < len(data):
            end = at + PART_BYTES
            while end < len(data) and data[end] & 0xC0 == 0x80:     # characters stay whole
                end += 1
            part = data[at:end]
            codes, bounds, last = grams(part, np.array([0, len(part)]), buckets, last)
            yield first, codes, bounds
            at = end


def ngram_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """class, bucket, n of the columns `class` and `text`; every row counts with its whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = TaskCounts(buckets)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, codes, bounds in gram_parts(batch.column(1), buckets):
                for i in range(len(bounds) - 1):
                    counts.add(names[first + i], codes[bounds[i]:bounds[i + 1]])
                yield from counts.rows(False)
        yield from counts.rows(True)

    return docs.select("class", "text").mapInArrow(run, COUNTS)


def train_language(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", buckets: int = BUCKETS,
                   smoothing: float = 0.5, most_languages: int = 256) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages in order, log-probabilities by bucket and language, log-priors) from all rows with a language.

    Rows with a null language or null text are not learned from. More than `most_languages` languages are refused, so
    the matrix that is broadcast has a fixed bound. Priors are uniform: a language is not guessed for being frequent.
    """
    rows = docs.select(docs[lang_column].cast("string").alias("class"), docs[text_column].cast("string").alias("text"))
    names, counts = count_matrix(
        ngram_counts(rows.filter("class IS NOT NULL AND text IS NOT NULL"), buckets), buckets, most_languages)
    smoothed = counts.T + smoothing
    return names, np.log(smoothed / smoothed.sum(axis=0)).astype(np.float32), np.zeros(len(names))


def predict_language(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_column: str = "doc_id",
                     text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (the language's posterior probability) of every row, from its whole text.

    A null text, one without a letter, and any text if no language was learned get `und` with score 0. Equal scores
    go to the first language in order. Repeated rows and null ids keep their rows; columns of `keep` follow, others are ignored.
    """
    names, weights, priors = model
    buckets = len(weights) if len(names) else BUCKETS
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            sums, told = np.zeros((batch.num_rows, len(names))), np.zeros(batch.num_rows, bool)
            for first, codes, bounds in gram_parts(batch.column(1), buckets) if names else ():
                full = np.flatnonzero(np.diff(bounds))
                told[first + full] = True
                for j in range(len(names) if len(full) else 0):
                    sums[first + full, j] += np.add.reduceat(weights[:, j][codes], bounds[full], dtype=np.float64)
            told &= np.array(batch.column(2).to_pylist(), bool)
            labels, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            rows = np.flatnonzero(told)
            if len(rows):
                sums = sums[rows] + priors
                top = sums.argmax(axis=1)
                scores[rows] = 1 / np.exp(np.minimum(sums - sums.max(axis=1, keepdims=True), 0)).sum(axis=1)
                for i, k in zip(rows, top, strict=True):
                    labels[i] = names[k]
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(labels, pa.string()), pa.array(scores), *[batch.column(places.get(c, 1)) for c in keep]],
                names=["doc_id", "lang_pred", "score", *keep])
            for at in range(0, out.num_rows, RETURNED):     # texts go back to Spark some at a time
                yield out.slice(at, RETURNED)

    text = docs[text_column].cast("string")
    others = [c for c in keep if c != text_column or docs.schema[c].dataType != StringType()]    # a kept text travels once
    places = {c: 3 + i for i, c in enumerate(others)}
    kept = [docs[c].alias(f"kept{i}") for i, c in enumerate(others)]
    schema = ", ".join([PREDICTED, *[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]])
    return docs.select(docs[id_column].cast("long").alias("doc_id"), text.alias("text"),
                       F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("known"), *kept).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True for a third of the ids, which are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
