"""Quality rules: base statistics and a hashed n-gram log-likelihood ratio of trusted against raw text (operator 9)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import byte_chunks, byte_values, mix, range_hashes, windows_of, word_spans, written
from shortlist.llm.counts import COUNTS, TaskCounts, count_matrix

BUCKETS = 1 << 16
#: Trusted documents that the target multinomial is fitted on, at most (of those with the smallest id hashes).
TRUSTED_ROWS = 20_000
#: Mean log-likelihood ratio per n-gram from which a document is kept.
THRESHOLD = -0.09
#: Parts of one n-gram that weighted counts are kept in, and rounds that fit the weights to the shares of all groups at most.
SCALE, FITTING_STEPS = 1 << 16, 200
#: Columns whose mix in the raw text is made that of the trusted text.
GROUPS = ("lang", "source")
MEASURED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " \
           "n_grams long, ratio double"


def gram_codes(hashes: np.ndarray, bounds: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Buckets of each row's words and pairs of neighbouring words."""
    with np.errstate(over="ignore"):
        one = (hashes >> np.uint64(40)).astype(np.int64) % buckets
        two = (mix(hashes[:-1] * np.uint64(3) + hashes[1:]) >> np.uint64(40)).astype(np.int64) % buckets
    return [np.concatenate([one[a:b], two[a:max(a, b - 1)]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def marked_rows(docs: DataFrame, trusted: DataFrame, group_columns: tuple[str, ...]) -> DataFrame:
    """text, trusted, and what each group column holds (null as the empty text) as `groups`."""
    groups = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in group_columns]).cast("array<string>").alias("groups")
    return docs.join(F.broadcast(trusted.select("doc_id", F.lit(True).alias("trusted"))), "doc_id", "left").select(
        "text", F.coalesce("trusted", F.lit(False)).alias("trusted"), groups)


def group_weights(marked: DataFrame, columns: int) -> dict[tuple[str, ...], int]:
    """For each combination of groups how much its raw n-grams count, in SCALE-ths.

    Weighted so, every group of every column has the same share of the raw n-grams as of the trusted ones, so a ratio does
    not tell how much of a language or source is labelled. Groups without trusted text count nothing. The combinations
    are those of groups that trusted documents have.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, ...], list[int]] = {}
        for batch in batches:
            good, groups = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for first, _, data, offsets in byte_chunks(batch.column(0)):
                words = np.diff(word_spans(data, offsets)[2])
                for i, n in enumerate(np.maximum(2 * words - 1, 0).tolist()):
                    own = sums.setdefault(tuple(groups[first + i]), [0, 0])
                    own[0] += n
                    own[1] += n * good[first + i]
            if len(sums) > 100_000:
                yield from rows(sums)
                sums = {}
        yield from rows(sums)

    def rows(sums: dict[tuple[str, ...], list[int]]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays(
            [pa.array([list(k) for k in sums], pa.list_(pa.string())), pa.array([x for x, _ in sums.values()], pa.int64()),
             pa.array([x for _, x in sums.values()], pa.int64())], names=["groups", "raw", "target"])

    cells = written(marked.mapInArrow(run, "groups array<string>, raw long, target long").groupBy("groups").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")), "quality")
    total, used = cells.agg(F.sum("raw")).first()[0] or 0, cells
    for c in range(columns):
        known = cells.filter("target > 0").select(F.col("groups")[c].alias("known")).distinct()
        used = used.join(known, F.col("groups")[c] == F.col("known"), "left_semi")
    table = used.toArrow()
    keys = [tuple(k) for k in table.column("groups").to_pylist()]
    raw, target = (table.column(c).to_numpy().astype(float) for c in ("raw", "target"))
    if not target.sum():
        return {}
    weights = np.full(len(keys), total / target.sum())
    sides = [np.unique([k[c] for k in keys], return_inverse=True)[1] for c in range(columns)] or [np.zeros(len(keys), np.int64)]
    for _ in range(FITTING_STEPS):
        before = weights.copy()
        for side in sides:
            have, wanted = np.bincount(side, weights * raw), np.bincount(side, target) * total / target.sum()
            weights = weights * np.divide(wanted, have, out=np.zeros(len(have)), where=have > 0)[side]
        if np.allclose(weights, before, rtol=1e-6, atol=0):
            break
    return dict(zip(keys, np.rint(weights * SCALE).astype(np.int64).tolist(), strict=True))


def corpus_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, group_columns: tuple[str, ...] = ()) -> DataFrame:
    """class (`raw` over every document, `target` over the trusted ones), bucket, n in SCALE-ths.

    The raw documents count with the weight of their groups.
    """
    marked = marked_rows(docs, trusted, group_columns)
    shared = docs.sparkSession.sparkContext.broadcast(group_weights(marked, len(group_columns)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, values, weights = TaskCounts(buckets), byte_values(True), shared.value
        for batch in batches:
            good = batch.column(1).to_pylist()
            weight = np.array([weights.get(tuple(g), 0) for g in batch.column(2).to_pylist()], np.int64)
            for first, _, data, offsets in byte_chunks(batch.column(0)):
                starts, ends, bounds = word_spans(data, offsets)
                rows = gram_codes(range_hashes(values[data], starts, ends), bounds, buckets)
                if rows:
                    counts.add("raw", np.concatenate(rows), np.repeat(weight[first:first + len(rows)], [len(r) for r in rows]))
                chosen = [r for i, r in enumerate(rows) if good[first + i]]
                if chosen:
                    codes = np.concatenate(chosen)
                    counts.add("target", codes, np.full(len(codes), SCALE))
        yield from counts.rows(True)

    return marked.mapInArrow(run, COUNTS)


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = 20.0) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw); all zero without trusted text.

    Each bucket has `smoothing` more n-grams in the raw text, and their expected share in the target: rare n-grams say
    little, whatever the size of the corpus.
    """
    names, matrix = count_matrix(counts, buckets, 2)
    rows = dict(zip(names, matrix / SCALE, strict=True))
    if "target" not in rows or "raw" not in rows:
        return np.zeros(buckets, np.float32)
    target, raw = rows["target"] + smoothing * rows["target"].sum() / rows["raw"].sum(), rows["raw"] + smoothing
    return (np.log(target / target.sum()) - np.log(raw / raw.sum())).astype(np.float32)


def trusted_ids(labels: DataFrame, most: int = TRUSTED_ROWS, id_column: str = "doc_id",
                quality_column: str = "quality") -> DataFrame:
    """At most `most` different ids of quality 1, those with the smallest hashes."""
    good = labels.filter(labels[quality_column] == 1).select(labels[id_column].cast("long").alias("doc_id"))
    return good.filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def measure(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """Base statistics, number of n-grams and mean log-likelihood ratio of every whole text.

    Null texts count as empty: all zero, ratio 0. Null ids and repeated rows keep their rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = shared.value
        exact, lower = byte_values(False), byte_values(True)
        symbol = np.zeros(256, bool)
        symbol[list(b"#*$%&|<>")] = True
        for batch in batches:
            parts = []
            for _, _, data, offsets in byte_chunks(batch.column(1)):
                n = len(offsets) - 1
                starts, ends, bounds = word_spans(data, offsets)
                words = range_hashes(exact[data], starts, ends)
                head = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                chars = np.concatenate([[0], np.cumsum(head[ends] - head[starts])])
                symbols = np.concatenate([[0], np.cumsum(symbol[data])])
                rows = gram_codes(range_hashes(lower[data], starts, ends), bounds, len(ratios))
                size = np.array([len(r) for r in rows], np.int64)
                ratio = np.array([float(ratios[r].mean(dtype=np.float64)) if len(r) else 0.0 for r in rows])
                parts.append((np.diff(bounds), chars[bounds[1:]] - chars[bounds[:-1]],
                              symbols[offsets[1:]] - symbols[offsets[:-1]],
                              repeated_lines(data, offsets, starts, exact), repeated_words(words, bounds), size, ratio))
                assert len(size) == n
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c.astype(np.int64)) for c in columns[:6]], pa.array(columns[6])], names=names)

    names = [x.split()[0] for x in MEASURED.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, MEASURED)


def repeated_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row its lines with a word that equal an earlier line of it."""
    feeds = np.flatnonzero(data == 10)
    first = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    first = first[first < len(data)] if len(data) else first[:0]
    last = np.concatenate([first[1:], [len(data)]]).astype(np.int64)
    last -= (data[last - 1] == 10) if len(first) else 0
    has = np.searchsorted(starts, first) < np.searchsorted(starts, last)
    first, last = first[has], last[has]
    hashes = range_hashes(values[data], first, last)
    out = np.zeros(len(offsets) - 1, np.int64)
    bounds = np.searchsorted(first, offsets)
    for i in range(len(out)):
        own = hashes[bounds[i]:bounds[i + 1]]
        if len(own) > 1:
            out[i] = len(own) - len(np.unique(own))
    return out


def repeated_words(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row its words in windows of three that occur twice or more in it."""
    firsts, ends = windows_of(bounds, 3)
    hashes = range_hashes(words, firsts, firsts + 3)
    out = np.zeros(len(bounds) - 1, np.int64)
    for i in range(len(out)):
        own = hashes[ends[i]:ends[i + 1]]
        if len(own) > 1:
            _, which, n = np.unique(own, return_inverse=True, return_counts=True)
            twice = n[which] > 1
            if twice.any():
                covered = np.zeros(len(own) + 2, bool)
                for k in range(3):
                    covered[k:len(own) + k] |= twice
                out[i] = covered.sum()
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, least_words: int = 50,
                  most_repeated_percent: int = 50, trusted_rows: int = TRUSTED_ROWS, buckets: int = BUCKETS,
                  id_column: str = "doc_id", text_column: str = "text", group_columns: tuple[str, ...] = GROUPS) -> DataFrame:
    """Base statistics, base_failed, ratio and kept of every document.

    The raw multinomial counts words and word pairs of all documents, the target one those of at most `trusted_rows`
    documents labelled with quality 1. A document is kept if it passes the base rules and its mean log-likelihood ratio
    per n-gram is at least `threshold`. Raw documents are weighted so that each value of the `group_columns` that `docs` has
    holds the same share of the raw n-grams as of the trusted ones; values that no trusted document has count nothing, so
    words that only they use are neutral. Without labels every ratio is 0 and the base rules alone decide. Null text counts
    as empty (base_failed). Repeated rows and null ids keep their rows; other columns are ignored.
    """
    groups = [c for c in group_columns if c in docs.columns]
    names = tuple(f"group{i}" for i in range(len(groups)))
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"),
                       *[docs[c].cast("string").alias(n) for c, n in zip(groups, names, strict=True)])
    ratios = log_ratios(corpus_counts(rows, trusted_ids(labels, trusted_rows), buckets, names), buckets)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated_percent * F.col("n_words"))
    return measure(rows, ratios).withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("ratio") >= threshold))
