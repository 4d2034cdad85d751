"""MinHash near-duplicate removal with bottom-k sketches of one hash function (operator 5)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.llm.blocks import links_across, open_groups
from shortlist.llm.common import byte_chunks, byte_values, mix, range_hashes, windows_of, word_spans, written
from shortlist.llm.components import components

#: Values a sketch retains.
RETAINED = 48
#: Chance that a link at the threshold is missed by its sketches, at most: half by the lists, half by the estimate.
MISSED = 1e-6
#: Bytes of text whose words and shingles are in memory at a time.
PART_BYTES = 100_000
SKETCH = "doc_id long, n_shingles long, hi long, lo long, sketch array<long>"


def least_shared(percent: int, k: int) -> float:
    """Share of a sketch of k values that two documents at the threshold hold together, but for a chance of MISSED / 2."""
    p, missed, least = percent / 100, 0.0, 0
    while least < k:
        missed += comb(k, least) * p ** least * (1 - p) ** (k - least)
        if missed > MISSED / 2:
            break
        least += 1
    return least / k


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) by chunk; A-Z count as a-z; short texts are one shingle."""
    values = byte_values(True)
    for first, _, data, offsets in byte_chunks(column, PART_BYTES):
        starts, ends, bounds = word_spans(data, offsets)
        words = range_hashes(values[data], starts, ends)
        runs, at = windows_of(bounds, size)
        hashes = range_hashes(words, runs, runs + size) >> np.uint64(1)
        short = range_hashes(words, bounds[:-1], bounds[1:]) >> np.uint64(1)
        yield first, [np.unique(hashes[at[i]:at[i + 1]]) if at[i + 1] > at[i] else
                      short[i:i + 1] if bounds[i + 1] > bounds[i] else hashes[:0] for i in range(len(at) - 1)]


def sketches(docs: DataFrame, size: int, k: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit mark of the whole set, and its k smallest hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1), size):
                with np.errstate(over="ignore"):
                    hi = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                    lo = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                low = [s[:k].view(np.int64) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(hi),
                     pa.array(lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(low)))], names=names)

    names = [x.split()[0] for x in SKETCH.split(", ")]
    return docs.mapInArrow(run, SKETCH)


def rare_lists(nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """v, node, n, alone: the inverted lists of every node's rarest retained values.

    Two linked nodes share at least `least_shared` of the smaller sketch. In one order of all values (rare ones first) they
    must then meet within the first (1 - `least_shared`) of each, so the frequent values of passages that many texts hold make no
    lists. Values of one node make none either. `alone` is the number of such values: few mark the centre of a family.
    """
    values = nodes.select("node", "n", F.explode("sketch").alias("v"))
    often = written(values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "near")
    mine = values.join(often, "v").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("xs"))
    held = F.least(F.col("n"), F.lit(k))
    alone = held - F.size("xs")
    first = (held - F.ceil(held * least_shared(percent, k) - 1e-9) + 1 - alone).cast("int")
    return mine.withColumn("alone", alone).withColumn("first", first).filter("first > 0").select(
        "node", "n", "alone", F.explode(F.expr("slice(xs, 1, first)")).alias("x")).select("x.v", "node", "n", "alone")


def likely(sa: Column, sb: Column, na: Column, nb: Column, k: int, percent: int) -> Column:
    """The union sketch's estimate is near the threshold or above; exact where both sketches are whole sets."""
    union = F.array_sort(F.array_union(sa, sb))
    whole = (na <= k) & (nb <= k)
    low = F.when(whole, union).otherwise(F.slice(union, 1, k))
    both = F.size(F.array_intersect(low, F.array_intersect(sa, sb)))
    least = F.when(whole, F.lit(percent / 100)).otherwise(F.lit(least_shared(percent, k)))
    sizes = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return sizes & (both >= least * F.size(low) - 1e-9)


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = written(docs.join(needed, "doc_id"), "near")
    full = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                left = [s for _, sets in shingle_sets(part.column(2), size) for s in sets]
                right = [s for _, sets in shingle_sets(part.column(3), size) for s in sets]
                for i, (x, y) in enumerate(zip(left, right, strict=True)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good[lo + i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            keep = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return written(full.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct(), "near")


def near_components(docs: DataFrame, size: int = 5, percent: int = 80, k: int = RETAINED, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: groups of documents linked at `percent` similarity of word shingles.

    Equal sets become one node first. Inverted lists of rare retained values give candidates: each member of a list meets
    the list's centre and its smallest node, so a list of any length gives two pairs per member. Union sketches filter the
    pairs and the full sets decide. Lists that still hold several components then compare full sets across these, in blocks.

    Null and empty texts have no shingles and stand alone. A null id stands alone with a null component and is kept.
    Rows that share an id are one node; repeated rows give repeated results; other columns are ignored.
    """
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    marked = written(sketches(rows, size, k), "near")
    known = marked.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    owners = written(known.groupBy("hi", "lo").agg(F.min("doc_id").alias("node")), "near")
    nodes = written(known.join(owners, ["hi", "lo"]).filter("doc_id = node").select(
        "node", F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["node", "n"]), "near")
    lists = written(rare_lists(nodes, k, percent), "near")

    hubs = written(lists.groupBy("v").agg(F.min(F.struct("alone", "node")).alias("centre"), F.min("node").alias("low")), "near")
    met = lists.join(hubs, "v").select("node", F.explode(F.array("centre.node", "low")).alias("hub")).filter("node != hub")
    pairs = met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()

    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("sketch").alias(f"s{name}"))

    near = likely(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb"), k, percent)
    tried = written(pairs.join(side("a"), "a").join(side("b"), "b").filter(near).select("a", "b").distinct(), "near")
    links = verified(tried, rows, size, percent)
    found = written(components(links), "near")
    groups = open_groups(lists, hubs.select("v", F.col("centre.node").alias("hub")), found)
    if not groups.isEmpty():
        texts = written(rows.join(groups.select(F.col("node").alias("doc_id")).distinct(), "doc_id").select(
            F.col("doc_id").alias("node"), "text"), "near")
        more = links_across(groups, texts, lambda c: [s for _, sets in shingle_sets(c, size) for s in sets], percent)
        found = written(components(links.unionByName(more)), "near")

    out = marked.select("doc_id", "n_shingles", "hi", "lo").join(owners, ["hi", "lo"], "left")
    out = out.withColumn("node", F.when(F.col("n_shingles") > 0, F.col("node")).otherwise(F.col("doc_id")))
    out = out.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("node")))
    out = out.join(found, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
