"""Fuzzy line de-duplication: MinHash of character shingles, exact verification, one line kept per component (operator 3)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.llm.blocks import links_across, open_groups, reaches
from shortlist.llm.common import byte_chunks, mix, process_cache, range_hashes, running_sums, unused, window_hashes, written
from shortlist.llm.components import components

#: Characters of a shingle, bins of a signature, and bands of three bins: a pair of similarity 0.8 is missed once in 1,300.
SHINGLE, BINS, BANDS, ROWS = 8, 32, 10, 3
#: Words of the fixed-size bit table that keeps most lines out of the text join (4 MB; a full table only filters less).
TABLE_WORDS = 1 << 19
NO_ID = (1 << 63) - 1
#: Bytes of text looked at together; the arrays of a part then stay in a core's own cache.
PART_BYTES = 100_000
#: Keys travel in blocks by their highest bits. A task collects so many of them at a time, and a row has so many at most.
BLOCK_BITS, HELD_KEYS, ROW_KEYS = 11, 1 << 18, 256


def split_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(code points, first, end, row, number in its row) of all lines that are not blank."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = offsets if len(points) == len(data) else np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    feeds = np.flatnonzero(points == 10)
    first = np.sort(np.concatenate([heads[:-1], feeds + 1]))
    row = np.sort(np.concatenate([np.arange(len(heads) - 1), np.searchsorted(heads, feeds, side="right") - 1]))
    end = np.concatenate([first[1:], [len(points)]])
    last = np.concatenate([row[1:] == row[:-1], [False]])
    end = end - last
    number = np.arange(len(first)) - np.searchsorted(row, row)
    keep = end > first
    begins = points[first[keep]]
    blank = (begins <= 32) | (begins == 133) | (begins == 160)
    if blank.any():                                 # only lines that begin with a blank need a look at the rest
        full = np.concatenate([[0], np.cumsum((points > 32) & (points != 133) & (points != 160))])
        keep = full[end] > full[first]
    return points, first[keep], end[keep], row[keep], number[keep]


def point_values(points: np.ndarray) -> np.ndarray:
    """A random 64-bit value for each code point; those of the first plane come from a table kept between calls."""
    seed = np.uint64(0x632BE59BD9B4E019)
    cache = process_cache("point_values")
    if "plane" not in cache:
        cache["plane"] = mix(np.arange(1 << 16, dtype=np.uint64) + seed)
    if not len(points) or points.max() <= 0xFFFF:
        return cache["plane"][points]
    out = cache["plane"][np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    out[high] = mix(points[high].astype(np.uint64) + seed)
    return out


def shingle_hashes(values: np.ndarray, first: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of every line, and where those of each begin; a shorter line is one shingle.

    Lines are parts of `values` in ascending order. All places are hashed from neighbouring sums, then those of lines are taken.
    """
    counts = np.maximum(end - first - SHINGLE + 1, 1)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    edges = np.zeros(len(values) + 1, np.int8)
    edges[first] += 1
    edges[first + counts] -= 1
    inside = np.cumsum(edges[:-1], dtype=np.int8).view(bool)
    sums = running_sums(values) if sums is None else sums
    places = window_hashes(values, SHINGLE, sums)
    out = np.zeros(bounds[-1], np.uint64)
    found = places[inside[:len(places)]]            # behind the last place only short lines begin
    out[:len(found)] = found
    short = np.flatnonzero(end - first < SHINGLE)
    if len(short):
        out[bounds[short]] = range_hashes(values, first[short], end[short], sums=sums)
    return out, bounds


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin; an empty bin takes that of another, the same one for every line with the same bins.

    Only the bins that bands use are filled.
    """
    n, empty = len(bounds) - 1, ~np.uint64(0)
    sig = np.full(n * BINS, empty)
    cell = np.repeat(np.arange(n) * BINS, np.diff(bounds))
    cell += (hashes >> np.uint64(59)).view(np.int64)
    np.minimum.at(sig, cell, hashes)
    own = sig.reshape(n, BINS)
    sig = own[:, :BANDS * ROWS].copy()
    rows, bins = np.nonzero(sig == empty)
    for attempt in range(64):
        if not len(rows):
            return sig
        donors = (mix((np.arange(BINS) * 64 + attempt).astype(np.uint64)) >> np.uint64(59)).astype(np.int64)
        given = own[rows, donors[bins]]
        sig[rows, bins] = given
        left = given == empty
        rows, bins = rows[left], bins[left]
    sig[rows, bins] = own.min(axis=1)[rows]
    return sig


def line_nodes(points: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = point_values(points)
    sums = running_sums(values)
    return values, sums, range_hashes(values, first, end, sums=sums).view(np.int64)


def key_blocks(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """block, keys, nodes: keys with equal highest bits, at most ROW_KEYS a row, and their nodes, as bytes."""
    keys, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
    for lo in range(0, len(keys), HELD_KEYS):
        yield key_rows(keys[lo:lo + HELD_KEYS], nodes[lo:lo + HELD_KEYS])


def key_rows(keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    block = (keys >> np.uint64(64 - BLOCK_BITS)).astype(np.uint16)
    order = np.argsort(block, kind="stable")
    block = block[order]
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    place = np.arange(len(block)) - np.repeat(starts, np.diff(np.append(starts, len(block))))
    rows = np.flatnonzero(place % ROW_KEYS == 0)
    offsets = pa.py_buffer((np.append(rows, len(block)) * 8).astype(np.int32))
    packed = [pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(x[order])]) for x in (keys, nodes)]
    return pa.RecordBatch.from_arrays([pa.array(block[rows].astype(np.int32)), *packed], names=["block", "keys", "nodes"])


def band_keys(docs: DataFrame) -> DataFrame:
    """block, keys, nodes: BANDS keys of every different line of a batch, many to a row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            seen = np.zeros(0, np.int64)               # nodes of the batch so far, sorted
            for _, _, data, offsets in byte_chunks(batch.column(0), PART_BYTES):
                points, first, end, _, _ = split_lines(data, offsets)
                values, sums, nodes = line_nodes(points, first, end)
                nodes, at = np.unique(nodes, return_index=True)
                place = np.searchsorted(seen, nodes)
                new = np.ones(len(nodes), bool) if not len(seen) else seen[np.minimum(place, len(seen) - 1)] != nodes
                nodes, at = nodes[new], at[new]
                seen = np.insert(seen, place[new], nodes)
                order = np.argsort(at)
                nodes, at = nodes[order], at[order]
                sig = signatures(*shingle_hashes(values, first[at], end[at], sums)).reshape(len(nodes), BANDS, ROWS)
                with np.errstate(over="ignore"):
                    keys = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :]
                    for r in range(ROWS):
                        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
                held.append((keys.ravel(), np.repeat(nodes, BANDS)))
                if sum(len(k) for k, _ in held) >= HELD_KEYS:
                    yield from key_blocks(held)
                    held = []
        if held:
            yield from key_blocks(held)

    return docs.select("text").mapInArrow(run, "block int, keys binary, nodes binary")


def packed_values(column: pa.Array) -> np.ndarray:
    """The 64-bit numbers of all rows of a binary column, one after the other."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(data, np.int64, (offsets[-1] - offsets[0]) // 8, offsets[0])


def shared_keys(keys: DataFrame) -> DataFrame:
    """v, node: the keys that have two nodes or more, and these. Rows sorted by block are streamed; of the last block,
    which may go on in the next batch, each key stays with one node, so a key of any size needs no memory.

    A row comes once from each batch that has it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the open block: its keys, a node of each, and whether that node has been given
        block, v0, node0, given0 = None, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = batch.column(0).to_numpy()
            if blocks[0] != block:
                v0, node0, given0 = v0[:0], node0[:0], given0[:0]
            block = blocks[-1]
            v, node = np.concatenate([v0, packed_values(batch.column(1))]), np.concatenate([node0, packed_values(batch.column(2))])
            old = len(v0)
            order = np.argsort(v)
            sorted_v, sorted_node = v[order], node[order]
            starts = np.flatnonzero(np.concatenate([[True], sorted_v[1:] != sorted_v[:-1]]))
            counts = np.diff(np.append(starts, len(v)))
            low, high = np.minimum.reduceat(sorted_node, starts), np.maximum.reduceat(sorted_node, starts)
            known = np.zeros(len(v), bool)
            known[:old] = given0
            shared = (low != high) | np.logical_or.reduceat(known[order], starts)
            rows = np.repeat(shared, counts) & ~known[order]
            found_v, found_node = sorted_v[rows], sorted_node[rows]
            order = np.lexsort((found_node, found_v))
            found_v, found_node = found_v[order], found_node[order]
            new = np.ones(len(order), bool)
            new[1:] = (found_v[1:] != found_v[:-1]) | (found_node[1:] != found_node[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(found_v[new]), pa.array(found_node[new])], names=["v", "node"])
            # keys of the last block: all with its highest bits
            kept = (sorted_v[starts].view(np.uint64) >> np.uint64(64 - BLOCK_BITS)).astype(np.int64) == block
            v0, node0, given0 = sorted_v[starts][kept], low[kept], shared[kept]

    return keys.repartition("block").sortWithinPartitions("block").mapInArrow(run, "v long, node long")


def line_table(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """node, doc_id, text_key, line of every line that is not blank, and the text of lines that may be needed, once a batch.

    A bit table of fixed size keeps most other texts out.
    """
    word = F.pmod("node", F.lit(TABLE_WORDS))
    words = needed.groupBy(word.cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pmod(shiftright(node, 20), 64) as int))")).alias("bits")).toArrow()
    bits = np.zeros(TABLE_WORDS, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value.view(np.uint64)
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for start, _, data, offsets in byte_chunks(batch.column(2), PART_BYTES):
                points, first, end, row, number = split_lines(data, offsets)
                _, _, nodes = line_nodes(points, first, end)
                own, at = np.unique(nodes, return_index=True)
                hit = at[(bits[own % TABLE_WORDS] >> ((own >> 20) % 64).astype(np.uint64)) & np.uint64(1) == 1]
                texts = np.full(len(nodes), None, object)
                for i in hit:
                    texts[i] = points[first[i]:end[i]].tobytes().decode("utf-32-le")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes), pa.array(ids[start + row]), pa.array(keys[start + row]), pa.array(number.astype(np.int32)),
                     pa.array(texts, pa.string())], names=["node", "doc_id", "text_key", "line", "text"])

    return written(docs.select("doc_id", "text_key", "text").mapInArrow(
        run, "node long, doc_id long, text_key long, line int, text string"), "lines")


def line_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of texts of one line each."""
    out = []
    for _, _, data, offsets in byte_chunks(column, PART_BYTES):
        points, first, end, row, _ = split_lines(data, offsets)
        hashes, bounds = shingle_hashes(point_values(points), first, end)
        bounds = bounds[np.searchsorted(row, np.arange(len(offsets)))]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            hashes[a:b].sort()
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        new[bounds[:-1][np.diff(bounds) > 0]] = True
        hashes, bounds = hashes[new], np.concatenate([[0], np.cumsum(new)])[bounds].tolist()
        out += [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def similar_pairs(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose lines' (node, text) shingle sets reach the threshold."""
    full = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                nodes, place, back = np.unique(np.concatenate([part.column(0), part.column(1)]), return_index=True, return_inverse=True)
                sets = line_sets(pa.concat_arrays([part.column(2), part.column(3)]).take(pa.array(place)))
                for i in range(part.num_rows):
                    good[lo + i] = reaches(sets[back[i]], sets[back[i + part.num_rows]], percent)
            keep = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return written(full.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "lines")


def line_components(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, component of the lines that are similar to another line; node, doc_id, text_key, line of all lines).

    Each member of a band's list meets the list's hub, its smallest node. Lists that then still hold several
    components compare their members' full sets across these, in blocks.
    """
    lists = written(shared_keys(band_keys(docs)), "lines")
    hubs = written(lists.groupBy("v").agg(F.min("node").alias("hub")), "lines")
    met = lists.join(hubs, "v").select("node", "hub").filter("node <> hub")
    tried = written(met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "lines")
    needed = written(lists.select("node").distinct(), "lines")
    table = line_table(docs, needed)
    texts = written(table.filter("text IS NOT NULL").select("node", "text").join(needed, "node", "left_semi").dropDuplicates(["node"]), "lines")
    links = similar_pairs(tried, texts, percent)
    found = written(components(links), "lines")
    groups = open_groups(lists, hubs, found)
    if not groups.isEmpty():
        found = written(components(links.unionByName(links_across(groups, texts, line_sets, percent))), "lines")
    return found, table.drop("text")


def dedup_lines(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All columns of `docs` with the text left of it, and n_lines, n_removed (with underscores where these names are taken).

    Lines are what line feeds part; blank ones are left alone. Lines whose sets of SHINGLE characters reach `percent`
    similarity are linked, and of every component (equal lines included) only the first line by doc_id, text and place
    stays. Null and empty texts stay as they are. Null ids come last. Rows with equal id and text count as one row and
    keep the same lines. An empty table gives no rows.
    """
    key = F.coalesce(docs[id_column].cast("long"), F.lit(NO_ID))
    text = docs[text_column].cast("string")
    rows = docs.select(key.alias("doc_id"), F.xxhash64(text).alias("text_key"), F.coalesce(text, F.lit("")).alias("text"))
    found, table = line_components(rows, percent)
    places = written(table.join(found, "node", "left").select(
        F.coalesce("component", "node").alias("group"), "doc_id", "text_key", "line"), "lines")
    place = F.struct("doc_id", "text_key", "line")
    first = written(places.groupBy("group").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low < high").select("group", "low"), "lines")
    own, own_text, cut = unused(docs.columns, "_key", "_text_key", "_gone")
    counted, removed = unused(docs.columns, "n_lines", "n_removed")
    # a set, as a repeated row names its lines again
    gone = places.join(first, "group").filter(place != F.col("low")).groupBy("doc_id", "text_key").agg(
        F.collect_set("line").alias(cut)).select(F.col("doc_id").alias(own), F.col("text_key").alias(own_text), cut)
    keyed = docs.withColumns({own: key, own_text: F.xxhash64(text)}).join(gone, [own, own_text], "left")
    lines = F.split(text_column, "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col(cut), i))
    return keyed.select(
        *[F.when(F.col(cut).isNull(), F.col(c)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_column else F.col(c)
          for c in docs.columns],
        F.coalesce(F.size(F.filter(lines, lambda x: x.rlike(r"\S"))), F.lit(0)).cast("long").alias(counted),
        F.coalesce(F.size(cut), F.lit(0)).cast("long").alias(removed))
