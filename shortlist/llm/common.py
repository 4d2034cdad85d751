"""Helpers the operators share: tables, written intermediates, word spans and hashes over Arrow buffers."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shortlist.session import scratch_path

#: Bytes of text that a task looks at together.
CHUNK_BYTES = 1_000_000
#: White space of all word definitions here: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the folder of spark.checkpoint.dir and read again; survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as make it new."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def process_cache(name: str) -> dict:
    """A dictionary of this Python process that outlives a task (workers are reused)."""
    holder = sys.modules.setdefault("_shortlist_llm_cache", types.ModuleType("_shortlist_llm_cache"))
    return holder.__dict__.setdefault(name, {})


def texts_of(column: pa.Array) -> pa.Array:
    """A string column with 64-bit offsets and null as the empty text."""
    return column.cast(pa.large_string()).fill_null("")


def byte_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) of consecutive rows with about `limit` bytes; one row may be larger."""
    column = texts_of(column)
    _, offsets, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))        # an array of its own, changed in place from here
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept between calls."""
    cache = process_cache("powers")
    have = cache.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16) if have is None else max(n + 1, 2 * len(have))
        with np.errstate(over="ignore"):
            have = cache[base] = np.concatenate([
                np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, base, np.uint64))])
    return have[:n + 1]


#: Odd multipliers of the rolling hashes and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


def running_sums(values: np.ndarray, which: int = 0) -> np.ndarray:
    """The sums that the hashes of slices of `values` are taken from."""
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    with np.errstate(over="ignore"):
        np.multiply(values, powers(BASES[which], len(values))[:len(values)], out=sums[1:])
        np.cumsum(sums[1:], out=sums[1:])
    return sums


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, sums: np.ndarray | None = None) -> np.ndarray:
    """A hash of values[start:end] for every pair, from one running sum; equal slices hash alike wherever they stand."""
    with np.errstate(over="ignore"):
        sums = running_sums(values, which) if sums is None else sums
        moved = (sums[ends] - sums[starts]) * powers(INVERSES[which], len(values))[starts]
        return mix(moved + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def window_hashes(values: np.ndarray, size: int, sums: np.ndarray | None = None) -> np.ndarray:
    """range_hashes of all runs of `size` values, by their first places; neighbouring sums need no look-ups."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = running_sums(values) if sums is None else sums
        moved = sums[size:] - sums[:n]
        moved *= powers(INVERSES[0], len(values))[:n]
        moved += np.uint64(size * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)
        return mix(moved)


def byte_values(lower: bool, seed: int = 0) -> np.ndarray:
    """A random 64-bit value for each byte; A-Z as a-z if lower."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(seed))
    if lower:
        values[65:91] = values[97:123]
    return values


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): byte spans of all words, and for each row where its words begin in them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.ones(256, bool)
    inside[list(SPACES)] = False
    full = inside[data]
    before, after = np.empty_like(full), np.empty_like(full)
    before[0], before[1:] = False, full[:-1]
    after[-1], after[:-1] = False, full[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(full & ~before)
    ends = np.flatnonzero(full & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def windows_of(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all runs of `size` words inside one row, and for each row where its runs begin in them."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    firsts = np.repeat(bounds[:-1] - ends[:-1], counts) + np.arange(ends[-1])
    return firsts, ends
