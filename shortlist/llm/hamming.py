"""Exact top-k search over binary codes by incremental multi-index hashing (operator 10)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shortlist.llm.common import written

#: Bits of a segment; a code has as many segments as it needs.
SEGMENT = 16
#: Queries that are broadcast together (codes of 64 bits: 0.8 MB).
QUERY_BLOCK = 50_000
CODES = "id long, code binary, size int"
FOUND = "query_id long, id long, distance int"


def sign_codes(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, code, size (of the vector): one bit for each positive component, filled up with zero bits to whole segments.

    Rows with a null id, a null or empty vector, or a null or not-a-number component have no code and are left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for v in batch.column(1).to_pylist():
                bits = np.packbits(np.asarray(v, np.float64) > 0, bitorder="little").tobytes()
                codes.append(bits + b"\0" * (-len(bits) % (SEGMENT // 8)))
            sizes = pa.array(batch.column(1).value_lengths().to_pylist(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), sizes], names=["id", "code", "size"])

    vector = F.col("vector")
    rows = vectors.select(vectors[id_column].cast("long").alias("id"), vectors[vector_column].cast("array<double>").alias("vector"))
    return rows.filter(F.col("id").isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
                       ).mapInArrow(run, CODES)


def masks(radius: int) -> np.ndarray:
    """All segment values with `radius` bits set."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(SEGMENT), radius)], np.uint16)


def best_of(query: np.ndarray, row: np.ndarray, distance: np.ndarray, ids: np.ndarray, k: int):
    """The k nearest ids of every query among the given pairs, each at its smallest distance, ties by id."""
    order = np.lexsort((distance, ids[row], query))
    query, row, distance = query[order], row[order], distance[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (ids[row[1:]] != ids[row[:-1]])
    query, row, distance = query[new], row[new], distance[new]
    order = np.lexsort((ids[row], distance, query))
    query, row, distance = query[order], row[order], distance[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return query[keep], row[keep], distance[keep]


def different(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Positions of the rows without those that repeat another's id and code."""
    order = np.lexsort((*rows.T, ids))
    new = np.ones(len(order), bool)
    new[1:] = (ids[order[1:]] != ids[order[:-1]]) | (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
    return np.sort(order[new])


def probe(codes: DataFrame, query_ids: np.ndarray, query_codes: np.ndarray, radius: int, k: int) -> DataFrame:
    """For each block of rows the k nearest ids of those with a segment at exactly `radius` from the query's.

    Equal rows of a block count once. A block's index lists its rows by segment value; the values at that radius are looked up, or all rows are tested
    where there are fewer of them than values.
    """
    shared = codes.sparkSession.sparkContext.broadcast((query_ids, query_codes))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        flips = masks(radius)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(ids), -1)
            once = different(ids, rows)
            ids, rows = ids[once], rows[once]
            lists = []
            for s in range(rows.shape[1]):
                order = np.argsort(rows[:, s], kind="stable")
                lists.append((order, np.searchsorted(rows[order, s], np.arange((1 << SEGMENT) + 1))))
            step = max(1, 2_000_000 // max(min(len(flips), len(ids)) * rows.shape[1], 1))
            for lo in range(0, len(queries), step):
                some = queries[lo:lo + step]
                pairs = []
                for s, (order, starts) in enumerate(lists):
                    if len(flips) < len(ids):
                        keys = some[:, s][:, None] ^ flips
                        begin, end = starts[keys].ravel(), starts[keys.astype(np.int64) + 1].ravel()
                        sizes = end - begin
                        q = np.repeat(np.repeat(np.arange(len(some)), len(flips)), sizes)
                        at = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                        pairs.append(q * len(ids) + order[at])
                    else:
                        q, r = np.nonzero(np.bitwise_count(some[:, s][:, None] ^ rows[:, s]) == radius)
                        pairs.append(q * len(ids) + r)
                q, r = np.divmod(np.unique(np.concatenate(pairs)), len(ids))
                distance = np.bitwise_count(some[q] ^ rows[r]).sum(axis=1, dtype=np.int32)
                q, r, distance = best_of(q, r, distance, ids, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_ids[lo + q]), pa.array(ids[r]), pa.array(distance)], names=["query_id", "id", "distance"])

    return codes.mapInArrow(run, FOUND)


def nearest_codes(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id",
                  vector_column: str = "embedding") -> DataFrame:
    """query_id, id, distance, rank: the k nearest rows of every query by Hamming distance of sign codes, ties by id.

    Search radii of the segments grow from 0. After radius r every code nearer than m * (r + 1) bits (m segments) has
    been met, so a query is settled once its k-th verified distance is below that; the others go on. Queries are taken
    in blocks of fixed size, rows in the blocks in which Spark reads them. A query row is its own neighbour. Rows
    without a usable vector are neither found nor searched for; repeated ids count once (at their smallest distance);
    a query meets the vectors of its own length only; fewer than k rows give fewer neighbours; empty tables give no rows; other columns are ignored.
    """
    codes = written(sign_codes(vectors, id_column, vector_column), "codes")
    asked = written(sign_codes(queries, id_column, vector_column).dropDuplicates(["id"]), "codes")
    out = codes.sparkSession.createDataFrame([], "query_id long, id long, distance int, rank int")
    for size in sorted(r["size"] for r in asked.select("size").distinct().collect()):
        for part in nearest_of_size(codes.filter(F.col("size") == size).drop("size"), asked.filter(F.col("size") == size), k):
            out = out.unionByName(part)
    return out


def nearest_of_size(codes: DataFrame, asked: DataFrame, k: int) -> list[DataFrame]:
    """The results of the blocks of queries; all codes are of vectors of one length."""
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    ranked = Window.partitionBy("query_id").orderBy("distance", "id")
    results = []
    for block in range(blocks):
        table = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()
        ids = table.column("id").to_numpy()
        if not len(ids):
            continue
        bits = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint16).reshape(len(ids), -1)
        best = None
        for radius in range(SEGMENT + 1):
            found = probe(codes, ids, bits, radius, k)
            if best is not None:
                found = found.unionByName(best)
            nearest = found.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
            best = written(nearest.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k), "nearest")
            covered = bits.shape[1] * (radius + 1) - 1
            done = best.filter((F.col("rank") == k) & (F.col("distance") <= covered)).select("query_id").toArrow()
            going = ~np.isin(ids, done.column("query_id").to_numpy())
            if radius < SEGMENT and going.any():
                settled = best.join(F.broadcast(best.sparkSession.createDataFrame(
                    [(int(i),) for i in ids[going]], "query_id long")), "query_id", "left_anti")
                results.append(settled)
                best = best.join(F.broadcast(best.sparkSession.createDataFrame(
                    [(int(i),) for i in ids[going]], "query_id long")), "query_id", "left_semi").drop("rank")
                ids, bits = ids[going], bits[going]
            else:
                results.append(best)
                break
    return results
