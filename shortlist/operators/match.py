"""Every profile against every posting, keeping the best k per profile."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shortlist.operators.groups import sliced, top_n_per_group
from shortlist.session import pin

MAX_BROADCAST_FLOATS = 16_000_000   # about 128 MB of doubles per pass
PROFILES_OF_TILE, POSTINGS_OF_TILE = 256, 2048      # 2 MB of scores in single precision
PAIRS_AT_ONCE = 100_000     # pairs scored in double precision together
ROWS_OF_TASK = 500_000      # postings of a task at most, about 128 MB of vectors


def match_profiles(postings: DataFrame, profiles: DataFrame, k: int = 10, digits: int = 6,
                   max_floats: int = MAX_BROADCAST_FLOATS) -> DataFrame:
    """Top k postings (id, embedding) per profile (profile_id, embedding) by cosine, rounded in the result.

    Ids may be integers or strings. Vectors of postings are dealt to tasks of equal size once; the profile matrix goes to the tasks
    in slices, which with their results have at most max_floats numbers. Every pair is scored, so the time grows as postings times
    profiles; memory does not. Each slice takes two passes: a share of the postings gives every profile a lower bound of its
    k-th score, then all postings are scored and only rows at or above the bound travel, so what is shuffled does not grow with the
    number of tasks. Pairs are never materialised. Scores that agree to twelve decimals are ties and go to the smaller
    posting id. All vectors must have one length; a null vector takes no part, another length is an error.
    """
    profiles = profiles.filter(F.col("embedding").isNotNull()).select("profile_id", "embedding")
    narrow, wide = profiles.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((postings, "id"), (profiles, "profile_id"))}
    if not wide:
        return postings.sparkSession.createDataFrame(
            [], f"profile_id {kinds['profile_id']}, id {kinds['id']}, score double, rank int")
    if narrow != wide:
        raise ValueError(f"profile vectors of {narrow} and {wide} numbers")
    fits = F.when(F.size("embedding") == wide, F.col("embedding")).otherwise(F.raise_error(F.concat(
        F.lit("a posting vector of another length than "), F.lit(str(wide)), F.lit(": "), F.size("embedding").cast("string"))))
    rows = postings.filter(F.col("embedding").isNotNull()).select("id", fits.alias("embedding"))
    rows = pin(rows.repartition(tasks_for(postings)))       # read twice a slice
    passes = [_best_of_slice(rows, part, k)
              for part in sliced(profiles, ["profile_id"], max(1, max_floats // (wide + k)))]
    ranked = _ranked(reduce(DataFrame.unionByName, passes), k)
    return ranked.select(F.col("profile_id").cast(kinds["profile_id"]).alias("profile_id"),
                         F.col("id").cast(kinds["id"]).alias("id"), F.round("score", digits).alias("score"), "rank")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    return top_n_per_group(rows, ["profile_id"], [F.desc("score"), F.asc("id")], k)


def tasks_for(postings: DataFrame) -> int:
    """Tasks for scoring these postings: enough of equal size to keep all cores busy, none with very many rows."""
    total = postings.count()
    return max(1, -(-total // ROWS_OF_TASK), min(4 * postings.sparkSession.sparkContext.defaultParallelism, total // 1000))


def first_share(postings: DataFrame) -> DataFrame:
    """One of about sqrt(tasks) postings, in that much fewer tasks.

    With s the share and t tasks, the first pass sends t / s times k rows a profile and the second about s times k; the root is the
    least of the sum.
    """
    tasks = postings.rdd.getNumPartitions()
    share = max(2, math.isqrt(tasks))
    return postings.filter(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).coalesce(max(1, tasks // share))


def _best_of_slice(postings: DataFrame, profiles: DataFrame, k: int) -> DataFrame:
    """The rows (profile_id, id, score) among which are the k best of every profile of a slice."""
    whole = ("tinyint", "smallint", "int", "bigint")
    types = {c: "long" if df.schema[c].dataType.simpleString() in whole else "string"
             for df, c in ((postings, "id"), (profiles, "profile_id"))}
    schema = f"profile_id {types['profile_id']}, id {types['id']}, score double"
    postings = postings.withColumn("id", F.col("id").cast(types["id"]))
    table = profiles.withColumn("profile_id", F.col("profile_id").cast(types["profile_id"])).toArrow()    # size checked by the caller
    if not table.num_rows:
        return postings.sparkSession.createDataFrame([], schema)
    ids = table["profile_id"].to_pylist()
    matrix = np.asarray(table["embedding"].combine_chunks().flatten(), dtype=np.float64).reshape(len(ids), -1)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths != 0)
    bounds = np.full(len(ids), -np.inf)
    some = first_share(postings)
    early = _ranked(best_rows(some, ids, matrix, bounds, k, schema), k).filter(F.col("rank") == k).toArrow()     # a row a profile at most
    place = {p: i for i, p in enumerate(ids)}
    for profile, score in zip(early["profile_id"].to_pylist(), early["score"].to_pylist(), strict=True):
        bounds[place[profile]] = score
    return best_rows(postings, ids, matrix, bounds, k, schema)


def best_rows(postings: DataFrame, profile_ids: list, matrix: np.ndarray, bounds: np.ndarray, k: int, schema: str) -> DataFrame:
    """Of every task's postings the k best of each profile, as far as they reach the profile's bound.

    The matrix has a unit vector a profile. All pairs are scored in single precision, in tiles that stay in a core's cache; the
    few that come within its rounding error of the bound are scored again in double precision, and only these scores count. A
    task raises its bounds with the k-th scores that it finds. Of equal vectors in a batch the k smallest ids take part.
    """
    shared = postings.sparkSession.sparkContext.broadcast((profile_ids, matrix, bounds))
    high, wide, most = PROFILES_OF_TILE, POSTINGS_OF_TILE, PAIRS_AT_ONCE

    # everything the tasks call is local, so workers need not have this package installed
    def places(own: np.ndarray) -> np.ndarray:
        """Numbers in the order of the ids, null first."""
        given = np.array([x is not None for x in own], bool)
        out = np.zeros(len(own), np.int64)
        if len(own):
            out[given] = np.unique(own[given], return_inverse=True)[1] + 1
        return out

    def firsts(group: np.ndarray) -> np.ndarray:
        """Place of each row in its group; groups are sorted."""
        return np.arange(len(group)) - np.searchsorted(group, group)

    def without_copies(block: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Rows that may be among the k best of a profile, as no k rows of the same vector have smaller ids."""
        rows = np.ascontiguousarray(block).view(np.dtype((np.void, block.itemsize * block.shape[1]))).ravel()
        group, counts = np.unique(rows, return_inverse=True, return_counts=True)[1:]
        if counts.max() <= k:
            return np.arange(len(block))
        order = np.lexsort((places(names), group))
        return np.sort(order[firsts(group[order]) < k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile_ids, targets, bounds = shared.value
        bounds = bounds.copy()
        rough = targets.astype(np.float32)
        error = (targets.shape[1] + 8) * 2.0 ** -23       # more than single precision is off by on unit vectors
        scores = np.full((len(bounds), k), -np.inf)       # of the best rows so far, and their ids
        ids = np.full((len(bounds), k), None, object)
        tile = np.empty(high * wide, np.float32)

        def candidates(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(profile, row) of the pairs that may reach the bound, or the k-th score in this block where there is no bound."""
            across = np.ascontiguousarray(block.astype(np.float32).T)
            found = []
            for at in range(0, len(bounds), high):
                n = min(high, len(bounds) - at)
                part = tile[:n * len(block)].reshape(n, -1)
                np.matmul(rough[at:at + n], across, out=part)
                low = bounds[at:at + n] - error
                unbound = np.flatnonzero(low == -np.inf)
                if len(unbound) and len(block) > k:
                    low[unbound] = np.partition(part[unbound], -k, axis=1)[:, -k].astype(np.float64) - 2 * error
                hit = np.flatnonzero(part.max(axis=1) >= low)
                p, row = np.nonzero(part[hit] >= low[hit, None])
                found.append((at + hit[p], row))
            return np.concatenate([p for p, _ in found]), np.concatenate([row for _, row in found])

        def take(profile: np.ndarray, found: np.ndarray, own: np.ndarray) -> None:
            """Put rows among the best of their profiles."""
            which = np.unique(profile)
            old = np.nonzero(scores[which] > -np.inf)
            profile = np.concatenate([profile, which[old[0]]])
            found = np.concatenate([found, scores[which][old]])
            own = np.concatenate([own, ids[which][old]])
            order = np.lexsort((places(own), -found, profile))
            place = firsts(profile[order])
            order, place = order[place < k], place[place < k]
            scores[which], ids[which] = -np.inf, None
            scores[profile[order], place], ids[profile[order], place] = found[order], own[order]
            bounds[which] = np.maximum(bounds[which], scores[which, k - 1])

        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.empty(batch.num_rows, object)
            names[:] = batch.column(0).to_pylist()
            given = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            kept = without_copies(given, names)
            names, block = names[kept], given[kept].astype(np.float64)
            lengths = np.linalg.norm(block, axis=1, keepdims=True)
            block = np.divide(block, lengths, out=np.zeros_like(block), where=lengths != 0)
            valid = ~np.isnan(block).any(axis=1)
            names, block = names[valid], block[valid]
            for start in range(0, len(names), wide):
                profile, row = candidates(block[start:start + wide])
                for at in range(0, len(row), most):
                    p, r = profile[at:at + most], start + row[at:at + most]
                    exact = np.round(np.einsum("ij,ij->i", targets[p], block[r]), 12)
                    good = np.flatnonzero(exact >= bounds[p])
                    if len(good):
                        take(p[good], exact[good], names[r[good]])
        profile, place = np.nonzero(scores > -np.inf)
        for at in range(0, len(profile), most):
            p, r = profile[at:at + most], place[at:at + most]
            yield pa.RecordBatch.from_arrays([pa.array([profile_ids[i] for i in p]), pa.array(ids[p, r].tolist(), kind),
                                              pa.array(scores[p, r])], names=["profile_id", "id", "score"])

    kind = pa.string() if "id string" in schema.split(", ")[1] else pa.int64()
    return postings.mapInArrow(run, schema)
