"""Bucket counts of classes, added up by Spark, and the small matrix made of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTS = "class string, bucket int, n long"


class TaskCounts:
    """Counts of one task by class; emits one row per class and filled bucket."""

    def __init__(self, buckets: int, most_classes: int = 64):
        self.buckets, self.most, self.by = buckets, most_classes, {}

    def add(self, name: str, codes: np.ndarray, times: np.ndarray | None = None) -> None:
        """times: whole numbers, how often each code counts; once without it."""
        if name not in self.by:
            self.by[name] = np.zeros(self.buckets, np.int64)
        self.by[name] += np.bincount(codes, times, self.buckets).astype(np.int64)

    def rows(self, last: bool) -> Iterator[pa.RecordBatch]:
        if last or len(self.by) > self.most:
            for name, counts in self.by.items():
                full = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array(counts[full])],
                    names=["class", "bucket", "n"])
            self.by = {}


def count_matrix(counts: DataFrame, buckets: int, most_classes: int) -> tuple[list[str], np.ndarray]:
    """(classes in order, counts by class and bucket). At most `most_classes` x `buckets` rows reach the driver."""
    summed = counts.groupBy("class", "bucket").agg(F.sum("n").alias("n"))
    rows = summed.limit(most_classes * buckets + 1).toArrow()
    if rows.num_rows > most_classes * buckets:
        raise ValueError(f"more than {most_classes} classes to learn")
    names = rows.column("class").combine_chunks().dictionary_encode() if rows.num_rows else None
    if names is None:
        return [], np.zeros((0, buckets), np.int64)
    if isinstance(names, pa.ChunkedArray):
        names = names.combine_chunks()
    classes = names.dictionary.to_pylist()
    matrix = np.zeros((len(classes), buckets), np.int64)
    matrix[names.indices.to_numpy(), rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    order = sorted(range(len(classes)), key=classes.__getitem__)
    return [classes[i] for i in order], matrix[order]
