"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import written


def smallest_neighbours(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("m"))


def star_step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; edges are (a, b) with a > b."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # written before the join, so that Spark can split the rows of a node with very many edges
    lows = written(smallest_neighbours(both).withColumn("m", F.least("a", "m")), "edges")
    large = both.join(lows, "a").filter("b > a AND b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = written(large, "edges")
    lows = written(smallest_neighbours(large), "edges")
    small = large.join(lows, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(lows.select("a", F.col("m").alias("b"))).distinct()


def mark(edges: DataFrame) -> tuple[int, int]:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge between two different nodes.

    Every step is written to the shared folder, so a lost executor costs one step. Minima are added up before they are
    shuffled and the joins have no order requirement, so a node with very many edges can be split. Null ends are no
    edges; repeated edges and self loops change nothing; no edges give no rows.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    now = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(
        a.isNotNull() & b.isNotNull() & (a != b)).distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        now = written(star_step(now), "edges")
        last, seen = seen, mark(now)
        if seen == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
