"""Per-group selection, positions and medians that stay even when one group is huge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from shortlist.session import pin

# Spark drops surplus rows of a group before the shuffle up to this limit
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000
SALTS = 64


def top_n_per_group(df: DataFrame, keys: list[str | Column], order: list[Column], n: int,
                    rank: str = "rank") -> DataFrame:
    """The first n rows of each group, numbered from 1.

    Up to GROUP_LIMIT rows per group every task keeps its own n first rows before the shuffle, so a
    group that holds a third of all rows arrives as n rows per task. Beyond that limit the same is
    done by hand: n per salted part of the group, then n overall.
    """
    if n > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*order_columns(df, order)), F.lit(SALTS))
        parts = df.withColumn("_salt", salt)
        window = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (parts.withColumn(rank, F.row_number().over(window))
              .filter(F.col(rank) <= n).drop(rank, "_salt"))
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def order_columns(df: DataFrame, order: list[Column]) -> list[Column]:
    """Plain columns to spread the rows of one group by; any spread gives the same result."""
    simple = [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct", "binary"))]
    return [F.col(f"`{c}`") for c in simple]


def first_per_group(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    return top_n_per_group(df, keys, order, 1, "_first").drop("_first")


def running_weight(df: DataFrame, group: list[str], order: list[str], weight: str,
                   out: str = "before") -> DataFrame:
    """Add the summed weight of all earlier rows of the group, without one task per group.

    The rows are range-sorted over the cluster and pinned; each sorted partition sums its own rows,
    and only one total per (partition, group) goes through a running sum.
    """
    ordered = pin(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order))
    parts = ordered.withColumn("_part", F.spark_partition_id())
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (parts.groupBy("_part", *group).agg(F.sum(weight).alias("_sum"))
               .withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
               .drop("_sum"))
    inside = (Window.partitionBy("_part", *group).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (parts.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
            .join(offsets, ["_part", *group])
            .withColumn(out, F.col("_offset") + F.col("_inside"))
            .drop("_part", "_inside", "_offset"))


def numbered(df: DataFrame, group: list[str], order: list[str], out: str = "position") -> DataFrame:
    """Zero-based position of each row in its group; order must be unique inside a group."""
    return running_weight(df.withColumn("_one", F.lit(1).cast("long")), group, order, "_one",
                          out).drop("_one")


def value_stats(df: DataFrame, group: list[str], value: str, nth: int | None = None) -> DataFrame:
    """Per group: rows, missing, min, max, mean and exact median of a numeric column.

    With nth, also the nth largest value. Equal values are counted before the shuffle and range-sorted by group and
    value. Everything else comes from one row per sorted partition and group: these tell in which partition a wanted
    position lies, and only there values are looked at again. No value is shuffled by its group.
    """
    counted = df.groupBy(*group, value).agg(F.count("*").alias("weight"))
    ordered = pin(counted.repartitionByRange(*group, value).withColumn("_part", F.spark_partition_id()))
    known, weight = F.col(value).isNotNull(), F.col("weight")
    parts = pin(ordered.groupBy("_part", *group).agg(
        F.sum("weight").alias("rows"), F.coalesce(F.sum(F.when(known, weight)), F.lit(0)).alias("_known"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.sum(F.col(value) * weight).alias("_sum")))
    totals = parts.groupBy(*group).agg(
        F.sum("rows").alias("rows"), (F.sum("rows") - F.sum("_known")).alias("missing"), F.min("min").alias("min"),
        F.max("max").alias("max"), (F.sum("_sum") / F.nullif(F.sum("_known"), F.lit(0))).alias("mean"), F.sum("_known").alias("_n"))

    n = F.col("_n")
    wanted = {"lower": F.floor((n - 1) / 2), "upper": F.floor(n / 2), **({"nth_best": n - nth} if nth else {})}
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), p.cast("long").alias("at")) for k, p in wanted.items()]))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_known").over(earlier), F.lit(0))
    places = (matched(parts.withColumn("_before", offset), totals.select(*group, "_n"), group)
              .select("_part", *group, "_known", "_before", asked.alias("_w"))
              .filter((F.col("_w.at") >= F.col("_before")) & (F.col("_w.at") < F.col("_before") + F.col("_known")))
              .select("_part", *group, "_w.kind", (F.col("_w.at") - F.col("_before")).alias("at")))
    inside = (Window.partitionBy("_part", *group, "kind").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(F.sum("weight").over(inside), F.lit(0))
    found = (matched(ordered.filter(known), places, ["_part", *group]).withColumn("_before", before)
             .filter((F.col("_before") <= F.col("at")) & (F.col("at") < F.col("_before") + weight)))
    picked = found.groupBy(*group).agg(*[F.max(F.when(F.col("kind") == k, F.col(value))).alias(f"_{k}") for k in wanted])
    return matched(totals, picked, group, "left").select(
        *group, "rows", "missing", "min", "max", "mean", ((F.col("_lower") + F.col("_upper")) / 2).alias("median"),
        *([F.col("_nth_best").alias("nth_best")] if nth else []))


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null with null."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(lambda x, y: x & y, [left[k].eqNullSafe(named[f"_r_{k}"]) for k in keys])
    return left.join(named, same, how).drop(*[f"_r_{k}" for k in keys])


def sliced(df: DataFrame, keys: list[str], max_rows: int) -> list[DataFrame]:
    """Split a lookup side by the hash of its keys into parts of about max_rows at most.

    The size is counted first; a side that fits stays whole.
    """
    total = df.count()
    if total <= max_rows:
        return [df]
    parts = -(-2 * total // max_rows)       # aim at half, so uneven hashing stays below the limit
    spread = F.pmod(F.xxhash64(*keys), F.lit(parts))
    return [df.filter(spread == i) for i in range(parts)]
