"""Links across the components of candidate groups, from exact intersections in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import written

#: Set elements of a block of members that are compared with each other.
BLOCK_ELEMENTS = 150_000
#: Up to so many pairs a member, sets are compared pair by pair.
FEW_PAIRS = 4
#: Up to so many members all intersections come from one product of a small matrix.
MATRIX_MEMBERS = 32


def open_groups(lists: DataFrame, hubs: DataFrame, found: DataFrame) -> DataFrame:
    """hub, node, component of the lists (v, node) that still hold several components; lists of one hub (v, hub) together.

    Lists of two are left out: their one pair has been compared, each member with the hub.
    """
    placed = lists.join(found, "node", "left").select("v", "node", F.coalesce("component", "node").alias("component"))
    split = placed.groupBy("v").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members")).filter("x < y AND members > 2").select("v")
    named = written(split.join(hubs.select("v", "hub"), "v"), "groups")
    return written(placed.join(named, "v").select("hub", "node", "component").distinct(), "groups")


def links_across(groups: DataFrame, texts: DataFrame, sets_of: Callable[[pa.Array], list[np.ndarray]], percent: int) -> DataFrame:
    """a, b: links that join the components of each group, from exact intersections of all full sets across components.

    groups: hub, node, component; texts: node, text. A group is dealt into blocks of about BLOCK_ELEMENTS and each pair
    of blocks is one task, so memory is bounded for a group of any size. A task counts intersections along its own
    inverted lists and gives a link only where it joins two components that no earlier link of the task joined.
    """
    sized = groups.join(texts.select("node", F.char_length("text").alias("n")), "node")
    sums = written(sized.groupBy("hub").agg(F.sum("n").alias("n"), F.ceil((F.sum("n") + 1) / BLOCK_ELEMENTS).cast("int").alias("blocks")), "groups")
    small = sums.filter("blocks = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = F.pmod(F.xxhash64("hub"), F.lit(small // BLOCK_ELEMENTS + 1))      # small groups share a task
    dealt = groups.join(sums.select("hub", "blocks"), "hub").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    task = F.when(F.col("blocks") == 1, F.concat(F.lit("s"), shared)).otherwise(F.concat(F.lit("h"), F.col("hub"))).alias("task")
    dealt = dealt.select("hub", "node", "component", "block", task, other).select(
        "hub", "node", "component", "task", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hub", kind="stable")
        texts = pdf.drop_duplicates("node")
        sets = dict(zip(texts["node"], sets_of(pa.array(texts["text"], pa.large_string())), strict=True))
        hubs, nodes, components = (pdf[c].to_numpy() for c in ("hub", "node", "component"))
        edges = np.flatnonzero(np.concatenate([[True], hubs[1:] != hubs[:-1], [True]]))
        links: list[tuple[int, int]] = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            links += joined(nodes[a:b], components[a:b].copy(), [sets[n] for n in nodes[a:b]], percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return written(dealt.join(texts, "node").groupBy("task", "x", "y").applyInPandas(run, "a long, b long"), "groups")


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets reach the similarity; sizes too far apart are told without a look at the elements."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    n = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * n >= percent * (len(x) + len(y) - n)


def joined(nodes: np.ndarray, component: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between the components of some nodes, one for each time that two of these come together."""
    _, label, number = np.unique(component, return_inverse=True, return_counts=True)
    if len(number) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    outside = label != number.argmax()
    if len(sets) <= MATRIX_MEMBERS and percent > 0:
        return joined_few(nodes, component, sets, sizes, outside, percent)
    flat = np.concatenate(sets)
    order = np.argsort(flat)
    flat, holders = flat[order], np.repeat(np.arange(len(sets)), sizes)[order]
    first = np.ones(len(flat), bool)
    first[1:] = flat[1:] != flat[:-1]
    which = np.empty(len(flat), np.int64)
    which[order] = np.cumsum(first) - 1
    starts = np.append(np.flatnonzero(first), len(flat))
    ends, links = np.concatenate([[0], np.cumsum(sizes)]), []
    for i in np.flatnonzero(outside):
        own = which[ends[i]:ends[i + 1]]
        begin, count = starts[own], starts[own + 1] - starts[own]
        at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        both = np.bincount(holders[at], minlength=len(sets))
        near = np.flatnonzero((100 * both >= percent * (sizes + sizes[i] - both)) & (both > 0) & (component != component[i]))
        for j in near:
            if component[j] != component[i]:
                links.append((nodes[i], nodes[j]))
                component[component == component[j]] = component[i]
    return links


def joined_few(nodes: np.ndarray, component: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, outside: np.ndarray,
               percent: int) -> list[tuple[int, int]]:
    """The links of `joined` for few members, which are compared only where their sizes allow a link."""
    near = (component[:, None] != component) & outside[:, None] & (sizes > 0) & (
        100 * np.minimum(sizes[:, None], sizes) >= percent * np.maximum(sizes[:, None], sizes))
    near &= ~(np.tri(len(sets), k=-1, dtype=bool) & outside)   # a pair of members outside has been looked at by the first of them
    pairs = np.argwhere(near)
    known = len(pairs) > FEW_PAIRS * len(sets)
    if known:
        both = intersections(sets, sizes)
        pairs = pairs[(100 * both >= percent * (sizes[:, None] + sizes - both))[near]]
    links = []
    for i, j in pairs.tolist():
        if component[j] != component[i] and (known or reaches(sets[i], sets[j], percent)):
            links.append((nodes[i], nodes[j]))
            component[component == component[j]] = component[i]
    return links


def intersections(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs, by a product of the matrix of the elements that two sets or more hold."""
    flat = np.concatenate(sets)
    order = np.argsort(flat)
    flat, holders = flat[order], np.repeat(np.arange(len(sets)), sizes)[order]
    first = np.ones(len(flat), bool)
    first[1:] = flat[1:] != flat[:-1]
    several = ~first
    several[:-1] |= several[1:]
    holders, first = holders[several], first[several]
    held = np.zeros((np.count_nonzero(first), len(sets)), np.float32)
    held[np.cumsum(first) - 1, holders] = 1
    return (held.T @ held).astype(np.int64)
