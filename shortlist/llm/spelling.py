"""Spelling variants: neighbours at one inserted, deleted or replaced code point, from pairs of trie nodes (operator 11)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import written

#: Words that a task numbers together (a range of the sorted words).
PART_WORDS = 50_000
#: Letters of words, after lower-casing A-Z: 26 and the 64 code points from U+00C0 to U+00FF.
ALPHABET = 26 + 64
RUN = r"[a-z\u00C0-\u00FF]{%d,}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every 97th run of a document (by its hash) loses a letter.
SLIPS = 97


def run_hash(doc_id: Column, run: Column) -> Column:
    return F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))


def slips(doc_id: Column, run: Column) -> Column:
    """Does the run lose a letter? Null without a document id."""
    return run_hash(doc_id, run) % SLIPS == 0


def with_slip(doc_id: Column, run: Column) -> Column:
    """The run without one code point where 97 divides the CRC-32 of `<doc_id>:<run>`; the run itself without a document id."""
    at = (run_hash(doc_id, run) % F.char_length(run)).cast("int")
    return F.when(slips(doc_id, run), F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def count_words(docs: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word, n: all words of whole texts with at least that many code points and occurrences.

    A run that is too short stays so when it loses a letter, so only runs of the least length are taken; they are counted before the shuffle.
    """
    low = F.translate(docs["text"], UPPER, LOWER)
    runs = docs.select(docs["doc_id"].alias("d"), F.explode(F.regexp_extract_all(low, F.lit(RUN % least_length), F.lit(0))).alias("run"))
    stays = (F.char_length("run") > least_length) | ~F.coalesce(slips(F.col("d"), F.col("run")), F.lit(False))
    words = runs.filter(stays).select(with_slip(F.col("d"), F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def shared_length(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    i = 0
    while a[i] == b[i]:
        i += 1
    return i


def boundary_paths(firsts: list[str]) -> list[list[int]]:
    """Numbers of the trie nodes on the paths of sorted words; equal prefixes have equal numbers."""
    paths: list[list[int]] = []
    used = 0
    for i, word in enumerate(firsts):
        path = paths[-1][:shared_length(firsts[i - 1], word) + 1] if i else []
        fresh = len(word) + 1 - len(path)
        paths.append(path + list(range(used, used + fresh)))
        used += fresh
    return paths


def number_part(words: list[str], part: int, path: list[int], last_before: str | None, first_after: str | None,
                path_after: list[int] | None) -> list[list[int]]:
    """For each of a part's sorted words the node numbers of those prefixes that another word shares, the empty one first.

    A prefix that also occurs in another part is one of a part's first word, as the words between share it. So the paths
    of this part's and the next part's first words hold all numbers from outside; the rest is numbered here.
    """
    out, used = [], (part + 1) << 40
    for i, word in enumerate(words):
        before = shared_length(words[i - 1], word) if i else -1
        if i:
            path = path[:before + 1] + list(range(used, used + len(word) - before))
            used += len(word) - before
        elif last_before is not None:
            before = shared_length(last_before, word)
        following = words[i + 1] if i + 1 < len(words) else first_after
        after = -1 if following is None else shared_length(word, following)
        if first_after is not None:
            known = shared_length(word, first_after) + 1
            path = path_after[:known] + path[known:]
        out.append(path[:max(before, after) + 1])
    return out


def numbered(words: DataFrame, text: str, keep: list[str], part_words: int, with_ids: bool) -> DataFrame:
    """The columns `keep` with `nodes` (numbers of the prefixes of `text` that other words share) for a table of distinct words.

    With `with_ids` also `id` (ascending in code-point order) and `fresh` (for each shared position: does the letter there differ from
    the one before?). Words are range-partitioned; one first and one last word a part reach the driver.
    """
    parts = max(1, -(-words.count() // part_words))
    ranged = words.repartitionByRange(parts, text).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "parts")
    edges = ranged.groupBy("part").agg(F.min(text).alias("first"), F.max(text).alias("last")).orderBy("part").toArrow().to_pylist()
    paths = boundary_paths([e["first"] for e in edges])
    around = {}
    for i, e in enumerate(edges):
        following = edges[i + 1]["first"] if i + 1 < len(edges) else None
        around[e["part"]] = (paths[i], edges[i - 1]["last"] if i else None, following, paths[i + 1] if following is not None else None)
    return ranged.groupBy("part").applyInPandas(numberer(around, text, keep, with_ids), ", ".join(
        [f"{c} {ranged.schema[c].dataType.simpleString()}" for c in keep] + ["nodes array<long>"] + ["id long", "fresh array<boolean>"] * with_ids))


def numberer(around: dict, text: str, keep: list[str], with_ids: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def number(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(text, kind="stable", ignore_index=True)
        part = int(rows["part"].iloc[0])
        words = rows[text].tolist()
        nodes = number_part(words, part, *around[part])
        out = rows[keep].copy()
        out["nodes"] = nodes
        if with_ids:
            out["id"] = (part << 32) + np.arange(len(rows))
            out["fresh"] = [[i == 0 or w[i] != w[i - 1] for i in range(min(len(w), len(n)))] for w, n in zip(words, nodes)]
        return out

    return number


def pairs(words: DataFrame) -> DataFrame:
    """p, s, n, key, kind: the (prefix node, suffix node) pairs of all words, around a skipped letter and around an inserted one.

    `key` is the negated id, so that of equal counts the smaller word is the greater. kind: 0 nothing skipped, 1 a letter skipped
    that repeats the one before, 2 any other letter skipped. Deleting any letter of a run of equal letters gives the same word;
    only kind 2 counts there. Pairs with a node that no other word has are left out; they meet nothing.
    """
    length = F.char_length("word")
    most_p, most_s = F.size("nodes") - 1, F.size("suffixes") - 1

    def around(skipped: int) -> Column:
        low = F.greatest(F.lit(0), length - skipped - most_s)
        high = F.least(most_p, length - skipped)
        spots = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.struct(
            F.get("nodes", i).alias("p"), F.get("suffixes", length - skipped - i).alias("s"),
            (F.when(F.get("fresh", i), 2).otherwise(1) if skipped else F.lit(0)).alias("kind")))

    spread = words.select("n", (-F.col("id")).alias("key"), F.explode(F.concat(around(1), around(0))).alias("x"))
    return spread.select("x.p", "x.s", "n", "key", "x.kind")


def neighbours(paired: DataFrame) -> DataFrame:
    """key, n_near, best (n, key of the near word of largest n) for every word that has a near word.

    Words that meet under a pair differ at one letter only, so a group has at most ALPHABET words with a skipped letter and one
    without. Each word gets the number and the best of the others from the group's two best; no pair of words is made.
    """
    groups = paired.groupBy("p", "s").agg(F.sort_array(F.collect_list(F.struct("n", "key", "kind")), asc=False).alias("all")).filter(F.size("all") > 1)
    skips, firsts = F.filter("all", lambda m: m["kind"] > 0), F.filter("all", lambda m: m["kind"] == 2)
    wholes = F.filter("all", lambda m: m["kind"] == 0)
    groups = groups.select("all", skips.alias("skips"), firsts.alias("firsts"), wholes.alias("wholes"))

    def named(m: Column) -> Column:
        return F.when(m.isNotNull(), F.struct(m["n"].alias("n"), m["key"].alias("key")))

    def row(m: Column) -> Column:
        top = F.get("skips", F.lit(0))
        other = F.when(top["key"] == m["key"], F.get("skips", F.lit(1))).otherwise(top)
        whole = F.when(m["kind"] == 2, named(F.get("wholes", F.lit(0))))
        links = F.when(m["kind"] == 0, F.size("firsts")).otherwise(F.size("skips") - 1 + F.when(m["kind"] == 2, F.size("wholes")).otherwise(0))
        best = F.when(m["kind"] == 0, named(F.get("firsts", F.lit(0)))).otherwise(F.greatest(named(other), whole))
        return F.struct(m["key"].alias("key"), links.alias("links"), best.alias("best"))

    each = groups.select(F.explode(F.transform("all", row)).alias("x")).select("x.*").filter("links > 0")
    return each.groupBy("key").agg(F.sum("links").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """id, root for a table (id, root) of next words: every round halves the way, as each word then knows its root's root.

    Counts at least double from a word to its form, so a way has at most 63 steps and the loop six rounds and one more.
    """
    while True:
        nxt = forms.select(F.col("id").alias("root"), F.col("root").alias("_beyond"))
        joined = written(forms.join(nxt, "root", "left"), "roots")
        moved = joined.filter("_beyond IS NOT NULL").limit(1).count()
        forms = joined.select("id", F.coalesce("_beyond", "root").alias("root"))
        if not moved:
            return forms


def spelling_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2, part_words: int = PART_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of the texts (columns doc_id and text).

    Words are maximal runs of a-z (A-Z lower-cased) and U+00C0 to U+00FF, some with a letter lost (`with_slip`), that have at least
    `least_length` code points and `least_count` occurrences. Near words differ by exactly one inserted, deleted or replaced code point.
    The form is the near word of largest n (ties: smallest in code-point order) if that is at least `ratio` times the word's n.

    The nodes of the trie of the words and of the trie of the reversed words are numbered. A word is filed under the pairs
    (prefix node, suffix node) around each of its letters skipped and around each gap; two words are near exactly if they share
    such a pair, at most one of them without a skipped letter. Null and empty texts have no words; rows that repeat count again;
    a null doc_id loses no letters; empty tables give no rows; other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent, or the ways to the roots could be circles")
    counted = written(count_words(docs, least_length, least_count), "words")
    words = written(numbered(counted, "word", ["word", "n"], part_words, True), "words")
    back = numbered(words.select("id", F.reverse("word").alias("turned")), "turned", ["id"], part_words, False)
    joined = words.join(back.select("id", F.col("nodes").alias("suffixes")), "id")
    near = neighbours(pairs(joined)).select((-F.col("key")).alias("id"), "n_near", "best")
    known = written(words.select("id", "word", "n").join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("best.n") >= ratio * F.col("n"), -F.col("best.key")).alias("form_id")), "near")
    linked = known.filter("form_id IS NOT NULL")
    ends = roots(linked.select("id", F.col("form_id").alias("root")))
    names = known.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    last = known.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    found = linked.join(ends.select("id", F.col("root").alias("root_id")), "id").join(names, "form_id").join(last, "root_id")
    alone = known.filter("form_id IS NULL").select("word", "n", "n_near", F.lit(None).cast("string").alias("form"),
                                                   F.lit(None).cast("long").alias("form_n"), F.col("word").alias("root"))
    return found.select("word", "n", "n_near", "form", "form_n", "root").unionByName(alone)
