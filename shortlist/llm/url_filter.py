"""URL rules and host lists looked up in Bloom filter cascades (operator 13)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType

from shortlist.llm.common import mix, written

#: Bits of a filter for each key it encodes, and the bits each key sets.
BITS, HASHES = 10, 5
#: Keys that one cascade encodes at its first level (its filter then takes 120 MB); more keys make several cascades.
MOST_KEYS = 100_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Name parts by which a host of the corpus comes on the list of `junk_hosts`.
JUNK_PARTS = ("ad", "ads", "adserver", "adult", "advert", "adverts", "bet", "bets", "betting", "casino", "clickbait", "dating",
              "escort", "gambling", "jackpot", "lottery", "malware", "phishing", "pills", "poker", "popup", "porn", "sex", "slots",
              "spam", "spyware", "torrent", "tracker", "viagra", "warez", "xxx")


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without a host mark."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, most_labels: int) -> Column:
    """The host and its parent domains, as far as they have at most `most_labels` labels; longest first."""
    labels = F.split(host, r"\.")
    first = F.greatest(F.size(labels) - most_labels, F.lit(0)) + 1
    return F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))


def rule_keys(host: Column, path: Column, most_labels: int, lengths: list[int]) -> Column:
    """All keys under which a rule could fit a url, longest first: each host suffix with each path prefix of a rule's length."""
    prefixes = F.filter(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    pairs = F.flatten(F.transform(host_suffixes(host, most_labels), lambda h: F.transform(
        prefixes, lambda p: F.struct((-F.char_length(F.concat(h, p))).alias("l"), (-F.char_length(h)).alias("h"), F.concat(h, p).alias("k")))))
    return F.transform(F.array_sort(pairs), lambda s: s["k"])


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits that keys with these hashes set in a filter of that many bits, one row a key."""
    h = hashes.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        step = mix(h ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        return (mix(h)[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)


def holds(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter holds."""
    at = places(hashes, len(words) * 64)
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def key_hash(key: Column, level: int) -> Column:
    """Every level hashes anew, so keys that agree at one level part at a later one."""
    return F.xxhash64(F.lit(level), key)


def bloom(keys: DataFrame, level: int, n: int) -> np.ndarray:
    """The filter of `n` keys. Tasks set bits, Spark unites them, and BITS x n bits reach the driver."""
    words = max(1, -(-n * BITS // 64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = places(batch.column(0).to_numpy(zero_copy_only=False), words * 64).ravel()
            word, which = np.unique(at >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, which, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "bits"])

    united = keys.select(key_hash(F.col("key"), level).alias("h")).mapInArrow(run, "word long, bits long").groupBy("word").agg(
        F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[united.column("word").to_numpy()] = united.column("bits").to_numpy().view(np.uint64)
    return out


def passing(keys: DataFrame, words: np.ndarray, level: int) -> DataFrame:
    """The keys that a filter holds."""
    shared = keys.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = holds(shared.value, batch.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(stays))], names=["key"])

    return keys.select("key", key_hash(F.col("key"), level).alias("h")).mapInArrow(run, "key string")


def cascade(listed: DataFrame, universe: DataFrame) -> list[np.ndarray]:
    """Filters that together tell exactly which keys of the universe are listed; both tables have a column `key`.

    The first level encodes the listed keys, the second the keys of the universe that the first holds wrongly, the third the
    listed keys that the second holds wrongly, and so on until nothing is held wrongly. Only keys that a filter held go on;
    they are written to the shared folder. Repeated keys count once; without listed keys there are no levels.
    """
    inside = listed = written(listed.select("key").distinct(), "listed")
    outside, levels = universe.select("key"), []
    while n := inside.count():
        level = len(levels)
        levels.append(bloom(inside, level, n))
        wrong = passing(outside, levels[-1], level)
        if not level:
            wrong = wrong.distinct().join(listed, "key", "left_anti")
        inside, outside = written(wrong, "held"), inside
    return levels


def members(levels: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Membership of keys given their hashes at every level (one column a level): the first level that refuses a key decides."""
    answer = np.zeros(len(hashes), bool)
    going = np.arange(len(hashes))
    for level, words in enumerate(levels):
        stays = holds(words, hashes[going, level])
        going = going[stays]
        answer[going] = level % 2 == 0
    return answer


def with_members(rows: DataFrame, keys: str, flags: str, listed: DataFrame, universe: DataFrame, most: int = MOST_KEYS) -> DataFrame:
    """The rows with `flags`: for each key of the array column `keys` whether it is listed, from cascades and without a join.

    A listed table of more than `most` keys is split by hash; each part's cascade is broadcast by a pass of its own.
    """
    parts = max(1, -(-listed.distinct().count() // most))
    ordered = rows.select(keys, *[c for c in rows.columns if c != keys]).schema.fields
    schema = StructType([*ordered, StructField(flags, ArrayType(BooleanType()))])
    rows = rows.withColumn(flags, F.transform(keys, lambda k: F.lit(False)))
    for part in range(parts):
        def of_part(key: Column) -> Column:
            return F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts)) == part

        levels = cascade(listed.filter(of_part(F.col("key"))), universe.filter(of_part(F.col("key"))))
        if not levels:
            continue
        rows = marked(rows, keys, flags, levels, of_part if parts > 1 else None, schema)
        if parts > 1:
            rows = written(rows, "marked")
    return rows


def marked(rows: DataFrame, keys: str, flags: str, levels: list[np.ndarray], of_part, schema: StructType) -> DataFrame:
    """One pass over the rows: `flags` is set where the cascade lists the key."""
    shared = rows.sparkSession.sparkContext.broadcast(levels)
    depth = len(levels)
    others = [c for c in rows.columns if c not in (keys, flags)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(batch.num_columns - 1)
            flat = hashes.flatten()
            table = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), depth + 1)
            old = batch.column(batch.num_columns - 2)
            found = (members(shared.value, table[:, 1:]) & (table[:, 0] == 1)) | old.flatten().to_numpy(zero_copy_only=False).astype(bool)
            sizes = np.diff(np.asarray(old.offsets))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            fresh = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], fresh], names=[*batch.schema.names[:-2], flags])

    def hashed(key: Column) -> Column:
        mine = F.lit(1) if of_part is None else F.when(of_part(key), 1).otherwise(0)
        return F.array(mine.cast("long"), *[key_hash(key, level) for level in range(depth)])

    ready = rows.select(keys, *others, flags, F.transform(keys, hashed).alias(f"{flags}_hashes"))
    return ready.mapInArrow(run, schema)


def junk_hosts(pages: DataFrame, url_column: str = "url", parts: Iterable[str] = JUNK_PARTS) -> DataFrame:
    """key: the hosts and parent domains in a table's urls whose first label has one of the name parts (between dots and hyphens).

    What is longer than the 253 characters of a host name is none and comes on no list.
    """
    labels, names = F.split(url_host(pages[url_column]), r"\."), F.array(*[F.lit(p) for p in parts])
    starts = F.filter(F.sequence(F.lit(1), F.size(labels)), lambda i: F.arrays_overlap(F.split(F.element_at(labels, i), "-"), names))
    hosts = F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    return pages.select(F.explode(hosts).alias("key")).filter(F.char_length("key") <= 253).distinct()


def judge_urls(pages: DataFrame, rules: DataFrame, listed_hosts: DataFrame, id_column: str = "page_id", url_column: str = "url",
               most: int = MOST_KEYS) -> DataFrame:
    """id, host, path, rule, verdict for every row.

    `rules` has host, path and action (`allow` or `block`); a rule fits its host and all subdomains where the url's path
    starts with the rule's. The longest that fits decides (of equally long ones that of the longer host; `block` where both
    actions are given). Where none fits, `rule` is null and the verdict is `block` if the host or a parent domain is a key of
    `listed_hosts`, else `allow`. Membership comes from Bloom cascades over all keys of all urls, so no url is joined and
    nothing of the lists but filters of known size is broadcast.

    A null url, or one without `://`, has an empty host and path, no rule and the verdict `allow`. Ids may be null or repeat: each row has
    its own result. Rules with a null or empty host, one with `/`, `?` or `#`, or another action say nothing; a null path is empty. Empty tables give no rows;
    without rules and hosts all is allowed; other columns are ignored.
    """
    rules = rules.filter("host <> '' AND NOT host RLIKE '[/?#]' AND action IN ('allow', 'block')").select(
        F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
    shape = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.sort_array(F.collect_set(F.char_length("path"))).alias("lengths")).first()
    hosts = written(listed_hosts.select("key").filter("key <> ''").distinct(), "hosts")
    deepest = hosts.agg(F.max(F.size(F.split("key", r"\.")))).first()[0] or 1
    found = pages.select(pages[id_column].alias("_id"), url_host(pages[url_column]).alias("host"), url_path(pages[url_column]).alias("path"))
    found = found.withColumn("_keys", rule_keys(F.col("host"), F.col("path"), shape["labels"] or 1, shape["lengths"] or [0])).withColumn(
        "_hosts", host_suffixes(F.col("host"), deepest))
    keys, names = found.select(F.explode("_keys").alias("key")), found.select(F.explode("_hosts").alias("key"))
    whole = F.concat("host", "path").alias("key")
    for action in ("allow", "block"):
        found = with_members(found, "_keys", f"_{action}", rules.filter(F.col("action") == action).select(whole), keys, most)
    found = with_members(found, "_hosts", "_listed", hosts, names, most)
    both = F.zip_with("_allow", "_block", lambda a, b: F.when(b, "block").when(a, "allow"))
    fits = F.filter(F.zip_with("_keys", both, lambda k, v: F.struct(k.alias("k"), v.alias("v"))), lambda s: s["v"].isNotNull())
    best = F.try_element_at(fits, F.lit(1))
    return found.select(F.col("_id").alias(id_column), "host", "path", best["k"].alias("rule"), F.coalesce(
        best["v"], F.when(F.array_contains("_listed", True), "block").otherwise("allow")).alias("verdict"))
