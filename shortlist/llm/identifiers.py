"""Personal data by fixed patterns and by bootstrapped contexts, in DataFrame functions only (operator 4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import unused, written

#: Patterns of the base kinds. Possessive repeats give the same matches without backtracking; a match begins where its
#: run of characters begins or where the last match ended, so long runs are read once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
ADDRESS = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
NUMBER = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Runs of words that may be identifiers: each with a digit or an at sign; or one word in quotes.
CANDIDATE = r"""(?<!\S)(?:[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9@]\S*+)*+|(["'])[^\s"']++\1(?!\S))"""
#: Contexts in a text: a word with the marks and blanks up to the next letter or digit, and the same to the left.
LEFT, RIGHT = r"[\p{L}_]++[^\p{L}\p{N}_]*+", r"(?<=[\p{L}\p{N}_])[^\p{L}\p{N}_]++[\p{L}_]++"
KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring, good instances that a pattern needs, and the confidence from which instances and patterns are taken.
ROUNDS, LEAST_SEEDS, CONFIDENCE = 3, 5, 0.9
#: Characters from which an instance taken in one place is taken wherever it stands; shorter ones need a context of their own.
ALONE = 8
#: Code points of the pieces that a long text is cut into, so that a place in it is reached in one step.
PIECE = 1024


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array under an associative join, in as many passes as its length has binary digits."""
    def widen(now: Column, k: Column) -> Column:
        return bound(F.pow(F.lit(2), k).cast("int"), lambda w: F.transform(now, lambda x, i: F.when(i >= w, join(x, F.get(now, i - w))).otherwise(x)))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int")), values, widen)


def matches(text: Column, pattern: str) -> Column:
    """All matches as array<struct<start, end, value, before, after>>; offsets in code points, `before` and `after` reach to the
    matches beside it. The work grows with the text and n log n of its matches."""
    def placed(s: Column) -> Column:
        n = F.size(s["found"])
        before, after = F.slice(s["pieces"], 1, n), F.slice(s["pieces"], 2, n)
        ends = running(F.zip_with(before, s["found"], lambda b, v: F.char_length(b) + F.char_length(v)), lambda x, y: x + y)
        rows = F.arrays_zip(s["found"].alias("value"), ends.alias("end"), before.alias("before"), after.alias("after"))
        names = rows_of("value", "end", "before", "after")
        return F.transform(rows.cast(names), lambda m: F.struct(
            (m["end"] - F.char_length(m["value"])).alias("start"), m["end"].alias("end"), m["value"].alias("value"),
            m["before"].alias("before"), m["after"].alias("after")))

    return bound(F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), placed)


def rows_of(*names: str) -> str:
    """The type of rows with these columns; `start` and `end` are numbers."""
    return "array<struct<" + ",".join(f"{n}:{'int' if n in ('start', 'end') else 'string'}" for n in names) + ">>"


def bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def base_spans(text: Column) -> dict[str, Column]:
    """kind: array<struct<start, end>> of what passes the kind's own test; failing matches are dropped, not retried."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    digit = text.rlike("[0-9]")

    def some(test: Column, pattern: str, keep) -> Column:
        return F.when(test, bare(F.filter(matches(text, pattern), lambda m: keep(m["value"])))).otherwise(none)

    def card(v: Column) -> Column:
        return F.length(digits(v)).between(16, 19) & F.call_function("luhn_check", digits(v))

    return {
        "email": some(text.contains("@"), EMAIL, lambda v: F.lit(True)),
        "ip": some(digit & text.rlike(r"[0-9]\.[0-9]"), ADDRESS, lambda v: v.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
        "card": some(digit & text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), NUMBER, card),
        "phone": some(text.contains("+"), PHONE, lambda v: F.length(digits(v)).between(8, 15)),
    }


def candidates(text: Column) -> Column:
    """array<struct<start, end, value, left, right>> of what may be an identifier, without the marks around it.

    `left` is the last word before it with all between, `right` the next word with all between, in small letters; empty
    where something else stands there. The key of `key=value` and `key:value` is the left word.
    """
    def item(m: Column) -> Column:
        def told(p: Column) -> Column:
            start, value = m["start"] + F.char_length(p["head"]), p["value"]
            tail = F.substring(m["value"], F.char_length(p["head"]) + F.char_length(value) + 1, F.char_length(m["value"]))
            # read from its end, so that a long text in front is passed once
            left = F.reverse(F.regexp_extract(F.reverse(F.concat(m["before"], p["head"])), r"^[^\p{L}\p{N}_]*+[\p{L}_]++", 0))
            right = F.regexp_extract(F.concat(tail, m["after"]), r"^[^\p{L}\p{N}_]++[\p{L}_]++", 0)
            return F.struct(start.alias("start"), (start + F.char_length(value)).alias("end"), value.alias("value"),
                            F.lower(left).alias("left"), F.lower(right).alias("right"))

        head = F.regexp_extract(m["value"], r"^(?:[\p{L}_]++[=:](?=.))?[^\p{L}\p{N}]*+", 0)
        rest = F.substring(m["value"], F.char_length(head) + 1, F.char_length(m["value"]))
        value = F.regexp_extract(rest, r"^[\p{L}\p{N}]++(?:[^\p{L}\p{N}]++[\p{L}\p{N}]++)*+", 0)
        return bound(F.struct(head.alias("head"), value.alias("value")), told)

    none = F.array().cast(rows_of("start", "end", "value", "left", "right"))
    found = F.filter(F.transform(matches(text, CANDIDATE), item), lambda c: c["value"] != "")
    return F.when(text.rlike("""[0-9@"']"""), found).otherwise(none)


def with_base(items: Column, known: Column) -> Column:
    """The candidates as c, each with base: whether a known span overlaps it. One sort and two running totals."""
    def events(spans: Column, mine: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(mine).alias("mine"), x["end"].alias("end")))

    def told(e: Column) -> Column:
        reached = running(F.transform(e, lambda x: F.when(x["mine"] == 0, x["end"]).otherwise(-1)), F.greatest)
        coming = running(F.reverse(F.transform(e, lambda x: F.when(x["mine"] == 0, x["start"]).otherwise((1 << 31) - 1))), F.least)
        seen = F.arrays_zip(e.alias("e"), reached.alias("reached"), F.reverse(coming).alias("coming"))
        mine = F.filter(seen, lambda x: x["e"]["mine"] == 1)
        return F.transform(mine, lambda x: (x["reached"] > x["e"]["start"]) | (x["coming"] < x["e"]["end"]))

    flags = bound(F.array_sort(F.concat(events(known, 0), events(items, 1))), told)
    return F.arrays_zip(items.alias("c"), flags.alias("base"))


def opaque(value: Column) -> Column:
    """Twenty letters and digits or more in one word, in turns: what keys and tokens look like."""
    return value.rlike(r"^[A-Za-z0-9_+/-]{20,}+$") & value.rlike("(?:[0-9]++[A-Za-z]++){4}")


def pattern_counts(texts: DataFrame) -> DataFrame:
    """side, pattern, total: how often each context stands in the texts, whatever is beside it."""
    both = F.array(*[F.struct(F.lit(side).alias("side"), F.regexp_extract_all("text", F.lit(regex), F.lit(0)).alias("all"))
                     for side, regex in (("left", LEFT), ("right", RIGHT))])
    sides = texts.select(F.explode(both).alias("s")).select("s.side", F.explode("s.all").alias("pattern"))
    return sides.groupBy("side", F.lower("pattern").alias("pattern")).agg(F.count("*").alias("total"))


def learned(found: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(side, pattern of trusted contexts; instance of trusted identifiers).

    found: instance, left, right, seed. Contexts are the patterns of a graph whose other nodes are the instances. A
    pattern's confidence is the mean score of its different instances (one more doubtful one added) times the share of its
    places in all texts where a candidate stands, an instance's score the chance that not all its patterns are wrong;
    seeds keep 1. A pattern needs LEAST_SEEDS instances that are trusted, found ones too, so the next round reaches farther.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("pattern")) for s in ("left", "right")]))
    edges = written(found.select("instance", "seed", sides.alias("e")).select("instance", "seed", "e.*").filter("pattern <> ''").groupBy(
        "side", "pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "identifiers")
    places = edges.groupBy("side", "pattern").agg(F.sum("n").alias("places"), F.max("seed").alias("any"))
    share = written(places.join(pattern_counts(texts), ["side", "pattern"]).select(
        "side", "pattern", F.least(F.lit(1.0), F.col("places") / F.col("total")).alias("share")), "identifiers")
    scores = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score"))
    for _ in range(ROUNDS):
        patterns = edges.join(scores, "instance").groupBy("side", "pattern").agg(
            (F.sum("score") / (F.count("*") + 1)).alias("pure"), F.sum((F.col("score") >= CONFIDENCE).cast("int")).alias("good"))
        trusted = written(patterns.filter(F.col("good") >= LEAST_SEEDS).join(share, ["side", "pattern"]).select(
            "side", "pattern", (F.col("pure") * F.col("share")).alias("confidence")), "identifiers")
        scores = written(edges.join(trusted, ["side", "pattern"], "left").groupBy("instance").agg(
            F.max("seed").alias("seed"), F.sum(F.log1p(-F.coalesce("confidence", F.lit(0.0)))).alias("doubt")).select(
            "instance", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("doubt")).alias("score")), "identifiers")
    return trusted.filter(F.col("confidence") >= CONFIDENCE).select("side", "pattern"), scores.filter(F.col("score") >= CONFIDENCE).select("instance")


def find_identifiers(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text_key, the spans of each base kind, and `id`: spans that bootstrapping adds.

    Null texts are empty. A null doc_id keeps its row; rows that share an id are told apart by their text; repeated rows
    give repeated results; other columns are ignored; an empty table gives no rows. Very long texts and texts with very many
    matches are read in one pass for each kind. No base span is changed by the learned ones, which never overlap them.

    Seeds are the candidates that hold a base span and opaque words. What a trusted context holds is added, and where it
    has ALONE characters or more and is no opaque word, in all its places.
    """
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), text.alias("text"))
    text = F.col("text")
    base = base_spans(text)
    marked = rows.select("doc_id", F.xxhash64("text").alias("text_key"), *[c.alias(k) for k, c in base.items()],
                         candidates(text).alias("candidates"))
    marked = written(marked, "identifiers")
    known = F.concat(*[F.col(k) for k in KINDS])
    maybe = marked.filter(F.size("candidates") > 0).select("doc_id", "text_key", F.explode(with_base(F.col("candidates"), known)).alias("x"))
    maybe = maybe.select("doc_id", "text_key", "x.c.start", "x.c.end", "x.c.left", "x.c.right", F.col("x.c.value").alias("instance"), "x.base")
    maybe = written(maybe.withColumn("seed", F.col("base") | opaque(F.col("instance"))), "identifiers")
    trusted, instances = learned(maybe, rows)
    free = maybe.filter("NOT base")
    wanted = ["doc_id", "text_key", "start", "end"]
    taken = free.filter(~F.col("seed") & (F.char_length("instance") >= ALONE)).join(instances, "instance", "left_semi").select(wanted)
    for side in ("left", "right"):
        own = trusted.filter(F.col("side") == side).select(F.col("pattern").alias(side))
        taken = taken.unionByName(free.join(own, side, "left_semi").select(wanted))
    added = taken.groupBy(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "text_key").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("id"))
    out = marked.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(added, ["key", "text_key"], "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return out.select("doc_id", "text_key", *KINDS, F.coalesce("id", none).alias("id"))


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by kind and start, joined by commas."""
    def told(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*[told(k) for k in kinds]), ",")


def between(pieces: Column, start: Column, end: Column) -> Column:
    """The text from start to end, out of its pieces of PIECE code points."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    open_end = F.substring(F.get(pieces, first), F.pmod(start, F.lit(PIECE)) + 1, F.when(first == last, end - start).otherwise(PIECE))
    full = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    tail = F.when(first == last, "").otherwise(F.substring(F.get(pieces, last), F.lit(1), F.pmod(end, F.lit(PIECE))))
    return F.concat(F.coalesce(open_end, F.lit("")), full, F.coalesce(tail, F.lit("")))


def redact(docs: DataFrame) -> DataFrame:
    """documents with every span found replaced by its kind in angle brackets; spans that overlap give one mark.

    Texts without a span (null ones too) stay as they are, and so do all other columns.
    """
    def with_mark(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"<{kind.upper()}>").alias("mark")))

    key, text_key, spans = unused(docs.columns, "_key", "_text_key", "_spans")
    found = find_identifiers(docs).select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias(key), F.col("text_key").alias(text_key),
        F.array_sort(F.concat(*[with_mark(k) for k in (*KINDS, "id")])).alias(spans))
    found = found.filter(F.size(spans) > 0).dropDuplicates([key, text_key])
    keyed = docs.withColumns({key: F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))),
                              text_key: F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))})
    def cleaned(s: Column) -> Column:
        ends = running(F.transform(s["spans"], lambda x: x["end"]), lambda x, y: F.greatest(x, y))
        since = F.concat(F.array(F.lit(0)), ends)          # where the text is told up to, before each span and at the end
        shown = F.zip_with(F.slice(since, 1, F.size(s["spans"])), s["spans"], lambda at, x: F.when(
            x["start"] >= at, F.concat(between(s["pieces"], at, x["start"]), x["mark"])).otherwise(""))
        rest = between(s["pieces"], F.array_max(since), F.char_length("text"))
        return F.concat(F.array_join(shown, ""), rest)

    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    clean = bound(F.struct(pieces.alias("pieces"), F.col(spans).alias("spans")), cleaned)
    joined = keyed.join(found, [key, text_key], "left")
    return joined.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(clean)).select(*docs.columns)
