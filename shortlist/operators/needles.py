"""Which of many needles occur in texts: an inverted index of q-grams, so that the work does not grow with the needles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shortlist.session import staged

GRAM = 3                # letters of a gram; most shorter words would take a second size
MAX_NEEDLES = 200_000   # needles of one index: a few megabytes, below Spark's own limit for broadcasting
PART_BYTES = 200_000    # bytes of text looked at together
LONG_WORD = 64          # longer words are cut into grams by a pattern, in one pass


def words_of(text: Column) -> Column:
    """The distinct parts of a text between blanks of any kind."""
    return F.array_distinct(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "))


def grams(word: Column, size: int) -> Column:
    """All substrings of `size` letters of a word."""
    short = F.transform(F.sequence(F.lit(1), F.char_length(word) - (size - 1)), lambda i: F.substring(word, i, F.lit(size)))
    long = F.regexp_extract_all(word, F.lit("(?s)(?=(.{%d}))" % size), F.lit(1))
    return F.when(F.char_length(word) < size, F.array().cast("array<string>")).when(F.char_length(word) <= LONG_WORD, short).otherwise(long)


def text_grams(text: Column, sizes: list[int]) -> Column:
    """The distinct grams of the given sizes inside the words of a text."""
    return F.array_distinct(F.flatten(F.transform(words_of(text), lambda w: F.concat(*[grams(w, n) for n in sizes]))))


def gram_index(needles: DataFrame, needle: str = "needle", size: int = GRAM) -> DataFrame:
    """The rows of `needles` (each different) with `gram`: of the grams of its longest words the one that fewest needles have (then the smallest).

    Grams lie inside words. A needle whose words are all shorter than `size` has its longest word as a gram; one that is
    blank has a blank.
    """
    words = words_of(F.col(needle))
    longest = F.array_max(F.transform(words, lambda w: F.char_length(w)))
    pieces = F.when(longest >= size, F.flatten(F.transform(words, lambda w: grams(w, size)))).otherwise(
        F.filter(words, lambda w: F.char_length(w) == longest))
    filed = needles.select("*", F.explode(F.array_distinct(pieces)).alias("gram")).withColumn(
        "_n", F.count("*").over(Window.partitionBy("gram")))
    first = Window.partitionBy(needle).orderBy("_n", "gram")
    return filed.withColumn("_first", F.row_number().over(first)).filter("_first = 1").drop("_n", "_first")


def occurrences(texts: DataFrame, text: str, needles: DataFrame, needle: str = "needle", size: int = GRAM,
                max_needles: int = MAX_NEEDLES) -> DataFrame:
    """Rows of `texts` with the columns of each needle that occurs in their `text`, once per row and needle.

    Every needle is filed under its rarest gram. A text looks the bytes of its grams up there and tests only the needles it
    finds, so the cost of a text is its length and its hits. The index is written first and sent to the tasks; the texts do not
    move. More than max_needles needles take a pass each. Needles without a letter besides blanks are tested on every text.
    """
    filed = staged(gram_index(needles, needle, size), "grams")
    total = filed.count()
    slices = -(-2 * total // max_needles) if total > max_needles else 1
    found = []
    for i in range(slices if total else 0):
        index = filed if slices == 1 else staged(filed.filter(F.pmod(F.xxhash64(needle), F.lit(slices)) == i), "grams")
        hits = texts.withColumn("_hits", needles_in(index, needle)(F.col(text).cast("binary")))
        hits = hits.select(*texts.columns, F.explode("_hits").alias("_hit")).select(*texts.columns, "_hit.gram", F.col("_hit.needle").alias(needle))
        found.append(hits.join(index, ["gram", needle]).select(*texts.columns, *needles.columns))
    if not found:
        return texts.join(needles.limit(0), F.lit(False))
    return reduce(DataFrame.unionByName, found)


def needles_in(index: DataFrame, needle: str) -> Callable[[Column], Column]:
    """A function of a text's bytes: the needles of the index that occur there, each once, with their grams.

    Texts are looked at in parts of about PART_BYTES. The first bytes of a needle's gram, three at most, tell where to test it.
    """
    entries = index.select("gram", needle).toArrow()        # size checked by the caller
    grams_, needles_ = (entries.column(i).to_pylist() for i in range(2))
    filed: dict[int, dict[int, list[tuple[int, bytes]]]] = {}
    for number, (gram, word) in enumerate(zip(grams_, needles_, strict=True)):
        head = gram.encode()[:GRAM]
        filed.setdefault(len(head), {}).setdefault(int.from_bytes(head, "big"), []).append((number, word.encode()))
    shared, limit = index.sparkSession.sparkContext.broadcast((filed, grams_, needles_)), PART_BYTES

    # everything the tasks call is local, so workers need not have this package installed
    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("gram", T.StringType()), T.StructField("needle", T.StringType())])))
    def occurring(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        filed, grams_, needles_ = shared.value
        grams_, needles_ = pa.array(grams_, pa.string()), pa.array(needles_, pa.string())
        always = filed.get(0, {}).get(0, [])
        marks = {}      # by length of a head whether a needle may have it, at the last 16 bits of a mixed code
        for n in filed.keys() - {0}:
            codes = np.array(list(filed[n]), np.uint32)
            marks[n] = np.zeros(1 << 16, bool)
            marks[n][(codes * np.uint32(2654435761)) >> np.uint32(16)] = True
        for batch in batches:
            column = batch.cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
            texts, out = column.to_pylist(), [[] for _ in range(len(column))]
            start = 0
            while start < len(texts):
                end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
                data = np.frombuffer(b"".join(texts[start:end]), np.uint8).astype(np.uint32)
                ends = offsets[start + 1:end + 1] - offsets[start]
                for n, mark in marks.items():
                    codes = data[:max(0, len(data) - n + 1)].copy()
                    for i in range(1, n):
                        codes = (codes << np.uint32(8)) | data[i:i + len(codes)]
                    at = np.flatnonzero(mark[(codes * np.uint32(2654435761)) >> np.uint32(16)])
                    row = np.searchsorted(ends, at, side="right")
                    inside = at + n <= ends[row]
                    for pair in np.unique((row[inside] << 24) | codes[at[inside]]).tolist():
                        text = start + (pair >> 24)
                        out[text] += [i for i, x in filed[n].get(pair & 0xFFFFFF, ()) if x in texts[text]]
                start = end
            if always:
                given = batch.is_valid().to_pylist()
                for text, known in enumerate(out):
                    known += [i for i, x in always if given[text] and x in texts[text]]
            ends = np.cumsum([0] + [len(x) for x in out], dtype=np.int32)
            flat = pa.array([i for x in out for i in x], pa.int32())
            yield pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                [grams_.take(flat), needles_.take(flat)], names=["gram", "needle"]))

    return occurring
