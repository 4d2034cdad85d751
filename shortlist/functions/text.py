"""Text expressions: HTML to plain text, best available text, prefixes.

All of it is built-in column work, so it stays inside one JVM stage.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

# Unicode whitespace, spelt so that Java and RE2 agree.
WHITESPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
# Comments and raw-text elements; one alternation, so the leftmost opener wins.
RAW_PARTS = (r"(?is)<(?:!--.*?--"
             r"|script(?:[\s/][^>]*)?>.*?(?:</script\s*|\z)"
             r"|style(?:[\s/][^>]*)?>.*?(?:</style\s*|\z))(?:>|\z)")
# What may stand in a tag after its name: a quoted value can hold ">", a quote elsewhere is a letter like others.
INSIDE = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+"""
TAG = f"<[a-zA-Z/!?]{INSIDE}>"
# Page furniture, dropped with its content; a letter stands for each element.
FURNITURE = {"noscript": "s", "header": "h", "footer": "f", "nav": "n"}
FURNITURE_TAG = rf"(?i)</?(?:{'|'.join(FURNITURE)})(?:[\s/]{INSIDE})?>"
H1 = rf"(?is)<h1(?:[\s/]{INSIDE})?>(.*?)</h1\s*>"
TITLE = rf"(?is)<title(?:[\s/]{INSIDE})?>(.*?)</title\s*>"

MIN_TEXT = 100      # below this a description is too short to use
SHORT_TEXT = 50     # below this a cleaned text is reported as short
THIN_PAGE = 1000    # below this a page is thin

# Prefix lengths that callers of `snippet` can name; no other operator shortens a text.
SNIPPET = {"extraction": 4000, "page": 6000, "explanation": 600, "digest": 800, "page_result": 1500}


def blank_to_null(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.trim(col), F.lit(""))


def bind(col: Column, use: Callable[[Column], Column]) -> Column:
    """Apply an expression that names its input several times, computing that input once."""
    return F.transform(F.array(col), use)[0]


def collapse(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, WHITESPACE, " "))


def _code_point(code: Column) -> Column:
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    hex8 = F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(0xFFFD)).cast("long")), 8, "0")
    return F.decode(F.unhex(hex8), "UTF-32")


_NAMED_ENTITIES = json.dumps({**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"})


def _entity_piece(piece: Column) -> Column:
    """Decode the entity at the start of a piece of text that followed an ampersand."""
    named = F.from_json(F.lit(_NAMED_ENTITIES), "map<string,string>")     # folded to a constant
    name = F.regexp_extract(F.substring(piece, 1, 12),
                            r"^(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]{1,9});", 1)
    text = (
        F.when(name == "", F.lit(None))
        .when(name.rlike("^#[xX]"), _code_point(F.conv(F.substr(name, F.lit(3)), 16, 10).cast("long")))
        .when(name.startswith("#"), _code_point(F.substr(name, F.lit(2)).cast("long")))
        .otherwise(F.try_element_at(named, name)))
    return F.coalesce(F.concat(text, F.substr(piece, F.length(name) + 2)), F.concat(F.lit("&"), piece))


def decode_entities(col: Column) -> Column:
    """Named and numeric entities to characters, in one pass over the pieces between ampersands."""
    return F.array_join(F.transform(
        F.split(col, "&"), lambda piece, i: F.when(i == 0, piece).otherwise(_entity_piece(piece))), "")


def _without(col: Column, *patterns: str) -> Column:
    for pattern in patterns:
        col = F.regexp_replace(col, pattern, " ")
    return col


def html_to_text(col: Column | str) -> Column:
    """Visible text; null gives an empty string. Texts without markup skip those passes."""
    col = F.col(col) if isinstance(col, str) else col
    plain = bind(col, lambda c: F.when(
        F.contains(c, F.lit("<")), _without(c, RAW_PARTS, TAG)).otherwise(c))
    return F.coalesce(collapse(decode_entities(plain)), F.lit(""))


def _open_at(tags: Column) -> Column:
    """For tags as letters (capital: end tag) the letters "0" and "1": is an element open after each tag?

    The open elements are a stack. An end tag closes the last open element of its name and those opened since; without one
    it is nothing. The state is two short texts, so a page's cost is its length.
    """
    def step(state: Column, tag: Column) -> Column:
        name = F.lower(tag)
        below = F.length(state["open"]) - F.length(F.call_function("substring_index", state["open"], name, F.lit(-1))) - 1
        left = (F.when(tag == name, F.concat(state["open"], name))
                .when(F.contains(state["open"], name), F.left(state["open"], below)).otherwise(state["open"]))
        return bind(left, lambda now: F.struct(now.alias("open"), F.concat(
            state["flags"], F.when(now == "", "0").otherwise("1")).alias("flags")))

    empty = F.lit("")
    return F.aggregate(tags, F.struct(empty.alias("open"), empty.alias("flags")), step)["flags"]


def _without_furniture(col: Column) -> Column:
    """The text outside page furniture, however its elements are nested in each other.

    What lies between two tags goes if an element is open there read forward, and also read backward: an end tag without a
    beginning and a beginning without an end take nothing with them. A furniture tag counts even inside a broken tag.
    """
    def letter(tag: Column) -> Column:
        ends = tag.startswith("</")
        name = F.lower(F.substr(tag, F.when(ends, 3).otherwise(2), F.lit(3)))
        low = F.lit(None).cast("string")
        for element, sign in FURNITURE.items():
            low = F.when(name == element[:3], F.when(ends, sign.upper()).otherwise(sign)).otherwise(low)
        return low

    def kept(parts: Column) -> Column:
        forward = F.split(_open_at(parts["tags"]), "")
        turned = F.transform(F.reverse(parts["tags"]), lambda t: F.when(t == F.lower(t), F.upper(t)).otherwise(F.lower(t)))
        backward = F.reverse(F.split(_open_at(turned), ""))
        # piece i lies after tag i - 1 and before tag i
        return bind(F.struct(forward.alias("f"), backward.alias("b")), lambda d: F.array_join(F.filter(
            parts["texts"], lambda text, i: (i == 0) | (F.get(d["f"], i - 1) != "1") | (F.coalesce(F.get(d["b"], i), F.lit("0")) != "1")), " "))

    pattern = F.lit(FURNITURE_TAG)
    parts = F.struct(F.transform(F.regexp_extract_all(col, pattern, F.lit(0)), letter).alias("tags"),
                     F.split(col, FURNITURE_TAG).alias("texts"))
    return F.when(col.rlike(FURNITURE_TAG), bind(parts, kept)).otherwise(col)


def page_text(col: Column | str) -> Column:
    """Text of a fetched page without scripts, styles and page furniture."""
    col = F.col(col) if isinstance(col, str) else col
    body = bind(_without(col, RAW_PARTS), _without_furniture)
    return F.coalesce(collapse(decode_entities(_without(body, TAG))), F.lit(""))


def page_title(col: Column | str) -> Column:
    """First h1, else title, else empty."""
    col = F.col(col) if isinstance(col, str) else col
    inner = bind(_without(col, RAW_PARTS), lambda c: F.when(c.rlike(H1), F.regexp_extract(c, H1, 1)).otherwise(
        F.regexp_extract(c, TITLE, 1)))
    return F.coalesce(collapse(decode_entities(_without(inner, TAG))), F.lit(""))


def best_text(title: Column | str = "title", company: Column | str = "company",
              text: Column | str = "description_text",
              fallback: Column | str | None = "description") -> Column:
    """Cleaned '<title> at <company>. <description>'; short descriptions use the fallback."""
    title, company, text = (F.col(c) if isinstance(c, str) else c for c in (title, company, text))
    spare = F.lit("") if fallback is None else F.coalesce(
        F.col(fallback) if isinstance(fallback, str) else fallback, F.lit(""))
    body = F.coalesce(text, F.lit(""))
    body = F.when(F.length(body) < MIN_TEXT, spare).otherwise(body)
    return html_to_text(F.concat(
        F.coalesce(title, F.lit("")), F.lit(" at "), F.coalesce(company, F.lit("")), F.lit(". "), body))


def snippet(col: Column | str, use: str) -> Column:
    """Leading characters for display or request texts; never used to compute a score."""
    return F.substring(col, 1, SNIPPET[use])


def gate_status(text: Column) -> Column:
    return (F.when(F.length(text) < MIN_TEXT, "error")
            .when(F.length(text) < THIN_PAGE, "thin").otherwise("ok"))


def word_count(col: Column) -> Column:
    """Whitespace-separated words of a text."""
    return bind(collapse(F.coalesce(col, F.lit(""))), lambda c: F.when(c == "", 0).otherwise(
        F.size(F.split(c, " "))))
