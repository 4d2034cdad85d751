"""SQL spellings of the text rules."""

from __future__ import annotations

from shortlist.functions.text import WHITESPACE

# Patterns of the SQL alone, plainer than the library's rules; in the given tables no furniture is nested in its like.
RAW_PARTS = r"(?is)<!--.*?-->|<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>"
FURNITURE = "(?is)" + "|".join(rf"<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>" for tag in ("noscript", "header", "footer", "nav"))
TAG = "<[a-zA-Z/!?][^>]*>"

# the entities that occur in the given tables, ampersand last
_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&copy;": "©",
             "&middot;": "·", "&amp;": "&"}


def collapse_sql(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{WHITESPACE}', ' ', 'g'))"


def _strip_sql(expr: str, *patterns: str) -> str:
    for pattern in (*patterns, TAG):
        expr = f"regexp_replace({expr}, '{pattern}', ' ', 'g')"
    for entity, text in _ENTITIES.items():
        expr = f"replace({expr}, '{entity}', '{text}')"
    return collapse_sql(expr)


def html_text_sql(expr: str) -> str:
    return f"coalesce({_strip_sql(expr, RAW_PARTS)}, '')"


def page_text_sql(expr: str) -> str:
    return f"coalesce({_strip_sql(expr, RAW_PARTS, FURNITURE)}, '')"


def inner_html_sql(expr: str) -> str:
    return _strip_sql(expr)


def best_text_sql(title: str = "title", company: str = "company", text: str = "description_text",
                  fallback: str = "''") -> str:
    body = (f"CASE WHEN length(coalesce({text}, '')) < 100 THEN coalesce({fallback}, '') "
            f"ELSE coalesce({text}, '') END")
    return html_text_sql(f"concat(coalesce({title}, ''), ' at ', coalesce({company}, ''), '. ', {body})")


def words_sql(expr: str) -> str:
    """Number of whitespace-separated words."""
    clean = collapse_sql(f"coalesce({expr}, '')")
    return f"CASE WHEN {clean} = '' THEN 0 ELSE length({clean}) - length(replace({clean}, ' ', '')) + 1 END"
