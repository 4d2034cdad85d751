"""Field expressions: seniority, salary, domain, numbers, list columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from shortlist.functions.text import blank_to_null
from shortlist.lookups import DOMAIN_SIGNALS, SENIORITY_LEVELS, TAXONOMY

NUMERIC = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w.lower())) for w in words])


def safe_number(col: Column | str) -> Column:
    """A trimmed decimal number, or null. The pattern keeps suffixes such as 7d out."""
    text = F.trim(_col(col).cast("string"))
    return F.when(text.rlike(NUMERIC), text.cast("double"))


def canonical_seniority(col: Column | str) -> Column:
    """Known site wording becomes the canonical level, other wording is kept."""
    raw = _col(col)
    key = F.lower(F.trim(raw))
    known = [(k, v) for k, v in SENIORITY_LEVELS.items() if v is not None]
    dropped = [k for k, v in SENIORITY_LEVELS.items() if v is None]
    case = F.when(raw.isNull() | key.isin(dropped), F.lit(None).cast("string"))
    for k, v in known:
        case = case.when(key == k, v)
    return case.otherwise(raw)


def salary_display(currency: Column | str, low: Column | str, high: Column | str,
                   salary: Column | str | None = None) -> Column:
    """'CUR 1,000 - 2,000' or 'CUR 1,000+'; an existing salary text wins."""
    low_n, high_n = safe_number(low), safe_number(high)

    def money(n: Column) -> Column:
        return F.call_function("format_number", n, F.lit("#,##0.######"))

    label = F.coalesce(blank_to_null(currency), F.lit("USD"))
    text = (
        F.when(low_n.isNull() | (low_n == 0), F.lit(None).cast("string"))
        .when(high_n.isNull() | (high_n == 0), F.concat(label, F.lit(" "), money(low_n), F.lit("+")))
        .otherwise(F.concat(label, F.lit(" "), money(low_n), F.lit(" - "), money(high_n)))
    )
    return text if salary is None else F.coalesce(blank_to_null(salary), text)


def detect_domain(text: Column | str) -> Column:
    """First domain with a signal word in the text; 'any' when there is none."""
    lowered = F.lower(_col(text))
    case = None
    for domain, signals in DOMAIN_SIGNALS.items():
        hit = contains_any(lowered, signals)
        case = F.when(hit, domain) if case is None else case.when(hit, domain)
    return case.otherwise("any")


def taxonomy_tags(title: Column | str, taxonomy: dict[str, list[str]] | None = None) -> Column:
    """Sorted categories with a keyword in the title."""
    lowered = F.lower(_col(title))
    tags = [F.when(contains_any(lowered, words), F.lit(name))
            for name, words in sorted((taxonomy or TAXONOMY).items())]
    return F.array_compact(F.array(*tags))


def parse_tech_stack(col: Column | str) -> Column:
    """List text, JSON or single-quoted, as an array."""
    return F.from_json(_col(col), "array<string>")


def encode_list(col: Column | str) -> Column:
    return F.to_json(_col(col))
