"""De-duplication with a declared winner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shortlist.functions.text import blank_to_null
from shortlist.lookups import SOURCE_PRIORITY
from shortlist.operators.groups import first_per_group


def source_rank(col: Column | str = "source", priority: list[str] | None = None) -> Column:
    """Position of the source in the priority list; unknown sources come last."""
    names = priority or SOURCE_PRIORITY
    found = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(col) if isinstance(col, str) else col)
    return F.when(F.coalesce(found, F.lit(0)) == 0, len(names) + 1).otherwise(found)


def dedup_url(df: DataFrame, order: list[Column], within: tuple[str, ...] = (),
              keep_blank: bool = False, url: str = "url", row_id: str = "id") -> DataFrame:
    """One row per url, the first in the given order.

    Blank urls count as one url, unless keep_blank keeps every one of them: then each such row is
    keyed by its own id, which also spreads them evenly. Rows without an id column bypass the
    shuffle instead.
    """
    key = blank_to_null(url)
    if not keep_blank:
        return first_per_group(df, [*within, F.coalesce(key, F.lit(""))], order)
    if row_id in df.columns:
        own = F.concat(F.lit("#"), F.col(row_id).cast("string"))
        return first_per_group(df, [*within, F.coalesce(key, own)], order)
    return first_per_group(df.filter(key.isNotNull()), [*within, key], order).unionByName(
        df.filter(key.isNull()))


def dedup_keys(df: DataFrame, order: list[Column],
               keys: tuple[str, ...] = ("title", "company", "url")) -> DataFrame:
    """One row per key combination; absent and blank are the same key."""
    return first_per_group(df, [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], order)


def dedup_source_hits(df: DataFrame, order: list[Column], within: tuple[str, ...] = ()) -> DataFrame:
    """Inside one source: rows without url go, then one row per url."""
    return dedup_url(has_url(df), order, within)


def has_url(df: DataFrame, url: str = "url") -> DataFrame:
    return df.filter(blank_to_null(url).isNotNull())
