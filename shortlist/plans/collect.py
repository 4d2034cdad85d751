"""Collect: search landed source tables, merge, extract, de-duplicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shortlist.functions.fields import detect_domain
from shortlist.lookups import SOURCE_PRIORITY
from shortlist.operators.dedup import dedup_url
from shortlist.operators.enrich import enrich_descriptions, judged, read_fields
from shortlist.operators.groups import first_per_group
from shortlist.operators.search import (expand_countries, filter_sites, plan_sources, search_grid,
                                        search_postings)
from shortlist.functions.text import blank_to_null
from shortlist.session import bucketed, pin, staged
from shortlist.sources.ingest import (add_canonical, alias_cascade_builtin, alias_cascade_linkedin,
                                      normalise_columns, tag_source, union_sources)


def search_plan(strategies: DataFrame, sources: list[str] | None = None, detect: bool = True,
                mode: str = "substring") -> DataFrame:
    """Grid rows (strategy, job_domain, source, keyword, location, position) of all strategies.

    A strategy's own `sources` go before those of the call.
    """
    named = F.concat_ws(" ", "keywords")
    asked = F.col("job_domain") if "job_domain" in strategies.columns else F.lit(None).cast("string")
    domain = F.coalesce(blank_to_null(asked), detect_domain(named) if detect else F.lit("any"))
    own = ["sources"] if "sources" in strategies.columns else []
    grid = search_grid(strategies.select("strategy", "keywords", "locations", domain.alias("job_domain"), *own))
    planned = plan_sources(grid, sources, mode)
    coded = expand_countries(planned)
    location = F.when(F.col("source") == "builtin", F.col("location_key")).otherwise(F.col("location"))
    return (coded.withColumn("location", location).drop("location_key")
            .groupBy("strategy", "job_domain", "source", "keyword", "location")
            .agg(F.min("position").alias("position")))


def landed_source(name: str, df: DataFrame, pages: DataFrame | None = None,
                  domains: list[str] | None = None) -> DataFrame:
    """One source's raw rows under canonical names."""
    if name == "builtin":
        return alias_cascade_builtin(tag_source(df, None if "source" in df.columns else "builtin"))
    if name == "linkedin":
        return alias_cascade_linkedin(df)
    out = tag_source(filter_sites(df, domains) if domains else df, name)
    return enrich_descriptions(out, pages) if pages is not None else out


def collect_postings(landed: dict[str, DataFrame], strategies: DataFrame,
                     sources: list[str] | None = None, cap: int | None = None,
                     pages: DataFrame | None = None, domains: dict[str, list[str]] | None = None,
                     keep_blank: bool = False, detect: bool = True, mode: str = "substring",
                     extract: bool = True) -> DataFrame:
    """Postings of every strategy, one row per url and strategy, in canonical columns.

    The sources, with the texts of their pages, are made once and written bucketed by source and id. Searching, choosing
    and fetching read that table: each page is parsed once and the wide rows are shuffled once, when they are written.

    Rows of equal url go to the source of higher priority, then to the earlier search, then to the
    smaller id. That order also settles repeats inside a source, so one shuffle does both. Only
    LinkedIn rows may lack a url.
    """
    merged = bucketed(union_sources(
        {name: landed_source(name, df, pages, (domains or {}).get(name))
         for name, df in landed.items()}, SOURCE_PRIORITY), ["source", "id"], "collected")
    grid = pin(search_plan(strategies, sources, detect, mode))      # a few rows, used several times
    hits = search_postings(merged, grid, cap, ("strategy", "source", "keyword", "location"))
    wanted = staged(first_per_group(
        hits.select("id", "source", "strategy", "job_domain", "position"),
        ["strategy", "source", "id"], [F.asc("position")]), "wanted")
    # winners are found on keys alone; the wide rows are fetched for the winners
    found = merged.select("id", "source", "url", "priority").join(wanted, ["source", "id"])
    usable = found.filter((F.col("source") == "linkedin") | blank_to_null("url").isNotNull())
    kept = dedup_url(usable, [F.asc("priority"), F.asc("position"), F.asc("id")], ("strategy",), keep_blank)
    kept = kept.select("id", "source", "strategy", "job_domain", "position")
    # a posting is fetched and read once, however many strategies found it; a merge join leaves the buckets where they are and
    # gives every bucket's rows a task of its own
    once = kept.groupBy("source", "id").agg(F.collect_list(F.struct("strategy", "job_domain", "position")).alias("_searched"))
    rows = merged.hint("merge").join(once, ["source", "id"])
    rows = (read_fields(rows) if extract else rows).select("*", F.explode("_searched").alias("_by"))
    kept = rows.select("*", "_by.*").drop("_searched", "_by")
    if extract:
        kept = judged(kept, F.col("job_domain"))
    return normalise_columns(add_canonical(kept, fill=None), mode="coalesce")
