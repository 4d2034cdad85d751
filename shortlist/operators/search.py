"""Search planning over landed postings: grid, routing, site restriction, matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shortlist.lookups import (ATS_DOMAINS, COUNTRY_CODES, DEFAULT_SOURCES, JAPAN_LOCATIONS)
from shortlist.operators.groups import top_n_per_group
from shortlist.operators.needles import MAX_NEEDLES, occurrences
from shortlist.session import pin


def search_grid(strategies: DataFrame) -> DataFrame:
    """Every keyword with every location of its strategy, keyword-major.

    A strategy without locations yields its keywords with a null location.
    """
    extra = [c for c in strategies.columns if c not in ("keywords", "locations")]
    by_keyword = strategies.select(
        *extra, "locations", F.posexplode("keywords").alias("_k", "keyword"))
    return by_keyword.select(
        *extra, "keyword", F.size("locations").alias("_n"), "_k",
        F.posexplode_outer("locations").alias("_l", "location"),
    ).select(*extra, "keyword", "location",
             (F.col("_k") * F.greatest("_n", F.lit(1)) + F.coalesce("_l", F.lit(0))).alias("position"))


def expand_countries(grid: DataFrame, codes: dict[str, list[str]] | None = None) -> DataFrame:
    """Add the location key: known country names become one or several country codes."""
    table = codes or COUNTRY_CODES
    lookup = F.create_map(*[part for name, values in table.items()
                            for part in (F.lit(name), F.array(*[F.lit(v) for v in values]))])
    found = F.try_element_at(lookup, F.coalesce(F.lower("location"), F.lit("")))
    return grid.select("*", F.explode(F.coalesce(found, F.array("location"))).alias("location_key"))


def is_japan(location: Column | str, watch: list[str] | None = None,
             mode: str = "substring") -> Column:
    """Whether a location belongs to the japan boards.

    'substring' asks whether the location occurs inside a watched name, so 'Remote' does; 'exact'
    asks for equality.
    """
    lowered = F.lower(F.col(location) if isinstance(location, str) else location)
    names = [w.lower() for w in (watch or JAPAN_LOCATIONS)]
    if mode == "exact":
        hit = lowered.isin(names)
    else:
        hit = reduce(lambda a, b: a | b, [F.contains(F.lit(name), lowered) for name in names])
    return F.coalesce(hit, F.lit(False))


def route_locations(locations: DataFrame, watch: list[str] | None = None,
                    mode: str = "substring", col: str = "location") -> DataFrame:
    return locations.withColumn(
        "route", F.when(is_japan(col, watch, mode), "japan").otherwise("other"))


def plan_sources(grid: DataFrame, sources: list[str] | None = None,
                 mode: str = "substring") -> DataFrame:
    """Give every grid row to the active sources; japan boards are searched by keyword only.

    A column `sources` (array of strings) names the sources of each row; where it is null or absent, `sources` of the
    call holds for all rows, and all sources if that is None.
    """
    none = F.lit(None).cast("array<string>")
    given = none if sources is None else F.array(*[F.lit(s.lower()) for s in sources]).cast("array<string>")
    own = F.transform("sources", F.lower) if "sources" in grid.columns else none
    active = F.coalesce(own, given)
    general = F.filter(F.array(*[F.lit(s) for s in DEFAULT_SOURCES]), lambda s: active.isNull() | F.array_contains(active, s))
    japan = F.when(active.isNull() | F.array_contains(active, "japan"), F.array(F.lit("japan_boards"))).otherwise(
        F.array().cast("array<string>"))
    rows = grid.select("*", F.explode(F.when(is_japan("location", mode=mode), japan).otherwise(general)).alias("source"))
    keywords_only = F.col("source") == "japan_boards"
    rows = rows.withColumn("location", F.when(~keywords_only, F.col("location"))).drop("sources")
    keys = [c for c in rows.columns if c != "position"]
    return rows.groupBy(*keys).agg(F.min("position").alias("position")).select(
        *[c for c in grid.columns if c != "sources"], "source")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def on_site(url: Column | str, domains: list[str] | None = None) -> Column:
    """Host equals a listed domain or is a sub-domain of one; a listed path must be a prefix."""
    url = F.col(url) if isinstance(url, str) else url
    host, path = url_host(url), url_path(url)

    def matches(entry: str) -> Column:
        domain, _, prefix = entry.lower().partition("/")
        hit = (host == domain) | host.endswith("." + domain)
        if prefix:
            hit = hit & ((path == "/" + prefix) | path.startswith("/" + prefix + "/"))
        return hit

    return F.coalesce(reduce(lambda a, b: a | b, map(matches, domains or ATS_DOMAINS)), F.lit(False))


def filter_sites(postings: DataFrame, domains: list[str] | None = None) -> DataFrame:
    return postings.filter(on_site("url", domains))


def search_postings(postings: DataFrame, grid: DataFrame, cap: int | None = None,
                    keys: tuple[str, ...] = ("source", "keyword", "location"),
                    max_words: int = MAX_NEEDLES) -> DataFrame:
    """Hits of the search grid in landed postings, all of them.

    A hit has the grid row's source and contains its keyword, and its location if it has one, in any letter case. Keywords
    and locations are filed in one q-gram index; the postings are read once and look up what occurs in them, so neither the
    number of keywords nor of locations adds to the work on a text. What was found meets the grid's (source, keyword) with the
    locations asked there, so only pairs that the grid asks for are made. Only ids and words travel. Rows of equal
    id, source and text count once. With a cap, at most that many hits per grid row stay, by posting id, numbered in `hit`.
    """
    asking = pin(grid.withColumn("_kw", F.lower("keyword")).withColumn(
        "_loc", F.lower(F.coalesce("location", F.lit("")))).filter(F.col("_kw").isNotNull()))
    words = (asking.select(F.col("_kw").alias("needle"), F.lit(True).alias("_word"))
             .unionByName(asking.filter(F.col("_loc") != "").select(F.col("_loc").alias("needle"), F.lit(False).alias("_word")))
             .groupBy("needle").agg(F.max("_word").alias("_word"), F.max(~F.col("_word")).alias("_spot")))
    texts = postings.select("id", "source", F.lower(F.concat_ws(" ", "title", "description_text")).alias("_text"),
                            F.lower(F.coalesce("location", F.lit(""))).alias("_place"))
    texts = texts.withColumn("_both", F.concat_ws("\n", "_text", "_place"))
    in_text, in_place = F.contains("_text", "needle"), F.contains("_place", "needle")
    row = ["id", "source", F.xxhash64("_text", "_place").alias("_row")]
    found = occurrences(texts, "_both", words, max_needles=max_words).select(
        *row, F.when(F.col("_word") & in_text, F.col("needle")).alias("_kw"),
        F.when(F.col("_spot") & (in_text | in_place), F.col("needle")).alias("_loc"))
    asked = asking.groupBy("source", "_kw").agg(F.collect_set("_loc").alias("_asked"))
    per_row = found.groupBy("id", "source", "_row").agg(
        F.collect_set("_kw").alias("_kws"), F.array_append(F.collect_set("_loc"), F.lit("")).alias("_locs"))
    pairs = per_row.select("id", "source", "_locs", F.explode("_kws").alias("_kw")).join(asked, ["source", "_kw"]).select(
        "id", "source", "_kw", F.explode(F.array_intersect("_locs", "_asked")).alias("_loc"))
    hits = pairs.join(asking, ["source", "_kw", "_loc"]).select("id", *grid.columns)
    return hits if cap is None else top_n_per_group(hits, list(keys), [F.asc("id")], cap, "hit")
