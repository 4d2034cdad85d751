"""Search planning and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shortlist.functions.fields import detect_domain, taxonomy_tags
from shortlist.lookups import COUNTRY_CODES, DEFAULT_SOURCES, DOMAIN_SIGNALS, JAPAN_LOCATIONS
from shortlist.operators import ranking
from shortlist.operators.search import (expand_countries, filter_sites, plan_sources, route_locations,
                                        search_grid, search_postings)
from workload.registry import query
from workload.tables import postings, table, with_postings

# Locations searched beside the nations, so that countries, regions and japan all occur.
EXTRA_LOCATIONS = ["Tokyo", "Remote", "Germany", "EMEA"]


def strategies(spark, d) -> DataFrame:
    """One strategy per part type: the nouns of its part names in every nation."""
    words = (table(spark, d, "part").select(F.col("p_type").alias("strategy"), F.split("p_name", " ")[1].alias("w"))
             .distinct().groupBy("strategy").agg(F.array_sort(F.collect_list("w")).alias("keywords")))
    places = table(spark, d, "nation").select("n_name").distinct().collect()      # 25 nations
    names = sorted(r["n_name"] for r in places) + EXTRA_LOCATIONS
    return words.withColumn("locations", F.array(*[F.lit(x) for x in names]))


_PLACES = ", ".join(f"'{x}'" for x in EXTRA_LOCATIONS)
GRID_SQL = [
    """strategies AS (SELECT p_type AS strategy, list_sort(list(DISTINCT split_part(p_name, ' ', 2))) AS keywords,
      (SELECT list_concat(list_sort(list(DISTINCT n_name)), [""" + _PLACES + """]) FROM nation) AS locations
      FROM part GROUP BY p_type)""",
    """grid AS (SELECT strategy, keywords[k + 1] AS keyword, locations[l + 1] AS location,
      CAST(k * len(locations) + l AS INTEGER) AS position
      FROM (SELECT *, unnest(range(len(locations))) AS l FROM
            (SELECT *, unnest(range(len(keywords))) AS k FROM strategies)))""",
]
_WATCHED = " OR ".join(f"contains('{w.lower()}', lower(location))" for w in JAPAN_LOCATIONS)
_CODES = "CASE lower(location) " + " ".join(
    f"WHEN '{name}' THEN {codes}" for name, codes in COUNTRY_CODES.items()) + " ELSE [location] END"
PLAN_SQL = [
    *GRID_SQL,
    f"""planned AS (SELECT strategy, keyword, location, position, unnest({DEFAULT_SOURCES}) AS source
      FROM grid WHERE NOT ({_WATCHED})
      UNION ALL SELECT strategy, keyword, NULL, min(position), 'japan_boards' FROM grid WHERE {_WATCHED}
      GROUP BY strategy, keyword)""",
]


def _with(sql: str, parts: list[str]) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + sql


@query("search_grid", _with("SELECT * FROM grid", GRID_SQL))
def _search_grid(spark, d):
    return search_grid(strategies(spark, d))


@query("expand_countries", _with(f"SELECT *, unnest({_CODES}) AS location_key FROM grid", GRID_SQL))
def _expand_countries(spark, d):
    return expand_countries(search_grid(strategies(spark, d)))


@query("route_locations", _with(
    f"SELECT *, CASE WHEN {_WATCHED} THEN 'japan' ELSE 'other' END AS route FROM grid", GRID_SQL))
def _route_locations(spark, d):
    return route_locations(search_grid(strategies(spark, d)))


@query("plan_sources", _with("SELECT * FROM planned", PLAN_SQL))
def _plan_sources(spark, d):
    return plan_sources(search_grid(strategies(spark, d)))


@query("filter_sites", """
SELECT page_id, url FROM (SELECT page_id, url,
    regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1) AS host,
    regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages)
WHERE host = 'example.com' OR host LIKE '%.example.com'
  OR ((host = 'example.net' OR host LIKE '%.example.net') AND (path = '/en' OR path LIKE '/en/%'))""")
def _filter_sites(spark, d):
    return filter_sites(table(spark, d, "pages").select("page_id", "url"), ["example.com", "example.net/en"])


_HITS = f"""
texts AS (SELECT id, source, lower(concat_ws(' ', title, description_text)) AS t,
  lower(coalesce(location, '')) AS w FROM postings),
hits AS (SELECT x.id, g.strategy, g.source, g.keyword, g.location, g.position FROM planned g JOIN texts x
    ON x.source = g.source AND contains(x.t, lower(g.keyword))
   AND (g.location IS NULL OR contains(x.w, lower(g.location)) OR contains(x.t, lower(g.location))))"""


@query("search_postings", with_postings(
    "SELECT id, strategy, keyword, location, position, source FROM hits",
    *PLAN_SQL, _HITS))
def _search_postings(spark, d):
    rows = postings(spark, d, "source", "title", "location", "description_text")
    grid = plan_sources(search_grid(strategies(spark, d)))
    return search_postings(rows, grid)


@query("collection_summary", with_postings(
    "SELECT (SELECT count(*) FROM postings) AS jobs_collected, (SELECT count(*) FROM grid) AS queries_run", *GRID_SQL))
def _collection_summary(spark, d):
    return ranking.collection_summary(postings(spark, d, "source"), search_grid(strategies(spark, d)))


# Keyword groups over the words of the part names.
PART_TAXONOMY = {
    "moving": ["gear", "rod"],
    "fixing": ["bolt", "ring", "plate"],
    "warm": ["hot", "red"],
    "cold": ["cold", "blue gear"],
}


@query("tag_taxonomy", with_postings(
    "SELECT id, concat_ws('|', " + ", ".join(
        "CASE WHEN " + " OR ".join(f"contains(lower(title), '{w}')" for w in words) + f" THEN '{name}' END"
        for name, words in sorted(PART_TAXONOMY.items())) + ") AS tags FROM postings"))
def _tag_taxonomy(spark, d):
    rows = postings(spark, d, "title")
    return rows.select("id", F.array_join(taxonomy_tags("title", PART_TAXONOMY), "|").alias("tags"))


@query("taxonomy_counts", with_postings(" UNION ALL ".join(
    f"SELECT '{name}' AS tag, count(*) AS jobs FROM postings WHERE "
    + " OR ".join(f"contains(lower(title), '{w}')" for w in words) for name, words in PART_TAXONOMY.items())))
def _taxonomy_counts(spark, d):
    rows = postings(spark, d, "title")
    return (rows.select(F.explode(taxonomy_tags("title", PART_TAXONOMY)).alias("tag"))
            .groupBy("tag").agg(F.count("*").alias("jobs")))


# Role wording put before part names, so that every domain occurs.
ROLES = ["GTM engineer", "Account Executive", "Genomics analyst", "Machine Learning lead", "civil engineer",
         "Channel manager", "Senior data engineer", "Clinical GTM intern", "welder"]
HEADLINE_SQL = ("concat(CASE p_size % 9 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(ROLES))
                + " END, ' ', p_name)")


@query("detect_domain", f"""SELECT p_partkey, CASE """ + " ".join(
    "WHEN " + " OR ".join(f"contains(h, '{s}')" for s in signals) + f" THEN '{domain}'"
    for domain, signals in DOMAIN_SIGNALS.items()) + f""" ELSE 'any' END AS domain
FROM (SELECT p_partkey, lower({HEADLINE_SQL}) AS h FROM part)""")
def _detect_domain(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.expr(HEADLINE_SQL).alias("headline"))
    return rows.select("p_partkey", detect_domain("headline").alias("domain"))
