"""Columns, sources, de-duplication, texts and fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from shortlist.functions.fields import (canonical_seniority, parse_tech_stack, safe_number, salary_display)
from shortlist.functions.text import best_text, html_to_text, page_text, page_title, snippet, SNIPPET
from shortlist.lookups import CANONICAL_COLUMNS, SOURCE_PRIORITY
from shortlist.operators.dedup import dedup_keys, dedup_source_hits, dedup_url, source_rank
from shortlist.operators.enrich import enrich_descriptions
from shortlist.sources.ingest import (alias_cascade_builtin, alias_cascade_linkedin, conform_canonical,
                                      normalise_columns, search_hits_to_postings, tag_source, union_sources)
from workload.registry import query
from workload.sqltext import best_text_sql, html_text_sql, inner_html_sql, page_text_sql
from workload.tables import postings, table, table_rows, texts, with_postings

_RANK = ("CASE source WHEN 'builtin' THEN 1 WHEN 'linkedin' THEN 2 WHEN 'serper' THEN 3 "
         "WHEN 'japan_boards' THEN 4 ELSE 5 END")


def _first():
    return [F.asc(source_rank()), F.asc("id")]


# -- text -----------------------------------------------------------------------

@query("html_to_text", f"SELECT page_id, {html_text_sql('html')} AS page_text FROM pages")
def _html_to_text(spark, d):
    return texts(spark, d, "pages", "page_id", "html").select("page_id", html_to_text("html").alias("page_text"))


@query("page_text", f"SELECT page_id, {page_text_sql('html')} AS page_text FROM pages")
def _page_text(spark, d):
    return texts(spark, d, "pages", "page_id", "html").select("page_id", page_text("html").alias("page_text"))


_H1 = "(?is)<h1(?:[\\s/][^>]*)?>(.*?)</h1\\s*>"
_TITLE = "(?is)<title(?:[\\s/][^>]*)?>(.*?)</title\\s*>"


@query("page_title", f"""
SELECT page_id, {inner_html_sql(f"CASE WHEN regexp_matches(html, '{_H1}') THEN regexp_extract(html, '{_H1}', 1) ELSE regexp_extract(html, '{_TITLE}', 1) END")} AS title
FROM pages""")
def _page_title(spark, d):
    return texts(spark, d, "pages", "page_id", "html").select("page_id", page_title("html").alias("title"))


@query("best_text", with_postings(
    f"SELECT id, {best_text_sql(fallback='''concat(lang, ' ', description_text)''')} AS clean_text FROM postings"))
def _best_text(spark, d):
    rows = postings(spark, d, "title", "company", "description_text", "lang")
    spare = F.concat("lang", F.lit(" "), "description_text")
    return rows.select("id", best_text(fallback=spare).alias("clean_text"))


@query("snippets", with_postings(
    "SELECT id, " + ", ".join(f"substring(description_text, 1, {n}) AS {use}_snippet" for use, n in SNIPPET.items())
    + " FROM postings"))
def _snippets(spark, d):
    rows = postings(spark, d, "description_text")
    return rows.select("id", *[snippet("description_text", use).alias(f"{use}_snippet") for use in SNIPPET])


_ENRICHED = f"""
hits AS (SELECT d.doc_id AS id, CASE WHEN d.doc_id % 7 = 0 THEN '' ELSE p.url END AS url,
           'snippet ' || d.lang AS description_snippet, p.page_id
         FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)),
texts AS (SELECT url, {page_text_sql('html')} AS body FROM (
           SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM pages) WHERE rn = 1)"""


@query("enrich_descriptions", f"""WITH {_ENRICHED}
SELECT id, h.url, CASE WHEN length(t.body) > 100 THEN t.body ELSE description_snippet END AS description_text
FROM hits h LEFT JOIN texts t ON t.url = h.url AND h.url <> ''""")
def _enrich_descriptions(spark, d):
    pages = texts(spark, d, "pages", "page_id", "url", "html")
    docs = table(spark, d, "documents").select("doc_id", "lang")
    hits = docs.join(pages.select("page_id", "url"),
                     F.col("doc_id") % F.lit(table_rows(spark, d, "pages")) == F.col("page_id"), "left").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("url")).alias("url"),
        F.concat(F.lit("snippet "), "lang").alias("description_snippet"))
    return enrich_descriptions(hits, pages).select("id", "url", "description_text")


# -- fields -----------------------------------------------------------------------

@query("canonical_seniority", with_postings("""
SELECT id, seniority_raw, CASE WHEN seniority_raw IS NULL THEN NULL ELSE CASE lower(trim(seniority_raw))
  WHEN 'internship' THEN 'Intern' WHEN 'entry level' THEN 'Junior' WHEN 'associate' THEN 'Mid'
  WHEN 'mid-senior level' THEN 'Senior' WHEN 'senior' THEN 'Senior' WHEN 'director' THEN 'Director'
  WHEN 'executive' THEN 'VP' WHEN 'not applicable' THEN NULL WHEN '' THEN NULL
  ELSE seniority_raw END END AS seniority FROM postings"""))
def _canonical_seniority(spark, d):
    rows = postings(spark, d, "seniority_raw")
    return rows.select("id", "seniority_raw", canonical_seniority("seniority_raw").alias("seniority"))


@query("salary_display", """
SELECT c_custkey, CASE WHEN lo = 0 THEN NULL WHEN hi = 0 THEN concat(cur, ' ', format('{:,}', lo), '+')
  ELSE concat(cur, ' ', format('{:,}', lo), ' - ', format('{:,}', hi)) END AS salary
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS cur,
        CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE CAST(floor(abs(c_acctbal)) AS BIGINT) * 10 END AS lo,
        CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE CAST(floor(abs(c_acctbal)) AS BIGINT) * 12 END AS hi FROM customer)""")
def _salary_display(spark, d):
    base = F.floor(F.abs("c_acctbal"))
    rows = table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 3 == 0, "EUR").otherwise("").alias("cur"),
        F.when(F.col("c_custkey") % 5 == 0, 0).otherwise(base * 10).alias("lo"),
        F.when(F.col("c_custkey") % 4 == 0, 0).otherwise(base * 12).alias("hi"))
    return rows.select("c_custkey", salary_display("cur", "lo", "hi").alias("salary"))


@query("safe_number", with_postings(
    "SELECT id, salary_min, try_cast(trim(salary_min) AS DOUBLE) AS amount FROM postings"))
def _safe_number(spark, d):
    return postings(spark, d, "salary_min").withColumn("amount", safe_number("salary_min"))


@query("parse_tech_stack", """
SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN '' ELSE replace(p_name, ' ', '|') END AS tech_stack FROM part""")
def _parse_tech_stack(spark, d):
    words = F.split("p_name", " ")
    python_like = F.concat(F.lit("['"), F.array_join(words, "', '"), F.lit("']"))
    text = (F.when(F.col("p_size") % 10 == 0, "[]").when(F.col("p_size") % 2 == 0, python_like)
            .otherwise(F.to_json(words)))
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(parse_tech_stack(text), "|").alias("tech_stack"))


# -- columns and sources -------------------------------------------------------------

@query("normalise_columns", """
SELECT c_custkey AS id, c_name AS title, c_acctbal AS salary_min, CAST(c_nationkey AS INTEGER) AS workplace_type,
  c_mktsegment AS is_relevant FROM customer""")
def _normalise_columns(spark, d):
    raw = table(spark, d, "customer").select(
        F.col("c_custkey").alias(" ID"), F.col("c_name").alias("Title "), F.col("c_acctbal").alias("salary_json_min"),
        F.col("c_nationkey").alias("Workplace Type Enum"), F.lit("later").alias("salary_min"),
        F.col("c_mktsegment").alias("is_gtm_technical"))
    return normalise_columns(raw)


_CONFORMED = ["id", "title", "company", "url", "source", "description_text"]
_EMPTY = [c for c in CANONICAL_COLUMNS if c not in _CONFORMED]


@query("conform_canonical", with_postings(
    "SELECT id, title, company, url, source, description_text, "
    + ", ".join(f"'' AS {c}" for c in _EMPTY) + f""" FROM (
  SELECT *, row_number() OVER (PARTITION BY coalesce(title, ''), coalesce(company, ''), coalesce(url, '')
                               ORDER BY {_RANK}, id) AS rn FROM postings) WHERE rn = 1"""))
def _conform_canonical(spark, d):
    return conform_canonical(postings(spark, d, *_CONFORMED[1:]), _first())


_LINKEDIN_RAW = """
raw AS (SELECT id, CASE WHEN id % 3 = 0 THEN url ELSE '' END AS url,
  CASE WHEN id % 3 = 1 THEN url END AS jobUrl, url AS link, CASE WHEN id % 2 = 0 THEN company END AS company,
  concat(company, ' Inc') AS companyName, CASE WHEN id % 5 = 0 THEN description_text END AS descriptionText,
  lang AS description, employment_type AS employmentType, 'Permanent' AS contractType,
  CASE WHEN id % 2 = 1 THEN '2026-01-01' END AS postedAt, '2025-12-31' AS postedDate,
  'remote' AS workType, seniority_raw AS seniorityLevel FROM postings)"""


@query("alias_cascade_linkedin", with_postings("""
SELECT id, coalesce(nullif(trim(url), ''), nullif(trim(jobUrl), ''), nullif(trim(link), '')) AS url,
  coalesce(nullif(trim(company), ''), companyName) AS company,
  coalesce(nullif(trim(descriptionText), ''), description) AS description_text, description,
  coalesce(employmentType, contractType) AS employment_type, coalesce(postedAt, postedDate) AS date_posted,
  workType AS workplace_type, CASE lower(trim(seniorityLevel))
  WHEN 'internship' THEN 'Intern' WHEN 'entry level' THEN 'Junior' WHEN 'associate' THEN 'Mid'
  WHEN 'mid-senior level' THEN 'Senior' WHEN 'senior' THEN 'Senior' WHEN 'director' THEN 'Director'
  WHEN 'executive' THEN 'VP' WHEN 'not applicable' THEN NULL ELSE seniorityLevel END AS seniority, 'linkedin' AS source
FROM raw""", _LINKEDIN_RAW))
def _alias_cascade_linkedin(spark, d):
    rows = postings(spark, d, "url", "company", "description_text", "lang", "employment_type", "seniority_raw")
    n = F.col("id")
    raw = rows.select(
        "id", F.when(n % 3 == 0, F.col("url")).otherwise("").alias("url"),
        F.when(n % 3 == 1, F.col("url")).alias("jobUrl"), F.col("url").alias("link"),
        F.when(n % 2 == 0, F.col("company")).alias("company"), F.concat("company", F.lit(" Inc")).alias("companyName"),
        F.when(n % 5 == 0, F.col("description_text")).alias("descriptionText"), F.col("lang").alias("description"),
        F.col("employment_type").alias("employmentType"), F.lit("Permanent").alias("contractType"),
        F.when(n % 2 == 1, "2026-01-01").alias("postedAt"), F.lit("2025-12-31").alias("postedDate"),
        F.lit("remote").alias("workType"), F.col("seniority_raw").alias("seniorityLevel"))
    return alias_cascade_linkedin(raw).select(
        "id", "url", "company", "description_text", "description", "employment_type", "date_posted",
        "workplace_type", "seniority", "source")


@query("alias_cascade_builtin", with_postings("""
SELECT id, CASE WHEN id % 2 = 0 THEN 'hybrid' ELSE 'onsite' END AS workplace_type, description_text AS description,
  '2026-02-02' AS postedDate, nullif(trim(seniority_raw), '') AS experienceLevel, lang AS category_raw,
  CASE WHEN try_cast(salary_min AS DOUBLE) > 0 THEN concat('USD ', format('{:,}', CAST(salary_min AS BIGINT)), '+') END AS salary
FROM (SELECT *, CASE WHEN try_cast(salary_min AS BIGINT) IS NULL THEN NULL ELSE salary_min END AS s FROM postings)"""
.replace("CAST(salary_min AS BIGINT)", "try_cast(salary_min AS BIGINT)")))
def _alias_cascade_builtin(spark, d):
    rows = postings(spark, d, "description_text", "seniority_raw", "lang", "salary_min")
    n = F.col("id")
    raw = rows.select(
        "id", F.when(n % 2 == 0, "hybrid").otherwise("").alias("workplace_type"), F.lit("onsite").alias("workType"),
        F.lit(None).cast("string").alias("description"), "description_text", F.lit("2026-02-02").alias("date_posted"),
        F.col("seniority_raw").alias("seniority"), F.col("lang").alias("category"),
        F.col("salary_min").alias("salary_json_min"))
    return alias_cascade_builtin(raw).select(
        "id", "workplace_type", "description", "postedDate", "experienceLevel", "category_raw", "salary")


@query("tag_source", "SELECT page_id, 'snipe' AS source FROM pages")
def _tag_source(spark, d):
    return tag_source(table(spark, d, "pages").select("page_id"), "snipe")


@query("search_hits_to_postings", """
SELECT page_id, CAST(i AS INTEGER) AS hit, concat(CASE i WHEN 0 THEN 'first ' ELSE 'second ' END, url) AS title,
  CASE i WHEN 0 THEN url ELSE concat(url, '/2') END AS url, '' AS company, '' AS location,
  CASE i WHEN 0 THEN 'one' ELSE '' END AS description_snippet, 'serper' AS source
FROM pages, (SELECT unnest([0, 1]) AS i)""")
def _search_hits_to_postings(spark, d):
    def hit(title, link, text):
        return F.struct(title.alias("title"), link.alias("link"), text.alias("snippet"))

    url = F.col("url")
    responses = table(spark, d, "pages").select("page_id", F.array(
        hit(F.concat(F.lit("first "), url), url, F.lit("one")),
        hit(F.concat(F.lit("second "), url), F.concat(url, F.lit("/2")), F.lit(None).cast("string"))
    ).alias("organic"))
    return search_hits_to_postings(responses, "serper")


@query("union_sources", with_postings(f"""
SELECT id, source, CASE WHEN source = 'linkedin' THEN company END AS company, title,
  CAST({_RANK} - 1 AS INTEGER) AS priority FROM postings"""))
def _union_sources(spark, d):
    rows = postings(spark, d, "source", "company", "title")
    frames = {name: rows.filter(F.col("source") == name) for name in SOURCE_PRIORITY}
    frames = {name: df if name == "linkedin" else df.drop("company") for name, df in frames.items()}
    return union_sources(frames, SOURCE_PRIORITY)


# -- de-duplication ---------------------------------------------------------------

def _first_by(keys: str, where: str = "TRUE") -> str:
    return with_postings(f"""
SELECT id, source, url, title FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {_RANK}, id) AS rn FROM postings WHERE {where})
WHERE rn = 1""")


_DEDUP = ("source", "url", "title")
_URL = "trim(coalesce(url, ''))"


@query("dedup_url", _first_by(_URL))
def _dedup_url(spark, d):
    return dedup_url(postings(spark, d, *_DEDUP), _first())


@query("dedup_url_keep_blank", _first_by(f"CASE WHEN {_URL} = '' THEN concat('#', id) ELSE {_URL} END"))
def _dedup_url_keep_blank(spark, d):
    return dedup_url(postings(spark, d, *_DEDUP), _first(), keep_blank=True)


@query("dedup_source_hits", _first_by(f"source, {_URL}", f"{_URL} <> ''"))
def _dedup_source_hits(spark, d):
    return dedup_source_hits(postings(spark, d, *_DEDUP), _first(), ("source",))


@query("dedup_title_company_url", _first_by("coalesce(title, ''), coalesce(company, ''), coalesce(url, '')"))
def _dedup_title_company_url(spark, d):
    return dedup_keys(postings(spark, d, *_DEDUP, "company"), _first()).drop("company")
