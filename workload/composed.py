"""Whole tasks: collect, score, rank, compare, score pages, rank a file."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from shortlist.lookups import SOURCE_PRIORITY
from shortlist.operators.embed import embed
from shortlist.plans.collect import collect_postings
from shortlist.plans.compare import compare_scored, compare_searches
from shortlist.plans.pages import score_pages
from shortlist.plans.rank import rank_file, top_jobs
from shortlist.plans.score import profile_row, score_postings
from shortlist.session import pin, scratch_path
from shortlist.sources import sinks
from shortlist.sources.ingest import scan_postings
from shortlist.streaming.arrivals import run_available, stream_score_text
from workload.adverts import PROFILE_TEXT_SQL, profiles
from workload.extraction import rules_sql
from workload.letters import LETTERS, letters_sql
from workload.ranking import RULES, _COMPARED, _EMPLOYED, _PAID, _RELEVANT, _SENIOR, _scored_by_strategy, _strategies
from workload.registry import query
from workload.searching import _CODES, PLAN_SQL, strategies
from workload.streams import stream_of
from workload.sqltext import best_text_sql, inner_html_sql, page_text_sql, words_sql
from workload.tables import postings, profile_vector, table, table_rows, texts, with_postings, with_scored

# -- one candidate: the customer with the smallest key ------------------------------

_ME_SQL = f"""me AS (SELECT {letters_sql('profile_text')} AS vec, * FROM (
  SELECT {PROFILE_TEXT_SQL} AS profile_text, c_name, c_mktsegment, c_nationkey FROM customer
  ORDER BY c_custkey LIMIT 1))"""


def _me(spark, d):
    everyone = profiles(spark, d)
    return everyone.orderBy("profile_id").limit(1)


@query("embed_batches", f"""
SELECT doc_id, round(v[1], 5) AS a, round(v[5], 5) AS e, round(list_sum(v), 5) AS total
FROM (SELECT doc_id, {letters_sql('text')} AS v FROM documents)""")
def _embed_batches(spark, d):
    rows = embed(texts(spark, d, "documents", "doc_id", "text"), "text", LETTERS)
    value = F.transform("embedding", lambda x: x.cast("double"))
    return rows.select("doc_id", F.round(value[0], 5).alias("a"), F.round(value[4], 5).alias("e"),
                       F.round(F.aggregate(value, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


# -- collect -----------------------------------------------------------------------------

def landed(spark, d):
    """The postings of each source under that source's own column names, landed as a table by source."""
    rows = postings(spark, d, "title", "company", "location", "description_text", "source", "url", "salary_min",
                    "seniority_raw")
    rows = spark.read.parquet(sinks.write_scored(rows, scratch_path(spark, "landed")))
    by = {name: rows.filter(F.col("source") == name) for name in SOURCE_PRIORITY}
    core = ["id", "title", "location"]
    return {
        "builtin": by["builtin"].select(*core, "company", "description_text", "url", "source",
                                        F.col("salary_min").alias("salary_json_min")),
        "linkedin": by["linkedin"].select(
            *core, F.col("company").alias("companyName"), F.col("description_text").alias("descriptionText"),
            F.col("url").alias("jobUrl"), F.col("seniority_raw").alias("seniorityLevel")),
        "serper": by["serper"].select(*core, F.lit("").alias("company"), "description_text", "url"),
        "japan_boards": by["japan_boards"].select(*core, F.lit("").alias("company"), "description_text", "url"),
    }


def _planned_strategies(spark, d):
    named = strategies(spark, d)
    return named.withColumn("job_domain", F.when(F.col("strategy") == "ECONOMY", "data")).withColumn(
        "position", F.expr(_PLACE.format("strategy")))


_PLACE = "(ascii({0}) * 256 + ascii(substring({0}, 2, 1)))"


def _collected_sql() -> list[str]:
    """Hits of all strategies and the surviving rows, as named parts."""
    return [
        *PLAN_SQL,
        f"""coded AS (SELECT strategy, source, keyword, place AS location, min(position) AS position FROM (
          SELECT strategy, source, keyword, position, unnest(CASE WHEN source = 'builtin' THEN {_CODES} ELSE [location] END) AS place
          FROM planned) GROUP BY ALL)""",
        """texts AS (SELECT *, lower(concat_ws(' ', title, description_text)) AS t, lower(coalesce(location, '')) AS w FROM postings)""",
        """hits AS (SELECT x.id, g.strategy, g.source, g.keyword, g.location AS place, g.position FROM coded g JOIN texts x
            ON x.source = g.source AND contains(x.t, lower(g.keyword))
           AND (g.location IS NULL OR contains(x.w, lower(g.location)) OR contains(x.t, lower(g.location))))""",
        f"""wanted AS (SELECT strategy, id, min(position) AS position FROM hits GROUP BY ALL)""",
        """collected AS (SELECT * FROM (SELECT p.*, w.strategy AS searched, row_number() OVER (
          PARTITION BY w.strategy, trim(coalesce(p.url, '')) ORDER BY CASE p.source WHEN 'builtin' THEN 1 WHEN 'linkedin' THEN 2
          WHEN 'serper' THEN 3 ELSE 4 END, w.position, p.id) AS rn
          FROM wanted w JOIN postings p USING (id) WHERE p.source = 'linkedin' OR trim(coalesce(p.url, '')) <> '') WHERE rn = 1)""",
    ]


def _collect_sql(*more: str, parts: list[str] | None = None) -> str:
    return with_postings(f"""
SELECT strategy, id, source, nullif(trim(url), '') AS url, title, company, job_domain, seniority, employment_type, min_years_exp,
  coalesce(nullif(raw_salary, ''), CAST(salary_min AS VARCHAR)) AS salary_min, is_relevant FROM (
  SELECT searched AS strategy, id, source, url, title,
    CASE WHEN source IN ('builtin', 'linkedin') THEN company ELSE '' END AS company,
    CASE WHEN searched = 'ECONOMY' THEN 'data' ELSE 'any' END AS job_domain,
    CASE WHEN source = 'builtin' THEN s END AS raw_salary,
    {rules_sql("CASE WHEN searched = 'ECONOMY' THEN 'false' ELSE 'true' END")}
  FROM (SELECT * EXCLUDE (salary_min), salary_min AS s, lower(title) AS h, lower(description_text) AS b, lower(title) || chr(10) || lower(description_text) AS t
        FROM (SELECT id, searched, source, url, title, company, salary_min, description_text FROM collected)))""",
        *more, *(parts or _collected_sql()))


def _collected_columns(out):
    return out.select("strategy", "id", "source", F.nullif(F.trim("url"), F.lit("")).alias("url"), "title",
                      F.coalesce("company", F.lit("")).alias("company"), "job_domain", "seniority",
                      "employment_type", "min_years_exp", "salary_min", "is_relevant")


@query("collect_postings", _collect_sql())
def _collect_postings(spark, d):
    return _collected_columns(collect_postings(landed(spark, d), _planned_strategies(spark, d)))


_PAGED = ("serper", "japan_boards")
_SITES = ["example.com", "example.net/en"]
_PAGED_SQL = f"""
shown AS (SELECT url, arg_min(body, page_id) AS body FROM (SELECT url, page_id, {page_text_sql('html')} AS body FROM pages) GROUP BY url),
paged AS (SELECT p.* REPLACE (
    CASE WHEN p.source IN {_PAGED} THEN g.url ELSE p.url END AS url,
    CASE WHEN p.source IN {_PAGED} AND length(f.body) > 100 THEN f.body ELSE p.description_text END AS description_text)
  FROM postings p LEFT JOIN pages g ON g.page_id = p.id % (SELECT count(*) FROM pages) LEFT JOIN shown f ON f.url = g.url
  WHERE p.source <> 'serper' OR regexp_matches(lower(g.url), '^[a-z]+://([^/?#]*[.])?(example[.]com([/?#:]|$)|example[.]net(:[0-9]+)?/en([/?#]|$))'))"""


@query("collect_pages", _collect_sql(_PAGED_SQL, parts=[re.sub(r"\bpostings\b", "paged", x) for x in _collected_sql()]))
def _collect_pages(spark, d):
    """Search hits of two sources lead to pages, those of one only on some sites; descriptions come from the pages."""
    by = landed(spark, d)
    pages = table(spark, d, "pages")
    n = table_rows(spark, d, "pages")
    for name in _PAGED:
        hits = by[name].withColumnRenamed("description_text", "description_snippet").drop("url")
        by[name] = hits.join(pages.select("page_id", "url"), F.col("id") % F.lit(n) == F.col("page_id"), "left").drop("page_id")
    return _collected_columns(collect_postings(by, _planned_strategies(spark, d), pages=pages, domains={"serper": _SITES}))


# -- score and rank ------------------------------------------------------------------------

@query("score_postings", with_postings(f"""
SELECT id, (embedding IS NULL OR id % 3 = 0) AS embedded_now, 'letters' AS embedding_model,
  round(CASE WHEN embedding IS NULL OR id % 3 = 0 THEN v[5] ELSE embedding[5]::DOUBLE END, 5) AS e
FROM (SELECT id, embedding, {letters_sql(best_text_sql())} AS v FROM postings)"""))
def _score_postings(spark, d):
    rows = postings(spark, d, "title", "company", "description_text", "embedding")
    rows = rows.withColumn("embedding_model", F.when(F.col("id") % 3 == 0, "older").otherwise("letters"))
    out = score_postings(rows, LETTERS)
    return out.select("id", "embedded_now", "embedding_model",
                      F.round(F.col("embedding")[4].cast("double"), 5).alias("e"))


@query("top_jobs", with_scored(f"""
SELECT title, company, location, employment_type, replace(title, ' ', '|') AS tech_stack, url,
  round(similarity_score, 6) AS similarity_score,
  concat('Matching skills: ', coalesce(nullif(array_to_string(list_sort([w for w in string_split(title, ' ') if w IN ('red', 'ring')]), ', '), ''), 'none'),
    '. Missing skills: ', coalesce(nullif(array_to_string(list_sort([w for w in string_split(title, ' ') if w NOT IN ('red', 'ring')]), ', '), ''), 'none'), '.') AS fit_explanation
FROM scored WHERE {_RELEVANT} AND {_SENIOR} AND {_EMPLOYED} AND {_PAID}
ORDER BY scored.similarity_score DESC NULLS LAST, id LIMIT 10"""))
def _top_jobs(spark, d):
    rows = postings(spark, d).withColumn("tech_stack", F.split("title", " "))
    ranking = top_jobs(rows, profile_vector(spark, d), 10, rules=RULES, skills=["red", "ring"])
    return (ranking.result.withColumn("tech_stack", F.array_join("tech_stack", "|"))
            .withColumn("similarity_score", F.round("similarity_score", 6)))


@query("score_and_rank_csv", with_scored(f"""
SELECT title, company, location, employment_type, coalesce(url, '') AS url, round(s.similarity_score, 6) AS similarity_score
FROM scored s WHERE {_RELEVANT} AND {_SENIOR} AND {_EMPLOYED} AND {_PAID}
ORDER BY s.similarity_score DESC NULLS LAST, title, company, s.url LIMIT 10"""))
def _score_and_rank_csv(spark, d):
    """Scored rows written as CSV without their ids, read again and ranked."""
    path = sinks.write_raw(postings(spark, d).drop("id"), scratch_path(spark, "scored"))
    ranking = top_jobs(scan_postings(spark, path), profile_vector(spark, d), 10, rules=RULES, explain=False)
    return ranking.result.select("title", "company", "location", "employment_type", F.coalesce("url", F.lit("")).alias("url"),
                                 F.round("similarity_score", 6).alias("similarity_score"))


@query("scan_mixed_files", """
SELECT s_name AS title, 'supplier ' || s_nationkey AS company, 'https://x.example.com/s' || s_suppkey AS url, NULL::VARCHAR AS salary FROM supplier
UNION ALL SELECT c_name, 'customer "' || c_nationkey || '", new', 'https://x.example.com/c' || c_custkey, CAST(c_custkey AS VARCHAR) FROM customer""")
def _scan_mixed_files(spark, d):
    """Two folders of files whose headers differ in order and number."""
    one = table(spark, d, "supplier").select(
        F.col("s_name").alias("title"), F.concat(F.lit("supplier "), "s_nationkey").alias("company"),
        F.concat(F.lit("https://x.example.com/s"), "s_suppkey").alias("url"))
    two = table(spark, d, "customer").select(
        F.concat(F.lit('customer "'), "c_nationkey", F.lit('", new')).alias("company"),
        F.concat(F.lit("https://x.example.com/c"), "c_custkey").alias("url"), F.col("c_name").alias("title"),
        F.col("c_custkey").cast("string").alias("salary"))
    paths = [sinks.write_raw(x, scratch_path(spark, "mixed")) for x in (one, two)]
    return scan_postings(spark, paths).select("title", "company", "url", "salary")


@query("top_jobs_summary", with_scored(f"""
SELECT count(*) AS total_filtered, count(similarity_score) AS total_scored, round(max(similarity_score), 6) AS max_score,
  round(min(similarity_score), 6) AS min_score, round(median(similarity_score), 6) AS median_score
FROM scored WHERE {_RELEVANT} AND {_SENIOR} AND {_EMPLOYED} AND {_PAID}"""))
def _top_jobs_summary(spark, d):
    ranking = top_jobs(postings(spark, d), profile_vector(spark, d), rules=RULES)
    return ranking.summary.select("total_filtered", "total_scored", *[
        F.round(c, 6).alias(c) for c in ("max_score", "min_score", "median_score")])


_LETTER_SCORED = f"list_cosine_similarity({{0}}, (SELECT vec FROM me))"


_RANKED_FILE = f"""
texts AS (SELECT title, company, description_text, t, {_LETTER_SCORED.format(letters_sql('t'))} AS s, {words_sql('t')} AS words
  FROM (SELECT *, {best_text_sql()} AS t FROM postings)),
best AS (SELECT row_number() OVER (ORDER BY s DESC, title, company) AS position, title, company, s, length(description_text) AS chars
  FROM texts WHERE s >= 0 QUALIFY position <= 10)"""


@query("rank_file", with_postings("""
SELECT 'ranked' AS part, position, title, company, round(s, 4) AS score, CAST(chars AS BIGINT) AS amount FROM best
UNION ALL SELECT 'digest', NULL, title, company, round(s, 4), CAST(chars AS BIGINT) FROM best
UNION ALL SELECT 'candidate', NULL, (SELECT c_name FROM me), NULL, NULL, (SELECT count(*) FROM best)
UNION ALL SELECT 'rows', NULL, NULL, NULL, round(max(s), 4), count(*) FROM texts
UNION ALL SELECT 'scored', NULL, NULL, NULL, round(median(s), 4), count(s) FROM texts
UNION ALL SELECT 'worst', NULL, NULL, NULL, round(min(s), 4), NULL FROM texts
UNION ALL SELECT 'short', NULL, NULL, NULL, NULL, count(*) FILTER (length(t) < 50) FROM texts
UNION ALL SELECT 'tokens', NULL, NULL, NULL, NULL, CAST(floor(sum(words) / 0.75) AS BIGINT) FROM texts""", _ME_SQL, _RANKED_FILE))
def _rank_file(spark, d):
    """The ranked rows, the digest's records, and the totals of a file without ids."""
    rows = postings(spark, d, "title", "company", "location", "description_text", "url")
    path = sinks.write_raw(rows, scratch_path(spark, "jobs"))
    out = rank_file(spark, path, _me(spark, d), LETTERS, 10)
    order = Window.orderBy(F.desc("similarity_score"), "title", "company")      # over ten rows
    best = out.top.select("title", "company", F.row_number().over(order).alias("position"), F.round("similarity_score", 4).alias("score"),
                          F.length("description_text").cast("long").alias("amount"))
    record = out.digest.select(F.from_json(
        "line", "title string, company string, similarity_score double, description_snippet string, candidate struct<name string>").alias("r"))
    none, summary = F.lit(None), pin(out.summary)

    def part(df, name, position=none, title=none, company=none, score=none, amount=none):
        return df.select(F.lit(name).alias("part"), position.cast("long").alias("position"), title.cast("string").alias("title"),
                         company.cast("string").alias("company"), score.cast("double").alias("score"), amount.cast("long").alias("amount"))

    c = F.col
    parts = [
        part(best, "ranked", c("position"), c("title"), c("company"), c("score"), c("amount")),
        part(record.filter("r.candidate IS NULL").select("r.*"), "digest", none, c("title"), c("company"), c("similarity_score"), F.length("description_snippet")),
        part(record.agg(F.max("r.candidate.name").alias("name"), F.count_if(c("r.candidate").isNull()).alias("n")), "candidate", none, c("name"), amount=c("n")),
        part(summary, "rows", score=F.round("max_score", 4), amount=c("total_filtered")),
        part(summary, "scored", score=F.round("median_score", 4), amount=c("total_scored")),
        part(summary, "worst", score=F.round("min_score", 4)),
        part(out.short_texts, "short", amount=c("short_texts")),
        part(out.tokens, "tokens", amount=c("full_tokens"))]
    return reduce(DataFrame.unionByName, parts)


# -- compare -------------------------------------------------------------------------------

@query("compare_scored", with_scored("""
SELECT 'strategy' AS part, CAST(strategy AS VARCHAR) AS name, jobs, median_score AS score FROM stats
UNION ALL SELECT 'winner', CAST(strategy AS VARCHAR), NULL, median_score FROM (SELECT * FROM stats ORDER BY median_score DESC, strategy LIMIT 1)
UNION ALL SELECT 'merged', title || '@' || company, NULL, score FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, strategy, rank) AS rn
  FROM leaders) WHERE rn = 1 QUALIFY row_number() OVER (ORDER BY score DESC, strategy, rank) <= 10""", *_COMPARED))
def _compare_scored(spark, d):
    out = compare_scored(_scored_by_strategy(spark, d), _strategies(spark, d))
    none = F.lit(None).cast("long").alias("jobs")
    return (out.strategies.select(F.lit("strategy").alias("part"), F.col("strategy").cast("string").alias("name"), "jobs",
                                  F.col("median_score").alias("score"))
            .unionByName(out.winner.select(F.lit("winner").alias("part"), F.col("winner").cast("string").alias("name"),
                                           none, F.col("median_score").alias("score")))
            .unionByName(out.merged.select(F.lit("merged").alias("part"),
                                           F.concat("title", F.lit("@"), "company").alias("name"), none, "score")))


_SEARCHED = f"""
found AS (SELECT searched AS strategy, {_PLACE.format('searched')} AS position, id, title, shown_company AS company, url,
    {_LETTER_SCORED.format(letters_sql('clean'))} AS s FROM (
  SELECT *, {best_text_sql(company='shown_company', fallback="CASE WHEN source IN ('builtin', 'linkedin') THEN description_text ELSE '' END")} AS clean
  FROM (SELECT *, CASE WHEN source IN ('builtin', 'linkedin') THEN company ELSE '' END AS shown_company FROM collected))),
stats AS (SELECT strategy, any_value(position) AS position, count(*) AS jobs, round(median(s), 4) AS median_score, round(avg(s), 4) AS mean_score,
  round(max(s), 4) AS max_score FROM found GROUP BY strategy),
leaders AS (SELECT strategy, position, title, coalesce(trim(url), '') AS url, round(s, 4) AS score,
  row_number() OVER (PARTITION BY strategy ORDER BY s DESC NULLS LAST, id) AS rank FROM found QUALIFY rank <= 5),
merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC NULLS LAST, position, rank) AS rn FROM leaders)
  WHERE rn = 1 QUALIFY row_number() OVER (ORDER BY score DESC NULLS LAST, position, rank) <= 10)"""


@query("compare_searches", with_postings("""
SELECT 'strategy' AS part, strategy AS name, NULL AS detail, jobs AS amount, median_score, mean_score, max_score FROM stats
UNION ALL SELECT 'winner', strategy, NULL, NULL, median_score, NULL, NULL FROM (SELECT * FROM stats ORDER BY median_score DESC, position LIMIT 1)
UNION ALL SELECT 'leader', strategy, title, rank, NULL, NULL, score FROM leaders
UNION ALL SELECT 'merged', strategy, title || '@' || url, NULL, NULL, NULL, score FROM merged
UNION ALL SELECT 'high', strategy, NULL, count(*) FILTER (s >= 0.55), NULL, NULL, NULL FROM found GROUP BY strategy
UNION ALL SELECT 'middle', strategy, NULL, count(*) FILTER (s >= 0.45 AND s < 0.55), NULL, NULL, NULL FROM found GROUP BY strategy
UNION ALL SELECT 'low', strategy, NULL, count(*) FILTER (s < 0.45), NULL, NULL, NULL FROM found GROUP BY strategy""",
    *_collected_sql(), _ME_SQL, _SEARCHED))
def _compare_searches(spark, d):
    """Statistics, winner, leaders, merged rows and distribution of all strategies' searches."""
    me = profile_row(_me(spark, d), LETTERS)
    out = compare_searches(landed(spark, d), _planned_strategies(spark, d), me["vector"], LETTERS)
    c, none = F.col, F.lit(None)

    def part(df, name, detail=none, amount=none, median=none, mean=none, best=none, key="strategy"):
        return df.select(F.lit(name).alias("part"), c(key).alias("name"), detail.cast("string").alias("detail"), amount.cast("long").alias("amount"),
                         *[x.cast("double").alias(f"{n}_score") for n, x in (("median", median), ("mean", mean), ("max", best))])

    spread_ = pin(out.distribution)
    merged = F.concat("title", F.lit("@"), F.coalesce(F.trim("url"), F.lit("")))
    return reduce(DataFrame.unionByName, [
        part(out.strategies.filter("error IS NULL"), "strategy", none, c("jobs"), c("median_score"), c("mean_score"), c("max_score")),
        part(out.winner, "winner", median=c("median_score"), key="winner"),
        part(out.leaders, "leader", c("title"), c("rank"), best=c("score")),
        part(out.merged, "merged", merged, best=c("score")),
        *[part(spread_, name, amount=c(name)) for name in ("high", "middle", "low")]])


@query("stream_score_text", f"""WITH {_ME_SQL}
SELECT doc_id, round({_LETTER_SCORED.format(letters_sql('text'))}, 5) AS similarity_score FROM documents""")
def _stream_score_text(spark, d):
    """Arriving documents, vectorised and scored as they come."""
    me = profile_row(_me(spark, d), LETTERS)
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "state")
    arrivals = stream_of(spark, d, "documents").select("doc_id", "text")
    run_available(stream_score_text(arrivals, me["vector"], LETTERS, F.col("text")).select("doc_id", "similarity_score"), out, state)
    return spark.read.parquet(out).select("doc_id", F.round("similarity_score", 5).alias("similarity_score"))


# -- pages -----------------------------------------------------------------------------------

_H1 = "(?is)<h1(?:[\\s/][^>]*)?>(.*?)</h1\\s*>"
_PAGE_STATUS = "CASE WHEN length(body) < 100 THEN 'error' WHEN length(body) < 1000 THEN 'thin' ELSE 'ok' END"


@query("score_pages", f"""WITH {_ME_SQL},
texts AS (SELECT page_id, url, {inner_html_sql(f"regexp_extract(html, '{_H1}', 1)")} AS title, {page_text_sql('html')} AS body FROM pages)
SELECT page_id, url, title, page_status, seniority, employment_type, min_years_exp, tech_stack,
  body AS description_text, CASE WHEN page_status <> 'error' THEN round(score, 4) END AS similarity_score, 'snipe' AS source
FROM (SELECT page_id, url, title, body, {_PAGE_STATUS} AS page_status, {rules_sql("'true'")},
        {_LETTER_SCORED.format(letters_sql(best_text_sql(title='title', company="''", text='body', fallback='body')))} AS score
      FROM (SELECT *, lower(title) AS h, lower(body) AS b, lower(title) || chr(10) || lower(body) AS t FROM texts))""")
def _score_pages(spark, d):
    me = profile_row(_me(spark, d), LETTERS)
    out = score_pages(texts(spark, d, "pages", "page_id", "url", "html"), me["vector"], LETTERS, me["profile_skills"])
    return out.select("page_id", "url", "title", "page_status", "seniority", "employment_type", "min_years_exp",
                      F.array_join("tech_stack", "|").alias("tech_stack"), "description_text", "similarity_score", "source")
