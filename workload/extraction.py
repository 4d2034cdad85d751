"""Extraction batches, responses, rules, explanations and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from shortlist.functions.text import best_text
from shortlist.lookups import DOMAIN_ROLES, TECH_VOCABULARY
from shortlist.operators import enrich, explain
from shortlist.operators.profile import profile_skills, profile_text
from shortlist.operators.ranking import cosine_scores, top_k
from workload.adverts import ADVERTS_SQL, PROFILE_TEXT_SQL, adverts, profiles
from workload.registry import query
from workload.sqltext import best_text_sql, words_sql
from workload.tables import postings, profile_vector, table, with_postings, with_scored

_PLACED = """
placed AS (SELECT id, source, title, description_text, (rn - 1) // 20 AS batch, CAST((rn - 1) % 20 AS INTEGER) AS idx
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS rn FROM postings))"""


@query("batch_positions", with_postings("SELECT id, source, batch, idx FROM placed", _PLACED))
def _batch_positions(spark, d):
    return enrich.batch_positions(postings(spark, d, "source"))


@query("extraction_batches", with_postings("""
SELECT source, batch, CAST(count(*) AS INTEGER) AS postings, max(title) FILTER (idx = 0) AS first_title,
  CAST(sum(length(description_text)) AS BIGINT) AS chars,
  md5(string_agg(concat(title, '|', description_text), '|' ORDER BY idx)) AS digest FROM placed GROUP BY source, batch""", _PLACED))
def _extraction_batches(spark, d):
    rows = postings(spark, d, "source", "title", "company", "description_text")
    out = enrich.extraction_batches(rows)
    items = F.from_json("payload", "array<struct<idx:int,title:string,description:string>>")
    return out.select(
        "source", "batch", "postings", F.get_json_object("payload", "$[0].title").alias("first_title"),
        F.aggregate(items, F.lit(0).cast("bigint"), lambda a, i: a + F.length(i["description"])).alias("chars"),
        F.md5(F.array_join(F.transform(items, lambda i: F.concat(i["title"], F.lit("|"), i["description"])), "|").cast("binary")).alias("digest"))


# One response per part, in six shapes: array, object with a list, one object, one object with a
# list of strings, a cut-off text, and an empty array.
_ITEM = """concat('{"seniority":"', {0}, '","min_years_exp":', CAST(p_size AS STRING), ',"tech_stack":["', split_part(p_name, ' ', 1), '","sql"]}')"""
_RESPONSE = ("CASE p_partkey % 6 WHEN 0 THEN concat('[', " + _ITEM.replace("{0}", "'Senior'") + ", ',', "
             + _ITEM.replace("{0}", "'Lead'") + ", ']') WHEN 1 THEN concat('{\"note\":\"x\",\"jobs\":[', "
             + _ITEM.replace("{0}", "'Mid'") + ", ']}') WHEN 2 THEN " + _ITEM.replace("{0}", "'Staff'")
             + " WHEN 3 THEN concat('{\"tech_stack\":[\"', p_name, '\"],\"seniority\":null}') WHEN 4 THEN '[{\"seniority\":\"Se'"
             " ELSE '[]' END")
_SENT = "sent AS (SELECT *, p_partkey % 6 AS shape, split_part(p_name, ' ', 1) || '|sql' AS pair FROM part)"


@query("parse_extraction", f"""WITH {_SENT}
SELECT p_partkey, shape = 4 AS failed, CASE WHEN shape < 4 THEN 0 END AS idx,
  CASE shape WHEN 0 THEN 'Senior' WHEN 1 THEN 'Mid' WHEN 2 THEN 'Staff' END AS seniority,
  CASE WHEN shape < 3 THEN p_size END AS min_years_exp, CASE WHEN shape < 3 THEN pair WHEN shape = 3 THEN p_name END AS tech_stack,
  CASE WHEN shape < 3 THEN 'min_years_exp,seniority,tech_stack' WHEN shape = 3 THEN 'seniority,tech_stack' END AS returned
FROM sent
UNION ALL SELECT p_partkey, false, 1, 'Lead', p_size, pair, 'min_years_exp,seniority,tech_stack' FROM sent WHERE shape = 0""")
def _parse_extraction(spark, d):
    responses = table(spark, d, "part").select("p_partkey", F.expr(_RESPONSE).alias("response"))
    out = enrich.parse_extraction(responses)
    return out.select(
        "p_partkey", "failed", "idx", "fields.seniority", "fields.min_years_exp",
        F.array_join("fields.tech_stack", "|").alias("tech_stack"),
        F.array_join(F.array_sort("returned"), ",").alias("returned"))


@query("merge_extraction", with_postings("""
SELECT id, CASE WHEN batch % 4 <> 1 AND idx < 15 THEN CASE WHEN id % 3 = 0 THEN NULL ELSE 'Senior' END ELSE seniority_raw END AS seniority,
  employment_type, CASE WHEN batch % 4 <> 1 AND idx < 15 THEN CAST(id % 9 AS INTEGER) END AS min_years_exp,
  CASE WHEN batch % 4 <> 1 AND idx < 15 THEN '["sql"]' END AS tech_stack FROM placed JOIN postings USING (id)""",
    _PLACED.replace("id, source, title, description_text,", "id,")))
def _merge_extraction(spark, d):
    rows = postings(spark, d, "source", "seniority_raw", "employment_type")
    raw = (rows.withColumnRenamed("seniority_raw", "seniority").withColumn("tech_stack", F.lit(None).cast("string"))
           .join(enrich.batch_positions(rows), ["id", "source"]))
    level = F.when(F.col("id") % 3 == 0, "null").otherwise('"Senior"')
    item = F.concat(F.lit('{"seniority":'), level, F.lit(',"tech_stack":["sql"],"min_years_exp":'),
                    (F.col("id") % 9).cast("string"), F.lit("}"))
    # answers stop after 15 postings, and every fourth batch fails
    answers = (raw.filter("idx < 15").groupBy("source", "batch")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", item.alias("item")))),
                                             lambda x: x["item"]), ",").alias("items"))
               .select("source", "batch", F.when(F.col("batch") % 4 == 1, "sorry, no")
                       .otherwise(F.concat(F.lit("["), "items", F.lit("]"))).alias("response")))
    out = enrich.merge_extraction(raw, enrich.parse_extraction(answers))
    return out.select("id", "seniority", "employment_type", "min_years_exp", "tech_stack")


def _first_word_sql(text: str, table_: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{enrich.word_pattern(words)}') THEN '{value}'"
                              for value, words in table_.items()) + " END"


_ROLE = "coalesce(" + ", ".join(f"CASE WHEN contains(h, '{r}') THEN '{r}' END" for r in DOMAIN_ROLES["data"]) + ")"
_VOCABULARY = str([v for v in TECH_VOCABULARY if "." not in v])
_DOTTED = enrich.word_pattern([r"node\.js"])     # the one name with a dot


def _amount_sql(group: int) -> str:
    """Bound of the salary with its currency before it, or else behind it, in units."""
    before, behind = (f"regexp_replace(regexp_extract(t, '{p}', {group}), '[,\\s]', '', 'g')" for p in (enrich.SALARY, enrich.SALARY_BEHIND))
    text = f"CASE WHEN regexp_matches(t, '{enrich.SALARY}') THEN {before} ELSE {behind} END"
    return f"CASE WHEN ends_with({text}, 'k') THEN CAST(replace({text}, 'k', '') AS DOUBLE) * 1000 ELSE CAST(nullif({text}, '') AS DOUBLE) END"


def rules_sql(role: str) -> str:
    """Rule-extracted fields over columns h (title), b (text) and t (both), all in lower case."""
    return f"""coalesce({_first_word_sql('h', enrich.SENIORITY_WORDS)}, {_first_word_sql('b', enrich.SENIORITY_WORDS)}, 'Mid') AS seniority,
  coalesce({_first_word_sql('t', enrich.EMPLOYMENT_WORDS)}, 'Full-time') AS employment_type,
  coalesce(list_min([CAST(n AS INTEGER) FOR n IN regexp_extract_all(t, '{enrich.YEARS}', 1) IF length(n) <= 2]), 0) AS min_years_exp,
  {_amount_sql(1)} AS salary_min,
  {_amount_sql(2)} AS salary_max,
  array_to_string(list_sort(list_concat(list_distinct([w for w in regexp_split_to_array(t, '{enrich.WORD_BREAK}')
    if list_contains({_VOCABULARY}, w)]), CASE WHEN regexp_matches(t, '{_DOTTED}') THEN ['node.js'] ELSE [] END)), '|') AS tech_stack,
  {role} AS is_relevant"""


_LOWERED = "lower(title) AS h, lower(description_text) AS b, lower(title) || chr(10) || lower(description_text) AS t"


@query("rule_extract", with_scored(f"""
SELECT id, {rules_sql(f"CASE WHEN {_ROLE} IS NULL THEN 'false' ELSE 'true' END")},
  CASE WHEN {_ROLE} IS NULL THEN 'title names no data role' ELSE 'title names ' || {_ROLE} END AS reason
FROM (SELECT id, {_LOWERED} FROM adverts)""", ADVERTS_SQL))
def _rule_extract(spark, d):
    out = enrich.rule_extract(adverts(spark, d), "data")
    return out.select("id", "seniority", "employment_type", "min_years_exp", "salary_min", "salary_max",
                      F.array_join("tech_stack", "|").alias("tech_stack"), "is_relevant", "reason")


def _top(spark, d, *columns):
    """The ten best by key and score; their other columns are fetched for these ten alone."""
    best = top_k(cosine_scores(postings(spark, d, "embedding"), profile_vector(spark, d)), 10)
    return postings(spark, d, *columns).join(F.broadcast(best.select("id", "similarity_score")), "id")


_TOP10 = "best AS (SELECT * FROM scored ORDER BY similarity_score DESC NULLS LAST, id LIMIT 10)"


@query("explain_requests", with_scored("""
SELECT id, 'fit_explanation' AS task, 'I build pipelines.' AS candidate, coalesce(title, '') AS title, coalesce(company, '') AS company,
  coalesce(location, '') AS location, printf('%.3f', similarity_score) AS score,
  '["' || replace(title, ' ', '","') || '"]' AS skills_asked, description_text AS description
FROM best WHERE id % 3 <> 0""", _TOP10))
def _explain_requests(spark, d):
    top = _top(spark, d, "title", "company", "location", "description_text")
    top = top.withColumn("tech_stack", F.split("title", " ")).withColumn(
        "fit_explanation", F.when(F.col("id") % 3 == 0, "known"))
    sent = F.from_json("request", "task string, candidate string, title string, company string, location string, score string, "
                       "skills_asked string, description string")
    return explain.explain_requests(top, "I build pipelines.").select("id", sent.alias("r")).select("id", "r.*")


@query("explain_overlap", with_scored("""
SELECT id, CASE WHEN id % 3 = 0 THEN 'known' ELSE concat('Matching skills: ',
  coalesce(nullif(array_to_string(list_sort([w for w in string_split(title, ' ') if w IN ('red', 'small', 'ring', 'hot')]), ', '), ''), 'none'),
  '. Missing skills: ',
  coalesce(nullif(array_to_string(list_sort([w for w in string_split(title, ' ') if w NOT IN ('red', 'small', 'ring', 'hot')]), ', '), ''), 'none'),
  '.') END AS fit_explanation FROM best""", _TOP10))
def _explain_overlap(spark, d):
    top = _top(spark, d, "title").withColumn("tech_stack", F.split("title", " ")).withColumn(
        "fit_explanation", F.when(F.col("id") % 3 == 0, "known"))
    return explain.explain_overlap(top, ["red", "small", "ring", "hot"]).select("id", "fit_explanation")


_CANDIDATE = "(SELECT c_name FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer))"


def _candidate(spark, d) -> str:
    return table(spark, d, "customer").agg(F.min_by("c_name", "c_custkey")).first()[0]


def _digest(spark, d):
    top = _top(spark, d, "title", "company", "location", "url", "description_text")
    return explain.match_digest(top, _candidate(spark, d), "1")


@query("match_digest", with_scored(f"""
SELECT {_CANDIDATE} AS candidate, NULL::VARCHAR AS title, NULL::VARCHAR AS company, NULL::VARCHAR AS location, NULL::VARCHAR AS url,
  NULL::DOUBLE AS score, NULL::VARCHAR AS description
UNION ALL SELECT NULL, title, company, location, nullif(url, ''), round(similarity_score, 4),
  description_text FROM best""", _TOP10))
def _match_digest(spark, d):
    def field(path):
        return F.get_json_object("line", path)

    return _digest(spark, d).select(
        field("$.candidate.name").alias("candidate"), field("$.title").alias("title"), field("$.company").alias("company"),
        field("$.location").alias("location"), field("$.url").alias("url"),
        field("$.similarity_score").cast("double").alias("score"),
        field("$.description_snippet").alias("description"))


_RECORD = """CAST(to_json({'title': title, 'company': company, 'location': location, 'url': nullif(url, ''),
  'similarity_score': round(similarity_score, 4), 'description_snippet': description_text}) AS VARCHAR)"""


@query("token_estimate", with_scored(f"""
SELECT CAST(floor(f / 0.75) AS BIGINT) AS full_tokens, CAST(floor(s / 0.75) AS BIGINT) AS digest_tokens,
  round(100 * floor(s / 0.75) / floor(f / 0.75), 1) AS percent
FROM (SELECT (SELECT sum({words_sql('t')}) FROM (SELECT {best_text_sql()} AS t FROM scored)) AS f,
             (SELECT sum({words_sql(_RECORD)}) FROM best)
             + (SELECT {words_sql("CAST(to_json({'candidate': {'name': " + _CANDIDATE + ", 'profile_version': '1'}}) AS VARCHAR)")}) AS s)""", _TOP10))
def _token_estimate(spark, d):
    rows = postings(spark, d, "title", "company", "description_text")
    return explain.token_estimate(rows.select(best_text(fallback=None).alias("clean_text")), _digest(spark, d))


@query("profile_text", f"SELECT c_custkey AS profile_id, {PROFILE_TEXT_SQL} AS profile_text FROM customer")
def _profile_text(spark, d):
    return profile_text(profiles(spark, d)).select("profile_id", "profile_text")


@query("profile_skills", """
SELECT c_custkey AS profile_id, array_to_string(list_sort(list_distinct(['python', 'sql', lower(c_mktsegment),
  'nation_' || c_nationkey, 'spark', 'tool1', 'tool2', 'tool3', 'tool4', 'tool5', 'llm'])), '|') AS profile_skills FROM customer""")
def _profile_skills(spark, d):
    return profile_skills(profiles(spark, d)).select(
        "profile_id", F.array_join("profile_skills", "|").alias("profile_skills"))
