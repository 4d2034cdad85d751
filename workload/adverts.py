"""Postings worded like job advertisements, and candidate profiles, made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from workload.searching import HEADLINE_SQL
from workload.tables import postings, table, table_rows

LEVELS = ["Senior", "Junior", "Head of", "Staff", "VP", "", "Lead", "Intern", "Director", ""]
SKILLS = ["python", "sql", "kafka", "spark", "dbt", "looker", "aws"]

_TITLE = ("trim(concat(CASE id % 10 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(LEVELS))
          + " END, ' ', headline))")
_TEXT = """concat(description_text, ' We need ', CAST(id % 13 AS STRING), '+ years of ',
  CASE id % 7 """ + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(SKILLS)) + """ END, ' and ',
  CASE id % 5 WHEN 0 THEN 'Python.' WHEN 1 THEN 'Node.js' WHEN 2 THEN 'n8n,' WHEN 3 THEN 'SQL;' ELSE 'tact' END,
  CASE id % 4 WHEN 0 THEN '. Part-time, USD 90,000 - 120,000.' WHEN 1 THEN '. Contract at $75000.'
    WHEN 2 THEN '. Full time.' ELSE '. Internship, EUR 40000 to 45000' END)"""

ADVERTS_SQL = f"""
adverts AS (SELECT id, source, company, location, url, similarity_score, {_TITLE} AS title, {_TEXT} AS description_text
  FROM (SELECT s.*, {HEADLINE_SQL.replace('p_size', 'q.p_size').replace('p_name', 'q.p_name')} AS headline
        FROM scored s LEFT JOIN part q ON q.p_partkey = s.id % (SELECT count(*) FROM part)))"""


def adverts(spark, d, *columns: str) -> DataFrame:
    """id, title and description_text of every posting, plus other posting columns."""
    rows = postings(spark, d, "description_text", *columns)
    part = table(spark, d, "part")
    heads = part.select("p_partkey", F.expr(HEADLINE_SQL).alias("headline"))
    rows = rows.join(heads, F.col("id") % F.lit(table_rows(spark, d, "part")) == F.col("p_partkey"), "left")
    return rows.select("id", *columns, F.expr(_TITLE).alias("title"), F.expr(_TEXT).alias("description_text"))


def profiles(spark, d) -> DataFrame:
    """One candidate profile per customer."""
    e = F.expr
    strings = "CAST(NULL AS array<string>)"
    nation = "concat('NATION_', CAST(c_nationkey AS STRING))"
    role = ("named_struct('role', concat(c_mktsegment, ' engineer {0}'), 'company', concat('Company ', CAST(c_custkey % 97 AS STRING)),"
            " 'summary', CASE WHEN c_custkey % 2 = 0 THEN 'Built  pipelines {0}' END, 'achievements',"
            " array(named_struct('description', 'Moved data {0}', 'impact', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Saved hours' END)),"
            " 'tech_used', array('Spark', 'tool{0}'))")
    return table(spark, d, "customer").select(
        e("c_custkey AS profile_id"), e(f"named_struct('full_name', c_name, 'location', {nation}) AS identity"),
        e("named_struct('headline', concat(lower(c_mktsegment), ' specialist'), 'elevator_pitch', "
          "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('Works in ', c_mktsegment) END) AS summary"),
        e("named_struct('things_to_emphasize', array('Clarity', '')) AS tone_and_style"),
        e(f"map('languages', array('Python', 'SQL'), 'sector', array(c_mktsegment, {nation})) AS technical_skills"),
        e("CASE WHEN c_custkey % 2 = 0 THEN map('bioinformatics_focus', array('genomics'), 'general', array('data', c_mktsegment))"
          " ELSE CAST(NULL AS map<string, array<string>>) END AS domain_expertise"),
        e("array(" + ", ".join(role.format(i) for i in range(1, 6)) + ") AS experience"),
        e("array(named_struct('name', 'Cloud')) AS certifications"),
        e("array(named_struct('name', 'Side', 'description', '', 'tech_used', array('Go'))) AS projects"),
        e("array('LLM', c_mktsegment) AS ats_keywords_pool"),
        e(f"named_struct('primary', array('Data Engineer'), 'secondary', {strings}) AS open_roles_targeted"),
        e("array(named_struct('degree', 'BSc', 'field', CAST(NULL AS STRING), 'institution', 'TU')) AS education"),
        e("named_struct('version', '1') AS _meta"))


_ROLE_TEXT = ("c_mktsegment || ' engineer {0} at Company ' || (c_custkey % 97) || "
              "CASE WHEN c_custkey % 2 = 0 THEN ' Built pipelines {0}' ELSE '' END || ' Moved data {0}' || "
              "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' Saved hours' END || ' Spark tool{0}'")
_SKILL_LINES = "'Python SQL Python SQL ' || c_mktsegment || ' NATION_' || c_nationkey || ' ' || c_mktsegment || ' NATION_' || c_nationkey"
PROFILE_TEXT_SQL = (
    "lower(c_mktsegment) || ' specialist' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE ' Works in ' || c_mktsegment END"
    " || ' Clarity ' || " + _SKILL_LINES
    + " || CASE WHEN c_custkey % 2 = 0 THEN ' genomics data ' || c_mktsegment || ' genomics' ELSE '' END || ' ' || "
    + " || ' ' || ".join(_ROLE_TEXT.format(i) for i in range(1, 6))
    + " || ' Cloud Side Go LLM ' || c_mktsegment || ' LLM ' || c_mktsegment || ' Data Engineer BSc TU'")
