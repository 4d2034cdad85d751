"""The postings view over the given tables, in Spark and as a SQL prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shortlist.operators.ranking import cosine_scores
from shortlist.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ROWS: dict[tuple[str, str], int] = {}


def table_rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Row count of a given table, which never changes."""
    if (sf_dir, name) not in _ROWS:
        _ROWS[sf_dir, name] = table(spark, sf_dir, name).count()
    return _ROWS[sf_dir, name]


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table read for heavy work on its texts."""
    return spread(table(spark, sf_dir, name).select(*columns))


_SENIORITY = ["Internship", "Entry level", "Associate", "Mid-Senior level", " Senior ", "Director",
              "Executive", "Not Applicable", "Staff"]

_OWN = {
    "source": """CASE doc_id % 4 WHEN 0 THEN 'builtin' WHEN 1 THEN 'linkedin' WHEN 2 THEN 'serper'
                 ELSE 'japan_boards' END""",
    "url": """CASE WHEN doc_id % 23 = 0 THEN ''
              ELSE concat('https://jobs.example.com/p/', CAST(doc_id * 7 div 10 AS STRING)) END""",
    "salary_min": """CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 17 = 0 THEN 'n/a'
                     ELSE CAST(50000 + (doc_id * 7919) % 150000 AS STRING) END""",
}
_PART = {
    "title": "p_name",
    "seniority_raw": "CASE p_size % 9 " + " ".join(
        f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SENIORITY[:-1])) + f" ELSE '{_SENIORITY[-1]}' END",
    "employment_type": """CASE p_size % 4 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'full-time'
                          WHEN 2 THEN 'Contract' ELSE NULL END""",
}
_LABEL = {
    "is_relevant": "CASE WHEN quality = 1 THEN 'True' WHEN quality = 0 THEN 'False' ELSE '' END",
    "expected_rank_tier": "CASE WHEN quality = 1 THEN 'top' WHEN quality = 0 THEN 'bottom' ELSE 'mid' END",
}
_ALL = ["title", "company", "location", "description_text", "lang", "source", "url", "seniority_raw",
        "employment_type", "salary_min", "is_relevant", "expected_rank_tier", "embedding", "strategy"]


def postings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One posting per document with the asked columns; only the tables they need are joined.

    Attributes are joined to the bare ids; the texts come last, in one join by id.
    """
    want = list(columns) or _ALL
    docs = table(spark, sf_dir, "documents")
    heavy = bool(set(want) & {"description_text", "lang"})
    rows = texts(spark, sf_dir, "documents", "doc_id") if heavy else docs.select("doc_id")

    def lookup(name: str, key: str, keep: list[str]) -> None:
        nonlocal rows
        side = table(spark, sf_dir, name)
        modulus = F.lit(table_rows(spark, sf_dir, name))
        hit = F.col("doc_id") % modulus == F.col(key)
        if name == "embeddings":
            hit = hit & (F.col("doc_id") % 11 != 3)
        rows = rows.join(side.select(key, *keep), hit, "left").drop(key)

    if set(want) & set(_PART):
        lookup("part", "p_partkey", ["p_name", "p_size"])
    if "company" in want:
        lookup("supplier", "s_suppkey", ["s_name"])
    if "location" in want:
        lookup("nation", "n_nationkey", ["n_name"])
    if set(want) & {"embedding", "strategy"}:
        lookup("embeddings", "vec_id",
               [c for c, w in (("embedding", "embedding"), ("label", "strategy")) if w in want])
    if set(want) & set(_LABEL):
        rows = rows.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    if heavy:
        rows = rows.join(texts(spark, sf_dir, "documents", "doc_id", "text", "lang"), "doc_id")
    plain = {"company": "s_name", "location": "n_name", "description_text": "text", "lang": "lang",
             "embedding": "embedding", "strategy": "label"}
    spell = {**_OWN, **_PART, **_LABEL, **plain}
    return rows.select(F.col("doc_id").alias("id"), *[F.expr(spell[c]).alias(c) for c in want])


def profile_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector standing for the candidate (one row)."""
    row = table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]]


def scored(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Postings with similarity_score instead of the vector."""
    rows = postings(spark, sf_dir, *columns, "embedding")
    return cosine_scores(rows, profile_vector(spark, sf_dir)).drop("embedding")


_POSTINGS_SQL = f"""
sizes AS (SELECT (SELECT count(*) FROM embeddings) AS n_vec, (SELECT count(*) FROM part) AS n_part,
                 (SELECT count(*) FROM supplier) AS n_supp, (SELECT count(*) FROM nation) AS n_nat),
docs AS (SELECT d.*, d.doc_id % n_vec AS vec_key, d.doc_id % n_part AS part_key,
                d.doc_id % n_supp AS supp_key, d.doc_id % n_nat AS nat_key FROM documents d, sizes),
postings AS (
SELECT d.doc_id AS id, p.p_name AS title, s.s_name AS company, n.n_name AS location,
  d.text AS description_text, d.lang AS lang,
  {_OWN['source'].replace('doc_id', 'd.doc_id')} AS source,
  {_OWN['url'].replace('doc_id', 'd.doc_id').replace(' div ', ' // ')} AS url,
  {_PART['seniority_raw']} AS seniority_raw,
  {_PART['employment_type']} AS employment_type,
  {_OWN['salary_min'].replace('doc_id', 'd.doc_id')} AS salary_min,
  {_LABEL['is_relevant']} AS is_relevant,
  {_LABEL['expected_rank_tier']} AS expected_rank_tier,
  e.embedding AS embedding, e.label AS strategy
FROM docs d
LEFT JOIN labels l ON l.doc_id = d.doc_id
LEFT JOIN embeddings e ON e.vec_id = d.vec_key AND d.doc_id % 11 <> 3
LEFT JOIN part p ON p.p_partkey = d.part_key
LEFT JOIN supplier s ON s.s_suppkey = d.supp_key
LEFT JOIN nation n ON n.n_nationkey = d.nat_key)"""


def with_postings(sql: str, *more: str) -> str:
    """SQL over the postings view; `more` are further named parts."""
    return "WITH " + ",\n".join([_POSTINGS_SQL.strip(), *more]) + "\n" + sql


SCORED_SQL = """
scored AS (SELECT p.*, list_cosine_similarity(p.embedding::DOUBLE[],
             (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS similarity_score
           FROM postings p)"""


def with_scored(sql: str, *more: str) -> str:
    return with_postings(sql, SCORED_SQL.strip(), *more)
