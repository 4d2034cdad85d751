"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.llm.common import table
from shortlist.llm.fuzzy_lines import dedup_lines
from shortlist.llm.hamming import nearest_codes
from shortlist.llm.identifiers import KINDS, find_identifiers, listed
from shortlist.llm.language import held_out, predict_language, train_language
from shortlist.llm.lexical import lexical_search
from shortlist.llm.main_text import main_text
from shortlist.llm.near_copies import near_components
from shortlist.llm.packing import pack_tokens
from shortlist.llm.passages import drop_repeated_passages
from shortlist.llm.pieces import decode_pieces, encode_pieces
from shortlist.llm.quality import quality_rules
from shortlist.llm.spelling import spelling_variants
from shortlist.llm.url_filter import JUNK_PARTS, judge_urls, junk_hosts

#: Host, path and action of the rules that op13 applies.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
             ("net", "/fr/", "block")]


def bpe_files() -> dict[str, str]:
    """The 50k byte-level vocabulary in both of its forms."""
    import public_tokenizers

    return {"tokenizer_file": public_tokenizers.path("byte_bpe_50k.json"),
            "ranks_file": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_tokens(table(spark, sf_dir, "documents"), **bpe_files())
    return packed.select("doc_id", "start", "length", F.crc32("ids_le").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "tier", "step_group")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_language(docs.filter(~held_out(F.col("doc_id"))))
    return predict_language(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", "text")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_identifiers(table(spark, sf_dir, "documents")).select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(KINDS), 256).alias("base_sha256"), listed((*KINDS, "id")).alias("spans"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), size=3, percent=85)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and the CRC-32 of the text that decoding them gives."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents")
    coded = decode_pieces(encode_pieces(docs, model), model)
    return coded.select("doc_id", "ids", "n_ids", F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_passages(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", "n_grams", "ratio")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest_codes(rows, rows.filter("vec_id % 50 = 0"), k=10)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where no rule fits, hosts with a junk name part are blocked; the list of these is made from the table's own urls."""
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, spark.createDataFrame(URL_RULES, "host string, path string, action string"), junk_hosts(pages))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_language_id, op3_line_dedup, op4_pii, op5_minhash_near_dedup, op6_sentencepiece, op7_html_extraction,
    op8_substring_dedup, op9_quality_rules, op10_exact_topk, op11_spelling_variants, op12_lexical_search, op13_url_filter)}
ORACLE_SQL: dict[str, str] = {
    "op10_exact_topk": """
        WITH bits AS (
            SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) > 0 AS bit FROM embeddings),
        near AS (
            SELECT q.vec_id AS query_id, b.vec_id AS id, CAST(count(*) FILTER (WHERE q.bit <> b.bit) AS INTEGER) AS distance
            FROM bits q JOIN bits b ON q.i = b.i WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM near)
        SELECT query_id, id, distance, rank FROM ranked WHERE rank <= 10""",
    # CRC-32 as its definition states it: eight shifts a byte, over the bytes of the text in hexadecimal
    "op11_spelling_variants": r"""
        WITH RECURSIVE crc_table AS (
            SELECT list(c ORDER BY i) AS t FROM (
                SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
                FROM range(256) r(i))),
        runs AS (
            SELECT doc_id, run, count(*) AS k FROM (
                SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL),
        hashed AS (
            SELECT run, k, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
                       range(0, strlen(doc_id || ':' || run)),
                       lambda p: CAST('0x' || substring(hex(encode(doc_id || ':' || run)), 2 * p + 1, 2) AS BIGINT))),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
            FROM runs, crc_table),
        words AS (
            SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
                SELECT k, CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word
                FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
        skips AS (
            SELECT DISTINCT word, n, substring(word, 1, i) || '|' || substring(word, i + 2) AS hole, substring(word, 1, i) || substring(word, i + 2) AS rest
            FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
        near AS (
            SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM skips a JOIN skips b ON a.hole = b.hole AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM skips a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM skips a JOIN words b ON a.rest = b.word),
        best AS (
            SELECT word, count(*) AS n_near, arg_min({'w': other, 'm': m}, {'a': -m, 'b': other}) AS top FROM near GROUP BY word),
        formed AS (
            SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top.m >= 2 * w.n THEN b.top.w END AS form,
                   CASE WHEN b.top.m >= 2 * w.n THEN b.top.m END AS form_n
            FROM words w LEFT JOIN best b USING (word)),
        way AS (
            SELECT word, word AS last, 0 AS step FROM formed
            UNION ALL SELECT way.word, f.form, step + 1 FROM way JOIN formed f ON f.word = way.last WHERE f.form IS NOT NULL)
        SELECT f.word, n, n_near, form, form_n, r.root
        FROM formed f JOIN (SELECT word, arg_max(last, step) AS root FROM way GROUP BY word) r ON r.word = f.word""",
    "op12_lexical_search": r"""
        WITH terms AS (
            SELECT pos, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS pos, doc_id, text FROM documents)),
        asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark WHERE item_id IS NOT NULL),
        lengths AS (SELECT pos, any_value(doc_id) AS doc_id, count(*) AS n FROM terms GROUP BY pos),
        totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
        tfs AS (SELECT pos, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term, docs),
        scored AS (
            SELECT a.item_id, l.pos, l.doc_id,
                   CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
            FROM asked a JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths l ON l.pos = tfs.pos, totals
            WHERE l.doc_id IS NOT NULL GROUP BY ALL),
        ranked AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
            FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""",
    "op13_url_filter": """
        WITH parts AS (
            SELECT page_id, coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') AS raw,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        hosts AS (
            SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
        rules(host, path, action) AS (
            VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'),
                   ('net', '/fr/', 'block')),
        fits AS (
            SELECT h.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(action, length(r.host || r.path)) AS action
            FROM hosts h JOIN rules r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)
            GROUP BY h.page_id)
        SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.action, CASE WHEN list_has_any(
                   string_split_regex(h.host, '[.-]'), [%s]) THEN 'block' ELSE 'allow' END) AS verdict
        FROM hosts h LEFT JOIN fits f USING (page_id)""" % ", ".join(f"'{p}'" for p in JUNK_PARTS),
}
