"""Page texts and extracted fields joined onto postings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from shortlist.functions.fields import contains_any
from shortlist.functions.text import MIN_TEXT, bind, blank_to_null, page_text
from shortlist.lookups import DOMAIN_ROLES, TECH_VOCABULARY
from shortlist.operators.groups import numbered
from shortlist.schema import EXTRACTED

BATCH = 20


def enrich_descriptions(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Description from the fetched page if it is long enough, else the search snippet.

    Hits without url get a key of their own, so they spread over all tasks.
    """
    # chosen on keys alone, and only among urls that hits have; the text of no other page is made
    asked = hits.select(F.col("url").alias("_key")).distinct()
    first = pages.groupBy(F.col("url").alias("_key")).agg(F.min("page_id").alias("_page_id")).join(asked, "_key", "left_semi")
    page = (pages.join(first, (pages["url"] == first["_key"]) & (pages["page_id"] == first["_page_id"]))
            .select("_key", page_text("html").alias("_page")).dropDuplicates(["_key"]))
    key = F.coalesce(blank_to_null("url"), F.concat(F.lit("#"), F.col("id").cast("string")))
    body = F.when(F.length("_page") > MIN_TEXT, F.col("_page")).otherwise(F.col("description_snippet"))
    return (hits.withColumn("_key", key).join(page, "_key", "left")
            .withColumn("description_text", body).withColumn("description", body)
            .drop("_key", "_page"))


def extraction_batches(df: DataFrame, size: int = BATCH) -> DataFrame:
    """Consecutive groups of `size` postings per source, as JSON request payloads with the whole texts.

    Positions come from a range sort, so a source with most of the postings is numbered by many
    tasks. Only ids are sorted; texts join back by id and meet again in groups of at most `size`.
    """
    placed = batch_positions(df, size)
    sent = df.select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "company")],
                     F.coalesce("description_text", F.lit("")).alias("description"))
    item = F.struct("idx", "title", "company", "description")
    return (sent.join(placed, "id").groupBy("source", "batch")
            .agg(F.array_sort(F.collect_list(item)).alias("items"))
            .select("source", "batch", F.size("items").alias("postings"),
                    F.to_json("items").alias("payload")))


def batch_positions(df: DataFrame, size: int = BATCH) -> DataFrame:
    """(id, source, batch, idx) of every posting."""
    placed = numbered(df.select("source", "id"), ["source"], ["id"])
    return placed.select("id", "source", F.floor(F.col("position") / size).alias("batch"),
                         (F.col("position") % size).cast("int").alias("idx"))


def parse_extraction(responses: DataFrame, col: str = "response") -> DataFrame:
    """One row per item of an extraction response, with typed fields and the keys it had.

    A response is an array, an object whose first list of objects is the array, or one object.
    Anything else, an object that names a key twice included, yields one row with failed = true.
    The text is parsed once; a value of another type than its field's is null, and only that field.
    """
    rest = [c for c in responses.columns if c != col]

    def as_list(value: Column) -> Column:
        return F.try_variant_get(value, "$", "array<variant>")

    def as_object(value: Column) -> Column:
        return F.try_variant_get(value, "$", "map<string,variant>")

    def of_objects(_: Column, value: Column) -> Column:
        return (F.size(as_list(value)) == 0) | as_object(F.get(as_list(value), F.lit(0))).isNotNull()

    whole = responses.select(*rest, F.trim(F.col(col)).alias("_text"), F.try_parse_json(F.trim(F.col(col))).alias("_whole"))
    members = whole.withColumn("_members", as_object(F.col("_whole")))
    lists = members.withColumn("_lists", F.map_filter("_members", lambda k, v: F.coalesce(of_objects(k, v), F.lit(False))))
    # a parsed object has its keys by name; only where several are lists does the order in the text count
    names = F.when(F.size("_lists") > 1, F.filter(F.json_object_keys("_text"), lambda k: F.map_contains_key("_lists", k)))
    first = F.get(F.coalesce(names, F.map_keys("_lists")), F.lit(0))
    single = F.when((F.size("_members") > 0) & (F.size("_lists") == 0), F.array("_whole"))
    items = lists.select(*rest, F.coalesce(as_list(F.col("_whole")), as_list(F.try_element_at("_lists", first)), single).alias("_items"))
    rows = items.select(*rest, F.col("_items").isNull().alias("failed"), F.posexplode_outer("_items").alias("idx", "_item"))
    fields = F.struct(*[F.try_variant_get("_item", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in EXTRACTED.fields])
    return rows.select(*rest, "failed", "idx", F.map_keys(as_object(F.col("_item"))).alias("returned"),
                       F.when(F.col("_item").isNotNull(), fields).alias("fields"))


def merge_extraction(raw: DataFrame, extracted: DataFrame,
                     on: tuple[str, ...] = ("source", "batch", "idx")) -> DataFrame:
    """Overlay extracted fields; a returned key overwrites even with null, others keep the raw value.

    Every raw posting stays, also when its batch failed or came back short.
    """
    new = extracted.filter(~F.col("failed") & F.col("idx").isNotNull()).select(*on, "returned", "fields")
    joined = raw.join(new, list(on), "left")
    present = {c: kind for c, kind in raw.dtypes}

    def overlay(field: T.StructField) -> Column:
        value = F.col("fields").getField(field.name)
        old = F.col(field.name) if field.name in present else F.lit(None)
        if field.name in present and present[field.name] != field.dataType.simpleString():
            value = F.to_json(value) if isinstance(field.dataType, T.ArrayType) else value.cast("string")
            old = old.cast("string")
        hit = F.coalesce(F.array_contains("returned", F.lit(field.name)), F.lit(False))
        return F.when(hit, value).otherwise(old).alias(field.name)

    fields = {f.name: f for f in EXTRACTED.fields}
    return joined.select(*[c for c in raw.columns if c not in fields],
                         *[overlay(f) for f in EXTRACTED.fields])


# -- fixed values: wording looked for, in order of precedence -----------------
SENIORITY_WORDS = {
    "Intern": ["intern", "internship"], "VP": ["vp", "vice president"], "Head": ["head of"],
    "Director": ["director"], "Manager": ["manager"], "Lead": ["lead"], "Staff": ["staff"],
    "Senior": ["senior", "sr"], "Junior": ["junior", "jr", "entry level"], "Mid": ["mid"],
}
EMPLOYMENT_WORDS = {
    "Part-time": ["part-time", "part time"], "Contract": ["contract", "contractor"],
    "Freelance": ["freelance", "freelancer"], "Internship": ["internship"],
    "Full-time": ["full-time", "full time"],
}
# patterns start with a narrow class where they can, which keeps the scan of long texts fast
YEARS = r"([0-9]+)(?:\s?(?:-|–|to)\s?[0-9]+)?\s?\+?\s?(?:years|yrs)(?:[^\p{L}\p{N}]|$)"
MAX_YEARS_DIGITS = 2
YEARS_MARKS = ["years", "yrs"]
AMOUNT = r"([0-9]{2,3}(?:,[0-9]{3})+|[0-9]{4,7}|[0-9]{2,3}(?:\.[0-9])?\s?k\b)"
CURRENCY = "(?:usd|eur|gbp|[$€£])"
SALARY = rf"{CURRENCY}\s?{AMOUNT}(?:\s?(?:-|–|to)\s?{CURRENCY}?\s?{AMOUNT})?"
SALARY_BEHIND = rf"{AMOUNT}(?:\s?(?:-|–|to)\s?{AMOUNT})?\s?{CURRENCY}(?:[^\p{{L}}\p{{N}}]|$)"
SALARY_MARKS = ["usd", "eur", "gbp", "$", "€", "£"]
WORD_BREAK = r"[^\p{L}\p{N}+#]+"


def word_pattern(words: list[str]) -> str:
    """Whole-word match that Java and RE2 read alike."""
    return rf"(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(words)})(?:[^\p{{L}}\p{{N}}]|$)"


def _first_word(text: Column, table: dict[str, list[str]]) -> Column:
    """First value with one of its words in the text; a plain substring test comes before the pattern."""
    case = F.when(F.lit(False), F.lit(None).cast("string"))
    for value, words in table.items():
        case = case.when(contains_any(text, words) & text.rlike(word_pattern(words)), value)
    return case


def _years(text: Column) -> Column:
    """Smallest number of years named; of a range the lower bound, numbers of three digits and more are none."""
    named = F.when(contains_any(text, YEARS_MARKS), F.regexp_extract_all(text, F.lit(YEARS), F.lit(1)))
    valid = F.filter(named, lambda n: F.length(n) <= MAX_YEARS_DIGITS)
    return F.coalesce(F.array_min(F.transform(valid, lambda n: n.cast("int"))), F.lit(0))


def _salary(text: Column) -> Column:
    """First amount or range with a currency before it, or else behind it; the long text is searched once for each."""
    def bound(hit: Column, pattern: str, group: int) -> Column:
        amount = F.regexp_replace(F.regexp_extract(hit, pattern, group), r"[,\s]", "")
        thousands = F.when(amount.endswith("k"), F.regexp_replace(amount, "k", "").try_cast("double") * 1000)
        return F.coalesce(thousands, F.nullif(amount, F.lit("")).try_cast("double"))

    def both(pattern: str):
        return lambda h: F.when(h != "", F.struct(bound(h, pattern, 1).alias("low"), bound(h, pattern, 2).alias("high")))

    marked = contains_any(text, SALARY_MARKS)
    return F.coalesce(bind(F.when(marked, F.regexp_extract(text, SALARY, 0)), both(SALARY)),
                      bind(F.when(marked, F.regexp_extract(text, SALARY_BEHIND, 0)), both(SALARY_BEHIND)))


def rule_extract(df: DataFrame, domain: str | Column = "any", title: str = "title",
                 text: str = "description_text", vocabulary: list[str] | None = None) -> DataFrame:
    """Structured fields of a posting by fixed rules; overwrites columns of the same names."""
    return judged(read_fields(df, title, text, vocabulary), domain, title)


def read_fields(df: DataFrame, title: str = "title", text: str = "description_text", vocabulary: list[str] | None = None) -> DataFrame:
    """Add `_found`, what the rules find in title and text whatever the domain."""
    names = vocabulary or TECH_VOCABULARY
    simple = F.array(*[F.lit(v) for v in names if re.fullmatch(r"[\w+#]+", v)])
    spelt = [v for v in names if not re.fullmatch(r"[\w+#]+", v)]

    def tools(text: Column) -> Column:
        """Vocabulary words of the text; names with other signs are looked for one by one."""
        found = F.array_intersect(F.split(text, WORD_BREAK), simple)
        more = [F.when(F.contains(text, F.lit(v)) & text.rlike(word_pattern([re.escape(v)])), F.lit(v))
                for v in spelt]
        return F.array_sort(F.concat(found, F.array_compact(F.array(*more))) if more else found)

    def fields(head: Column, body: Column, both: Column) -> Column:
        return F.struct(
            F.coalesce(_first_word(head, SENIORITY_WORDS),
                       _first_word(body, SENIORITY_WORDS), F.lit("Mid")).alias("seniority"),
            F.coalesce(_first_word(both, EMPLOYMENT_WORDS),
                       F.lit("Full-time")).alias("employment_type"),
            _years(both).alias("min_years_exp"), _salary(both).alias("salary"),
            tools(both).alias("tech_stack"))

    head = F.lower(F.coalesce(title, F.lit("")))
    body = F.lower(F.coalesce(text, F.lit("")))
    found = bind(F.struct(head.alias("head"), body.alias("body")), lambda t: bind(
        F.concat(t["head"], F.lit("\n"), t["body"]), lambda both: fields(t["head"], t["body"], both)))
    return df.withColumn("_found", found)


def judged(df: DataFrame, domain: str | Column = "any", title: str = "title") -> DataFrame:
    """Rows of read_fields with their fields as columns and whether the title fits the domain."""
    head = F.lower(F.coalesce(title, F.lit("")))
    domain = F.lit(domain) if isinstance(domain, str) else domain
    role = F.lit(None).cast("string")
    for name, roles in DOMAIN_ROLES.items():
        first = F.coalesce(*[F.when(F.contains(head, F.lit(r)), F.lit(r)) for r in roles])
        role = F.when(domain == name, first).otherwise(role)
    relevant = ~domain.isin(list(DOMAIN_ROLES)) | role.isNotNull()
    reason = (
        F.when(~domain.isin(list(DOMAIN_ROLES)), F.lit("every role is accepted"))
        .when(role.isNotNull(), F.concat(F.lit("title names "), role))
        .otherwise(F.concat(F.lit("title names no "), domain, F.lit(" role"))))
    rows = df.withColumns({
        "is_relevant": F.when(relevant, "true").otherwise("false"), "reason": reason})
    names = ["seniority", "employment_type", "min_years_exp", "tech_stack"]
    return rows.withColumns({
        **{name: F.col("_found")[name] for name in names},
        "salary_min": F.col("_found.salary.low"), "salary_max": F.col("_found.salary.high"),
    }).drop("_found")
