"""Reading and normalising postings and profiles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shortlist.functions.fields import canonical_seniority, salary_display
from shortlist.functions.text import blank_to_null
from shortlist.lookups import (BUILTIN_ALIASES, CANONICAL_COLUMNS, COLUMN_RENAMES, LINKEDIN_ALIASES)
from shortlist.operators.dedup import dedup_keys
from shortlist.schema import PROFILE


def scan_postings(spark: SparkSession, path: str | list[str], fmt: str = "csv",
                  schema: T.StructType | None = None, multi_line: bool = True, file: str | None = None) -> DataFrame:
    """Postings from delimited files or Parquet, with normalised column names.

    CSV columns are strings. Files of different headers are read with their own header each and then put together by
    name, so neither order nor missing columns mix values up. The header lines are looked up with one Spark job over
    the files' first blocks. A schema names the columns wanted and their types. With multi_line off (no line breaks inside
    values) large CSV files are split over tasks. `file` names a column for the path of each row's file; a filter on it reads
    no other file.
    """
    def named(df: DataFrame) -> DataFrame:
        return df.withColumn(file, F.col("_metadata.file_path")) if file else df

    if fmt != "csv":
        reader = spark.read.schema(schema) if schema else spark.read
        return normalise_columns(named(reader.format(fmt).load(path)))
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if schema:
        names = [f.name for f in schema.fields]
        more = [file] if file else []
        parts = [read_named(reader, files, names, named) for _, files in by_header(spark, path)]
        raw = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
        return normalise_columns(raw.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields], *[c for c in more if c in raw.columns]))
    parts = [normalise_columns(named(reader.csv(files))) for _, files in by_header(spark, path)]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts) if parts else normalise_columns(reader.csv(path))


def by_header(spark: SparkSession, path: str | list[str]) -> list[tuple[str, list[str]]]:
    """(header line, files with it). One line per file comes to the driver, as file names do anyway."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value").filter("block = 0")
    heads = lines.groupBy("file").agg(F.min_by("value", "line").alias("head"))
    return sorted((r["head"], sorted(r["files"])) for r in heads.groupBy("head").agg(F.collect_list("file").alias("files")).collect())


def read_named(reader, files: list[str], names: list[str], named: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The named columns of files with one header, and what `named` adds; those the header lacks are null."""
    raw = reader.csv(files)
    more = named(raw)
    return more.select(*[F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string").alias(c) for c in names],
                       *more.columns[len(raw.columns):])


def scan_profiles(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Candidate profiles: one JSON object per file, or one per line if multi_line is off."""
    return spark.read.schema(PROFILE).option("multiLine", multi_line).json(path)


def file_inventory(spark: SparkSession, dirs: list[str]) -> DataFrame:
    """CSV files directly inside the given folders, newest first; missing folders are skipped."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    present = [d for d in dirs if hadoop(d).getFileSystem(conf).exists(hadoop(d))]
    schema = "name string, location string, path string, size_kb double, modified string"
    if not present:
        return spark.createDataFrame([], schema)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
             .load(present).select("path", "length", "modificationTime"))
    parts = F.split("path", "/")
    return files.select(
        F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("location"), "path",
        F.round(F.col("length") / 1024, 2).alias("size_kb"),
        F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss").alias("modified"),
    ).orderBy(F.desc("modified"), F.asc("path"))


def normalise_columns(df: DataFrame, mode: str = "first") -> DataFrame:
    """Tidy and rename columns; of equal names the first stays, or their first filled value.

    Names are metadata, so this adds a projection and runs no job.
    """
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    names = [COLUMN_RENAMES.get(c, c) for c in names]
    positional = df.toDF(*[f"_c{i}" for i in range(len(names))])
    places: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        places.setdefault(name, []).append(i)
    kinds = dict(positional.dtypes)

    def merged(at: list[int]) -> Column:
        if mode == "first" or len(at) == 1:
            return F.col(f"_c{at[0]}")
        filled = [blank_to_null(f"_c{i}") if kinds[f"_c{i}"] == "string" else F.col(f"_c{i}") for i in at]
        if len({kinds[f"_c{i}"] for i in at}) > 1:
            filled = [c.cast("string") for c in filled]
        return F.coalesce(*filled)

    return positional.select(*[merged(at).alias(name) for name, at in places.items()])


def blanks_to_null(df: DataFrame) -> DataFrame:
    """Every blank string becomes null, so that one spelling of 'absent' is left."""
    return df.select(*[blank_to_null(f"`{c}`").alias(c) if kind == "string" else F.col(f"`{c}`")
                       for c, kind in df.dtypes])


def add_canonical(df: DataFrame, fill: str | None = "") -> DataFrame:
    """Add the canonical columns that are missing."""
    have = {c.lower() for c in df.columns}
    missing = [c for c in CANONICAL_COLUMNS if c.lower() not in have]
    return df.select("*", *[F.lit(fill).cast("string").alias(c) for c in missing])


def conform_canonical(df: DataFrame, order: list[Column], fill: str | None = "") -> DataFrame:
    """All canonical columns, and one row per (title, company, url)."""
    return dedup_keys(add_canonical(df, fill), order)


def alias_cascade(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Fill each target from the first filled candidate column; absent columns are ignored.

    Targets see the values of targets filled before them.
    """
    have = {c.lower(): c for c in df.columns}
    filled: dict[str, Column] = {}
    for target, names in aliases.items():
        found = [filled[n] if n in filled and n != target else blank_to_null(f"`{have[n.lower()]}`")
                 for n in names if n.lower() in have or n in filled]
        filled[target] = F.coalesce(*found) if found else F.lit(None).cast("string")
    return df.withColumns({have.get(t.lower(), t): value for t, value in filled.items()})


def alias_cascade_linkedin(df: DataFrame) -> DataFrame:
    """LinkedIn field names to canonical ones, description copied, seniority mapped, source set."""
    cascade = {**LINKEDIN_ALIASES, "description": ["description", "description_text"]}
    out = alias_cascade(df, cascade)
    return tag_source(out.withColumn("seniority", canonical_seniority("seniority")), "linkedin")


def alias_cascade_builtin(df: DataFrame) -> DataFrame:
    """BuiltIn field names to canonical ones, with a display salary from its bounds."""
    out = alias_cascade(df, BUILTIN_ALIASES)

    def have(name: str) -> Column:
        return F.col(name) if name in out.columns else F.lit(None).cast("string")

    return out.withColumn("salary", salary_display(
        have("salary_json_currency"), have("salary_json_min"), have("salary_json_max"), have("salary")))


def tag_source(df: DataFrame, name: str | None) -> DataFrame:
    """Set the source; None keeps what the rows carry."""
    return df if name is None else df.withColumn("source", F.lit(name))


def search_hits_to_postings(hits: DataFrame, source: str, results: str = "organic") -> DataFrame:
    """One posting per search result of a response, in result order."""
    extra = [c for c in hits.columns if c != results]
    rows = hits.select(*extra, F.posexplode(results).alias("hit", "_r"))
    blank = F.lit("")
    return tag_source(rows.select(
        *extra, "hit", F.coalesce("_r.title", blank).alias("title"),
        F.coalesce("_r.link", blank).alias("url"), blank.alias("company"), blank.alias("location"),
        F.coalesce("_r.snippet", blank).alias("description_snippet")), source)


def union_sources(frames: dict[str, DataFrame | None], priority: list[str]) -> DataFrame:
    """Stack sources by column name with an explicit priority; absent sources are skipped."""
    present = [(name, frames[name]) for name in priority if frames.get(name) is not None]
    present += [(name, df) for name, df in frames.items() if name not in priority and df is not None]
    if not present:
        raise ValueError("no source returned postings")
    stacked = [df.withColumn("priority", F.lit(i)) for i, (_, df) in enumerate(present)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)
