"""Pre-filters of a ranking. Every rule keeps its own treatment of absent values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from shortlist.functions.fields import safe_number
from shortlist.functions.text import SHORT_TEXT, gate_status
from shortlist.operators.dedup import has_url as filter_has_url  # noqa: F401
from shortlist.sources.sinks import write_counted


@dataclass(frozen=True)
class Prefilter:
    relevant_only: bool = True
    exclude_seniority: list[str] = field(default_factory=list)
    employment_types: list[str] = field(default_factory=list)
    min_salary: float = 0.0
    seniority_column: str = "seniority"

    def stages(self, columns: list[str]) -> list[tuple[str, Column]]:
        """The active predicates in order; inactive ones are left out."""
        out = []
        if self.relevant_only and "is_relevant" in columns:
            out.append(("relevant", is_relevant()))
        needed = [self.seniority_column] * bool(self.exclude_seniority) + [
            "employment_type"] * bool(self.employment_types)
        if missing := [c for c in needed if c not in columns]:
            raise ValueError(f"columns missing: {missing}")
        if self.exclude_seniority:
            out.append(("seniority", seniority_allowed(self.exclude_seniority, self.seniority_column)))
        if self.employment_types:
            out.append(("employment", employment_allowed(self.employment_types)))
        if self.min_salary and "salary_min" in columns:
            out.append(("salary", salary_at_least(self.min_salary)))
        return out


def is_relevant(col: str = "is_relevant") -> Column:
    return F.coalesce(F.lower(F.col(col).cast("string")) == "true", F.lit(False))


def seniority_allowed(levels: list[str], col: str = "seniority") -> Column:
    return ~F.coalesce(F.lower(F.col(col)), F.lit("")).isin([level.lower() for level in levels])


def employment_allowed(types: list[str], col: str = "employment_type") -> Column:
    return F.coalesce(F.lower(F.col(col)).isin([t.lower() for t in types]), F.lit(False))


def salary_at_least(floor: float, col: str = "salary_min") -> Column:
    return F.coalesce(safe_number(col), F.lit(0.0)) >= floor


def filter_relevant(df: DataFrame, on: bool = True) -> DataFrame:
    return df.filter(is_relevant()) if on and "is_relevant" in df.columns else df


def _need(df: DataFrame, col: str) -> DataFrame:
    """Spark would still find a column dropped earlier in the plan; here it counts as missing."""
    if col not in df.columns:
        raise ValueError(f"column {col} is missing")
    return df


def exclude_seniority(df: DataFrame, levels: list[str], col: str = "seniority") -> DataFrame:
    return _need(df, col).filter(seniority_allowed(levels, col)) if levels else df


def filter_employment(df: DataFrame, types: list[str]) -> DataFrame:
    return _need(df, "employment_type").filter(employment_allowed(types)) if types else df


def filter_min_salary(df: DataFrame, floor: float) -> DataFrame:
    return df.filter(salary_at_least(floor)) if floor and "salary_min" in df.columns else df


def prefilter(df: DataFrame, rules: Prefilter) -> DataFrame:
    for _, predicate in rules.stages(df.columns):
        df = df.filter(predicate)
    return df


def prefilter_funnel(df: DataFrame, rules: Prefilter) -> DataFrame:
    """Rows left after each stage, from one pass."""
    return df.agg(*[F.count_if(test).alias(name) for name, test in funnel_tests(df, rules).items()])


def funnel_tests(df: DataFrame, rules: Prefilter) -> dict[str, Column]:
    """Which rows each number of the funnel counts."""
    passed, tests = F.lit(True), {"total": F.lit(True)}
    for name, predicate in rules.stages(df.columns):
        passed = passed & predicate
        tests[f"after_{name}"] = passed
    return {**tests, "remaining": passed}


def write_prefiltered(df: DataFrame, rules: Prefilter, path: str) -> dict[str, int]:
    """Write the rows that pass all rules to a new folder; the funnel is counted by the same job."""
    tests = funnel_tests(df, rules)
    return write_counted(df, path, tests, tests["remaining"])


def filter_min_score(df: DataFrame, threshold: float, strict: bool = False,
                     col: str = "similarity_score") -> DataFrame:
    """Only a positive threshold filters, unless strict, which always does."""
    return df.filter(F.col(col) >= threshold) if strict or threshold > 0 else df


def short_text_report(df: DataFrame, length: Column, limit: int = SHORT_TEXT) -> DataFrame:
    """Number of cleaned texts, given by their lengths, that are shorter than the limit."""
    return df.agg(F.count("*").alias("total"), F.count_if(length < limit).alias("short_texts"))


def gate_page_text(df: DataFrame, text: str = "page_text") -> DataFrame:
    return df.withColumn("page_status", gate_status(F.col(text)))


def require_embeddings(df: DataFrame, col: str = "embedding") -> bool:
    """True if there are rows to score; raises when rows exist but none has a vector."""
    if col not in df.columns:
        if df.isEmpty():
            return False
        raise ValueError("no embeddings found: score the postings first")
    if not df.filter(F.col(col).isNotNull()).select(F.lit(1)).isEmpty():
        return True
    if df.isEmpty():
        return False
    raise ValueError("no embeddings found: score the postings first")
