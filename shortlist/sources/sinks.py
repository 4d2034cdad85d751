"""Writing results. Every target is new; nothing is overwritten."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, functions as F

from shortlist.lookups import RESULT_COLUMNS


def _stamp() -> str:
    return datetime.now().strftime("%Y%m%d_%H%M%S_%f")


def _flat(df: DataFrame) -> DataFrame:
    """List columns as JSON text, for delimited files."""
    return df.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c)
                       for c, kind in df.dtypes])


def _write(df: DataFrame, path: str, fmt: str) -> str:
    writer = (_flat(df) if fmt == "csv" else df).write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)
    return path


def write_ranked(df: DataFrame, out_dir: str, fmt: str = "csv") -> str:
    """Ranked rows without their vectors, to a time-stamped folder; returns its path."""
    return _write(df.drop("embedding", "embedding_model"), f"{out_dir}/jobs_ranked_{_stamp()}", fmt)


def write_scored(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("source",)) -> str:
    """Postings with their vectors to a new version folder, partitioned for pruning."""
    version = f"{path}/v_{_stamp()}"
    keys = [c for c in partition_by if c in df.columns]
    df.write.mode("errorifexists").partitionBy(*keys).parquet(version)
    return version


def write_counted(df: DataFrame, path: str, counts: dict[str, Column], keep: Column | None = None) -> dict[str, int]:
    """Write the rows of df that `keep` holds for to a new Parquet folder; counts over all rows of df are taken while they pass.

    One job reads the rows once. A stage that runs again after a lost executor counts once if no shuffle stands between
    df and the written rows, as the tasks then write what they count. No rows give counts of 0.
    """
    passed = Observation()
    seen = df.observe(passed, *[F.count_if(test).alias(name) for name, test in counts.items()])
    (seen if keep is None else seen.filter(keep)).write.mode("errorifexists").parquet(path)
    return {**dict.fromkeys(counts, 0), **passed.get}


def write_raw(df: DataFrame, out_dir: str, fmt: str = "csv") -> str:
    return _write(df, f"{out_dir}/raw_jobs_{_stamp()}", fmt)


def project_result(df: DataFrame, explain: bool = True) -> DataFrame:
    """The result columns that exist, in their fixed order."""
    wanted = RESULT_COLUMNS + (["fit_explanation"] if explain else [])
    return df.select(*[c for c in wanted if c in df.columns])
