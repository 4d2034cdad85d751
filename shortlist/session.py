"""Session settings and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("shortlist")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shortlist-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared root."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder so that its partitions never change again."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, label: str = "staged") -> DataFrame:
    """Write df to the shared folder once and read it back, for results that several steps use.

    Being Parquet, each step then reads just the columns it needs.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], label: str = "bucketed") -> DataFrame:
    """Write df once below the shared root, bucketed and sorted by keys: joins on these keys move none of its rows.

    It has a file per shuffle partition. The table's name is new and lives as long as the session.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label}_{uuid.uuid4().hex}"
    (df.repartition(parts, *keys).write.format("parquet").bucketBy(parts, *keys).sortBy(*keys)
     .option("path", scratch_path(spark, label)).saveAsTable(name))
    return spark.table(name)


def spread(scan: DataFrame) -> DataFrame:
    """Give a plain scan of few partitions to all cores before heavy per-row work.

    Inputs that already have a partition per core, as any large table does, are left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
