"""Text to vector, with the vectoriser as a plug-in, and re-use of vectors that are still valid."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from shortlist.sources.sinks import write_counted

BATCH = 64


@dataclass(frozen=True)
class HashedWords:
    """Built-in vectoriser: hashed word counts of unit length, all inside the JVM.

    A row-local transformation without vocabulary, so it needs no shuffle and no fit.
    """

    dims: int = 512
    stop_words: bool = True

    @property
    def name(self) -> str:
        return f"hashed-words-{self.dims}" + ("" if self.stop_words else "-all")

    def vectors(self, df: DataFrame, text: str, out: str) -> DataFrame:
        kept = df.columns
        stages = [RegexTokenizer(inputCol="_text", outputCol="_all", pattern=r"[^\p{L}\p{N}+#]+")]
        if self.stop_words:
            stages.append(StopWordsRemover(inputCol="_all", outputCol="_words",
                                           stopWords=StopWordsRemover.loadDefaultStopWords("english"),
                                           locale="en_US"))
        stages += [HashingTF(inputCol="_words" if self.stop_words else "_all", outputCol="_counts",
                             numFeatures=self.dims),
                   Normalizer(inputCol="_counts", outputCol="_unit", p=2.0)]
        rows = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
        for stage in stages:
            rows = stage.transform(rows)
        vector = vector_to_array("_unit", "float32")
        return rows.select(*[c for c in kept if c != out],
                           F.when(F.col(text).isNotNull(), vector).alias(out))


@dataclass(frozen=True)
class BatchVectoriser:
    """A user's model: load() runs once per Python worker task and returns texts -> matrix."""

    name: str
    load: Callable[[], Callable[[list[str]], np.ndarray]]
    batch: int = BATCH

    def vectors(self, df: DataFrame, text: str, out: str) -> DataFrame:
        load, size = self.load, self.batch

        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = load()
            for batch in batches:
                present = ~np.asarray(batch.is_null(), dtype=bool)
                texts = batch.drop_null().to_pylist()       # rows without text never reach the model
                parts = [np.asarray(model(texts[i:i + size]), dtype=np.float64)
                         for i in range(0, len(texts), size)]
                rows = np.concatenate(parts) if parts else np.zeros((0, 0))
                lengths = np.linalg.norm(rows, axis=1, keepdims=True)
                rows = np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths != 0)
                ends = np.cumsum(np.where(present, rows.shape[1], 0), dtype=np.int64)
                yield pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]).astype(np.int32)),
                    pa.array(rows.astype(np.float32).ravel()), mask=pa.array(~present))

        # exploding a one-element array keeps one row and makes Spark finish the text before the
        # Python call, whatever expression it comes from
        rows = df.select("*", F.explode(F.array(text)).alias("_given"))
        return rows.withColumn(out, encode(F.col("_given"))).drop("_given")


Vectoriser = HashedWords | BatchVectoriser


def embed(df: DataFrame, text: str, vectoriser: Vectoriser, out: str = "embedding") -> DataFrame:
    """Add the unit-length vector of a text column and the vectoriser's own name; no text, no vector."""
    return vectoriser.vectors(df, text, out).withColumn("embedding_model", F.lit(vectoriser.name))


def is_stale(model: str) -> Column:
    return F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model))


def with_vector_columns(df: DataFrame) -> DataFrame:
    for name, kind in (("embedding", "array<float>"), ("embedding_model", "string")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def stale_embeddings(df: DataFrame, model: str, force: bool = False) -> DataFrame:
    """Flag rows that need a new vector: none yet, or one from another model."""
    return with_vector_columns(df).withColumn("stale", F.lit(True) if force else is_stale(model))


def embed_incremental(df: DataFrame, vectoriser: Vectoriser, text: str, force: bool = False) -> DataFrame:
    """Vectorise only stale rows. The flag `embedded_now` says which rows those were.

    One pass over the input: rows that are still valid offer no text, so they cost no vector.
    """
    flagged = stale_embeddings(df, vectoriser.name, force)
    offered = flagged.withColumn("_offered", F.when(F.col("stale"), F.col(text)))
    done = vectoriser.vectors(offered, "_offered", "_new").drop("_offered")
    return done.withColumns({
        "embedding": F.when(F.col("stale"), F.col("_new")).otherwise(F.col("embedding")),
        "embedding_model": F.lit(vectoriser.name),
    }).drop("_new").withColumnRenamed("stale", "embedded_now")


def reuse_vectors(df: DataFrame, earlier: DataFrame, text: str, key: str = "id") -> DataFrame:
    """Take over vectors of an earlier run where id and text are unchanged."""
    found = F.struct("embedding", "embedding_model")
    cached = (earlier.groupBy(key, F.xxhash64(text).alias("_hash")).agg(F.min_by(found, "embedding_model").alias("_old"))
              .select(key, "_hash", "_old.*"))      # one row per id and text, however many earlier runs there were
    fresh = df.drop("embedding", "embedding_model").withColumn("_hash", F.xxhash64(text))
    return fresh.join(cached, [key, "_hash"], "left").drop("_hash")


def embedding_coverage(df: DataFrame, model: str, force: bool = False) -> DataFrame:
    """How many rows a run would embed and how many it would skip."""
    flagged = stale_embeddings(df, model, force)
    return flagged.agg(F.count_if("stale").alias("embedded"),
                       F.count_if(~F.col("stale")).alias("skipped_cached"),
                       F.lit(model).alias("model_used"))


def write_embedded(df: DataFrame, vectoriser: Vectoriser, text: str, path: str, force: bool = False) -> dict[str, int]:
    """Write embed_incremental's rows to a new folder; the coverage is counted by the same job."""
    done = embed_incremental(df, vectoriser, text, force)
    return write_counted(done, path, {"embedded": F.col("embedded_now"), "skipped_cached": ~F.col("embedded_now")})


def text_vector(spark, text: str, vectoriser: Vectoriser) -> list[float]:
    """Vector of one text, e.g. of a profile."""
    row = embed(spark.createDataFrame([(text,)], "text string"), "text", vectoriser).first()
    return [float(x) for x in row["embedding"]]
