"""Vectors: a cache by text hash, the int8 index, and attaching vectors to endpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def embed_new(texts: DataFrame, cache: DataFrame, embed: Callable[[pd.Series], pd.Series], model: str, dim: int) -> DataFrame:
    """Vectors (text_hash, model, dim, vec) of the distinct texts that the cache hasn't under this model and dimension."""
    have = cache.where((F.col("model") == model) & (F.col("dim") == dim)).select("text_hash")
    new = texts.select(text_hash(F.col("text")).alias("text_hash"), "text").dropDuplicates(["text_hash"]).join(have, "text_hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"text_hash": b["text_hash"], "model": model, "dim": dim, "vec": embed(b["text"]) if len(b) else []})

    return new.mapInPandas(run, "text_hash string, model string, dim int, vec array<float>")


CACHE = "text_hash string, vec array<float>, model string, dim int"


def read_cache(spark: SparkSession, path: str, model: str, dim: int) -> DataFrame:
    """(text_hash, model, dim, vec) of one model and dimension: of the cache's folders only theirs are read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE).select("text_hash", "model", "dim", "vec")
    rows = spark.read.schema(CACHE).parquet(path).where((F.col("model") == model) & (F.col("dim") == dim))
    return rows.select("text_hash", "model", "dim", "vec")


def embed_cached(texts: DataFrame, path: str, embed: Callable[[pd.Series], pd.Series], model: str, dim: int) -> DataFrame:
    """Vectors (text_hash, model, dim, vec) of the distinct ``texts`` (text), embedding and appending those that the cache lacks.

    Appended are only hashes that the cache hasn't, in one commit: a run that is repeated, or fails and is run again, adds
    each text once. Null texts have no vector."""
    spark = texts.sparkSession
    known = texts.where("text IS NOT NULL")
    embed_new(known, read_cache(spark, path, model, dim), embed, model, dim).write.mode("append").partitionBy("model", "dim").parquet(path)
    asked = known.select(text_hash(F.col("text")).alias("text_hash")).distinct()
    return read_cache(spark, path, model, dim).join(asked, "text_hash", "left_semi")


def quantize(vectors: DataFrame, live: DataFrame) -> DataFrame:
    """(text_hash, scale, q: array of tinyint) of live vectors: scale = largest absolute value / 127 (1 for none)."""
    kept = vectors.join(live.select("text_hash").distinct(), "text_hash", "left_semi")
    top = F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))
    rows = kept.withColumn("scale", F.when(top > 0, top / 127).otherwise(1.0))
    # halves round up, as in the format's other readers
    q = F.transform("vec", lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") / F.col("scale") + 0.5))).cast("tinyint"))
    return rows.select("text_hash", "scale", q.alias("q"))


def packed(quantized: DataFrame) -> DataFrame:
    """(text_hash, scale, q: binary): the int8 index, a byte a component, as the arm searches it."""
    byte = F.transform("q", lambda x: F.lpad(F.hex(x.cast("int").bitwiseAND(255)), 2, "0"))
    return quantized.select("text_hash", "scale", F.unhex(F.array_join(byte, "")).alias("q"))


def attach(endpoints: DataFrame, vectors: DataFrame, text: Column) -> DataFrame:
    """Endpoints with the vector of their text; those without one, or without a text, fall out."""
    keyed = endpoints.withColumn("text_hash", text_hash(text)).where(F.length(text) > 0)
    return keyed.join(vectors.select("text_hash", "vec"), "text_hash")
