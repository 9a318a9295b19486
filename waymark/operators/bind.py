"""Binding of endpoints to intents: dense and TF-IDF similarity fused by reciprocal rank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.patterns import matches
from ..functions.text import bind_tokens
from ..tuning import Tuning
from .gate import BIND_META


def dot(a: Column, b: Column) -> Column:
    """Inner product of two vectors in double precision; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def token_counts(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, token, n): each document's binder tokens and how often it has them."""
    return docs.select(key, F.explode(bind_tokens(text)).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def idf_table(counts: DataFrame, n_docs: int | Column) -> DataFrame:
    """(token, df, idf) with idf = ln(N / (1 + df)); ``n_docs`` is all documents, those without tokens too."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return counts.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log(n / (1 + F.col("df"))))


def tfidf(counts: DataFrame, idf: DataFrame, n_docs: int, key: str) -> DataFrame:
    """(key, token, weight): counts times idf, scaled to unit length (zero length stays); unseen tokens have df 0."""
    w = counts.join(idf.select("token", "idf"), "token", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.log(F.lit(float(n_docs)))))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scaled = w.join(norm, key).withColumn("weight", F.col("w") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm")))
    return scaled.select(key, "token", "weight")


def sparse_cosines(docs: DataFrame, intents: DataFrame, key: str) -> DataFrame:
    """(key, intent_id, sparse) of pairs that share a token; intents' postings are few and go to the documents."""
    post = intents.select("intent_id", "token", F.col("weight").alias("w2"))
    return docs.join(post, "token").groupBy(key, "intent_id").agg(F.sum(F.col("weight") * F.col("w2")).alias("sparse"))


def dense_block(spark: SparkSession, vectors: DataFrame, intents: DataFrame, key: str) -> DataFrame:
    """(key, dense: array of double by intent_ord) of every vector with every intent, a block at a time.

    ``intents`` (intent_ord, vec) are the controlled vocabulary: its matrix is broadcast.
    """
    rows = intents.select("intent_ord", "vec").orderBy("intent_ord").collect()  # the vocabulary, some hundred rows
    if not rows:
        return vectors.select(key, F.array().cast("array<double>").alias("dense"))
    matrix = spark.sparkContext.broadcast(np.array([r["vec"] for r in rows], np.float64).T)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = np.stack(b["vec"].to_numpy()).astype(np.float64) @ matrix.value if len(b) else np.zeros((0, 0))
            yield pd.DataFrame({key: b[key], "dense": list(d)})

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, "vec").mapInPandas(run, f"`{key}` {kind}, dense array<double>")


def decide(scores: DataFrame, key: str, tuning: Tuning = Tuning()) -> DataFrame:
    """Binding of (key, intent_id, intent_ord, dense, sparse) for all intents of each key.

    The same as :func:`.binder.bind_endpoints` makes of blocks, for scores that are pairs already. Ranks run over all intents. Candidates have dense at their floor, or sparse at the strong floor (promoted);
    dense ones come first, each by reciprocal rank; the first ``top_k`` stay; then sparse must reach its floor;
    then sparse must be strong, or dense must lead the best other by the margin (a sole intent always does).
    Returns one row a candidate: key, intent_id, place, promoted, slot (in the top k), sparse_ok, bound.
    """
    c, part = F.col, Window.partitionBy(key)
    d, s = F.row_number().over(part.orderBy(F.desc("dense"), "intent_ord")) - 1, F.row_number().over(part.orderBy(F.desc("sparse"), "intent_ord")) - 1
    rows = scores.withColumns({"d": d, "s": s})
    second = F.coalesce(F.max(F.when(c("d") == 1, c("dense"))).over(part), F.lit(float("-inf")))
    rows = rows.withColumns({"best": F.max(F.when(c("d") == 0, c("dense"))).over(part), "second": second})
    floor = F.lit(tuning.dense_floor)
    for intent, own in tuning.floor_overrides.items():
        floor = F.when(c("intent_id") == intent, own).otherwise(floor)
    strong = c("sparse") >= tuning.strong_sparse_floor
    rows = rows.withColumn("promoted", ~(c("dense") >= floor) & strong).where((c("dense") >= floor) | c("promoted"))
    rrf = 1 / (tuning.rrf_k + c("d")) + 1 / (tuning.rrf_k + c("s"))
    place = F.row_number().over(part.orderBy(c("promoted").cast("int"), F.desc(rrf), "intent_ord"))
    lead = c("dense") - F.when(c("dense") >= c("best"), c("second")).otherwise(c("best"))
    out = rows.withColumn("place", place).withColumn("slot", c("place") <= tuning.top_k)
    out = out.withColumn("sparse_ok", c("slot") & (c("sparse") >= tuning.sparse_floor)).withColumn("bound", c("sparse_ok") & (strong | (lead >= tuning.dense_margin)))
    return out.select(key, "intent_id", "place", "promoted", "slot", "sparse_ok", "bound", "dense", "sparse")


def bind_report(decided: DataFrame, endpoints: DataFrame, key: str) -> DataFrame:
    """One row: bound, promoted_sparse, gated_meta, gated_sparse, gated_margin."""
    each = decided.groupBy(key).agg(F.max("bound").alias("b"), F.max(F.col("bound") & F.col("promoted")).alias("p"), F.max("sparse_ok").alias("s"))
    counts = each.agg(
        F.count_if("b").alias("bound"), F.count_if("p").alias("promoted_sparse"), F.count_if(~F.col("b") & ~F.col("s")).alias("gated_sparse"), F.count_if(~F.col("b") & F.col("s")).alias("gated_margin")
    )
    meta = endpoints.agg(F.count_if(matches(F.coalesce("path", F.lit("")), BIND_META)).alias("gated_meta"))
    return counts.crossJoin(meta).select("bound", "promoted_sparse", "gated_meta", "gated_sparse", "gated_margin")  # a row each


def capabilities(endpoints: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """``endpoints`` with the capabilities that were bound, best first; none is an empty list."""
    lists = decided.where("bound").groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "intent_id"))), lambda x: x["intent_id"]).alias("__caps"))
    out = endpoints.join(lists, key, "left")
    return out.withColumn("capabilities", F.coalesce("__caps", F.array().cast("array<string>"))).drop("__caps")
