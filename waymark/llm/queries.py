"""The operators' registered queries: each applies one to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path
from . import ann, decontam, langid, license, packing, pii, pstable, quality, repair, secrets, simhash, store, whitening
from .tokens import vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(spans: Column | str) -> Column:
    """kind:start:end of spans, comma-joined in their order."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packing.pieces(_table(spark, sf_dir, "documents"), vocabulary())
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id")))


def op7_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    store.write(_table(spark, sf_dir, "documents"), path, vocabulary())
    return store.read_back(spark, path)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[count_of("spans", k) for k in pii.KINDS],
        F.sha2(digest(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        digest("spans").alias("spans"),
    )


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.spans(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[count_of("spans", k) for k in secrets.KINDS],
        F.sha2(digest(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        digest("spans").alias("spans"),
    )


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(_table(spark, sf_dir, "conversations")))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_simhash, op2_quality, op3_language, op4_packing, op5_decontamination, op6_neighbours, op7_store, op8_pii, op9_license, op10_secrets, op11_repair, op12_embedding_dedup, op13_whitening)
}
ORACLES: dict[str, str] = {}
