"""The catalog's datasets as versions of a folder: a version is there once its commit is, whole or not at all.

A write puts its tables under a name of its own and then a commit, a one-row table whose last file, ``_SUCCESS``, is made
when all else is. Readers take the greatest committed version, so a write that fails midway changes nothing for them,
and two writers of one version can't both commit. Endpoints are dealt by a hash of their id, as one origin may hold a
third of all. Counts are observed while the tables are written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..storage import partitions

COMMIT = "version long, folder string, endpoints long, priced long, newest string, capabilities long, refs long"


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, from the first; a folder that isn't there has none."""
    fs, at = _files(spark, f"{root}/commits")
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at)]
    done = [p.getName() for p in found if p.getName().isdigit() and fs.exists(_files(spark, f"{p.toString()}/_SUCCESS")[1])]
    return sorted(map(int, done))


def write_version(root: str, endpoints: DataFrame, intents: DataFrame, refs: DataFrame) -> int:
    """Write and commit the next version; its number."""
    spark = endpoints.sparkSession
    version = max(versions(spark, root), default=0) + 1
    folder = f"{root}/data/{version:08d}-{uuid.uuid4().hex}"
    seen = {name: Observation(name) for name in ("endpoints", "capabilities", "refs")}
    count = F.count(F.lit(1)).alias("n")
    n = partitions(endpoints)
    counted = endpoints.observe(seen["endpoints"], count, F.count("payment.price_usd").alias("priced"), F.max("built_at").alias("newest"))
    counted.repartition(n, "id").write.parquet(f"{folder}/endpoints")
    intents.observe(seen["capabilities"], count).write.parquet(f"{folder}/capabilities")
    refs.observe(seen["refs"], count).write.parquet(f"{folder}/refs")
    e, i, r = (seen[k].get for k in ("endpoints", "capabilities", "refs"))
    row = (version, folder, e["n"], e["priced"], e["newest"], i["n"], r["n"])
    spark.createDataFrame([row], COMMIT).coalesce(1).write.parquet(f"{root}/commits/{version:08d}")
    return version


def commits(spark: SparkSession, root: str) -> DataFrame:
    """A row for each committed version, with its counts."""
    paths = [f"{root}/commits/{v:08d}" for v in versions(spark, root)]
    return spark.read.schema(COMMIT).parquet(*paths) if paths else spark.createDataFrame([], COMMIT)


def read_version(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The endpoints, capabilities and refs of a version, the current one unless named."""
    known = versions(spark, root)
    if not known or version is not None and version not in known:
        raise ValueError(f"no such committed version under {root}")
    folder = spark.read.schema(COMMIT).parquet(f"{root}/commits/{known[-1] if version is None else version:08d}").first()["folder"]
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("endpoints", "capabilities", "refs")}
