"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage and survives lost executors. The folder is the one the cluster names in
``spark.checkpoint.dir``; where it is unset, a local session takes a folder of its own under the temp
directory, and a cluster session is told to set it. The tables go when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_KNOWN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables."""
    sc = spark.sparkContext
    app = sc.applicationId
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not top:
        if app not in _OWN:
            local = sc.master.startswith("local[") or sc.master == "local"
            if not local:
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            _OWN[app] = tempfile.mkdtemp(prefix="spark-waymark-")
        top = _OWN[app]
    path = f"{top.rstrip('/')}/waymark-{app}"
    if path not in _KNOWN:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _KNOWN.add(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and read it back: later uses neither recompute it nor depend on live executors."""
    path = new_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._waymark_path = path
    return out


def partitions(df: DataFrame, factor: float = 1.0, most_bytes: int = 256 << 20) -> int:
    """Shuffle partitions for ``factor`` times what Spark expects ``df`` to hold: as many as the session has, or
    more where they would get over ``most_bytes``. Frames of unknown size get the session's."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if size > 1 << 53 else max(n, int(size * factor / most_bytes) + 1)


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`saved` wrote and that nothing reads any more."""
    path = getattr(df, "_waymark_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores if its files give fewer tasks than there are cores: for heavy work on rows of small
    inputs. Inputs of more files stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
