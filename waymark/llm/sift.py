"""A runtime filter: rows that can't meet a join's other side are told before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import free

#: Buckets of hashes; the broadcast holds one number for each that occurs, 16 MB at most. Where the other side has many
#: more keys than this, nearly all rows pass and the join does the work alone.
BUCKETS = 1 << 20


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def split(rows: DataFrame, key: Column, wanted: DataFrame, of: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be among ``wanted``'s, and rows whose key surely isn't."""
    (name,) = free(rows, "__bucket")
    buckets = F.broadcast(wanted.select(_bucket(of).alias(name)).distinct())
    own = rows.withColumn(name, _bucket(key))
    return own.join(buckets, name, "left_semi").drop(name), own.join(buckets, name, "left_anti").drop(name)
