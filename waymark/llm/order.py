"""Running totals over a globally ordered table, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import partitions, saved


def starts(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """``rows`` with ``start``, the sum of ``size`` over all rows before it in ``order`` (nulls first), and ``nth``, their number.

    Rows are range-partitioned and sorted; each task runs its own total, and the partitions' totals, one row
    each, give the bases. ``order`` should be total (end in a unique column), as ties have no defined order.
    """
    n = partitions(rows)
    schema = T.StructType([*rows.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("nth", T.LongType())])
    names, at = schema.names, rows.columns.index(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, seen = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            sizes = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(sizes)
            place = pa.array(np.arange(seen, seen + b.num_rows))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(ends - sizes), place], names=names)
            seen += b.num_rows
            total = int(ends[-1]) if len(ends) else total

    local = saved(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, schema), "ordered")
    totals = local.groupBy("__part").agg(F.sum(size).alias("t"), F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    summed = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    bases = totals.select("__part", summed("t").alias("__base"), summed("c").alias("__rows"))
    placed = local.join(F.broadcast(bases), "__part")
    place = [(F.col("start") + F.col("__base")).alias("start"), (F.col("nth") + F.col("__rows")).alias("nth")]
    out = placed.select(*[F.col(f"`{c}`") for c in rows.columns], *place)
    out._waymark_path = local._waymark_path  # for discard(), when nothing reads it any more
    return out
