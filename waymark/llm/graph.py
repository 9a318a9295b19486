"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined map-side) and an equi-join that Spark may split where a node is
hot; its result is written to the shared folder, so a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, saved

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (node, root) for every node of a link; the root is the smallest node.

    Nulls and links of a node to itself name no one else and are dropped; repeated and reversed links count
    once. No links give no rows.
    """
    clean = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = saved(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _mark(now)
    if before[0] == 0:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(MOST_ROUNDS):
        # large star: each node's larger neighbours move to its smallest one
        both = now.union(now.select("b", "a"))
        least = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = saved(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # small star: each node's smaller neighbours, and the node, move to the smallest of them
        low = saved(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = saved(moved.union(low.select("a", "m")).distinct(), "links")
        mark = _mark(after)
        for old in (now, least, large, low):
            discard(old)
        now = after
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"] or 0
