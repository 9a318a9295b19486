"""Endpoint hits (the arm) as lists, as support for intents, and as routing.

An arm is a table (query_id, rank, id, score) of endpoint hits; endpoints bring capabilities, thinness, host and
breadth along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tuning import Tuning
from .gate import is_thin

SUPPORT_HITS, ARM_WEIGHT, SEARCH_WEIGHT, GUARD_LEAST, ROUTED = 8, 2.0, 1.0, 1.0, 12


def rerank(arm: DataFrame, endpoints: DataFrame, tuning: Tuning = Tuning(), breadth: float = 0.0) -> DataFrame:
    """The arm without thin endpoints, ranked anew; ``breadth`` is taken off for each intent of a host over the threshold."""
    own = endpoints.select("id", is_thin().alias("thin"), F.coalesce("host_breadth", F.lit(0)).alias("b"))
    kept = arm.join(own, "id").where("NOT thin")
    if breadth:
        kept = kept.withColumn("score", F.col("score") - breadth * F.greatest(F.lit(0), F.col("b") - tuning.breadth_threshold))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("rank"), "id")
    return kept.select("query_id", "id", "score", F.row_number().over(w).alias("rank"))


def support(arm: DataFrame, endpoints: DataFrame, hits: int = SUPPORT_HITS) -> DataFrame:
    """(query_id, intent_id, support, first): sum of 1 / rank over the capabilities of the first non-thin hits, and the
    first place (rank, position) that names the intent, which breaks ties."""
    first = rerank(arm, endpoints).where(F.col("rank") <= hits)
    each = first.join(endpoints.select("id", F.posexplode("capabilities").alias("cap", "intent_id")), "id")
    # rounded, as sums in another order differ in their last bits
    return each.groupBy("query_id", "intent_id").agg(F.round(F.sum(1 / F.col("rank")), 12).alias("support"), F.min(F.struct("rank", "cap")).alias("first"))


def routing(arm: DataFrame, endpoints: DataFrame, order: DataFrame, k: int = ROUTED, rrf_k: int = 60) -> DataFrame:
    """(query_id, rank, intent_id, score): intents by the arm's support and by a search order (query_id, rank, intent_id),
    fused by weighted reciprocal rank; ties go to the arm's order, then the search's."""
    w = Window.partitionBy("query_id")
    own = support(arm, endpoints).withColumn("r", F.row_number().over(w.orderBy(F.desc("support"), "first")) - 1)
    a = own.select("query_id", "intent_id", (ARM_WEIGHT / (rrf_k + F.col("r"))).alias("s"), F.lit(0).alias("o"), F.col("r"))
    b = order.select("query_id", "intent_id", (SEARCH_WEIGHT / (rrf_k + F.col("rank") - 1)).alias("s"), F.lit(1).alias("o"), (F.col("rank") - 1).alias("r"))
    total = a.union(b).groupBy("query_id", "intent_id").agg(F.round(F.sum("s"), 12).alias("score"), F.min(F.struct("o", "r")).alias("at"))
    return total.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "at"))).where(F.col("rank") <= k).select("query_id", "rank", "intent_id", "score")


def guard(order: DataFrame, supports: DataFrame, least: float = GUARD_LEAST) -> DataFrame:
    """``order`` (query_id, rank, intent_id) with the arm's top intent first, where the first has no support at all,
    the arm's top has at least ``least``, and it is in the order already."""
    w = Window.partitionBy("query_id")
    top = supports.withColumn("rn", F.row_number().over(w.orderBy(F.desc("support"), "first"))).where("rn = 1").select("query_id", F.col("intent_id").alias("top_id"), F.col("support").alias("top_support"))
    rows = order.join(supports.drop("first"), ["query_id", "intent_id"], "left").join(top, "query_id", "left").withColumn("n", F.count(F.lit(1)).over(w))
    rows = rows.withColumn("bare", F.max(F.when((F.col("rank") == 1) & F.col("support").isNull(), 1)).over(w))
    up = F.coalesce((F.col("intent_id") == F.col("top_id")) & (F.col("bare") == 1) & (F.col("top_support") >= least) & (F.col("n") >= 2), F.lit(False))
    return rows.withColumn("rank", F.row_number().over(w.orderBy((~up).cast("int"), "rank"))).select("query_id", "rank", "intent_id")


def diversify(hits: DataFrame, k: int = 12) -> DataFrame:
    """``hits`` (query_id, host, score, ep_ord, ...) as a list: each host's best first, then the rest, cut at ``k``."""
    by_host = Window.partitionBy("query_id", "host").orderBy(F.desc("score"), "ep_ord")
    w = Window.partitionBy("query_id").orderBy((F.col("__h") > 1).cast("int"), F.desc("score"), "ep_ord")
    return hits.withColumn("__h", F.row_number().over(by_host)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("__h")


def concentrated(direct: DataFrame, pools: DataFrame, k: int = 12, later: int = 2) -> DataFrame:
    """A list without vectors: (query_id, rank, id).

    ``direct`` (query_id, rank, id) comes first, then the first intent's pool of ``pools`` (query_id, intent_rank, host,
    score, ep_ord, id), host-diversified, then ``later`` of each later intent; an endpoint stands once.
    """
    head = diversify(pools.where("intent_rank = 1"), 3 * k).select("query_id", F.lit(1).alias("stage"), F.lit(1).alias("a"), F.col("rank").alias("b"), "id")
    w = Window.partitionBy("query_id", "intent_rank").orderBy(F.desc("score"), "ep_ord")
    tail = pools.where("intent_rank > 1").withColumn("b", F.row_number().over(w)).where(F.col("b") <= later).select("query_id", F.lit(2).alias("stage"), F.col("intent_rank").alias("a"), "b", "id")
    rows = direct.select("query_id", F.lit(0).alias("stage"), F.lit(1).alias("a"), F.col("rank").alias("b"), "id").union(head).union(tail)
    once = rows.groupBy("query_id", "id").agg(F.min(F.struct("stage", "a", "b")).alias("at"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "id"))).where(F.col("rank") <= k).select("query_id", "rank", "id")


def matched_capabilities(order: DataFrame, supports: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, rank, intent_id, support): the first intent of an order, and of the others those with support."""
    rows = order.join(supports, ["query_id", "intent_id"], "left").where("rank = 1 OR support > 0")
    w = Window.partitionBy("query_id").orderBy("rank")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "intent_id", F.coalesce("support", F.lit(0.0)).alias("support"))


def classify(order: DataFrame, arm: DataFrame, endpoints: DataFrame, k: int = 5, direct: int = 3) -> tuple[DataFrame, DataFrame]:
    """A query's answer: the guarded order cut at ``k``, and the first ``direct`` endpoint hits."""
    guarded = guard(order, support(arm, endpoints)).where(F.col("rank") <= k)
    return guarded, rerank(arm, endpoints).where(F.col("rank") <= direct)
