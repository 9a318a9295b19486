"""Follow-ups for held entities, and next steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import consumers_by_entity

#: Actions that do something in the world.
ACT_ACTIONS = ("send", "provision", "transform", "execute")
TOPIC_FLOOR, RELEVANCE_FLOOR, PER_ENTITY, PER_DOMAIN, LIMIT = 0.15, 0.3, 3, 2, 8


def candidates(held: DataFrame, intents: DataFrame, parents: DataFrame, entities: DataFrame, best: DataFrame, topical: DataFrame | None = None, include_act: bool = False, floor: float = RELEVANCE_FLOOR) -> DataFrame:
    """Scored consumers of each query's held identities, those under the relevance floor dropped (never all).

    ``held``: query_id, pos, entity, kind, source_intent, exclude (array); ``best``: intent_id, id, quality (0..1);
    ``topical``: query_id, intent_id, topic (missing: 0). Returns query_id, intent_id, bridge, domain, score, relevance, ord.
    """
    bridges = entities.where("bridge_eligible").select(F.col("name").alias("b"))
    watched = entities.where("kind = 'observation'").select(F.col("name").alias("entity"))
    own = held.where("coalesce(kind, '') <> 'observation' AND entity <> 'Query'").join(F.broadcast(watched), "entity", "left_anti")
    up = own.join(F.broadcast(parents), own["entity"] == parents["child"], "left").drop("child")
    # the bridge is the entity itself, or its parent, where eligible
    at = up.join(F.broadcast(bridges), (F.col("b") == F.col("entity")) | (F.col("b") == F.col("parent")))
    one = at.withColumn("rn", F.row_number().over(Window.partitionBy("query_id", "pos").orderBy((F.col("b") != F.col("entity")).cast("int")))).where("rn = 1")
    users = consumers_by_entity(intents, parents).withColumnRenamed("held", "b")
    facts = intents.select(F.col("id").alias("intent_id"), F.col("facets.action").alias("action"))
    source = intents.select(F.col("id").alias("source_intent"), F.col("facets.domain").alias("source_domain"))
    rows = one.join(users, "b").join(facts, "intent_id").join(best.select("intent_id", "quality"), "intent_id").join(source, "source_intent", "left")
    match = F.when(F.col("entity") == F.col("port_entity"), 1.0).when(F.col("parent") == F.col("port_entity"), 0.7)
    rows = rows.withColumn("struct", match).where("struct IS NOT NULL")
    rows = rows.where(~F.coalesce(F.array_contains("exclude", F.col("intent_id")), F.lit(False)) & F.coalesce(F.col("intent_id") != F.col("source_intent"), F.lit(True)))
    if not include_act:
        rows = rows.where(~F.coalesce(F.col("action").isin(*ACT_ACTIONS), F.lit(False)))
    if topical is not None:
        rows = rows.join(topical, ["query_id", "intent_id"], "left").withColumn("topic", F.coalesce("topic", F.lit(0.0)))
    else:
        rows = rows.withColumn("topic", F.lit(0.0))
    w = Window.partitionBy("query_id")
    low, high = F.min("topic").over(w), F.max("topic").over(w)
    spread = (high - low) if topical is not None else F.lit(0.0)
    rows = rows.withColumn("spread", spread).withColumn("low", low)
    prime = F.when(F.col("spread") > 0, TOPIC_FLOOR + (1 - TOPIC_FLOOR) * (F.col("topic") - F.col("low")) / F.col("spread")).otherwise(1.0)
    rows = rows.withColumn("relevance", F.col("struct") * prime)
    other = F.coalesce((F.col("source_domain") != F.col("domain")), F.lit(False))
    rows = rows.withColumn("score", F.col("relevance") + F.when(other, 0.05).otherwise(0.0) + 0.05 * F.col("quality"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos", "intent_ord", "port_entity")
    rows = rows.withColumn("ord", F.row_number().over(order)).withColumn("n_ok", F.count_if(F.col("relevance") >= floor).over(w))
    kept = rows.where((F.col("spread") <= 0) | (F.col("relevance") >= floor) | ((F.col("n_ok") == 0) & (F.col("ord") == 1)))
    return kept.select("query_id", "intent_id", F.col("b").alias("bridge"), F.coalesce("domain", F.lit("unknown")).alias("domain"), "score", "relevance", "ord")


def fill(pool: DataFrame, per_entity: int = PER_ENTITY, per_domain: int = PER_DOMAIN, limit: int = LIMIT) -> DataFrame:
    """Greedy choice from each query's pool in order, under caps that depend on what was chosen: (query_id, rank,
    intent_id, bridge, score). A query's pool is as large as the vocabulary at most."""
    c = F.col
    each = F.struct(c("ord"), c("intent_id"), c("bridge"), c("domain"), c("score"))
    pools = pool.groupBy("query_id").agg(F.sort_array(F.collect_list(each)).alias("pool"))
    none = F.array().cast("array<struct<intent_id:string,bridge:string,domain:string,score:double>>")

    def step(out: Column, x: Column) -> Column:
        """The chosen so far, ``limit`` at most, and ``x`` if the caps leave it room."""
        same = lambda field: F.size(F.filter(out, lambda y: y[field] == x[field]))
        room = (F.size(out) < limit) & (same("intent_id") == 0) & (same("bridge") < per_entity) & (same("domain") < per_domain)
        new = F.struct(x["intent_id"].alias("intent_id"), x["bridge"].alias("bridge"), x["domain"].alias("domain"), x["score"].alias("score"))
        return F.when(room, F.concat(out, F.array(new))).otherwise(out)

    chosen = pools.select("query_id", F.posexplode(F.aggregate("pool", none, step)).alias("at", "x"))
    return chosen.select("query_id", (c("at") + 1).cast("int").alias("rank"), "x.intent_id", "x.bridge", "x.score")


def next_steps(leads: DataFrame, cluster: DataFrame, links: DataFrame, limit: int = 6) -> DataFrame:
    """(query_id, rank, intent_id, source): held leads, then the query's cluster, then links, each intent once.

    Each input is (query_id, rank, intent_id).
    """
    rows = None
    for k, (name, df) in enumerate((("held", leads), ("query", cluster), ("link", links))):
        one = df.select("query_id", F.lit(k).alias("stage"), F.lit(name).alias("source"), "rank", "intent_id")
        rows = one if rows is None else rows.union(one)
    once = rows.groupBy("query_id", "intent_id").agg(F.min(F.struct("stage", "rank", "source")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at.stage", "at.rank", "intent_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "rank", "intent_id", F.col("at.source").alias("source"))
