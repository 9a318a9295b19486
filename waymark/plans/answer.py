"""Workload C: answer a batch of requests, each with endpoints, the capabilities they serve, and what to do next."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import host_of
from ..operators import arm as arms
from ..operators import followups, graph, leads, rank, search
from ..storage import saved
from .enrich import Catalog

HITS, ARM_FACTOR, LINKS = 12, 8, 12
#: Next steps of a request: with something held, and without; and what a request's own cluster allows.
WITH_HELD, WITHOUT, LOOSE, CLUSTER_FLOOR = 8, 6, 99, 0.25


@dataclass
class Found:
    """(query_id, rank, target) of endpoints ("METHOD address") and of next steps (intents), (query_id, rank, intent_id, support) of
    capabilities; support is null where a request has no vector."""

    endpoints: DataFrame
    capabilities: DataFrame
    steps: DataFrame


@dataclass
class Graph:
    """What requests walk: links, one-hop parents, entities, and each intent's best endpoint (intent_id, id, quality)."""

    links: DataFrame
    parents: DataFrame
    entities: DataFrame
    best: DataFrame


def _address() -> Column:
    return F.concat("origin", "path")


def _from_arm(arm: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    """The arm as a list: an address once, each host's best first, then the rest."""
    w = Window.partitionBy("query_id", "url").orderBy("at")
    rows = arm.select("query_id", "id", "score", F.col("rank").alias("at")).join(facts, "id")
    once = rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").withColumn("ep_ord", F.col("at"))
    return arms.diversify(once, k).select("query_id", "rank", "target")


def _from_intents(hits: DataFrame, order: DataFrame, requests: DataFrame, catalog: Catalog, facts: DataFrame, k: int) -> DataFrame:
    """A list without vectors: endpoints that words hit, then many of the first intent's, then some of each other."""
    keyed = saved(catalog.refs.groupBy("intent_id", "origin", "method", "path").agg(F.min("rank").alias("rank")), "keyed-refs")
    direct = saved(hits.where("kind = 'endpoint'").select("query_id", "rank", F.col("hit_id").alias("id")).join(facts, "id").select("query_id", "rank", F.col("target").alias("id")), "direct-hits")

    def pool(some: DataFrame, n: int) -> DataFrame:
        """The ``n`` best endpoints of some requests' intents."""
        asks = some.join(requests, "query_id").select("query_id", "intent_id", "query")
        known = rank.resolve(asks, keyed, catalog.endpoints, catalog.intents, n).select("query_id", "intent_id", "id", "score", F.col("rank").alias("ep_ord"))
        return known.join(some.select("query_id", "intent_id", F.col("rank").alias("intent_rank")), ["query_id", "intent_id"]).join(facts, "id")

    first = saved(pool(order.where("rank = 1"), 3 * k), "first-pools")
    # only lists that these leave short look at further intents, of which each gives two
    full = direct.select("query_id", "id").union(first.select("query_id", "target")).groupBy("query_id").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= k)
    pools = first.unionByName(pool(order.where("rank > 1").join(full, "query_id", "left_anti"), 2))
    pools = pools.select("query_id", "intent_rank", "host", "score", "ep_ord", F.col("target").alias("id"))
    return arms.concentrated(direct, pools, k).select("query_id", "rank", F.col("id").alias("target"))


def _steps(guarded: DataFrame, hits: DataFrame, requests: DataFrame, intents: DataFrame, g: Graph, held: DataFrame | None) -> DataFrame:
    first = guarded.where("rank = 1").select("query_id", F.col("intent_id").alias("routed"))
    none, given = F.lit(None), "array<struct<entity:string,value:string>>"
    asked = requests.select("query_id", F.col("query").alias("finding"), none.cast(given).alias("given"), none.cast("string").alias("intent_id"), none.cast("array<string>").alias("exclude"))
    watched = g.entities.where("kind = 'observation'").select(F.col("name").alias("entity"))
    named = leads.held_entities(asked, first, intents).drop("method").join(watched, "entity", "left_anti").where("source_intent IS NOT NULL")
    # a request that names nothing, and whose intent makes nothing one can hold, goes by what the intent takes
    takes = intents.select(F.col("id").alias("source_intent"), F.posexplode("consumes").alias("pos", "p"))
    bare = first.withColumnRenamed("routed", "source_intent").join(named.select("query_id").distinct(), "query_id", "left_anti").join(takes, "source_intent")
    own = named.select("query_id", "pos", "entity", "kind", "source_intent", "exclude").union(
        bare.select("query_id", "pos", F.col("p.entity").alias("entity"), F.lit("identity").alias("kind"), "source_intent", none.cast("array<string>").alias("exclude"))
    )
    topics = leads.topical_scores(hits)
    pool = followups.candidates(own, intents, g.parents, g.entities, g.best, topics, include_act=True, floor=CLUSTER_FLOOR)
    cluster = followups.fill(pool, LOOSE, LOOSE).select("query_id", "rank", "intent_id")
    related = graph.related_options(g.links, intents, g.best).where((F.col("rank") <= LINKS) & F.col("group").isin("next", "alternatives", "drill-down"))
    stage = F.array_position(F.array(*[F.lit(x) for x in ("next", "alternatives", "drill-down")]), F.col("group"))
    linked = first.join(related, F.col("routed") == F.col("intent_id")).select("query_id", (stage * 100 + F.col("rank")).alias("rank"), F.col("target").alias("intent_id"))
    if held is None:
        return followups.next_steps(cluster.limit(0), cluster, linked, WITHOUT)
    holds = held.join(first, "query_id").select("query_id", F.lit("").alias("finding"), "given", none.cast("string").alias("intent_id"), F.array("routed").alias("exclude"))
    has = leads.held_entities(holds, first, intents).drop("method").where("source_intent IS NOT NULL")
    lead = followups.fill(followups.candidates(has, intents, g.parents, g.entities, g.best, topics)).select("query_id", "rank", "intent_id")
    steps = followups.next_steps(lead, cluster, linked, WITH_HELD)
    more = has.select(F.col("query_id").alias("holder")).distinct()
    return steps.join(more, F.col("query_id") == F.col("holder"), "left").where(F.col("holder").isNotNull() | (F.col("rank") <= WITHOUT)).drop("holder")


def find(requests: DataFrame, vectors: DataFrame, catalog: Catalog, intent_vectors: DataFrame, endpoint_vectors: DataFrame, g: Graph, held: DataFrame | None = None, k: int = 12) -> Found:
    """Answer ``requests`` (query_id, query), those with a vector (query_id, vec) by it, the others by their words.

    Routes are search hits on intents, guarded by the arm: the nearest of the endpoints' vectors (ep_ord, vec), without thin
    ones, made once for the list, the guard and the capabilities. A request without a vector gets the concentrated list of
    its intents. Next steps are leads of what is ``held`` (query_id, given), the request's own cluster, then links.
    """
    requests = saved(requests.select("query_id", "query"), "requests")
    vectors = saved(vectors.join(requests.select("query_id"), "query_id", "left_semi"), "request-vectors")
    hits = saved(search.search_with_fallback(requests, vectors, catalog.intents, intent_vectors, catalog.endpoints, HITS), "hits")
    w = Window.partitionBy("query_id").orderBy("rank")
    order = saved(hits.where("kind = 'capability'").select("query_id", F.row_number().over(w).alias("rank"), F.col("capability_id").alias("intent_id")), "order")
    ids = catalog.endpoints.select("ep_ord", "id")
    near = search.block_top_k(requests.sparkSession, vectors, endpoint_vectors, k * ARM_FACTOR, "ep_ord").join(ids, "ep_ord").select("query_id", "rank", "id", "score")
    arm = saved(arms.rerank(near, catalog.endpoints), "arm")
    supports = saved(arms.support(arm, catalog.endpoints), "support")
    guarded = saved(arms.guard(order, supports), "routes")
    facts = catalog.endpoints.select("id", host_of(F.col("origin")).alias("host"), _address().alias("url"), F.concat_ws(" ", "method", _address()).alias("target"))
    blind = requests.join(vectors.select("query_id"), "query_id", "left_anti").select("query_id")
    alone = lambda df: df.join(blind, "query_id", "left_semi")
    listed = _from_arm(arm, facts, k).union(_from_intents(alone(hits), alone(order), requests, catalog, facts, k))
    seen = arms.matched_capabilities(guarded.join(blind, "query_id", "left_anti"), supports)
    matched = seen.union(alone(guarded).where("rank <= 8").select("query_id", "rank", "intent_id", F.lit(None).cast("double")))
    steps = _steps(guarded, hits, requests, catalog.intents, g, held).select("query_id", "rank", F.col("intent_id").alias("target"))
    return Found(listed, matched, steps)


def flat(found: Found) -> DataFrame:
    """(query_id, part, rank, target) of all three."""
    one = lambda df, name, target: df.select("query_id", F.lit(name).alias("part"), "rank", F.col(target).alias("target"))
    return one(found.endpoints, "endpoint", "target").union(one(found.capabilities, "capability", "intent_id")).union(one(found.steps, "step", "target"))


def answer_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different request of the given tables, answered from the enriched catalog; see the query ``found``."""
    from ..queries.answering import found_in

    return flat(found_in(spark, sf_dir))
