"""Queries on checks of authored inputs, entity sources, scenarios and ranks of expected answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import embed_text, source_entities
from ..operators import arm, audit, evaluate, graph, rank
from ..sources import registry, vectors
from . import views as v
from .binding import ALL as BINDING
from .binding import _ALL_ARM
from .catalog import ALL as CATALOG
from .catalog import _embed
from .views import E, I, PARENT_SQL, Q, with_

S, D = SparkSession, DataFrame


def provider_origins(spark: S, sf: str) -> D:
    """Customers as providers: an eighth have no endpoints, a seventh no count, a ninth no address."""
    c = v.table(spark, sf, "customer").select(
        F.col("c_name").alias("fqn"), F.when(F.col("c_custkey") % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("https://P"), F.col("c_custkey") % 211, F.lit(".example.com/pay"))).alias("service_url"),
        F.when(F.col("c_custkey") % 7 != 0, (F.col("c_custkey") % 8).cast("int")).alias("endpoint_count"),
    )
    return registry.provider_origins(c)


def checked_bindings(spark: S, sf: str) -> D:
    e = v.endpoints(spark, sf)
    ids = F.array(*[F.lit(x) for x in v.IDS], F.lit("no.such_intent"))
    own = e.select("origin", F.lower("method").alias("method"), F.when(F.col("ep_ord") % 6 == 0, F.lit("/gone")).otherwise(F.col("path")).alias("path"), F.array(F.element_at(ids, (F.col("ep_ord") % 17 + 1).cast("int"))).alias("capabilities"))
    return audit.check_bindings(own, e, v.intents(spark, sf))


def checked_queries(spark: S, sf: str) -> D:
    """Customers' expectations: every fifth intent has no candidates, every seventh endpoint isn't indexed."""
    ids = F.array(*[F.lit(x) for x in v.IDS])
    e = v.endpoints(spark, sf).groupBy("ph").agg(F.min_by("id", "ep_ord").alias("endpoint_id"))
    q = v.queries(spark, sf).join(e, "ph").select(
        "query_id", F.when(F.col("query_id") % 5 == 0, "no.such_intent").when(F.col("query_id") % 5 == 1, F.lit(None).cast("string")).otherwise(F.element_at(ids, (F.col("ph") + 1).cast("int"))).alias("intent_id"),
        F.when(F.col("query_id") % 7 == 0, "gone").when(F.col("query_id") % 7 != 1, F.col("endpoint_id")).alias("endpoint_id"),
    )
    return audit.check_queries(q, v.refs(spark, sf), v.endpoints(spark, sf))


def entity_sources(spark: S, sf: str) -> D:
    """Orders' findings: given entities first, then those in the text, then what the intent produces."""
    o = v.table(spark, sf, "orders")
    given = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.struct(F.lit("Query").alias("entity"), F.lit("x").alias("value")), F.struct(F.lit("Person").alias("entity"), F.col("o_orderstatus").alias("value"))))
    given = F.when(F.col("o_orderkey") % 3 == 1, F.array(F.struct(F.lit("Query").alias("entity"), F.lit("x").alias("value")))).otherwise(given)
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("order from shop"), F.col("o_custkey"), F.lit(".example.org")))
    got = source_entities(given, text, F.array(F.lit("Place")))
    return o.select("o_orderkey", F.explode(got).alias("x")).select("o_orderkey", "x.entity", "x.value", "x.method", "x.confidence")


def select_ranks(spark: S, sf: str) -> D:
    """Where each part stands among the ten selected for its own intent."""
    e = v.faceted(spark, sf)
    refs = v.refs(spark, sf).groupBy("intent_id", "origin", "method", "path").agg(F.min("rank").alias("rank"))
    chosen = rank.select_for_intents(refs, e, v.intents(spark, sf))
    ids = F.array(*[F.lit(x) for x in v.IDS])
    want = e.select(F.col("ep_ord").alias("query_id"), F.element_at(ids, (F.col("ph") + 1).cast("int")).alias("intent_id"), F.col("id").alias("endpoint_id"))
    return rank.select_rank(chosen, want)


def attached_vectors(spark: S, sf: str) -> D:
    """Endpoints with the vector of their text, where the texts of even parts are embedded (as their length)."""
    e = v.endpoints(spark, sf)
    text = embed_text(F.col("summary"), F.col("description"), F.col("path"), F.col("inputs"))
    have = e.where("ep_ord % 2 = 0").select(vectors.text_hash(text).alias("text_hash"), F.array(F.length(text).cast("float")).alias("vec")).dropDuplicates(["text_hash"])
    return vectors.attach(e, have, text).select("ep_ord", F.col("vec")[0].cast("double").alias("n"))


def discover_ranks(spark: S, sf: str) -> D:
    """The first keyword hit of each request that is its phrase's intent, where that has an indexed reference."""
    from .binding import _requests
    from ..operators.search import keyword_search

    e = v.endpoints(spark, sf)
    hits = keyword_search(_requests(spark, sf), e, v.intents(spark, sf), 5)
    ids = F.array(*[F.lit(x) for x in v.IDS])
    want = _requests(spark, sf).select("query_id", F.element_at(ids, (F.col("ph") + 1).cast("int")).alias("intent_id"), F.lit("none").alias("endpoint_id"))
    refs = v.refs(spark, sf).where("intent_id NOT LIKE 'web.%'")
    return evaluate.discover_rank(hits, want, refs, e)


def bridge_scenarios(spark: S, sf: str) -> D:
    """Nations as scenarios: two held entities each, another domain than their region's phrase."""
    n = v.table(spark, sf, "nation")
    names = F.array(*[F.lit(x) for x in ("City", "Brand", "Domain", "Query", "SearchResults")])
    ids = F.array(*[F.lit(x) for x in v.IDS])
    at = lambda k: F.element_at(names, ((F.col("n_nationkey") + k) % 5 + 1).cast("int"))
    s = n.select(
        F.col("n_nationkey").alias("id"), F.array(at(0), at(F.col("n_regionkey"))).alias("held"), F.when(F.col("n_regionkey") == 1, "travel").when(F.col("n_regionkey") == 2, "cloud").alias("source_domain"),
        F.array(F.element_at(ids, F.lit(14)), F.element_at(ids, F.lit(9))).alias("expect"), F.when(F.col("n_nationkey") % 3 == 0, 1).alias("min_hits"), F.when(F.col("n_nationkey") % 7 == 0, 0).alias("max_lateral"),
    )
    out = evaluate.bridge_scenarios(s, v.intents(spark, sf), v.parents(spark), v.entities(spark, sf))
    return out.select("id", F.array_join("matched", ",").alias("matched"), F.array_join(F.sort_array("missing"), ",").alias("missing"), "passed")


def usefulness(spark: S, sf: str) -> D:
    """Orders as steps, their lines as leads, returned parts as judged."""
    li = v.table(spark, sf, "lineitem")
    leads = li.groupBy(F.col("l_orderkey").alias("step_id"), (F.col("l_partkey") % 16).cast("string").alias("intent_id")).agg(F.min("l_linenumber").alias("rank"), F.min("l_linestatus").alias("domain"), (F.min("l_quantity") > 5).alias("callable"))
    judged = li.groupBy(F.col("l_orderkey").alias("step_id"), (F.col("l_suppkey") % 16).cast("string").alias("intent_id")).agg((F.max("l_returnflag") == "R").alias("good"))
    steps = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("step_id"), (F.col("o_orderstatus") != "P").alias("held_bridge"))
    out = evaluate.usefulness(leads, judged, steps)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def reranked_arm(spark: S, sf: str) -> D:
    """Keyword hits of each request without thin endpoints, ranked anew."""
    from .binding import _arm

    e = rank.with_breadth(v.endpoints(spark, sf), v.refs(spark, sf))
    return arm.rerank(_arm(spark, sf, e), e).join(e.select("id", "ep_ord"), "id").select("query_id", "rank", "ep_ord")


def subtype_closure(spark: S, sf: str) -> D:
    """Entities with their children, for those that intents have on a port."""
    used = graph.ports(v.intents(spark, sf)).select("entity").distinct()
    _, closure = graph.entity_index(v.intents(spark, sf), v.parents(spark))
    return closure.join(used, "entity", "left_semi").select("entity", F.array_join("members", ",").alias("members"))


_ID = "list_extract([" + ", ".join(f"'{x}'" for x in v.IDS) + ", 'no.such_intent'], {})"

SELECTED, KEYWORD = CATALOG["selected"][1], BINDING["keyword_search"][1]

ALL = {
    "provider_origins": (provider_origins, "SELECT DISTINCT concat('https://p', c_custkey % 211, '.example.com') AS origin FROM customer WHERE c_custkey % 9 <> 0 AND (c_custkey % 7 = 0 OR c_custkey % 8 <> 0)"),
    "checked_bindings": (checked_bindings, with_(E) + "SELECT DISTINCT 'error' AS level, 'no.such_intent' AS subject FROM e WHERE ep_ord % 17 = 16 UNION ALL SELECT DISTINCT 'warning', concat_ws('|', origin, method, '/gone') FROM e WHERE ep_ord % 6 = 0"),
    "checked_queries": (
        checked_queries,
        with_(E, Q) + "SELECT query_id, 'intent without candidates' AS problem FROM q WHERE query_id % 5 = 0 AND ph IN (SELECT ph FROM e) UNION ALL SELECT query_id, 'endpoint not indexed' FROM q WHERE query_id % 7 = 0 AND ph IN (SELECT ph FROM e)",
    ),
    "entity_sources": (
        entity_sources,
        "SELECT o_orderkey, 'Person' AS entity, o_orderstatus AS value, 'explicit' AS method, 'high' AS confidence FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'Domain', concat('shop', o_custkey, '.example.org'), 'heuristic', 'medium' FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 "
        "UNION ALL SELECT o_orderkey, 'Company', concat('Shop', o_custkey), 'heuristic', 'medium' FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'Place', NULL, 'intent_produces', 'low' FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 1",
    ),
    "select_ranks": (
        select_ranks,
        "WITH s AS (" + SELECTED + ") SELECT p_partkey AS query_id, min(s.rank) AS rank FROM part LEFT JOIN s ON s.ep_ord = p_partkey AND s.intent_id = " + _ID.format("p_partkey % 16 + 1") + " GROUP BY 1",
    ),
    "attached_vectors": (
        attached_vectors,
        with_(E) + f", t AS (SELECT ep_ord, trim(regexp_replace({_embed}, '[ \\t\\n\\r]+', ' ', 'g')) AS t FROM e) SELECT ep_ord, CAST(length(t) AS DOUBLE) AS n FROM t WHERE t IN (SELECT t FROM t WHERE ep_ord % 2 = 0)",
    ),
    "discover_ranks": (
        discover_ranks,
        "WITH h AS (" + KEYWORD + "), c AS (SELECT min(c_custkey) AS query_id, c_custkey % 16 AS ph FROM customer GROUP BY c_custkey % 16, c_mktsegment, c_custkey % 3 = 0) "
        "SELECT c.query_id, min(h.rank) AS rank FROM c LEFT JOIN h ON h.query_id = c.query_id AND h.kind = 'capability' AND h.hit_id = " + _ID.format("c.ph + 1") + " AND h.hit_id NOT LIKE 'web.%' GROUP BY 1",
    ),
    "bridge_scenarios": (
        bridge_scenarios,
        with_(E, I, PARENT_SQL)
        + ", nm AS (SELECT ['City', 'Brand', 'Domain', 'Query', 'SearchResults'] AS l), h AS (SELECT n_nationkey AS id, unnest([list_extract(l, n_nationkey % 5 + 1), list_extract(l, (n_nationkey + n_regionkey) % 5 + 1)]) AS ent, CASE n_regionkey WHEN 1 THEN 'travel' WHEN 2 THEN 'cloud' END AS sd FROM nation, nm),\n"
        f"op AS (SELECT unnest([{', '.join(repr(b) for b in v.BRIDGES)}]) AS x UNION SELECT child FROM par WHERE parent IN {v.BRIDGE_LIST}),\nhe AS (SELECT id, sd, ent, ent AS port FROM h WHERE ent IN (SELECT x FROM op) UNION SELECT id, sd, ent, parent FROM h JOIN par ON child = ent WHERE ent IN (SELECT x FROM op)),\n"
        "ma AS (SELECT DISTINCT id, i.intent_id FROM he JOIN i ON i.consumes = port WHERE port IN (SELECT x FROM op) AND (sd IS NULL OR i.domain <> sd)),\nml AS (SELECT n_nationkey AS id, coalesce(list_sort(list(intent_id) FILTER (intent_id IS NOT NULL)), []) AS m FROM nation LEFT JOIN ma ON ma.id = n_nationkey GROUP BY 1),\n"
        "ex AS (SELECT *, list_sort(list_filter(['travel.hotel_reviews', 'identity.company_enrich'], lambda x: NOT list_contains(m, x))) AS ms FROM ml)\n"
        "SELECT id, array_to_string(m, ',') AS matched, array_to_string(ms, ',') AS missing, CASE WHEN id % 7 = 0 THEN len(m) = 0 WHEN id % 3 = 0 THEN 2 - len(ms) >= 1 ELSE len(ms) = 0 END AS passed FROM ex",
    ),
    "usefulness": (
        usefulness,
        "WITH l AS (SELECT l_orderkey AS s, CAST(l_partkey % 16 AS VARCHAR) AS i, min(l_linenumber) AS r, min(l_linestatus) AS d, min(l_quantity) > 5 AS c FROM lineitem GROUP BY 1, 2), j AS (SELECT l_orderkey AS s, CAST(l_suppkey % 16 AS VARCHAR) AS i, max(l_returnflag) = 'R' AS g FROM lineitem GROUP BY 1, 2),\n"
        "t AS (SELECT l.*, j.g FROM l LEFT JOIN j USING (s, i) WHERE r <= 8), dv AS (SELECT sum(n) AS n FROM (SELECT s, count(DISTINCT d) AS n FROM t WHERE r <= 6 GROUP BY 1)), st AS (SELECT count(*) AS n, avg(CASE WHEN o_orderstatus <> 'P' THEN 1.0 ELSE 0 END) AS ir FROM orders), gt AS (SELECT count(*) FILTER (g) AS n FROM j)\n"
        "SELECT round(avg(CASE WHEN c THEN 1.0 ELSE 0 END), 6) AS callable_precision, round(count(*) FILTER (g) / greatest(count(g), 1), 6) AS relevance_precision, round(any_value(ir), 6) AS identity_recall, round(count(*) FILTER (r <= 6 AND g) / greatest(any_value(gt.n), 1), 6) AS good_recall_6, "
        "round(count(*) FILTER (NOT g) / (any_value(st.n) * 8), 6) AS bad_rate_8, round(any_value(dv.n) / any_value(st.n), 6) AS domain_diversity FROM t, dv, st, gt",
    ),
    "reranked_arm": (reranked_arm, _ALL_ARM + "SELECT query_id, thick.rank AS rank, ep_ord FROM thick JOIN e USING (id)"),
    "subtype_closure": (
        subtype_closure,
        with_(E, I, PARENT_SQL) + ", al AS (SELECT child AS entity FROM par UNION SELECT parent FROM par), u AS (SELECT consumes AS x FROM i UNION SELECT produces FROM i) SELECT entity, concat_ws(',', entity, string_agg(child, ',' ORDER BY child)) AS members FROM al LEFT JOIN par ON parent = entity WHERE entity IN (SELECT x FROM u) GROUP BY entity",
    ),
}
