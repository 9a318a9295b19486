"""Queries that put operators together: search with its fallback, whole answers, leads for findings, roll-ups, re-gating."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers, audit, followups, graph, labels, leads, rank, search
from ..plans.catalog import regate
from ..sources import openapi
from ..storage import saved
from ..tuning import Tuning
from . import views as v
from .binding import _KE, _KI, _SCORE_Q, _requests, intent_vectors
from .catalog import _GATE, _RESOLVE, HOST_SQL
from .flow import _ID, _ORDER, _links, _map, _pool, FILL, FOLLOW, L, POOL
from .views import BRIDGE_LIST, E, I, M, OBSERVATIONS, PARENT_SQL, Q, with_

S, D = SparkSession, DataFrame
PENALTIES = Tuning(domain_penalty=30.0, action_penalty=20.0, entity_penalty=10.0, gated_intents=v.IDS[:12])


def _hits(spark: S, sf: str, texts: D, k: int) -> D:
    """Search hits of ``texts`` (query_id, query): those of even number have the vector of their number, if there is one."""
    texts = saved(texts, "texts")
    vectors = v.table(spark, sf, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    own = vectors.join(texts.select("query_id"), "query_id", "left_semi")
    return search.search_with_fallback(texts, own, v.intents(spark, sf), intent_vectors(spark, sf), v.endpoints(spark, sf), k)


def searched(spark: S, sf: str) -> D:
    """Five hits of each request, by vector where it has one and by words where not."""
    hits = _hits(spark, sf, _requests(spark, sf).select("query_id", "query"), 5)
    return hits.select("query_id", "rank", "kind", "capability_id", F.round("score", 9).alias("score"))


def _asks(spark: S, sf: str) -> D:
    ids = F.array(*[F.lit(x) for x in v.IDS])
    return v.queries(spark, sf).select("query_id", "query", F.element_at(ids, (F.col("ph") + 1).cast("int")).alias("intent_id"))


def _keyed(refs: D) -> D:
    return refs.groupBy("intent_id", "origin", "method", "path").agg(F.min("rank").alias("rank"))


def answered(spark: S, sf: str) -> D:
    """Every customer's request with its endpoints, prices, inputs and rails, and the options related to its intent."""
    e, refs, i = v.faceted(spark, sf), v.refs(spark, sf), v.intents(spark, sf)
    e = saved(rank.with_breadth(e, refs), "endpoints")
    best = rank.rank_neutral(rank.with_intents(e, i), ["intent_id"], 1, rank.relevance_bonus(F.col("consumes"), F.col("produces")))
    out = answers.answers(_asks(spark, sf), _keyed(refs), e, i, _links(spark, sf), best, 3)
    return out.select(
        "query_id", "intent_id", "kind", "rank", "target", "price_usd", F.array_join("inputs", ",").alias("inputs"),
        F.array_join("rails", ",").alias("rails"), "relation",
    )


def resolved_by_facets(spark: S, sf: str) -> D:
    """Requests resolved with penalties for contradicting facets, half of which are authored."""
    authored = F.col("ep_ord") % 2 == 0
    verb = F.element_at(F.array(*[F.lit(x) for x in v.ACTIONS]), (F.col("ep_ord") % 7 + 1).cast("int"))
    e = v.faceted(spark, sf)
    own = F.col("facets").withField("authored", authored).withField("action", F.when(F.col("ep_ord") % 3 == 0, verb))
    refs = v.refs(spark, sf)
    e = saved(rank.with_breadth(e.withColumn("facets", own), refs), "endpoints")
    out = rank.resolve(_asks(spark, sf), _keyed(refs), e, v.intents(spark, sf), 3, PENALTIES)
    return out.select("query_id", "intent_id", "rank", F.round("score", 6).alias("score"), "price_usd")


SEMANTIC = Tuning(semantic_floor=0.05, breadth_threshold=3)


def resolved_semantic(spark: S, sf: str) -> D:
    """Each different request with a vector, where close endpoints of hosts with few intents are rescued."""
    refs = v.refs(spark, sf)
    e = saved(rank.with_breadth(v.faceted(spark, sf), refs), "endpoints")
    vec = v.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    own = e.select("id", (F.col("ep_ord") % 500).alias("vec_id")).join(vec, "vec_id").select("id", "vec")
    ids = F.array(*[F.lit(x) for x in v.IDS])
    asks = saved(_requests(spark, sf).select("query_id", "query", F.element_at(ids, (F.col("ph") + 1).cast("int")).alias("intent_id")), "asks")
    out = rank.resolve(asks, _keyed(refs), e, v.intents(spark, sf), 3, SEMANTIC, (vec.withColumnRenamed("vec_id", "query_id"), own))
    return out.select("query_id", "intent_id", "rank", F.round("score", 6).alias("score"), "price_usd")


def _findings(spark: S, sf: str) -> D:
    """Customers' findings: a request, and for some a domain, a place, an intent or an entity that is given."""
    text = (
        "concat(query, CASE WHEN c_custkey % 4 = 0 THEN concat(' at www.', lower(c_mktsegment), '.example.com') ELSE '' END, "
        "CASE WHEN c_custkey % 5 = 1 THEN ' in Los Angeles, CA' ELSE '' END)"
    )
    ids = F.array(*[F.lit(x) for x in v.IDS])
    pair = lambda e: F.struct(F.lit(e).alias("entity"), F.lit("x").alias("value"))
    c = v.table(spark, sf, "customer").join(v.queries(spark, sf), F.col("c_custkey") == F.col("query_id"))
    return c.select(
        "query_id", F.expr(text).alias("finding"), "ph",
        F.when(F.col("c_custkey") % 6 == 0, F.array(pair("Query"), pair("City"))).alias("given"),
        F.when(F.col("c_custkey") % 2 == 0, F.element_at(ids, (F.col("ph") + 1).cast("int"))).alias("intent_id"),
        F.array(F.element_at(ids, (F.col("c_nationkey") % 16 + 1).cast("int"))).alias("exclude"),
    )


def finding_leads(spark: S, sf: str) -> D:
    """Leads of every customer's finding; each different text is searched once."""
    found = saved(_findings(spark, sf), "findings")
    texts = found.groupBy(F.col("finding").alias("query")).agg(F.min("query_id").alias("text_id"))
    hits = saved(_hits(spark, sf, texts.select(F.col("text_id").alias("query_id"), "query"), 200), "hits")
    own = found.join(texts, found["finding"] == texts["query"]).select(found["query_id"], "text_id")
    hits = own.join(hits.withColumnRenamed("query_id", "text_id"), "text_id").drop("text_id")
    i = v.intents(spark, sf)
    best = i.select(F.col("id").alias("intent_id"), F.lit("x").alias("id"), (F.col("intent_ord") / 16).alias("quality"))
    out = leads.leads(found, hits, i, v.parents(spark), v.entities(spark, sf), best)
    return out.select("query_id", "rank", "intent_id", "bridge", F.round("score", 6).alias("score"))


def followups_filled(spark: S, sf: str) -> D:
    return followups.fill(_pool(spark, sf)).select("query_id", "rank", "intent_id", "bridge", F.round("score", 6).alias("score"))


def entity_rollup(spark: S, sf: str) -> D:
    out = audit.entity_rollup(v.intents(spark, sf))
    return out.select("entity", F.array_join("produced_by", ",").alias("produced_by"), F.array_join("consumed_by", ",").alias("consumed_by"))


def domain_rollup(spark: S, sf: str) -> D:
    out = audit.domain_rollup(v.intents(spark, sf), v.refs(spark, sf))
    return out.select("domain", F.array_join("intents", ",").alias("intents"), "endpoints")


def regated(spark: S, sf: str) -> D:
    """The parts as a snapshot that an earlier gate noted things on."""
    snapshot = v.endpoints(spark, sf).withColumns({
        "_source": F.lit("bazaar"), "_completeness": F.lit(13), "_flags": F.array(F.lit("old")), "_wellknown": F.lit(True),
    })
    out = regate(snapshot)
    return out.select("ep_ord", F.lit(len([c for c in out.columns if c.startswith("_")])).alias("notes"))


def merged_labels(spark: S, sf: str) -> D:
    """Labels of three parts in four, and returned ones of every third part, a third of them without an action."""
    e = v.endpoints(spark, sf)
    old = e.where("ep_ord % 4 <> 0").select(F.col("id").alias("key"), F.lit("old").alias("action"), F.lit("stale").alias("content_hash"))
    verb = F.when(F.col("ep_ord") % 9 == 0, F.lit(" ")).otherwise(F.lit("lookup"))
    new = e.where("ep_ord % 3 = 0").select(F.col("id").alias("key"), verb.alias("action"), F.lit("stale").alias("content_hash"))
    out = labels.merge_labels(old, new, e.where("ep_ord % 5 <> 0"))
    return out.join(e.select(F.col("id").alias("key"), "ep_ord"), "key").select("ep_ord", "action", "content_hash")


def inferred_links(spark: S, sf: str) -> D:
    """Authored links, and those inferred between intents that neighbour each other in the vocabulary."""
    made = _links(spark, sf)
    ids = F.array(*[F.lit(x) for x in v.IDS])
    near = v.intents(spark, sf).select(F.col("id").alias("from"), "intent_ord", F.explode(F.array(F.lit(1), F.lit(2), F.lit(1))).alias("k"))
    to = F.element_at(ids, ((F.col("intent_ord") + F.col("k")) % 16 + 1).cast("int"))
    inferred = near.select("from", F.lit("sibling_of").alias("type"), to.alias("to"), F.lit(None).cast("string").alias("note"), F.col("k").alias("pos"))
    return graph.merge_inferred(made, inferred).select("from", "type", "to")


def service_documents(spark: S, sf: str) -> D:
    """OpenAPI documents of suppliers whose service extension is whole, partly there, or of a wrong shape."""
    s = v.table(spark, sf, "supplier")
    docs = F.concat(
        F.lit('{"categories": ["shop", "'), F.col("s_nationkey"), F.lit('"], "docs": {"homepage": "'),
        F.when(F.col("s_suppkey") % 4 == 0, "no address").otherwise(F.concat(F.lit("https://s"), "s_suppkey", F.lit(".example.com/"))),
        F.lit('"'), F.when(F.col("s_suppkey") % 3 == 0, F.lit(', "llms": "https://example.com/llms.txt"')).otherwise(""), F.lit("}}"),
    )
    ext = F.when(F.col("s_suppkey") % 5 == 0, F.lit('{"categories": "shop"}')).otherwise(docs)
    doc = F.concat(F.lit('{"info": {"title": "S"}, "x-service-info": '), ext, F.lit(', "paths": {"/v1/a": {"get": {"summary": "A path"}}}}'))
    rows = s.select(F.concat(F.lit("https://s"), "s_suppkey", F.lit(".example.com")).alias("origin"), doc.alias("doc"))
    out = openapi.parse_openapi(rows, "2024-01-31")
    named = lambda k: F.try_element_at("service.docs", F.lit(k))
    return out.select("origin", F.array_join("service.categories", ",").alias("categories"), named("homepage").alias("homepage"), named("llms").alias("llms"))


_FINDING = (
    "concat(query, CASE WHEN query_id % 4 = 0 THEN concat(' at www.', lower(c_mktsegment), '.example.com') ELSE '' END, "
    "CASE WHEN query_id % 5 = 1 THEN ' in Los Angeles, CA' ELSE '' END)"
)
#: Requests as findings under the name ``q``.
FQ = Q.replace("q AS (", "q0 AS (", 1) + f",\nq AS (SELECT query_id, {_FINDING} AS query, ph, c_nationkey, c_mktsegment FROM q0 JOIN customer ON c_custkey = query_id)"
_IV = (
    "vx AS (SELECT vec_id % 16 AS ph, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings),\n"
    "vm AS (SELECT ph, p, avg(x) AS m FROM vx GROUP BY 1, 2),\n"
    "iv AS (SELECT ph, list(m / nrm ORDER BY p) AS c FROM vm JOIN (SELECT ph, sqrt(sum(m * m)) AS nrm FROM vm GROUP BY 1) USING (ph) GROUP BY 1)"
)


def _found(k: int) -> str:
    """``hit``: vector hits of even requests with an embedding, keyword hits of the rest."""
    return f"""vq AS (SELECT rq.query_id, embedding FROM rq JOIN embeddings ON vec_id = query_id WHERE vec_id % 2 = 0),
    vh AS (SELECT query_id, {_ID.format('iv.ph + 1')} AS cap, iv.ph AS o,
        1 / (1 + list_sum(list_transform(list_zip(embedding::DOUBLE[], c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score FROM vq, iv),
    kh AS (SELECT query_id, 'capability' AS kind, intent_id AS cap, score, 0 AS o, io AS ord FROM ki
        UNION ALL SELECT query_id, 'endpoint', fc.cap, score, 1, ke.ep_ord FROM ke LEFT JOIN (
            SELECT ep_ord, {_ID.format('ph + 1')} AS cap FROM e WHERE bound) fc USING (ep_ord)),
    hit AS (SELECT query_id, rank, 'capability' AS kind, cap, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o) AS rank FROM vh) WHERE rank <= {k}
        UNION ALL SELECT query_id, rank, kind, cap, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, o, ord) AS rank FROM kh
            WHERE query_id NOT IN (SELECT query_id FROM vq)) WHERE rank <= {k})"""


_OBSERVED = "(" + ", ".join(f"'{x}'" for x in OBSERVATIONS) + ")"
#: Held entities (``h2``) and topics (``top``) of findings.
_LEADS = f"""fq AS (SELECT query, ph, min(query_id) AS tid FROM q GROUP BY 1, 2),
    fh AS (SELECT q.query_id AS qid, hit.* EXCLUDE (query_id) FROM q JOIN fq USING (query, ph) JOIN hit ON hit.query_id = tid WHERE kind = 'capability'),
    top AS (SELECT qid, cap AS intent_id, arg_min(score, rank) AS topic FROM fh GROUP BY 1, 2),
    so AS (SELECT q.*, CASE WHEN q.query_id % 2 = 0 THEN {_ID.format('q.ph + 1')} ELSE r.cap END AS src, {_ID.format('c_nationkey % 16 + 1')} AS exc
        FROM q LEFT JOIN (SELECT qid, arg_min(cap, rank) AS cap FROM fh GROUP BY 1) r ON r.qid = q.query_id),
    ents AS (SELECT so.query_id AS qid, src, exc, CASE WHEN so.query_id % 6 = 0 THEN ['City']
        WHEN so.query_id % 4 = 0 OR so.query_id % 5 = 1 THEN list_filter([CASE WHEN so.query_id % 4 = 0 THEN 'Domain' END,
            CASE WHEN so.query_id % 4 = 0 THEN 'Company' END, CASE WHEN so.query_id % 5 = 1 THEN 'Place' END], lambda x: x IS NOT NULL)
        ELSE [produces] END AS es FROM so LEFT JOIN i ON i.intent_id = src),
    held AS (SELECT qid, src, exc, unnest(es) AS entity, generate_subscripts(es, 1) - 1 AS pos FROM ents),
    h2 AS (SELECT held.*, parent, CASE WHEN entity IN {BRIDGE_LIST} THEN entity WHEN parent IN {BRIDGE_LIST} THEN parent END AS bridge
        FROM held LEFT JOIN par ON child = entity WHERE entity <> 'Query' AND entity NOT IN {_OBSERVED})"""

_PEN = f"""xf AS (SELECT ep_ord, domain AS own_domain, output_entity AS own_made, ep_ord % 2 = 0 AS authored,
        CASE WHEN ep_ord % 3 = 0 THEN list_extract([{', '.join(f"'{x}'" for x in v.ACTIONS)}], ep_ord % 7 + 1) END AS verb FROM f),
    pn AS (SELECT sc.*, score - CASE WHEN i.ph >= 12 THEN 0 ELSE
        (CASE WHEN authored AND own_domain <> i.domain AND (own_domain, i.domain) NOT IN
            (('travel', 'maps'), ('maps', 'travel'), ('finance', 'blockchain'), ('blockchain', 'finance')) THEN 30 ELSE 0 END)
        + (CASE WHEN verb <> i.action AND (verb, i.action) NOT IN (('lookup', 'search'), ('search', 'lookup')) THEN 20 ELSE 0 END)
        + (CASE WHEN authored AND own_made <> i.produces THEN 10 ELSE 0 END) END AS s2
        FROM sc JOIN xf USING (ep_ord) JOIN i USING (intent_id))
    """

#: The resolve score of different requests, with the rescue by cosine.
_RQ = Q.replace("q AS (", "q0 AS (", 1) + ",\nq AS (SELECT min(query_id) AS query_id, query, ph FROM q0 GROUP BY query, ph)"
_RESCUE = (
    _RESOLVE.replace(Q, _RQ).replace("> 12 THEN -2.0 * (breadth - 12)", f"> {SEMANTIC.breadth_threshold} THEN -2.0 * (breadth - {SEMANTIC.breadth_threshold})").rstrip()
    + f""",
    cs AS (SELECT sc.*, coalesce(breadth, 0) AS b, list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[])
            / sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])) / sqrt(list_dot_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[])) AS cosine
        FROM sc JOIN e USING (ep_ord) LEFT JOIN hb ON hb.host = {HOST_SQL.format('e.origin')}
        LEFT JOIN embeddings x ON x.vec_id = sc.query_id LEFT JOIN embeddings y ON y.vec_id = sc.ep_ord % 500),
    rc AS (SELECT *, score + CASE WHEN cosine IS NOT NULL AND b <= {SEMANTIC.breadth_threshold}
        THEN {SEMANTIC.semantic_weight} * greatest(0, cosine - {SEMANTIC.semantic_floor}) ELSE 0 END AS s3 FROM cs)
    """
)
_HASH = "sha256(concat_ws(chr(10), method, path, summary, coalesce(description, ''), array_to_string(inputs, '|')))[1:16]"

ALL = {
    "searched": (
        searched,
        with_(E, I, Q, _SCORE_Q, _KI, _KE, _IV, _found(5)) + "SELECT query_id, rank, kind, cap AS capability_id, round(score, 9) AS score FROM hit",
    ),
    "answered": (
        answered,
        "WITH " + _RESOLVE.rstrip() + ",\n" + L + f""",
        best AS (SELECT intent_id, id FROM m WHERE rank = 1),
        fp AS (SELECT * FROM (SELECT sc.*, row_number() OVER (PARTITION BY query_id, intent_id ORDER BY score DESC, ref_rank, ep_ord) AS rank FROM sc)
            WHERE rank <= 3),
        o AS (SELECT l.*, {_ORDER} AS ro, row_number() OVER (PARTITION BY src, dst ORDER BY {_ORDER}, pos) AS rn
            FROM l JOIN i ON i.intent_id = dst WHERE src <> dst),
        op AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY ro, pos, dst) AS rank, dst, {_map(graph.RELATION_LABEL, 'type')} AS relation
            FROM o WHERE rn = 1)
        SELECT query_id, intent_id, 'endpoint' AS kind, rank, concat(method, ' ', origin, path) AS target, fp.price_usd,
            array_to_string(inputs[1:8], ',') AS inputs, CASE WHEN has_rails THEN 'x402' ELSE '' END AS rails, NULL AS relation
        FROM fp JOIN e USING (ep_ord)
        UNION ALL SELECT query_id, src, 'related', rank, dst, NULL, '', '', relation FROM q JOIN i USING (ph) JOIN op ON src = i.intent_id""",
    ),
    "resolved_by_facets": (
        resolved_by_facets,
        "WITH " + _RESOLVE.rstrip() + ",\n" + _PEN + """SELECT query_id, intent_id, rank, round(s2, 6) AS score, price_usd FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id, intent_id ORDER BY s2 DESC, ref_rank, ep_ord) AS rank FROM pn) WHERE rank <= 3""",
    ),
    "resolved_semantic": (
        resolved_semantic,
        "WITH " + _RESCUE + """SELECT query_id, intent_id, rank, round(s3, 6) AS score, price_usd FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id, intent_id ORDER BY s3 DESC, ref_rank, ep_ord) AS rank FROM rc) WHERE rank <= 3""",
    ),
    "finding_leads": (
        finding_leads,
        with_(E, I, FQ, _SCORE_Q, _KI, _KE, _IV, _found(200), PARENT_SQL, _LEADS, FOLLOW, FILL).replace("WITH ", "WITH RECURSIVE ", 1)
        + "SELECT query_id, rank, intent_id, bridge, round(score, 6) AS score FROM filled",
    ),
    "followups_filled": (
        followups_filled,
        (POOL + ",\n" + FILL + "\n").replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT query_id, rank, intent_id, bridge, round(score, 6) AS score FROM filled",
    ),
    "entity_rollup": (
        entity_rollup,
        with_(E, I) + """SELECT entity, coalesce(string_agg(p, ',' ORDER BY ph), '') AS produced_by, coalesce(string_agg(c, ',' ORDER BY ph), '') AS consumed_by
        FROM (SELECT produces AS entity, intent_id AS p, NULL AS c, ph FROM i UNION ALL SELECT consumes, NULL, intent_id, ph FROM i) GROUP BY 1""",
    ),
    "domain_rollup": (
        domain_rollup,
        "WITH " + M + """ SELECT domain, string_agg(intent_id, ',' ORDER BY ph) AS intents, CAST(sum(coalesce(n2, 0)) AS BIGINT) AS endpoints
        FROM i LEFT JOIN (SELECT intent_id, count(*) AS n2 FROM m GROUP BY 1) USING (intent_id) GROUP BY 1""",
    ),
    "regated": (regated, with_(E, _GATE) + "SELECT ep_ord, 0 AS notes FROM g WHERE verdict = 'pass'"),
    "merged_labels": (
        merged_labels,
        with_(E) + f"""SELECT ep_ord, CASE WHEN ep_ord % 3 = 0 AND ep_ord % 9 <> 0 THEN 'lookup' ELSE 'old' END AS action,
            CASE WHEN ep_ord % 5 <> 0 THEN {_HASH} ELSE 'stale' END AS content_hash
        FROM e WHERE ep_ord % 4 <> 0 OR (ep_ord % 3 = 0 AND ep_ord % 9 <> 0)""",
    ),
    "inferred_links": (
        inferred_links,
        with_(E, I, L) + f"""SELECT src AS "from", type, dst AS "to" FROM l
        UNION ALL SELECT DISTINCT intent_id, 'sibling_of', dst FROM (
            SELECT intent_id, {_ID.format('(i.ph + k) % 16 + 1')} AS dst FROM i, (SELECT unnest([1, 2]) AS k)) n
        WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.src = n.intent_id AND l.dst = n.dst)""",
    ),
    "service_documents": (
        service_documents,
        """WITH s AS (SELECT *, s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0 AS ok FROM supplier)
        SELECT concat('https://s', s_suppkey, '.example.com') AS origin, CASE WHEN ok THEN concat('shop,', s_nationkey) ELSE '' END AS categories,
            CASE WHEN ok THEN concat('https://s', s_suppkey, '.example.com/') END AS homepage,
            CASE WHEN ok AND s_suppkey % 3 = 0 THEN 'https://example.com/llms.txt' END AS llms FROM s""",
    ),
}
