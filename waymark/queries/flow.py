"""Queries on the intent graph, entity flow and follow-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, followups, graph, rank
from . import views as v
from .catalog import HOST_SQL, _bind
from .views import BRIDGE_LIST, E, I, M, PARENT_SQL, with_

S, D = SparkSession, DataFrame

#: Links between parts' phrases by the distance of their numbers: two typed kinds and one that dangles.
TYPES = ("pipes_to", "alternative_of", "broader_of", "sibling_of")


def _links(spark: S, sf: str) -> D:
    """(from, type, to, note, pos) between intents that share an order: the most frequent pairs' types by their numbers."""
    li = v.table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 16).alias("ph")).distinct()
    a, b = li.select("l_orderkey", F.col("ph").alias("x")), li.select("l_orderkey", F.col("ph").alias("y"))
    n = a.join(b, "l_orderkey").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("(x * 7 + y * 3) % 5 = 0")
    ids = F.array(*[F.lit(i) for i in v.IDS], F.lit("no.such_intent"))
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), ((F.col("x") + F.col("y")) % 4 + 1).cast("int"))
    to = F.element_at(ids, F.when(F.col("y") == 15, F.lit(17)).otherwise(F.col("y") + 1).cast("int"))
    return n.select(F.element_at(ids, (F.col("x") + 1).cast("int")).alias("from"), kind.alias("type"), to.alias("to"), F.lit(None).cast("string").alias("note"), (F.col("x") * 100 + F.col("y")).alias("pos"))


_ID = "list_extract([" + ", ".join(f"'{x}'" for x in v.IDS) + ", 'no.such_intent'], {})"
L = (
    "lp AS (SELECT DISTINCT l_orderkey, l_partkey % 16 AS ph FROM lineitem),\n"
    "l0 AS (SELECT a.ph AS x, b.ph AS y FROM lp a JOIN lp b USING (l_orderkey) GROUP BY 1, 2),\n"
    f"l AS (SELECT {_ID.format('x + 1')} AS src, list_extract([" + ", ".join(f"'{t}'" for t in TYPES) + f"], (x + y) % 4 + 1) AS type, {_ID.format('CASE WHEN y = 15 THEN 17 ELSE y + 1 END')} AS dst, x * 100 + y AS pos FROM l0 WHERE (x * 7 + y * 3) % 5 = 0)"
)
IDS_SQL = "SELECT intent_id FROM i"


def links(spark: S, sf: str) -> D:
    return _links(spark, sf).select("from", "type", "to")


def inverse_links(spark: S, sf: str) -> D:
    return graph.add_inverse(_links(spark, sf), v.intents(spark, sf)).select("from", "type", "to", F.coalesce("note", F.lit("")).alias("note"))


def _related(spark: S, sf: str) -> D:
    """(from, to, pos): each intent's next but one."""
    ids = F.array(*[F.lit(i) for i in v.IDS])
    return v.intents(spark, sf).select(F.col("id").alias("from"), F.element_at(ids, ((F.col("intent_ord") + 2) % 16 + 1)).alias("to"), F.col("intent_ord").alias("pos"))


def merged_related(spark: S, sf: str) -> D:
    return graph.merge_related(_links(spark, sf), _related(spark, sf)).select("from", "type", "to")


def related_options(spark: S, sf: str) -> D:
    e = v.faceted(spark, sf)
    best = rank.rank_neutral(rank.with_intents(e, v.intents(spark, sf)), ["intent_id"], 1, rank.relevance_bonus(F.col("consumes"), F.col("produces")))
    out = graph.related_options(_links(spark, sf), v.intents(spark, sf), best)
    return out.select("intent_id", "rank", "relation", "relation_label", "group", "target", "label", "endpoint_id")


def forward_flow(spark: S, sf: str) -> D:
    return graph.forward_flow(v.intents(spark, sf), v.parents(spark)).select("from", "to", "entity", "match")


def lateral_flow(spark: S, sf: str) -> D:
    return graph.lateral_flow(v.intents(spark, sf), v.parents(spark), v.entities(spark, sf)).select("entity", "from_domain", "to", "to_domain")


def consumers(spark: S, sf: str) -> D:
    return graph.consumers_by_entity(v.intents(spark, sf), v.parents(spark)).select("held", "intent_id", "domain", "port_entity")


def entity_sets(spark: S, sf: str) -> D:
    by_intent, _ = graph.entity_index(v.intents(spark, sf), v.parents(spark))
    return by_intent.select("intent_id", F.array_join("produces", ",").alias("produces"), F.array_join("consumes", ",").alias("consumes"))


def linked_capabilities(spark: S, sf: str) -> D:
    """Capabilities of endpoints after the intents' references are added, as sorted sets."""
    refs = v.refs(spark, sf)
    out = graph.link_capabilities(v.endpoints(spark, sf), refs)
    return out.select("ep_ord", F.array_join(F.sort_array("capabilities"), ",").alias("capabilities"))


def majority_domains(spark: S, sf: str) -> D:
    return graph.majority_domains(v.refs(spark, sf).groupBy("intent_id", "origin", "method", "path").agg(F.min("rank").alias("rank")), v.faceted(spark, sf))


def integrity(spark: S, sf: str) -> D:
    words = v.intents(spark, sf).select(F.explode("consumes").alias("p")).select(F.col("p.entity").alias("entity")).distinct()
    out = audit.integrity(v.intents(spark, sf), _links(spark, sf), _related(spark, sf).select("from", "to"), words)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("intent_id").alias("least"))


def contributed(spark: S, sf: str) -> D:
    """The intents as contributions to a catalog that knows those with over the mean number of parts."""
    i = v.intents(spark, sf)
    known = i.where(F.col("intent_ord") % 2 == 0).select("id")
    vocabulary = v.entities(spark, sf).where("name <> 'Money'").select("name", "kind", (F.col("name") == "Text").alias("deprecated"), F.when(F.col("name") == "Place", F.array(F.lit("Venue"))).alias("absorbs"))
    out = audit.contributed(i, known, vocabulary, _links(spark, sf))
    return out.select("id", "valid", F.array_join("errors", ";").alias("errors"), F.size("warnings").alias("n_warnings"))


def followups_pool(spark: S, sf: str) -> D:
    return _pool(spark, sf).select("query_id", "intent_id", "bridge", F.round("score", 6).alias("score"), F.round("relevance", 6).alias("relevance"))


def _pool(spark: S, sf: str) -> D:
    """Customers hold two entities each, by their nation and their number; topics come from their orders' priorities."""
    i = v.intents(spark, sf)
    c = v.table(spark, sf, "customer")
    names = F.array(*[F.lit(x) for x in ("City", "Brand", "Location", "Domain", "Query")])
    one = c.select(F.col("c_custkey").alias("query_id"), F.lit(0).alias("pos"), F.element_at(names, (F.col("c_custkey") % 5 + 1).cast("int")).alias("entity"), F.col("c_custkey"), "c_nationkey")
    two = c.select(F.col("c_custkey").alias("query_id"), F.lit(1).alias("pos"), F.element_at(F.array(F.lit("Company"), F.lit("Place")), (F.col("c_nationkey") % 2 + 1).cast("int")).alias("entity"), F.col("c_custkey"), "c_nationkey")
    ids = F.array(*[F.lit(x) for x in v.IDS])
    held = one.union(two).select("query_id", "pos", "entity", F.lit("identity").alias("kind"), F.element_at(ids, (F.col("c_custkey") % 16 + 1).cast("int")).alias("source_intent"), F.array(F.element_at(ids, (F.col("c_nationkey") % 16 + 1).cast("int"))).alias("exclude"))
    o = v.table(spark, sf, "orders")
    topical = o.groupBy(F.col("o_custkey").alias("query_id"), F.element_at(ids, (F.col("o_orderkey") % 16 + 1).cast("int")).alias("intent_id")).agg(F.count(F.lit(1)).cast("double").alias("topic"))
    best = i.select(F.col("id").alias("intent_id"), F.lit("x").alias("id"), (F.col("intent_ord") / 16).alias("quality"))
    return followups.candidates(held, i, v.parents(spark), v.entities(spark, sf), best, topical)


def next_steps(spark: S, sf: str) -> D:
    """Leads from suppliers of an order's lines, the query's cluster from its parts, links from its returned lines."""
    li = v.table(spark, sf, "lineitem")
    step = lambda df, key: df.groupBy(F.col("l_orderkey").alias("query_id"), (F.col(key) % 16).cast("string").alias("intent_id")).agg(F.min("l_linenumber").alias("rank")).select("query_id", "rank", "intent_id")
    return followups.next_steps(step(li, "l_suppkey"), step(li, "l_partkey"), step(li.where("l_returnflag = 'R'"), "l_quantity"), 6)


def orphan_hosts(spark: S, sf: str) -> D:
    return audit.orphan_hosts(v.endpoints(spark, sf), 20).select("rank", "host", "n", F.array_join("samples", ",").alias("samples"))


def orphan_prefixes(spark: S, sf: str) -> D:
    return audit.orphan_prefixes(v.endpoints(spark, sf), 20)


def uncovered_terms(spark: S, sf: str) -> D:
    from ..functions.text import bind_tokens

    words = v.intents(spark, sf).where("intent_ord < 8").select(F.explode(bind_tokens(F.concat_ws(" ", "id", "label"))).alias("term")).distinct()
    return audit.uncovered_terms(v.endpoints(spark, sf), words, 20).select("rank", "term", "df", F.round("weight", 6).alias("weight"))


def bind_rate(spark: S, sf: str) -> D:
    return audit.bind_rate(v.endpoints(spark, sf))


def binding_precision(spark: S, sf: str) -> D:
    out = audit.binding_precision(v.faceted(spark, sf), v.intents(spark, sf))
    return out.select("intent_id", "bound", "domain_mismatch", "domain_denom", F.round("domain_rate", 6).alias("domain_rate"))


def bind_comparison(spark: S, sf: str) -> D:
    e = v.endpoints(spark, sf)
    return audit.bind_comparison(e, e.withColumn("capabilities", F.slice("capabilities", 1, 1)))


def catalog_rollup(spark: S, sf: str) -> D:
    out = audit.catalog_rollup(v.refs(spark, sf))
    return out.select("intent_id", "endpoints", F.array_join("hosts", ",").alias("hosts"), F.array_join("samples", ",").alias("samples"))


def coverage(spark: S, sf: str) -> D:
    """Hosts of half the pages' URLs as losses, those of the rest as the corpus."""
    from ..functions.ids import url_origin

    p = v.table(spark, sf, "pages").select("page_id", url_origin(F.col("url")).alias("origin"))
    return audit.coverage(p.where("page_id % 2 = 0").select("origin"), p.where("page_id % 2 = 1").select("origin"), 30)


def provider_corpus(spark: S, sf: str) -> D:
    return audit.provider_corpus(v.endpoints(spark, sf)).select("provider", "text")


_BACK = "CASE type WHEN 'alternative_of' THEN 'alternative_of' WHEN 'sibling_of' THEN 'sibling_of' WHEN 'broader_of' THEN 'narrower_of' WHEN 'narrower_of' THEN 'broader_of' WHEN 'pipes_to' THEN 'fed_by' END"
_ORDER = "list_position([" + ", ".join(f"'{x}'" for x in graph.RELATION_ORDER) + "], type)"
_map = lambda d, c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in d.items()) + " END"
_EXP = PARENT_SQL + ",\nmade AS (SELECT intent_id, domain, produces AS own, produces AS port, 'exact' AS match FROM i UNION ALL SELECT intent_id, domain, produces, parent, 'parent' FROM i JOIN par ON child = produces)"
_REL = f"rel AS (SELECT intent_id AS src, {_ID.format('(ph + 2) % 16 + 1')} AS dst FROM i)"
_GRAPH = with_(E, I, L)

#: Scores of what is held (``h2``) and topical (``top``), up to the pool ``po``.
FOLLOW = (
    "con AS (SELECT consumes AS held_e, intent_id, domain, consumes AS port FROM i UNION SELECT child, intent_id, domain, consumes FROM i JOIN par ON parent = consumes),\n"
    "w AS (SELECT h2.qid, con.intent_id, bridge, con.domain, CASE WHEN entity = port THEN 1.0 WHEN parent = port THEN 0.7 END AS st, coalesce(topic, 0) AS topic, i.ph AS io, sd.domain AS sdom, h2.pos FROM h2 JOIN con ON con.held_e = bridge JOIN i ON i.intent_id = con.intent_id LEFT JOIN i sd ON sd.intent_id = src "
    "LEFT JOIN top ON top.qid = h2.qid AND top.intent_id = con.intent_id WHERE bridge IS NOT NULL AND con.intent_id <> exc AND con.intent_id <> src AND i.action NOT IN ('send', 'provision', 'transform', 'execute')),\n"
    "w2 AS (SELECT *, min(topic) OVER (PARTITION BY qid) AS lo, max(topic) OVER (PARTITION BY qid) - min(topic) OVER (PARTITION BY qid) AS spread FROM w WHERE st IS NOT NULL),\n"
    "w3 AS (SELECT *, st * CASE WHEN spread > 0 THEN 0.15 + 0.85 * (topic - lo) / spread ELSE 1 END AS relevance FROM w2),\n"
    "w4 AS (SELECT *, relevance + CASE WHEN sdom <> domain THEN 0.05 ELSE 0 END + 0.05 * io / 16 AS score FROM w3),\n"
    "w5 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos, io) AS ord, count(*) FILTER (relevance >= 0.3) OVER (PARTITION BY qid) AS n_ok FROM w4),\n"
    "po AS (SELECT * FROM w5 WHERE spread <= 0 OR relevance >= 0.3 OR (n_ok = 0 AND ord = 1))"
)
#: The greedy choice from ``po``, one candidate a round: ``filled``.
FILL = """pk AS (SELECT qid, intent_id, bridge, coalesce(domain, 'unknown') AS domain, CAST(score AS DOUBLE) AS score,
        row_number() OVER (PARTITION BY qid ORDER BY ord) AS k FROM po),
    ch AS (SELECT DISTINCT qid, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(i VARCHAR, b VARCHAR, d VARCHAR, s DOUBLE)[]) AS got FROM pk
        UNION ALL SELECT pk.qid, pk.k, CASE WHEN len(got) < 8 AND len(list_filter(got, lambda g: g.i = intent_id)) = 0
            AND len(list_filter(got, lambda g: g.b = bridge)) < 3 AND len(list_filter(got, lambda g: g.d = domain)) < 2
            THEN list_append(got, {'i': intent_id, 'b': bridge, 'd': domain, 's': score}) ELSE got END
        FROM ch JOIN pk ON pk.qid = ch.qid AND pk.k = ch.k + 1),
    ends AS (SELECT qid, arg_max(got, k) AS got FROM ch GROUP BY 1),
    filled AS (SELECT qid AS query_id, rank, g.i AS intent_id, g.b AS bridge, g.s AS score FROM (
        SELECT qid, unnest(got) AS g, generate_subscripts(got, 1) AS rank FROM ends))"""
POOL = (
    with_(E, I, PARENT_SQL)
    + f", held AS (SELECT c_custkey AS qid, 0 AS pos, list_extract(['City', 'Brand', 'Location', 'Domain', 'Query'], c_custkey % 5 + 1) AS entity, c_custkey, c_nationkey FROM customer UNION ALL SELECT c_custkey, 1, list_extract(['Company', 'Place'], c_nationkey % 2 + 1), c_custkey, c_nationkey FROM customer),\n"
    f"h2 AS (SELECT held.*, parent, CASE WHEN entity IN {BRIDGE_LIST} THEN entity WHEN parent IN {BRIDGE_LIST} THEN parent END AS bridge, {_ID.format('c_custkey % 16 + 1')} AS src, {_ID.format('c_nationkey % 16 + 1')} AS exc FROM held LEFT JOIN par ON child = entity WHERE entity <> 'Query'),\n"
    f"top AS (SELECT o_custkey AS qid, {_ID.format('o_orderkey % 16 + 1')} AS intent_id, CAST(count(*) AS DOUBLE) AS topic FROM orders GROUP BY 1, 2),\n"
    + FOLLOW
)
_POOL = POOL + "\nSELECT qid AS query_id, intent_id, bridge, round(score, 6) AS score, round(relevance, 6) AS relevance FROM po"

ALL = {
    "links": (links, _GRAPH + 'SELECT src AS "from", type, dst AS "to" FROM l'),
    "inverse_links": (
        inverse_links,
        _GRAPH + f", bk AS (SELECT dst AS src, {_BACK} AS type, src AS dst, pos FROM l WHERE src <> dst AND dst IN ({IDS_SQL})),\n"
        "b1 AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY pos, type) AS rn FROM bk WHERE type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l WHERE l.src = bk.src AND l.dst = bk.dst))\n"
        "SELECT src AS \"from\", type, dst AS \"to\", '' AS note FROM l UNION ALL SELECT src, type, dst, 'auto-generated inverse' FROM b1 WHERE rn = 1",
    ),
    "merged_related": (merged_related, _GRAPH + f", {_REL}\n" + 'SELECT src AS "from", type, dst AS "to" FROM l UNION ALL SELECT src, \'sibling_of\', dst FROM rel WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.src = rel.src AND l.dst = rel.dst)'),
    "related_options": (
        related_options,
        "WITH " + M + ",\n" + L + ",\nbest AS (SELECT intent_id, id FROM m WHERE rank = 1),\n"
        f"o AS (SELECT l.*, i.label, {_ORDER} AS ro, row_number() OVER (PARTITION BY src, dst ORDER BY {_ORDER}, pos) AS rn FROM l JOIN i ON i.intent_id = dst WHERE src <> dst)\n"
        f"SELECT src AS intent_id, row_number() OVER (PARTITION BY src ORDER BY ro, pos, dst) AS rank, type AS relation, {_map(graph.RELATION_LABEL, 'type')} AS relation_label, {_map(graph.RELATION_GROUP, 'type')} AS \"group\", dst AS target, label, best.id AS endpoint_id FROM o LEFT JOIN best ON best.intent_id = dst WHERE rn = 1",
    ),
    "forward_flow": (forward_flow, with_(E, I, _EXP) + 'SELECT made.intent_id AS "from", i.intent_id AS "to", port AS entity, match FROM made JOIN i ON i.consumes = port WHERE made.intent_id <> i.intent_id'),
    "lateral_flow": (
        lateral_flow,
        with_(E, I, PARENT_SQL) + f", held AS (SELECT DISTINCT x AS held FROM (SELECT unnest([{', '.join(repr(b) for b in v.BRIDGES)}]) AS x)),\nhx AS (SELECT held, held AS port FROM held UNION ALL SELECT held, parent FROM held JOIN par ON child = held),\n"
        "pr AS (SELECT DISTINCT held, i.intent_id AS dst, i.domain AS td FROM hx JOIN i ON i.consumes = port),\ndm AS (SELECT domain, min(ph) AS o FROM i GROUP BY 1)\n"
        'SELECT held AS entity, arg_min(dm.domain, dm.o) AS from_domain, dst AS "to", td AS to_domain FROM pr, dm WHERE dm.domain <> td GROUP BY 1, 3, 4',
    ),
    "consumers": (consumers, with_(E, I, PARENT_SQL) + "SELECT DISTINCT * FROM (SELECT consumes AS held, intent_id, domain, consumes AS port_entity FROM i UNION ALL SELECT child, intent_id, domain, consumes FROM i JOIN par ON parent = consumes)"),
    "entity_sets": (entity_sets, with_(E, I) + "SELECT intent_id, produces, consumes FROM i"),
    "linked_capabilities": (
        linked_capabilities,
        "WITH " + M + "\nSELECT ep_ord, coalesce(string_agg(c, ',' ORDER BY c), '') AS capabilities FROM e LEFT JOIN (SELECT id, intent_id AS c FROM caps JOIN i ON i.ph = ip UNION SELECT e.id, m.intent_id FROM m JOIN e USING (origin, method, path)) x USING (id) GROUP BY ep_ord",
    ),
    "majority_domains": (
        majority_domains,
        "WITH " + M + ",\nkeyed AS (SELECT intent_id, origin, method, path, min(rank) AS r FROM m GROUP BY ALL),\nmd AS (SELECT intent_id, f.domain, count(*) AS n, min(r) AS r FROM keyed JOIN f USING (origin, method, path) WHERE f.domain IS NOT NULL GROUP BY 1, 2)\n"
        "SELECT intent_id, domain FROM (SELECT *, row_number() OVER (PARTITION BY intent_id ORDER BY n DESC, r) AS rn FROM md) WHERE rn = 1",
    ),
    "integrity": (
        integrity,
        _GRAPH + f", {_REL},\niss AS (SELECT 'self_link' AS kind, src FROM l WHERE src = dst UNION ALL SELECT 'self_link', src FROM rel WHERE src = dst UNION ALL SELECT 'dangling_link', src FROM l WHERE src <> dst AND dst NOT IN ({IDS_SQL}) UNION ALL SELECT 'dangling_related', src FROM rel WHERE dst NOT IN ({IDS_SQL}) "
        "UNION ALL SELECT 'unknown_entity', intent_id FROM i WHERE produces NOT IN (SELECT consumes FROM i) UNION ALL SELECT 'asymmetric_link', src FROM (SELECT DISTINCT a.src, a.dst, a.type FROM l a JOIN l b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst AND a.type IN ('alternative_of', 'sibling_of') AND a.type <> b.type) "
        "UNION ALL SELECT 'pipes_to_flow', src FROM l JOIN i a ON a.intent_id = src JOIN i b ON b.intent_id = dst WHERE type = 'pipes_to' AND a.produces <> b.consumes)\nSELECT kind, count(*) AS n, min(src) AS least FROM iss GROUP BY 1",
    ),
    "contributed": (
        contributed,
        _GRAPH + ", er AS (SELECT DISTINCT intent_id, CASE WHEN x = 'Money' THEN 'unknown entity: Money' WHEN x = 'Text' THEN 'deprecated entity: Text' END AS err FROM (SELECT intent_id, unnest([consumes, produces]) AS x FROM i)),\n"
        "typ AS (SELECT unnest(['place', 'company', 'person', 'product', 'productcategory', 'domain', 'cryptoasset', 'walletaddress']) AS t),\n"
        "wr AS (SELECT intent_id AS id, 'new' AS w FROM i WHERE ph % 2 = 1 UNION SELECT src, dst FROM l WHERE src <> dst AND dst NOT IN (SELECT intent_id FROM i WHERE ph % 2 = 0) UNION SELECT intent_id, 'typed' FROM i, typ WHERE consumes = 'Query' AND contains(lower(label), t))\n"
        "SELECT intent_id AS id, coalesce(errors, '') = '' AS valid, coalesce(errors, '') AS errors, coalesce(x.n, 0) AS n_warnings FROM i LEFT JOIN (SELECT intent_id, string_agg(err, ';' ORDER BY err) AS errors FROM er WHERE err IS NOT NULL GROUP BY 1) USING (intent_id) LEFT JOIN (SELECT id, count(*) AS n FROM wr GROUP BY 1) x ON x.id = intent_id",
    ),
    "followups_pool": (followups_pool, _POOL),
    "next_steps": (
        next_steps,
        "WITH s AS (SELECT l_orderkey AS q, CAST(l_suppkey % 16 AS VARCHAR) AS x, min(l_linenumber) AS r, 0 AS st, 'held' AS src FROM lineitem GROUP BY 1, 2 UNION ALL SELECT l_orderkey, CAST(l_partkey % 16 AS VARCHAR), min(l_linenumber), 1, 'query' FROM lineitem GROUP BY 1, 2 "
        "UNION ALL SELECT l_orderkey, CAST(CAST(l_quantity % 16 AS DOUBLE) AS VARCHAR), min(l_linenumber), 2, 'link' FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),\none AS (SELECT q, x, min({'st': st, 'r': r, 'src': src}) AS a FROM s GROUP BY 1, 2)\n"
        "SELECT query_id, rank, intent_id, source FROM (SELECT q AS query_id, x AS intent_id, a.src AS source, row_number() OVER (PARTITION BY q ORDER BY a.st, a.r, x) AS rank FROM one) WHERE rank <= 6",
    ),
    "orphan_hosts": (
        orphan_hosts,
        with_(E) + f", o AS (SELECT regexp_replace({HOST_SQL.format('lower(origin)')}, '^www\\.', '') AS host, ep_ord, path FROM e WHERE NOT bound),\nt AS (SELECT *, row_number() OVER (ORDER BY n DESC, o) AS rank FROM (SELECT host, count(*) AS n, min(ep_ord) AS o FROM o GROUP BY 1)),\n"
        "s AS (SELECT host, string_agg(path, ',' ORDER BY rn) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ep_ord) AS rn FROM o) WHERE rn <= 3 GROUP BY 1)\nSELECT rank, host, n, samples FROM t JOIN s USING (host) WHERE rank <= 20",
    ),
    "orphan_prefixes": (orphan_prefixes, with_(E) + "SELECT array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '')[1:2], '/') AS prefix, count(*) AS n FROM e WHERE NOT bound GROUP BY 1 ORDER BY n DESC, prefix LIMIT 20"),
    "uncovered_terms": (
        uncovered_terms,
        with_(E, I)
        + ", tm AS (SELECT unnest(list_distinct({})) AS term FROM e WHERE NOT bound),\nvc AS (SELECT DISTINCT unnest({}) AS term FROM i WHERE ph < 8)\n".format(
            _bind.format("concat_ws(' ', summary, coalesce(description, ''), path, search_text)"), _bind.format("concat_ws(' ', intent_id, label)")
        )
        + "SELECT row_number() OVER (ORDER BY w DESC, term) AS rank, term, df, round(w, 6) AS weight FROM (SELECT term, count(*) AS df, count(*) * ln((SELECT count(*) FROM e WHERE NOT bound) / (1 + count(*))) AS w FROM tm WHERE term NOT IN (SELECT term FROM vc) GROUP BY 1) ORDER BY w DESC, term LIMIT 20",
    ),
    "bind_rate": (bind_rate, with_(E) + "SELECT count(*) AS total, count(*) FILTER (bound) AS bound, count(*) FILTER (NOT bound) AS orphans, count(*) FILTER (bound) / count(*) AS bind_rate FROM e"),
    "binding_precision": (
        binding_precision,
        "WITH " + M + ",\nx AS (SELECT i.intent_id, f.domain AS ed, i.domain AS d FROM caps JOIN i ON i.ph = ip JOIN f USING (id)),\n"
        "y AS (SELECT *, ed IS NOT NULL AS den, NOT (ed = d OR (d = 'travel' AND ed = 'maps') OR (d = 'maps' AND ed = 'travel') OR (d = 'finance' AND ed = 'crypto') OR (d = 'crypto' AND ed = 'finance')) AS bad FROM x)\n"
        "SELECT intent_id, count(*) AS bound, count(*) FILTER (den AND bad) AS domain_mismatch, count(*) FILTER (den) AS domain_denom, round(CASE WHEN count(*) FILTER (den) > 0 THEN count(*) FILTER (den AND bad) / count(*) FILTER (den) END, 6) AS domain_rate FROM y GROUP BY ROLLUP (intent_id)",
    ),
    "bind_comparison": (bind_comparison, with_(E, v.CAPS, I) + "SELECT intent_id, n0 AS before, coalesce(n1, 0) AS after, coalesce(n1, 0) - n0 AS delta FROM (SELECT ip, count(*) AS n0 FROM caps GROUP BY 1) a LEFT JOIN (SELECT ph, count(*) AS n1 FROM e WHERE bound GROUP BY 1) b ON b.ph = a.ip JOIN i ON i.ph = ip"),
    "catalog_rollup": (
        catalog_rollup,
        "WITH " + M + f",\nh AS (SELECT intent_id, {HOST_SQL.format('origin')} AS host, count(*) AS c, min(rank) AS r FROM m GROUP BY 1, 2),\nhr AS (SELECT intent_id, string_agg(host, ',' ORDER BY rn) AS hosts FROM (SELECT *, row_number() OVER (PARTITION BY intent_id ORDER BY c DESC, r) AS rn FROM h) WHERE rn <= 8 GROUP BY 1)\n"
        "SELECT intent_id, n AS endpoints, hosts, samples FROM (SELECT intent_id, count(*) AS n, string_agg(path, ',' ORDER BY rank) FILTER (rank <= 6) AS samples FROM m GROUP BY 1) JOIN hr USING (intent_id)",
    ),
    "coverage": (
        coverage,
        "WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM pages) SELECT host, losses, host IN (SELECT host FROM h WHERE page_id % 2 = 1) AS present FROM (SELECT host, count(*) AS losses FROM h WHERE page_id % 2 = 0 GROUP BY 1) ORDER BY present, losses DESC, host LIMIT 30",
    ),
    "provider_corpus": (
        provider_corpus,
        with_(E) + "SELECT provider, lower(concat_ws(' ', provider, provider_title, summary, search_text)) AS text FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY ep_ord) AS rn FROM (SELECT *, coalesce(provider_fqn, origin) AS provider FROM e)) WHERE rn = 1",
    ),
}
