"""The whole answer to every different request, as one plan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, rank
from ..plans.answer import Found, Graph, find, flat
from ..plans.enrich import Catalog
from ..storage import saved
from . import views as v
from .binding import _ARM, _KE, _KI, _SCORE_Q, _guarded, _ALL_ARM, intent_vectors
from .catalog import _RESOLVE, HOST_SQL
from .flow import _ID, _ORDER, _links, _map, FILL, FOLLOW, L
from .views import BRIDGE_LIST, OBSERVATIONS, PARENT_SQL, Q, with_
from .whole import _IV, _findings, _found, FQ


def found_in(spark: SparkSession, sf: str) -> Found:
    refs, i = v.refs(spark, sf), v.intents(spark, sf)
    e = saved(rank.with_breadth(v.faceted(spark, sf), refs), "endpoints")
    found = _findings(spark, sf)
    texts = saved(found.groupBy(F.col("finding").alias("query"), "ph").agg(F.min("query_id").alias("query_id")), "texts")
    vec = v.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    # an endpoint's vector is the sum of two, which no other endpoint has
    at = e.select("ep_ord", (F.col("ep_ord") % 500).alias("vec_id"), (F.floor(F.col("ep_ord") / 500) % 499).alias("other"))
    both = at.join(vec, "vec_id").join(vec.select(F.col("vec_id").alias("other"), F.col("vec").alias("w")), "other")
    own = both.select("ep_ord", F.zip_with("vec", "w", lambda a, b: a.cast("double") + b.cast("double")).alias("vec"))
    pair = F.array(F.struct(F.lit("City").alias("entity"), F.lit("x").alias("value")))
    best = i.select(F.col("id").alias("intent_id"), F.lit("x").alias("id"), (F.col("intent_ord") / 16).alias("quality"))
    g = Graph(_links(spark, sf), v.parents(spark), v.entities(spark, sf), best)
    asked = vec.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "query_id")
    return find(texts, asked, Catalog(e, i, refs), intent_vectors(spark, sf), own, g, texts.where("query_id % 6 = 0").select("query_id", pair.alias("given")))


def found(spark: SparkSession, sf: str) -> DataFrame:
    """Each different request's endpoints, capabilities and next steps, by vector where it has one and by words where not."""
    return flat(found_in(spark, sf))


_TAIL = _ARM[_ARM.index("thick AS") :]
_LOOSE_FOLLOW = FOLLOW.replace(" AND con.intent_id <> exc", "").replace(" AND i.action NOT IN ('send', 'provision', 'transform', 'execute')", "").replace("0.3", "0.25")
_LOOSE_FILL = FILL.replace("< 3", "< 99").replace("< 2", "< 99")
_second = lambda text: re.sub(r"\b(con|h2|w|w2|w3|w4|w5|po|pk|ch|ends|filled)\b", r"\1_b", text)
_OBSERVED = "(" + ", ".join(f"'{x}'" for x in OBSERVATIONS) + ")"
_BRIDGE = f"CASE WHEN entity IN {BRIDGE_LIST} THEN entity WHEN parent IN {BRIDGE_LIST} THEN parent END AS bridge"
_ASKS = "FROM q JOIN i ON i.ph = q.ph)"
_URL = "concat(origin, path)"

#: Routing and the arm: search hits ``hit``, the arm ``arm``, its thick part ``thick``, support ``sup``, guarded routes ``gg``.
_ROUTE = (
    with_(v.M, FQ, _SCORE_Q, _KI, _KE, _IV, _found(12))
    + f""", av AS (SELECT e.id, e.ep_ord, list_transform(list_zip(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), lambda z: z[1] + z[2]) AS vec
        FROM e JOIN embeddings x ON x.vec_id = ep_ord % 500 JOIN embeddings y ON y.vec_id = (ep_ord // 500) % 499),
    arm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ep_ord) AS rank FROM (
        SELECT query_id, id, ep_ord, list_dot_product(embedding::DOUBLE[], vec) AS score FROM vq, av)) WHERE rank <= 96),
    ord AS (SELECT query_id, cap AS intent_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM hit WHERE kind = 'capability'),
    {_TAIL}"""
    + _guarded(1.0)[len(_ALL_ARM) :]
)
_LIST = f""", tl AS (SELECT query_id, thick.rank AS pl_, concat_ws(' ', method, {_URL}) AS target, {HOST_SQL.format('origin')} AS host,
        row_number() OVER (PARTITION BY query_id, {_URL} ORDER BY thick.rank) AS rn FROM thick JOIN e USING (id)),
    th AS (SELECT *, row_number() OVER (PARTITION BY query_id, host ORDER BY pl_) AS hn FROM tl WHERE rn = 1),
    la AS (SELECT query_id, target, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN hn > 1 THEN 1 ELSE 0 END, pl_) AS rank FROM th)"""
#: The resolve score ``sc`` of requests without a vector and all their intents, and the list of it.
_BLIND = (
    _RESOLVE[_RESOLVE.index("keyed AS") :].replace(_ASKS, "FROM rq q JOIN ord USING (query_id) JOIN i USING (intent_id) WHERE q.query_id NOT IN (SELECT query_id FROM vq))").rstrip()
    + f""", rs3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, intent_id ORDER BY score DESC, ref_rank, ep_ord) AS rank FROM sc) WHERE rank <= 36),
    pl AS (SELECT rs3.query_id, ord.rank AS ir, {HOST_SQL.format('e.origin')} AS host, score, rs3.rank AS o, concat_ws(' ', method, {_URL}) AS target
        FROM rs3 JOIN ord USING (query_id, intent_id) JOIN e USING (ep_ord)),
    hd AS (SELECT query_id, target, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN h > 1 THEN 1 ELSE 0 END, score DESC, o) AS b
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, host ORDER BY score DESC, o) AS h FROM pl WHERE ir = 1)),
    tl2 AS (SELECT query_id, target, ir, row_number() OVER (PARTITION BY query_id, ir ORDER BY score DESC, o) AS b FROM pl WHERE ir > 1),
    dr AS (SELECT query_id, kh2.rank AS b, concat_ws(' ', method, {_URL}) AS target FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, o, ord) AS rank FROM kh WHERE query_id NOT IN (SELECT query_id FROM vq)) kh2
        JOIN e ON e.ep_ord = kh2.ord WHERE kind = 'endpoint' AND rank <= 12),
    un AS (SELECT query_id, target, {{'s': 0, 'a': 1, 'b': b}} AS pt FROM dr UNION ALL SELECT query_id, target, {{'s': 1, 'a': 1, 'b': b}} FROM hd WHERE b <= 36
        UNION ALL SELECT query_id, target, {{'s': 2, 'a': ir, 'b': b}} FROM tl2 WHERE b <= 2),
    lb AS (SELECT query_id, target, row_number() OVER (PARTITION BY query_id ORDER BY pt, target) AS rank FROM (SELECT query_id, target, min(pt) AS pt FROM un GROUP BY 1, 2))"""
)
_MATCHED = """, mc AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY gg.rank) AS rank, gg.intent_id FROM gg LEFT JOIN sup USING (query_id, intent_id)
    WHERE query_id NOT IN (SELECT query_id FROM vq) OR gg.rank = 1 OR support > 0)"""
_HELD = f""", top AS (SELECT query_id AS qid, cap AS intent_id, arg_min(score, rank) AS topic FROM hit WHERE kind = 'capability' GROUP BY 1, 2),
    rt1 AS (SELECT query_id AS qid, intent_id AS src FROM gg WHERE rank = 1),
    he AS (SELECT qid, src, CASE WHEN qid % 4 = 0 OR qid % 5 = 1 THEN list_filter([CASE WHEN qid % 4 = 0 THEN 'Domain' END, CASE WHEN qid % 4 = 0 THEN 'Company' END,
        CASE WHEN qid % 5 = 1 THEN 'Place' END], lambda x: x IS NOT NULL) ELSE [produces] END AS es FROM rt1 JOIN i ON i.intent_id = src),
    h0 AS (SELECT qid, src, unnest(es) AS entity, generate_subscripts(es, 1) - 1 AS pos FROM he),
    h1 AS (SELECT * FROM h0 WHERE entity NOT IN {_OBSERVED}),
    h3 AS (SELECT * FROM h1 UNION ALL SELECT qid, src, consumes, 0 FROM rt1 JOIN i ON i.intent_id = src WHERE qid NOT IN (SELECT qid FROM h1)),
    h2 AS (SELECT h3.*, parent, {_BRIDGE} FROM h3 LEFT JOIN par ON child = entity WHERE entity <> 'Query' AND entity NOT IN {_OBSERVED}),
    hb0 AS (SELECT qid, src, src AS exc, 'City' AS entity, 0 AS pos FROM rt1 WHERE qid % 6 = 0),
    h2_b AS (SELECT hb0.*, parent, {_BRIDGE} FROM hb0 LEFT JOIN par ON child = entity)"""
_STEPS = f""", ro AS (SELECT l.*, {_ORDER} AS o, row_number() OVER (PARTITION BY src, dst ORDER BY {_ORDER}, pos) AS rn FROM l JOIN i ON i.intent_id = dst WHERE src <> dst),
    rp AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY o, pos, dst) AS r, list_position(['next', 'alternatives', 'drill-down'], {_map(graph.RELATION_GROUP, 'type')}) AS gp FROM ro WHERE rn = 1),
    st AS (SELECT query_id AS qid, intent_id, {{'s': 0, 'r': rank}} AS pt FROM filled_b UNION ALL SELECT query_id, intent_id, {{'s': 1, 'r': rank}} FROM filled
        UNION ALL SELECT qid, dst, {{'s': 2, 'r': gp * 100 + r}} FROM rt1 JOIN rp USING (src) WHERE r <= 12 AND gp IS NOT NULL),
    so2 AS (SELECT qid, intent_id, row_number() OVER (PARTITION BY qid ORDER BY pt, intent_id) AS rank FROM (SELECT qid, intent_id, min(pt) AS pt FROM st GROUP BY 1, 2))
    """
_FOUND = (
    _ROUTE.rstrip() + _LIST + ",\n" + _BLIND + _MATCHED + ",\n" + L + ",\n" + PARENT_SQL + _HELD + ",\n" + _LOOSE_FOLLOW + ",\n" + _LOOSE_FILL + ",\n" + _second(FOLLOW) + ",\n" + _second(FILL) + _STEPS
).replace("WITH ", "WITH RECURSIVE ", 1)

ALL = {
    "found": (
        found,
        _FOUND
        + """SELECT query_id, 'endpoint' AS part, rank, target FROM la WHERE rank <= 12 UNION ALL SELECT query_id, 'endpoint', rank, target FROM lb WHERE rank <= 12
        UNION ALL SELECT query_id, 'capability', rank, intent_id FROM mc WHERE rank <= 8
        UNION ALL SELECT qid, 'step', rank, intent_id FROM so2 WHERE rank <= CASE WHEN qid % 6 = 0 THEN 8 ELSE 6 END""",
    ),
}
