"""Queries on TF-IDF, binding, search and the arm."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import arm, bind, binder, search
from ..sources import vectors
from ..storage import saved
from ..tuning import Tuning
from . import views as v
from .catalog import HOST_SQL, STEM_SQL, _bind, _search
from .views import CAPS, E, I, Q, with_

S, D = SparkSession, DataFrame
TUNING = Tuning(dense_floor=0.12, sparse_floor=0.002, strong_sparse_floor=0.05, dense_margin=0.02, top_k=2)
SETTINGS = [TUNING, Tuning(dense_floor=0.2, sparse_floor=0.0, strong_sparse_floor=0.1, dense_margin=0.05, top_k=1), Tuning(dense_floor=0.3, sparse_floor=0.01, strong_sparse_floor=0.03, dense_margin=0.0, top_k=3)]


def idf(spark: S, sf: str) -> D:
    docs = v.table(spark, sf, "documents")
    counts = bind.token_counts(docs, "doc_id", F.col("text"))
    return bind.idf_table(counts, docs.count()).select("token", "df", F.round("idf", 6).alias("idf"))


def sparse_cosines(spark: S, sf: str) -> D:
    """Documents' whole texts against benchmark items, by TF-IDF."""
    docs = v.table(spark, sf, "documents")
    items = v.table(spark, sf, "benchmark").select(F.col("item_id").alias("intent_id"), "text")
    out = binder.sparse_cosines(docs, items, "doc_id", F.col("text"), F.col("text"))
    return out.select("doc_id", F.col("intent_id").alias("item_id"), F.round("sparse", 6).alias("sparse"))


def _centroids(spark: S, sf: str) -> D:
    """(intent_id, intent_ord, vec): each label's mean vector, scaled to unit length."""
    e = v.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    mean = e.groupBy("label", "p").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vec = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "m"))), lambda x: x["m"]).alias("c"))  # a label's components
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))
    return vec.select(F.col("label").cast("string").alias("intent_id"), F.col("label").alias("intent_ord"), F.transform("c", lambda x: x / norm).alias("vec"))


def _rows(spark: S, sf: str) -> D:
    return v.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))


def dense_scores(spark: S, sf: str) -> D:
    d = bind.dense_block(spark, _rows(spark, sf), _centroids(spark, sf), "vec_id")
    return d.select("vec_id", F.posexplode("dense").alias("label", "x")).select("vec_id", "label", F.round("x", 6).alias("dense"))


def _bindable(spark: S, sf: str) -> tuple[D, D]:
    """Vectors with the documents of their id, and label centroids with the benchmark items of theirs."""
    cent = saved(_centroids(spark, sf), "centroids")
    docs = v.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    ep = _rows(spark, sf).join(docs, "vec_id").withColumn("path", F.lit("/v1"))
    items = v.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("intent_id"), "text").join(cent, "intent_id")
    return ep, items


def _bound(spark: S, sf: str) -> D:
    return binder.bind_endpoints(*_bindable(spark, sf), "vec_id", F.col("text"), F.col("text"), TUNING)


def bound(spark: S, sf: str) -> D:
    return _bound(spark, sf).select("vec_id", "intent_id", "place", "promoted", "slot", "sparse_ok", "bound")


def bind_report(spark: S, sf: str) -> D:
    e = v.table(spark, sf, "embeddings").select("vec_id", F.lit("/v1").alias("path"))
    return bind.bind_report(_bound(spark, sf), e, "vec_id")


def floor_sweep(spark: S, sf: str) -> D:
    return binder.floor_sweep(*_bindable(spark, sf), "vec_id", F.col("text"), F.col("text"), SETTINGS)


def intent_vectors(spark: S, sf: str) -> D:
    """(intent_id, intent_ord, vec): each intent's vector, the mean of every sixteenth embedding, scaled to unit length."""
    e = v.table(spark, sf, "embeddings").select((F.col("vec_id") % 16).cast("int").alias("ph"), F.posexplode("embedding").alias("p", "x"))
    mean = e.groupBy("ph", "p").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vec = mean.groupBy("ph").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "m"))), lambda x: x["m"]).alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))
    ids = F.array(*[F.lit(x) for x in v.IDS])
    unit = F.transform("c", lambda x: x / norm)
    return saved(vec.select(F.element_at(ids, F.col("ph") + 1).alias("intent_id"), F.col("ph").alias("intent_ord"), unit.alias("vec")), "intent-vectors")


CATALOG_TUNING = Tuning(dense_floor=0.1, sparse_floor=0.01, strong_sparse_floor=0.3, dense_margin=0.02, top_k=2)
SWEPT = [Tuning(dense_floor=d, sparse_floor=0.01, strong_sparse_floor=s, dense_margin=m, top_k=2) for d in (0.0, 0.1, 0.2) for s in (0.2, 0.35) for m in (0.0, 0.05)]


def _catalog(spark: S, sf: str) -> tuple[D, D]:
    """All endpoints, some of them meta files, with vectors, and the intents that they carry, with theirs."""
    path = F.when(F.col("ep_ord") % 29 == 0, F.lit("/v1/status")).otherwise(F.col("path"))
    text_of = F.concat_ws(" ", "summary", "description", "path")
    vec = v.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    e = v.endpoints(spark, sf).select("ep_ord", path.alias("path"), text_of.alias("text"), (F.col("ep_ord") % 500).alias("vec_id"))
    own = v.intents(spark, sf).select(F.col("id").alias("intent_id"), F.concat_ws(" ", "id", "label").alias("text"))
    return e.join(vec, "vec_id"), own.join(intent_vectors(spark, sf), "intent_id")


def bound_catalog(spark: S, sf: str) -> D:
    """Every endpoint's binding to the catalog's intents."""
    out = binder.bind_endpoints(*_catalog(spark, sf), "ep_ord", F.col("text"), F.col("text"), CATALOG_TUNING)
    return out.select("ep_ord", "intent_id", "place", "promoted", "slot", "sparse_ok", "bound")


def catalog_bind_report(spark: S, sf: str) -> D:
    """What the binding of the catalog came to, meta files among it."""
    e, i = _catalog(spark, sf)
    return bind.bind_report(binder.bind_endpoints(e, i, "ep_ord", F.col("text"), F.col("text"), CATALOG_TUNING), e, "ep_ord")


def catalog_sweep(spark: S, sf: str) -> D:
    """The binding of the catalog decided for twelve settings."""
    return binder.floor_sweep(*_catalog(spark, sf), "ep_ord", F.col("text"), F.col("text"), SWEPT)


def quantized(spark: S, sf: str) -> D:
    """int8 vectors of all embeddings, and the score that they give with their own label's centroid."""
    e = v.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("text_hash"), F.col("embedding").alias("vec"))
    q = vectors.quantize(e, e)
    return q.select(F.col("text_hash").cast("long").alias("vec_id"), F.round("scale", 9).alias("scale"), F.array_join("q", ",").alias("q"))


def _packed(spark: S, sf: str) -> D:
    """The int8 index of all embeddings by vec_id."""
    e = v.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("text_hash"), F.col("embedding").alias("vec"))
    return vectors.packed(vectors.quantize(e, e)).select(F.col("text_hash").cast("long").alias("vec_id"), "scale", "q")


def int8_top_k(spark: S, sf: str) -> D:
    """The ten nearest of all int8 rows for each label's centroid."""
    q = _centroids(spark, sf).select(F.col("intent_id").alias("query_id"), "vec")
    return search.int8_top_k(q, _packed(spark, sf), 10, "vec_id").select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def int8_reranked(spark: S, sf: str) -> D:
    """Forty of the int8 arm for each label's centroid, and of these the ten nearest by whole vectors."""
    q = saved(_centroids(spark, sf).select(F.col("intent_id").alias("query_id"), "vec"), "centroids")
    hits = search.int8_top_k(q, _packed(spark, sf), 40, "vec_id")
    return search.reranked(hits, q, _rows(spark, sf), 10, "vec_id").select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def pair_cosines(spark: S, sf: str) -> D:
    """Every vector with its own label's centroid and the next label's."""
    q = saved(_centroids(spark, sf).select(F.col("intent_id").cast("int").alias("query_id"), "vec"), "centroids")
    own = v.table(spark, sf, "embeddings").select("vec_id", F.explode(F.array(F.col("label"), F.col("label") + 1)).alias("query_id"))
    return search.pair_cosines(own, q, _rows(spark, sf), "vec_id").select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"))


def keyword_top(spark: S, sf: str) -> D:
    """The seven best endpoints of each different request, by words."""
    out = search.keyword_top(_requests(spark, sf), v.endpoints(spark, sf), 7)
    return out.select("query_id", "rank", "id", F.round("score", 9).alias("score"))


def vector_intents(spark: S, sf: str) -> D:
    rows = _rows(spark, sf).withColumnRenamed("vec_id", "query_id")
    return search.vector_intents(rows, _centroids(spark, sf), 3).select("query_id", "rank", "intent_id", F.round("score", 6).alias("score"))


def endpoint_top_k(spark: S, sf: str) -> D:
    """The ten nearest of all vectors for each label's centroid."""
    q = _centroids(spark, sf).select(F.col("intent_id").alias("query_id"), "vec")
    return search.block_top_k(spark, q, _rows(spark, sf), 10, "vec_id").select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def _requests(spark: S, sf: str) -> D:
    """Each different request once."""
    return v.queries(spark, sf).groupBy("query", "ph").agg(F.min("query_id").alias("query_id"))


def keyword_intents(spark: S, sf: str) -> D:
    return search.keyword_intents(_requests(spark, sf), v.intents(spark, sf)).select("query_id", "intent_id", F.round("score", 6).alias("score"))


def keyword_endpoints(spark: S, sf: str) -> D:
    return search.keyword_endpoints(_requests(spark, sf), v.endpoints(spark, sf)).select("query_id", "ep_ord", F.round("score", 9).alias("score"))


def keyword_search(spark: S, sf: str) -> D:
    return search.keyword_search(_requests(spark, sf), v.endpoints(spark, sf), v.intents(spark, sf), 5).select("query_id", "rank", "kind", "hit_id", F.round("score", 9).alias("score"))


def match_capabilities(spark: S, sf: str) -> D:
    i = v.intents(spark, sf).select("id", "label", "description", "aliases", F.transform(F.concat("consumes", "produces"), lambda p: p["entity"]).alias("entities"), "facets.domain", "facets.action", F.col("parts").alias("endpoints"), "intent_ord")
    return search.match_capabilities(_requests(spark, sf), i).select("query_id", "rank", "intent_id", F.round("score", 6).alias("score"), F.round("strength", 6).alias("strength"))


def _arm(spark: S, sf: str, e: D) -> D:
    """Keyword hits of each request as an arm of ten."""
    return saved(search.keyword_top(_requests(spark, sf), e, 10).select("query_id", "rank", "id", "score", "ep_ord"), "arm")


def _order(spark: S, sf: str) -> D:
    """The intents that each request's words rank, five of them."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "intent_ord")
    k = search.keyword_intents(_requests(spark, sf), v.intents(spark, sf)).withColumn("score", F.round("score", 9))
    return saved(k.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("query_id", "rank", "intent_id"), "order")


def arm_support(spark: S, sf: str) -> D:
    e = saved(v.endpoints(spark, sf), "endpoints")
    return arm.support(_arm(spark, sf, e), e).select("query_id", "intent_id", F.round("support", 6).alias("support"))


def arm_guard(spark: S, sf: str) -> D:
    e = saved(v.endpoints(spark, sf), "endpoints")
    return arm.guard(_order(spark, sf), arm.support(_arm(spark, sf, e), e), 0.5)


def classified(spark: S, sf: str) -> D:
    """What each request is answered with: its guarded intents and its first endpoints, given back to every customer who asked."""
    e = saved(v.endpoints(spark, sf), "endpoints")
    guarded, direct = arm.classify(_order(spark, sf), _arm(spark, sf, e), e)
    answers = guarded.select("query_id", F.lit("capability").alias("kind"), "rank", F.col("intent_id").alias("hit_id"))
    answers = answers.union(direct.select("query_id", F.lit("endpoint").alias("kind"), "rank", F.col("id").alias("hit_id")))
    asked = v.queries(spark, sf).select(F.col("query_id").alias("customer"), "query", "ph").join(_requests(spark, sf), ["query", "ph"])
    return asked.join(answers, "query_id").select(F.col("customer").alias("query_id"), "kind", "rank", "hit_id")


def arm_routing(spark: S, sf: str) -> D:
    e = saved(v.endpoints(spark, sf), "endpoints")
    a = _arm(spark, sf, e).withColumn("id", F.col("id"))
    return arm.routing(a, e, _order(spark, sf)).select("query_id", "rank", "intent_id", F.round("score", 9).alias("score"))


def matched_capabilities(spark: S, sf: str) -> D:
    e = saved(v.endpoints(spark, sf), "endpoints")
    return arm.matched_capabilities(_order(spark, sf), arm.support(_arm(spark, sf, e), e)).select("query_id", "rank", "intent_id", F.round("support", 6).alias("support"))


def diversified(spark: S, sf: str) -> D:
    """Every line's order as a query's hits: a list in which suppliers (hosts) come once before they repeat."""
    li = v.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("query_id"), F.col("l_suppkey").alias("host"), F.col("l_quantity").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ep_ord"))
    return arm.diversify(li, 12).select("query_id", "rank", "host", "ep_ord")


def concentrated(spark: S, sf: str) -> D:
    """Orders as direct hits and lines as pools, by customer's nation."""
    o = v.table(spark, sf, "orders").join(v.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = v.table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    pools = lines.select(F.col("c_nationkey").alias("query_id"), F.col("l_linenumber").alias("intent_rank"), F.col("l_suppkey").alias("host"), F.col("l_extendedprice").alias("score"), F.col("l_orderkey").alias("ep_ord"), F.col("l_partkey").alias("id"))
    first = lines.groupBy(F.col("c_nationkey").alias("query_id")).agg(F.min("l_partkey").alias("id")).withColumn("rank", F.lit(1))
    once = pools.dropDuplicates(["query_id", "intent_rank", "host", "score", "ep_ord", "id"])
    return arm.concentrated(first, once)


_SCORE_Q = f"rq AS (SELECT query, ph, min(query_id) AS query_id FROM q GROUP BY 1, 2),\nqt AS (SELECT *, {_search.format('query')} AS qt FROM rq)"


def _tok_score(corpus_tokens: str) -> str:
    stems = f"list_transform({corpus_tokens}, lambda c: {STEM_SQL.format('c')})"
    return (
        f"list_sum(list_transform(qt, lambda t: CASE WHEN list_contains({corpus_tokens}, t) THEN 1.0 WHEN list_contains({stems}, {STEM_SQL.format('t')}) THEN 0.6 "
        f"WHEN len(list_filter({corpus_tokens}, lambda c: length(c) >= 4 AND length(t) >= length(c) + 3 AND ends_with(t, c))) > 0 THEN 0.5 ELSE 0 END)) / len(qt)"
    )


_KI = (
    f"ic AS (SELECT *, {_search.format(chr(99) + 'oncat_ws(' + repr(' ') + ', intent_id, label)')} AS ct FROM i),\n"
    f"ki0 AS (SELECT query_id, intent_id, ic.ph AS io, {_tok_score('ct')} AS t, (CASE WHEN contains(regexp_replace(lower(query), '[^a-z0-9._ -]', ' ', 'g'), lower(label)) THEN least(2.5, 0.5 + 0.2 * len(string_split(label, ' '))) ELSE 0 END) "
    "+ 0.4 * len(list_filter(list_filter(regexp_split_to_array(regexp_replace(intent_id, '[._-]', ' ', 'g'), ' '), lambda p: length(p) > 2), lambda p: contains(lower(query), p))) / len(list_filter(regexp_split_to_array(regexp_replace(intent_id, '[._-]', ' ', 'g'), ' '), lambda p: length(p) > 2)) AS b FROM qt, ic),\n"
    "ki AS (SELECT query_id, intent_id, io, (t + b) * (1 + 1.2 * least(1.0, t / 0.5)) AS score FROM ki0 WHERE t + b > 0)"
)
_KE = (
    f"ec AS (SELECT *, {_search.format('search_text')} AS ct FROM e),\n"
    f"ke0 AS (SELECT query_id, id, ep_ord, summary, guidance, price_usd, {_tok_score('ct')} AS t FROM qt, ec),\n"
    f"ke AS (SELECT query_id, id, ep_ord, t * (CASE WHEN regexp_matches(summary, '(?i)^(authenticate|prove action|delete a memory|get mcp|api info|free health|purchase |buy )') THEN 0.35 ELSE 1 END) * (CASE WHEN guidance THEN 1.15 ELSE 1 END) * (CASE WHEN price_usd IS NOT NULL THEN 1.05 ELSE 1 END) AS score FROM ke0 WHERE t > 0)"
)
_ARM = (
    "arm AS (SELECT * FROM (SELECT query_id, id, ep_ord, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ep_ord) AS rank FROM ke) WHERE rank <= 10),\n"
    "ord AS (SELECT * FROM (SELECT query_id, intent_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, io) AS rank FROM ki) WHERE rank <= 5),\n"
    "thick AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, id) AS rank FROM arm JOIN e USING (id) WHERE has200 OR len(inputs) > 0),\n"
    "sup AS (SELECT query_id, i.intent_id, round(sum(1.0 / thick.rank), 12) AS support, min({'r': thick.rank, 'c': (ip - e.ph + 16) % 16}) AS fst FROM thick JOIN caps USING (id) JOIN e USING (id) JOIN i ON i.ph = caps.ip WHERE thick.rank <= 8 GROUP BY 1, 2)"
)
_ALL_ARM = with_(E, CAPS, I, Q, _SCORE_Q, _KI, _KE, _ARM)

_CENT = (
    "ex AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings),\n"
    "mean AS (SELECT label, p, avg(x) AS m FROM ex GROUP BY 1, 2),\n"
    "cent AS (SELECT label, list(m / nrm ORDER BY p) AS c FROM mean JOIN (SELECT label, sqrt(sum(m * m)) AS nrm FROM mean GROUP BY 1) USING (label) GROUP BY 1)"
)
_INT8 = (
    "sc8 AS (SELECT vec_id, embedding, CASE WHEN mx > 0 THEN mx / 127 ELSE 1 END AS scale FROM (SELECT *, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS mx FROM embeddings)),\n"
    "q8 AS (SELECT vec_id, scale, list_transform(embedding, lambda x: greatest(-127, least(127, floor(x::DOUBLE / scale + 0.5)))) AS q FROM sc8),\n"
    "h8 AS (SELECT label, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM (\n"
    "SELECT cent.label AS label, vec_id, scale * list_dot_product(q::DOUBLE[], c) AS score FROM q8, cent))"
)
_COSINE = "list_dot_product(embedding::DOUBLE[], c) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(c, c))"
_DENSE = _CENT + ",\nden AS (SELECT vec_id, cent.label AS label, list_dot_product(embedding::DOUBLE[], c) AS dense FROM embeddings, cent)"


def _tfidf(docs: str, items: str, key: str) -> str:
    """CTEs: document counts, idf, weights of documents and items, and ``sp`` (key, item, sparse)."""
    return (
        f"dt AS (SELECT k, token, count(*) AS n FROM (SELECT {key} AS k, unnest({_bind.format('text')}) AS token FROM {docs}) GROUP BY 1, 2),\n"
        f"nd AS (SELECT count(*) AS total FROM {docs}),\n"
        "idf AS (SELECT token, count(*) AS df, ln(any_value(total) / (1 + count(*))) AS idf FROM dt, nd GROUP BY 1),\n"
        f"it AS (SELECT k, token, count(*) AS n FROM (SELECT item_id AS k, unnest({_bind.format('text')}) AS token FROM {items}) GROUP BY 1, 2),\n"
        "dw AS (SELECT k, token, n * idf AS w FROM dt JOIN idf USING (token)),\n"
        "iw AS (SELECT k, token, n * coalesce(idf, ln(total)) AS w FROM it LEFT JOIN idf USING (token), nd),\n"
        "dn AS (SELECT k, sqrt(sum(w * w)) AS nrm FROM dw GROUP BY 1),\nin_ AS (SELECT k, sqrt(sum(w * w)) AS nrm FROM iw GROUP BY 1),\n"
        "sp AS (SELECT a.k AS k, b.k AS item, sum(a.w / CASE WHEN dn.nrm = 0 THEN 1 ELSE dn.nrm END * b.w / CASE WHEN in_.nrm = 0 THEN 1 ELSE in_.nrm END) AS sparse FROM dw a JOIN dn ON dn.k = a.k JOIN iw b ON b.token = a.token JOIN in_ ON in_.k = b.k GROUP BY 1, 2)"
    )


_SCORES = (
    _DENSE + ",\nep AS (SELECT vec_id, text FROM embeddings JOIN documents ON doc_id = vec_id),\nlab AS (SELECT item_id, text FROM benchmark WHERE item_id IN (SELECT label FROM cent)),\n" + _tfidf("ep", "lab", "vec_id")
    + ",\nsco AS (SELECT den.vec_id, den.label, dense, coalesce(sparse, 0) AS sparse FROM den JOIN ep USING (vec_id) LEFT JOIN sp ON sp.k = den.vec_id AND sp.item = den.label),\n"
    "rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dense DESC, label) - 1 AS d, row_number() OVER (PARTITION BY vec_id ORDER BY sparse DESC, label) - 1 AS s FROM sco),\n"
    "bst AS (SELECT *, max(CASE WHEN d = 0 THEN dense END) OVER (PARTITION BY vec_id) AS best, max(CASE WHEN d = 1 THEN dense END) OVER (PARTITION BY vec_id) AS second FROM rk)"
)


def _decide(t: Tuning, name: str) -> str:
    return (
        f"{name}p AS (SELECT *, NOT dense >= {t.dense_floor} AS promoted FROM bst WHERE dense >= {t.dense_floor} OR sparse >= {t.strong_sparse_floor}),\n"
        f"{name}o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY promoted, 1.0 / (60 + d) + 1.0 / (60 + s) DESC, label) AS place FROM {name}p),\n"
        f"{name} AS (SELECT vec_id, CAST(label AS VARCHAR) AS intent_id, place, promoted, place <= {t.top_k} AS slot, place <= {t.top_k} AND sparse >= {t.sparse_floor} AS sparse_ok, "
        f"place <= {t.top_k} AND sparse >= {t.sparse_floor} AND (sparse >= {t.strong_sparse_floor} OR dense - CASE WHEN dense >= best THEN second ELSE best END >= {t.dense_margin}) AS bound FROM {name}o)"
    )


#: The catalog's scores under the names of :data:`_SCORES`.
_CATALOG = (
    "vx AS (SELECT vec_id % 16 AS ph, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings),\n"
    "vm AS (SELECT ph, p, avg(x) AS m FROM vx GROUP BY 1, 2),\n"
    "iv AS (SELECT ph, list(m / nrm ORDER BY p) AS c FROM vm JOIN (SELECT ph, sqrt(sum(m * m)) AS nrm FROM vm GROUP BY 1) USING (ph) GROUP BY 1),\n"
    "ep AS (SELECT ep_ord, CASE WHEN ep_ord % 29 = 0 THEN '/v1/status' ELSE path END AS path, concat_ws(' ', summary, description, path) AS text, embedding FROM e JOIN embeddings ON vec_id = ep_ord % 500),\n"
    "lab AS (SELECT ph AS item_id, concat_ws(' ', intent_id, label) AS text FROM i),\n" + _tfidf("ep", "lab", "ep_ord")
    + """,
    sco AS (SELECT ep_ord AS vec_id, iv.ph AS label, list_dot_product(embedding::DOUBLE[], iv.c) AS dense, coalesce(sparse, 0) AS sparse
        FROM ep CROSS JOIN iv JOIN i ON i.ph = iv.ph LEFT JOIN sp ON sp.k = ep_ord AND sp.item = iv.ph WHERE path <> '/v1/status'),
    """ + _SCORES[_SCORES.index("rk AS ("):]
)


def _report(name: str) -> str:
    return (
        "SELECT {} count(*) FILTER (b) AS bound, count(*) FILTER (p) AS promoted_sparse, count(*) FILTER (NOT b AND NOT s) AS gated_sparse, count(*) FILTER (NOT b AND s) AS gated_margin {} "
        f"FROM (SELECT vec_id, bool_or(bound) AS b, bool_or(bound AND promoted) AS p, bool_or(sparse_ok) AS s FROM {name} GROUP BY 1)"
    )




def _guarded(least: float) -> str:
    """CTEs up to ``gg``: each request's order with the arm's top intent first where the guard says so."""
    return (
        _ALL_ARM
        + f""", tp AS (SELECT query_id, intent_id AS top_id, support AS ts FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY support DESC, fst) rn FROM sup) WHERE rn = 1),
        gd AS (SELECT ord.*, coalesce(ord.intent_id = top_id AND ts >= {least}
            AND max(CASE WHEN ord.rank = 1 AND support IS NULL THEN 1 END) OVER (PARTITION BY ord.query_id) = 1
            AND count(*) OVER (PARTITION BY ord.query_id) >= 2, false) AS up
            FROM ord LEFT JOIN sup USING (query_id, intent_id) LEFT JOIN tp USING (query_id)),
        gg AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY NOT up, rank) AS rank, intent_id FROM gd)
        """
    )


ALL = {
    "idf": (idf, with_(_tfidf("documents", "benchmark", "doc_id")) + "SELECT token, df, round(idf, 6) AS idf FROM idf"),
    "sparse_cosines": (sparse_cosines, with_(_tfidf("documents", "benchmark", "doc_id")) + "SELECT k AS doc_id, item AS item_id, round(sparse, 6) AS sparse FROM sp"),
    "dense_scores": (dense_scores, with_(_DENSE) + "SELECT vec_id, label, round(dense, 6) AS dense FROM den"),
    "bound": (bound, with_(_SCORES, _decide(TUNING, "x")) + "SELECT * FROM x"),
    "bind_report": (bind_report, with_(_SCORES, _decide(TUNING, "x")) + _report("x").format("", ", 0 AS gated_meta")),
    "floor_sweep": (floor_sweep, with_(_SCORES, *[_decide(t, f"x{k}") for k, t in enumerate(SETTINGS)]) + " UNION ALL ".join(_report(f"x{k}").format(f"{k} AS setting,", "") for k in range(len(SETTINGS)))),
    "bound_catalog": (
        bound_catalog,
        with_(E, I, _CATALOG, _decide(CATALOG_TUNING, "x"))
        + f"SELECT vec_id AS ep_ord, {v.case('CAST(intent_id AS INT)', v.IDS)} AS intent_id, place, promoted, slot, sparse_ok, bound FROM x",
    ),
    "catalog_bind_report": (
        catalog_bind_report,
        with_(E, I, _CATALOG, _decide(CATALOG_TUNING, "x")) + _report("x").format("", ", (SELECT count(*) FROM ep WHERE path = '/v1/status') AS gated_meta"),
    ),
    "catalog_sweep": (
        catalog_sweep,
        with_(E, I, _CATALOG, *[_decide(t, f"x{k}") for k, t in enumerate(SWEPT)]) + " UNION ALL ".join(_report(f"x{k}").format(f"{k} AS setting,", "") for k in range(len(SWEPT))),
    ),
    "quantized": (
        quantized,
        "WITH s AS (SELECT vec_id, embedding, CASE WHEN mx > 0 THEN mx / 127 ELSE 1 END AS scale FROM (SELECT *, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS mx FROM embeddings)) "
        "SELECT vec_id, round(scale, 9) AS scale, array_to_string(list_transform(embedding, lambda x: greatest(-127, least(127, floor(x::DOUBLE / scale + 0.5)))::INT), ',') AS q FROM s",
    ),
    "vector_intents": (
        vector_intents,
        with_(_CENT) + "SELECT query_id, rank, intent_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rank FROM (SELECT vec_id AS query_id, CAST(cent.label AS VARCHAR) AS intent_id, cent.label AS label, "
        "1 / (1 + list_sum(list_transform(list_zip(embedding::DOUBLE[], c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score FROM embeddings, cent)) WHERE rank <= 3",
    ),
    "endpoint_top_k": (
        endpoint_top_k,
        with_(_DENSE) + "SELECT CAST(label AS VARCHAR) AS query_id, rank, vec_id, round(dense, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dense DESC, vec_id) AS rank FROM den) WHERE rank <= 10",
    ),
    "int8_top_k": (
        int8_top_k,
        with_(_CENT, _INT8) + "SELECT CAST(label AS VARCHAR) AS query_id, rank, vec_id, round(score, 6) AS score FROM h8 WHERE rank <= 10",
    ),
    "int8_reranked": (
        int8_reranked,
        with_(_CENT, _INT8)
        + f"""SELECT CAST(label AS VARCHAR) AS query_id, rank, vec_id, round(score, 6) AS score FROM (
            SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM (
                SELECT cent.label AS label, h8.vec_id AS vec_id, {_COSINE} AS score
                FROM h8 JOIN cent ON cent.label = h8.label JOIN embeddings e ON e.vec_id = h8.vec_id WHERE rank <= 40)) WHERE rank <= 10""",
    ),
    "pair_cosines": (
        pair_cosines,
        with_(_CENT) + f"SELECT cent.label AS query_id, vec_id, round({_COSINE}, 6) AS cosine FROM embeddings e JOIN cent ON cent.label IN (e.label, e.label + 1)",
    ),
    "keyword_top": (
        keyword_top,
        with_(E, I, Q, _SCORE_Q, _KE)
        + """SELECT query_id, rank, id, round(score, 9) AS score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ep_ord) AS rank FROM ke) WHERE rank <= 7""",
    ),
    "keyword_intents": (keyword_intents, with_(E, I, Q, _SCORE_Q, _KI) + "SELECT query_id, intent_id, round(score, 6) AS score FROM ki"),
    "keyword_endpoints": (keyword_endpoints, with_(E, Q, _SCORE_Q, _KE) + "SELECT query_id, ep_ord, round(score, 9) AS score FROM ke"),
    "keyword_search": (
        keyword_search,
        with_(E, I, Q, _SCORE_Q, _KI, _KE) + "SELECT query_id, rank, kind, hit_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, o, ord) AS rank FROM ("
        "SELECT query_id, 'capability' AS kind, intent_id AS hit_id, score, 0 AS o, io AS ord FROM ki UNION ALL SELECT query_id, 'endpoint', id, score, 1, ep_ord FROM ke)) WHERE rank <= 5",
    ),
    "match_capabilities": (
        match_capabilities,
        with_(E, I, Q, _SCORE_Q) + "SELECT query_id, rank, intent_id, round(score, 6) AS score, round(score / max(score) OVER (PARTITION BY query_id), 6) AS strength FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, io) AS rank FROM ("
        "SELECT query_id, intent_id, io, list_sum(per) + 2 * len(list_filter(per, lambda x: x > 0)) / len(per) + least(n, 50) / 200 AS score, list_sum(per) AS base FROM (SELECT query_id, intent_id, i.ph AS io, n, "
        "list_transform(list_distinct(list_filter(string_split(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) > 1)), lambda t: (CASE WHEN contains(lower(label), t) THEN 5.0 ELSE 0 END) + (CASE WHEN contains(lower(concat(consumes, ' ', produces)), t) THEN 3.0 ELSE 0 END) "
        "+ (CASE WHEN contains(concat(domain, ' ', action), t) THEN 2.5 ELSE 0 END) + (CASE WHEN list_contains(regexp_split_to_array(intent_id, '[._]'), t) THEN 3.0 ELSE 0 END)) AS per FROM rq, i)) WHERE base > 0) WHERE rank <= 7",
    ),
    "arm_support": (arm_support, _ALL_ARM + "SELECT query_id, intent_id, round(support, 6) AS support FROM sup"),
    "arm_guard": (arm_guard, _guarded(0.5) + "SELECT query_id, rank, intent_id FROM gg"),
    "classified": (
        classified,
        _guarded(1.0)
        + """, an AS (SELECT query_id, 'capability' AS kind, rank, intent_id AS hit_id FROM gg WHERE rank <= 5
            UNION ALL SELECT query_id, 'endpoint', rank, id FROM thick WHERE rank <= 3),
        fq AS (SELECT query, ph, min(query_id) AS first FROM q GROUP BY 1, 2)
        SELECT q.query_id, kind, rank, hit_id FROM q JOIN fq USING (query, ph) JOIN an ON an.query_id = first""",
    ),
    "arm_routing": (
        arm_routing,
        _ALL_ARM + ", own AS (SELECT query_id, intent_id, row_number() OVER (PARTITION BY query_id ORDER BY support DESC, fst) - 1 AS r FROM sup),\n"
        "un AS (SELECT query_id, intent_id, 2.0 / (60 + r) AS s, {'o': 0, 'r': r} AS pt FROM own UNION ALL SELECT query_id, intent_id, 1.0 / (60 + rank - 1), {'o': 1, 'r': rank - 1} FROM ord)\n"
        "SELECT query_id, rank, intent_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pt) AS rank FROM (SELECT query_id, intent_id, round(sum(s), 12) AS score, min(pt) AS pt FROM un GROUP BY 1, 2)) WHERE rank <= 12",
    ),
    "matched_capabilities": (
        matched_capabilities,
        _ALL_ARM + "SELECT query_id, rank, intent_id, round(support, 6) AS support FROM (SELECT ord.query_id, ord.intent_id, coalesce(support, 0) AS support, row_number() OVER (PARTITION BY ord.query_id ORDER BY ord.rank) AS rank FROM ord LEFT JOIN sup USING (query_id, intent_id) WHERE ord.rank = 1 OR support > 0) WHERE rank <= 8",
    ),
    "diversified": (
        diversified,
        "SELECT query_id, rank, host, ep_ord FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN h > 1 THEN 1 ELSE 0 END, score DESC, ep_ord) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, host ORDER BY score DESC, ep_ord) AS h FROM ("
        "SELECT l_partkey AS query_id, l_suppkey AS host, l_quantity AS score, l_orderkey * 10 + l_linenumber AS ep_ord FROM lineitem))) WHERE rank <= 12",
    ),
    "concentrated": (
        concentrated,
        "WITH li AS (SELECT DISTINCT c_nationkey AS query_id, l_linenumber AS ir, l_suppkey AS host, l_extendedprice AS score, l_orderkey AS ep_ord, l_partkey AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),\n"
        "hd AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN h > 1 THEN 1 ELSE 0 END, score DESC, ep_ord) AS b FROM (SELECT *, row_number() OVER (PARTITION BY query_id, host ORDER BY score DESC, ep_ord) AS h FROM li WHERE ir = 1)),\n"
        "tl AS (SELECT query_id, id, ir, row_number() OVER (PARTITION BY query_id, ir ORDER BY score DESC, ep_ord) AS b FROM li WHERE ir > 1),\n"
        "un AS (SELECT query_id, min(id) AS id, {'s': 0, 'a': 1, 'b': 1} AS pt FROM li GROUP BY 1 UNION ALL SELECT query_id, id, {'s': 1, 'a': 1, 'b': b} FROM hd WHERE b <= 36 UNION ALL SELECT query_id, id, {'s': 2, 'a': ir, 'b': b} FROM tl WHERE b <= 2)\n"
        "SELECT query_id, rank, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pt, id) AS rank FROM (SELECT query_id, id, min(pt) AS pt FROM un GROUP BY 1, 2)) WHERE rank <= 12",
    ),
}
