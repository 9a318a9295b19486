"""Keyword and vector search over intents and endpoints."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.facets import GENERIC_HIT
from ..functions.patterns import matches
from ..functions.text import search_tokens, stem
from ..storage import spread
from . import blocks
from .bind import dot

EXACT, STEM, COMPOUND = 1.0, 0.6, 0.5
#: Components of the intents' vectors that a task holds.
VOCABULARY = 4_000_000


def token_scores(queries: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """(query_id, key, token_score) of pairs with a hit.

    ``queries`` (query_id, query), ``corpus`` (key, text). A query token scores once a document: exactly, by stem, or
    as a compound that ends in a document token of four letters or more, three letters before it. All three are
    equi-joins on an inverted index; a compound's are on the query token's endings.
    """
    q = queries.select("query_id", search_tokens(F.col("query")).alias("tokens")).withColumn("n", F.size("tokens"))
    qt = q.select("query_id", "n", F.posexplode("tokens").alias("pos", "q"))
    index = corpus.select(key, F.explode(F.array_distinct(search_tokens(F.col("text")))).alias("c"))
    exact = qt.join(index, qt["q"] == index["c"]).select("query_id", key, "pos", "n", F.lit(EXACT).alias("s"))
    stems = index.select(key, stem(F.col("c")).alias("st")).distinct()
    by_stem = qt.withColumn("st", stem(F.col("q"))).join(stems, "st").select("query_id", key, "pos", "n", F.lit(STEM).alias("s"))
    longest = F.length("q") - 3
    ends = qt.where(longest >= 4).select("query_id", "pos", "n", F.explode(F.transform(F.sequence(F.lit(4), longest), lambda k: F.right(F.col("q"), k))).alias("c"))
    compound = ends.join(index, "c").select("query_id", key, "pos", "n", F.lit(COMPOUND).alias("s"))
    best = exact.union(by_stem).union(compound).groupBy("query_id", key, "pos", "n").agg(F.max("s").alias("s"))
    return best.groupBy("query_id", key, "n").agg(F.round(F.sum("s"), 6).alias("hits")).select("query_id", key, (F.col("hits") / F.col("n")).alias("token_score"))


def phrase_boost(query: Column, phrases: Column) -> Column:
    """Added for each phrase of four letters or more that stands in the query, by its words."""
    q = F.regexp_replace(F.lower(query), r"[^a-z0-9._ \t\n\r\f\x0B-]", " ")
    p = F.transform(phrases, lambda x: F.trim(F.lower(x)))
    each = F.transform(p, lambda x: F.when((F.length(x) >= 4) & F.contains(q, x), F.least(F.lit(2.5), 0.5 + 0.2 * F.size(F.split(x, r"\s+")))).otherwise(0.0))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x)


def id_boost(query: Column, intent_id: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(intent_id, "[._-]", " "), r"\s+"), lambda x: F.length(x) > 2)
    hit = F.size(F.filter(parts, lambda x: F.contains(F.lower(query), x)))
    return F.when(F.size(parts) > 0, hit / F.size(parts) * 0.4).otherwise(F.lit(0.0))


def keyword_intents(queries: DataFrame, intents: DataFrame) -> DataFrame:
    """(query_id, intent_id, score, intent_ord) of intents that a query hits by tokens, phrases or id."""
    phrases = F.filter(F.concat(F.array("label", "description"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))
    own = intents.select(F.col("id").alias("intent_id"), "intent_ord", phrases.alias("phrases"), F.coalesce("schema_org", F.array().cast("array<string>")).alias("schema_org"))
    corpus = own.select("intent_id", F.concat_ws(" ", "intent_id", "phrases", "schema_org").alias("text"))
    tokens = token_scores(queries, corpus, "intent_id")
    # boosts are on substrings, so every query meets every intent of the vocabulary, which is broadcast
    pairs = queries.select("query_id", "query").join(F.broadcast(own))
    boost = phrase_boost(F.col("query"), F.col("phrases")) + id_boost(F.col("query"), F.col("intent_id"))
    both = pairs.select("query_id", "intent_id", "intent_ord", boost.alias("boost")).join(tokens, ["query_id", "intent_id"], "left")
    t = F.coalesce("token_score", F.lit(0.0))
    raw = (t + F.col("boost")) * (1 + 1.2 * F.least(F.lit(1.0), t / 0.5))
    return both.where((t + F.col("boost")) > 0).select("query_id", "intent_id", raw.alias("score"), "intent_ord")


def hit_factor() -> Column:
    """What an endpoint's record makes of its token score."""
    guided = F.coalesce("guidance_available", F.lit(False))
    generic = matches(F.coalesce("summary", F.lit("")), GENERIC_HIT)
    return F.when(generic, 0.35).otherwise(1.0) * F.when(guided, 1.15).otherwise(1.0) * F.when(F.col("payment.price_usd").isNotNull(), 1.05).otherwise(1.0)


def keyword_endpoints(queries: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(query_id, id, score, ep_ord) of all endpoints that a query hits; for the best alone see :func:`keyword_top`.

    Up to ``blocks.QUERY_BYTES`` of queries are broadcast, and an endpoint's hits are made where it lies, without a shuffle;
    beyond, by the joins of :func:`token_scores`, which shuffle every hit."""
    tokens = search_tokens(F.col("query"))
    asked = queries.select("query_id", tokens.alias("tokens"), F.transform(tokens, stem).alias("stems"))
    if (asked.agg(F.sum(F.size("tokens") * 40 + 16)).first()[0] or 0) > blocks.QUERY_BYTES:
        own = endpoints.select("id", "ep_ord", hit_factor().alias("factor"))
        joined = token_scores(queries, endpoints.select("id", F.col("search_text").alias("text")), "id").join(own, "id")
        return joined.select("query_id", "id", (F.col("token_score") * F.col("factor")).alias("score"), "ep_ord")
    own = F.coalesce(F.array_distinct(search_tokens(F.col("search_text"))), F.array().cast("array<string>"))
    rows = spread(endpoints).select("id", "ep_ord", own.alias("tokens"), hit_factor().alias("factor")).select("id", "ep_ord", "tokens", F.transform("tokens", stem).alias("stems"), "factor")
    shared = endpoints.sparkSession.sparkContext.broadcast(asked.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = blocks.Hits(shared.value)
        for batch in batches:
            yield from kernel.add(batch)

    kinds = dict(endpoints.dtypes)
    hits = rows.mapInArrow(run, f"id {kinds['id']}, ep_ord {kinds['ep_ord']}, hits array<struct<query_id:{dict(queries.dtypes)['query_id']},score:double>>")
    return hits.select("id", "ep_ord", F.explode("hits").alias("hit")).select("hit.query_id", "id", "hit.score", "ep_ord")


def keyword_top(queries: DataFrame, endpoints: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, ep_ord, rank): the ``k`` best of :func:`keyword_endpoints`, scores rounded to nine digits.

    Postings stay with their endpoints in blocks, so a common token is no hot key; a query passes over what can't reach
    its best so far, and a task gives ``k`` rows a query."""
    tokens = search_tokens(F.col("query"))
    asked = queries.select("query_id", tokens.alias("tokens"), F.transform(tokens, stem).alias("stems"))
    own = F.array_distinct(search_tokens(F.col("search_text")))
    rows = spread(endpoints).select("id", F.col("ep_ord").cast("long").alias("ep_ord"), own.alias("tokens"), F.array_distinct(F.transform(own, stem)).alias("stems"), hit_factor().alias("factor"))
    schema = f"query_id {dict(queries.dtypes)['query_id']}, id string, score double, ep_ord long"
    weight = F.size("tokens") * 40 + 16
    return blocks.ranked(blocks.meet(asked, rows.where(F.size("tokens") > 0), partial(blocks.Postings, k=k), schema, weight, weight), k, "ep_ord")


def keyword_search(queries: DataFrame, endpoints: DataFrame, intents: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, kind, hit_id, capability_id, score): the ``k`` best of intents and endpoints together.

    Scores that agree to nine digits tie, as sums in another order differ in their last bits."""
    a = keyword_intents(queries, intents).select("query_id", F.lit("capability").alias("kind"), F.col("intent_id").alias("hit_id"), F.col("intent_id").alias("capability_id"), "score", F.lit(0).alias("o"), F.col("intent_ord").cast("long").alias("ord"))
    first = endpoints.select("id", F.try_element_at("capabilities", F.lit(1)).alias("capability_id"))
    b = keyword_top(queries, endpoints, k).join(first, "id").select("query_id", F.lit("endpoint").alias("kind"), F.col("id").alias("hit_id"), "capability_id", "score", F.lit(1).alias("o"), F.col("ep_ord").alias("ord"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "o", "ord")
    return a.union(b).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "kind", "hit_id", "capability_id", "score")


def block_top_k(spark: SparkSession, queries: DataFrame, rows: DataFrame, k: int, order: str) -> DataFrame:
    """(query_id, order, score, rank): the ``k`` rows of the largest inner product with each query, ties by ``order``.

    ``queries`` (query_id, vec) is the stated query set; see :mod:`.blocks` for how it meets the rows (order, vec).
    """
    kinds = dict(rows.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    schema = f"query_id {kinds['query_id']}, `{order}` {kinds[order]}, score double"
    own, bytes_of = queries.select("query_id", "vec"), F.size("vec") * 8
    return blocks.ranked(blocks.meet(own, rows.select(order, "vec"), partial(blocks.Nearest, k=k, order=order), schema, bytes_of, bytes_of), k, order)


def int8_top_k(queries: DataFrame, packed: DataFrame, k: int, order: str) -> DataFrame:
    """(query_id, order, score, rank): as :func:`block_top_k` over the int8 index ``packed`` (order, scale, q: binary)."""
    kinds = dict(packed.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    schema = f"query_id {kinds['query_id']}, `{order}` {kinds[order]}, score double"
    own = queries.select("query_id", "vec")
    found = blocks.meet(own, packed.select(order, "scale", "q"), partial(blocks.Nearest, k=k, order=order), schema, F.size("vec") * 8, F.octet_length("q") + 16)
    return blocks.ranked(found, k, order)


def pair_cosines(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(query_id, key, cosine) of stated pairs; those of which either side has no vector, or a zero one, fall out.

    Two joins by key: only the vectors that a pair names are multiplied."""
    norm = lambda c: F.sqrt(dot(c, c))
    rows = pairs.select("query_id", key).distinct().join(queries.select("query_id", F.col("vec").alias("a")), "query_id").join(vectors.select(key, F.col("vec").alias("b")), key)
    length = norm(F.col("a")) * norm(F.col("b"))
    return rows.where(length > 0).select("query_id", key, (dot(F.col("a"), F.col("b")) / length).alias("cosine"))


def reranked(hits: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, order: str) -> DataFrame:
    """The ``k`` best of an int8 arm's ``hits`` (query_id, order) by the cosine of the whole vectors."""
    return blocks.ranked(pair_cosines(hits, queries, vectors, order).withColumnRenamed("cosine", "score"), k, order)


def vector_intents(queries: DataFrame, intents: DataFrame, k: int = 10, squared: bool = True) -> DataFrame:
    """(query_id, rank, intent_id, score): intents by 1 / (1 + distance) of unit vectors; a row for each intent id.

    The intents' matrix goes to the queries, which are ranked where they are, a block at a time."""
    w = Window.partitionBy("intent_id").orderBy("intent_ord")
    own = intents.select("intent_id", "intent_ord", "vec").withColumn("rn", F.row_number().over(w)).where("rn = 1").orderBy("intent_ord", "intent_id")
    if (own.agg(F.sum(F.size("vec"))).first()[0] or 0) > VOCABULARY:
        raise ValueError(f"the intents' vectors have over {VOCABULARY} components; a task can't hold them")
    known = own.select("intent_id", "vec").toArrow()  # the vocabulary, in order
    ids = known.column("intent_id").combine_chunks()
    shared = queries.sparkSession.sparkContext.broadcast((ids, blocks.matrix_of(known.column("vec")) if len(ids) else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        if matrix is None:
            return
        step, lengths = max(1, blocks.PRODUCTS // len(names)), (matrix * matrix).sum(1)
        for b in batches:
            for s in range(0, b.num_rows, step):
                part = b.slice(s, step)
                x = blocks.matrix_of(part.column(1))
                apart = np.maximum((x * x).sum(1)[:, None] + lengths - 2 * (x @ matrix.T), 0)
                near = np.argsort(apart, axis=1, kind="stable")[:, :k]
                far = np.take_along_axis(apart, near, 1)
                at = np.repeat(np.arange(len(x)), near.shape[1])
                rank = np.tile(np.arange(1, near.shape[1] + 1, dtype=np.int32), len(x))
                score = 1 / (1 + (far if squared else np.sqrt(far)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(rank), names.take(pa.array(near.ravel())), pa.array(score.ravel())], names=["query_id", "rank", "intent_id", "score"])

    schema = f"query_id {dict(queries.dtypes)['query_id']}, rank int, intent_id string, score double"
    return queries.where("vec IS NOT NULL").select("query_id", "vec").mapInArrow(run, schema)


def search_with_fallback(queries: DataFrame, vectors: DataFrame, intents: DataFrame, intent_vectors: DataFrame, endpoints: DataFrame, k: int = 10) -> DataFrame:
    """Vector hits of queries that have a vector, keyword hits of the rest: (query_id, rank, kind, capability_id, score, hit_id)."""
    near = vector_intents(vectors, intent_vectors, k).select("query_id", "rank", F.lit("capability").alias("kind"), F.col("intent_id").alias("capability_id"), "score", F.col("intent_id").alias("hit_id"))
    rest = queries.join(vectors.select("query_id"), "query_id", "left_anti")
    return near.union(keyword_search(rest, endpoints, intents, k).select("query_id", "rank", "kind", "capability_id", "score", "hit_id"))


def match_capabilities(queries: DataFrame, intents: DataFrame, k: int = 7) -> DataFrame:
    """(query_id, rank, intent_id, score, strength): substring match of an explorer's search box.

    ``intents``: id, label, description, aliases, entities, domain, action, endpoints (count), intent_ord.
    """
    tokens = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("query"), "[^a-z0-9]+", " "), " "), lambda t: F.length(t) > 1))
    none = F.array().cast("array<string>")
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    own = intents.select(
        F.col("id").alias("intent_id"), "intent_ord", low(F.col("label")).alias("l"), low(F.array_join(F.coalesce("aliases", none), " ")).alias("a"), low(F.array_join(F.coalesce("entities", none), " ")).alias("e"),
        low(F.concat_ws(" ", "domain", "action")).alias("f"), low(F.col("description")).alias("d"), F.split(F.lower("id"), "[._]").alias("seg"), F.coalesce("endpoints", F.lit(0)).alias("n"),
    )
    pairs = queries.select("query_id", tokens.alias("tokens")).where(F.size("tokens") > 0).join(F.broadcast(own))  # the vocabulary
    c = F.col
    weight = lambda cond, w: F.when(cond, w).otherwise(0.0)
    per = F.transform(
        "tokens",
        lambda t: weight(F.contains(c("l"), t), 5.0) + weight(F.contains(c("a"), t), 4.0) + weight(F.contains(c("e"), t), 3.0) + weight(F.contains(c("f"), t), 2.5) + weight(F.contains(c("d"), t), 1.5) + weight(F.array_contains("seg", t), 3.0),
    )
    total = F.aggregate(per, F.lit(0.0), lambda s, x: s + x)
    share = F.size(F.filter(per, lambda x: x > 0)) / F.size("tokens")
    scored = pairs.withColumn("base", total).where("base > 0").withColumn("score", c("base") + 2 * share + F.least(c("n"), F.lit(50)) / 200)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "intent_ord")
    out = scored.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k)
    return out.select("query_id", "rank", "intent_id", "score", (c("score") / F.max("score").over(Window.partitionBy("query_id"))).alias("strength"))
