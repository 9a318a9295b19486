"""Ranking of endpoints: neutral, by intent, and by query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.facets import is_generic
from ..functions.ids import rooted
from ..functions.text import intent_id_tokens, intent_vocab_tokens, query_tokens
from ..storage import saved
from ..tuning import Tuning
from .search import pair_cosines

#: Input names that speak for an entity.
ENTITY_INPUTS = {
    "Product": ("product", "product_uid", "sku", "asin", "upc", "gtin", "item", "q"),
    "ProductCategory": ("category", "department", "product_category"),
    "Money": ("price", "budget", "max_price", "amount", "amount_usd"),
    "Currency": ("currency", "vs_currency", "base", "quote", "fiat"),
    "Query": ("query", "q", "search", "keyword", "term", "prompt"),
    "Webpage": ("url", "page_url", "link", "website", "uri"),
    "Document": ("document", "documentnumber", "file", "pdf", "doc", "documenttype"),
    "Image": ("image", "image_url", "imageurl", "base64", "photo", "img"),
    "AudioClip": ("audio", "audio_url", "voice", "speech", "sound"),
    "Text": ("text", "input", "content", "transcript", "body"),
    "Contact": ("to", "email", "phone", "recipient", "contact", "number"),
    "Mailbox": ("inbox", "mailbox", "from"),
    "Location": ("location", "lat", "lon", "lng", "latitude", "longitude", "coordinates", "city", "place"),
    "Company": ("company", "organization", "org", "business", "domain"),
    "Person": ("person", "name", "people", "fullname", "full_name"),
    "CryptoAsset": ("coin", "token", "asset", "symbol", "currency"),
    "WalletAddress": ("address", "wallet", "wallet_address", "account", "holder"),
    "BlockchainNetwork": ("chain", "network", "blockchain", "chain_id", "rpc"),
    "Ticker": ("ticker", "symbol", "stock", "equity"),
    "Domain": ("domain", "hostname", "host", "fqdn"),
    "IpAddress": ("ip", "ip_address", "ipaddress", "addr"),
}
MATERIALIZED, GENERIC_SCORE, OUTLIER = 50, -100.0, 20


def _or(c: Column, other) -> Column:
    return F.coalesce(c, F.lit(other))


def _inputs() -> Column:
    return F.coalesce(F.col("inputs"), F.array().cast("array<string>"))


def relevance_bonus(consumes: Column, produces: Column) -> Column:
    """What an intent's ports add to an endpoint's score, for a row that has both."""
    names = F.transform(_inputs(), lambda x: F.lower(x))
    parts = F.array_union(names, F.filter(F.flatten(F.transform(names, lambda x: F.split(x, r"[_\- \t\n\r]+"))), lambda x: x != ""))
    hay = F.lower(F.concat_ws(" ", _or(F.col("path"), ""), _or(F.col("summary"), ""), _or(F.col("description"), "")))
    table = F.create_map(*[x for k, v in ENTITY_INPUTS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    tokens = lambda port: F.coalesce(F.element_at(table, port["entity"]), F.array().cast("array<string>"))
    primary = F.col("facets.primary_entity")

    def port_bonus(p: Column) -> Column:
        named = F.when(F.exists(tokens(p), lambda t: F.contains(hay, t)), 2).otherwise(0) + F.when(primary.isNotNull() & (primary != "") & (primary == p["entity"]), 2).otherwise(0)
        return F.when(F.arrays_overlap(tokens(p), parts), 4).otherwise(named)

    ports = F.coalesce(consumes, F.array().cast("array<struct<entity:string,role:string,format:string,cardinality:string>>"))
    made = F.try_element_at(produces, F.lit(1))["entity"]
    return F.aggregate(F.transform(ports, port_bonus), F.lit(0), lambda a, x: a + x) + F.when(_or(made == F.col("facets.output_entity"), False), 3).otherwise(0)


def neutral_score(bonus: Column | None = None) -> Column:
    """An endpoint's score by what its record says, without a query."""
    depth = F.size(F.filter(F.split(_or(F.col("path"), ""), "/"), lambda x: x != ""))
    score = (
        F.when(F.length("description") > 20, 3).otherwise(0)
        + F.least(F.size(_inputs()), F.lit(5))
        + F.when(F.col("payment.price_usd").isNotNull(), 2).otherwise(0)
        + F.when(_or(F.col("payment.paid"), False), 1).otherwise(0)
        + F.when(_or(F.col("guidance_available"), False), 2).otherwise(0)
        + F.when(_or(F.col("openapi_url"), "") != "", 1).otherwise(0)
        + F.greatest(F.lit(0), 6 - depth)
        + F.when(F.length("summary") > 12, 1).otherwise(0)
    )
    score = score if bonus is None else score + bonus
    return F.when(is_generic(F.col("summary"), F.col("path")), GENERIC_SCORE).otherwise(score.cast("double"))


def paid_pool(rows: DataFrame, group: list[str]) -> DataFrame:
    """Of each group the paid or railed rows; all of a group that has none."""
    pays = _or(F.col("payment.paid"), False) | _or(F.size("payment.rails") > 0, False)
    any_paid = rows.withColumn("__pays", pays)
    flags = any_paid.groupBy(*group).agg(F.max("__pays").alias("__any"))  # combined map-side: groups may be large
    return any_paid.join(flags, group).where("__pays OR NOT __any").drop("__pays", "__any")


def top(rows: DataFrame, group: list[str], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` of each group by ``score``, then ``ep_ord``, with their rank from 1."""
    w = Window.partitionBy(*group).orderBy(F.desc("score"), "ep_ord")
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def rank_neutral(rows: DataFrame, group: list[str], k: int = 12, bonus: Column | None = None) -> DataFrame:
    """Neutral top ``k`` of each group's paid pool, with score and rank."""
    return top(paid_pool(rows, group).withColumn("score", neutral_score(bonus)), group, k)


def with_intents(endpoints: DataFrame, intents: DataFrame) -> DataFrame:
    """A row for each endpoint and intent among its capabilities, with the intent's ports."""
    small = intents.select(F.col("id").alias("intent_id"), "consumes", "produces")
    each = endpoints.withColumn("intent_id", F.explode(F.array_distinct("capabilities")))
    return each.join(small, "intent_id")


def materialize(endpoints: DataFrame, intents: DataFrame, k: int = MATERIALIZED) -> DataFrame:
    """(intent_id, rank, origin, method, path, source, score): the ``k`` best endpoints bound to each intent."""
    ranked = rank_neutral(with_intents(endpoints, intents), ["intent_id"], k, relevance_bonus(F.col("consumes"), F.col("produces")))
    return ranked.select("intent_id", "rank", "origin", "method", "path", F.lit("match_hint").alias("source"), "score")


def refs_to_endpoints(refs: DataFrame, endpoints: DataFrame) -> DataFrame:
    """``refs`` (intent_id, rank, origin, method, path) joined with their endpoints; unknown ones fall out."""
    key = F.concat_ws("|", "origin", F.upper("method"), rooted(F.col("path")))
    keyed = refs.select("intent_id", F.col("rank").alias("ref_rank"), key.alias("__key"))
    own = endpoints.withColumn("__key", F.concat_ws("|", "origin", "method", "path"))
    return own.join(keyed, "__key").drop("__key")


def select_for_intents(refs: DataFrame, endpoints: DataFrame, intents: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` endpoints of each intent's references, with score and rank."""
    rows = refs_to_endpoints(refs, endpoints).join(intents.select(F.col("id").alias("intent_id"), "consumes", "produces"), "intent_id")
    return rank_neutral(rows, ["intent_id"], k, relevance_bonus(F.col("consumes"), F.col("produces")))


def select_rank(selected: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, rank): where an expected (query_id, intent_id, endpoint_id) stands among the selected; null if not."""
    at = selected.select("intent_id", F.col("id").alias("endpoint_id"), "rank")
    return expected.join(at, ["intent_id", "endpoint_id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))


def price_medians(rows: DataFrame, group: list[str]) -> DataFrame:
    """The upper median of each group's positive prices, of groups that have one."""
    w = Window.partitionBy(*group)
    priced = rows.where("price_usd > 0").select(*group, "price_usd")
    at = priced.withColumn("rn", F.row_number().over(w.orderBy("price_usd"))).withColumn("n", F.count(F.lit(1)).over(w))
    return at.where("rn = floor(n / 2) + 1").select(*group, F.col("price_usd").alias("median"))


def _share(text: Column, tokens: Column) -> Column:
    n = F.size(tokens)
    return F.when(n > 0, F.size(F.filter(tokens, lambda t: F.contains(text, t))) / n).otherwise(F.lit(0.0))


def facet_penalties(tuning: Tuning, intent_id: Column, domain: Column, action: Column, made: Column) -> Column:
    """What facets that contradict an intent's take off; a missing facet takes nothing."""
    gated = intent_id.isin(*tuning.gated_intents) if tuning.gated_intents else F.lit(True)
    authored = _or(F.col("facets.authored"), False)

    def compatible(own: Column, of: Column, pairs: tuple) -> Column:
        more = [(of == a) & (own == b) for a, b in pairs]
        out = own == of
        for m in more:
            out = out | m
        return _or(out, True)  # missing facets pass

    own = F.col("facets")
    return (
        -F.when(gated & authored & ~compatible(own["domain"], domain, tuning.domain_compatible), tuning.domain_penalty).otherwise(0.0)
        - F.when(gated & ~compatible(own["action"], action, tuning.action_compatible), tuning.action_penalty).otherwise(0.0)
        - F.when(gated & authored & ~compatible(own["output_entity"], made, ()), tuning.entity_penalty).otherwise(0.0)
    )


def resolve(asks: DataFrame, refs: DataFrame, endpoints: DataFrame, intents: DataFrame, k: int = 10, tuning: Tuning = Tuning(), semantic: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Top ``k`` endpoints of each (query_id, intent_id, query) ask, by a score that sees the query.

    Candidates are the endpoints of the intent's references; references of endpoints that share a key name them all.
    ``semantic``, vectors of queries (query_id, vec) and endpoints (id, vec), rescues close endpoints of narrow hosts; pairs
    without a vector get nothing. Cosines are made of candidates alone, by key. Without vectors equal queries have equal
    answers, so each distinct one is scored once and its answer joined back.
    Returns query_id, intent_id, rank, id, origin, method, path, price_usd, inputs, rails, score.
    """
    if semantic is None:
        told = asks.select("intent_id", "query").distinct().withColumn("query_id", F.monotonically_increasing_id())
        told = saved(told, "distinct-asks")
        answers = _resolved(told, refs, endpoints, intents, k, tuning, None).withColumnRenamed("query_id", "__ask")
        named = told.withColumnRenamed("query_id", "__ask")
        same = named["intent_id"].eqNullSafe(asks["intent_id"]) & named["query"].eqNullSafe(asks["query"])
        return asks.join(named, same).select(asks["query_id"], "__ask").join(answers, "__ask").drop("__ask")
    return _resolved(asks, refs, endpoints, intents, k, tuning, semantic)


def _resolved(asks: DataFrame, refs: DataFrame, endpoints: DataFrame, intents: DataFrame, k: int, tuning: Tuning, semantic: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    i = F.col
    small = intents.select(
        i("id").alias("intent_id"), "consumes", "produces", i("facets.domain").alias("i_domain"), i("facets.action").alias("i_action"),
        F.try_element_at("produces", F.lit(1))["entity"].alias("i_made"), intent_id_tokens(i("id")).alias("id_tokens"), intent_vocab_tokens(i("label"), i("aliases")).alias("vocab"),
    )
    candidates = refs_to_endpoints(refs, endpoints)
    medians = price_medians(candidates.select("intent_id", i("payment.price_usd").alias("price_usd")), ["intent_id"])
    text = F.lower(F.concat_ws(" ", _or(i("summary"), ""), _or(i("description"), ""), i("path"), F.array_join(_inputs(), " ")))
    known = candidates.join(small, "intent_id").join(medians, "intent_id", "left").withColumn("text", text)
    known = known.withColumn("neutral", neutral_score(relevance_bonus(i("consumes"), i("produces"))))
    rows = asks.select("query_id", "intent_id", query_tokens(i("query")).alias("q_tokens")).join(known, "intent_id")
    if semantic is not None:
        narrow = asks.select("query_id", "intent_id").join(candidates.where(_or(i("host_breadth"), 0) <= tuning.breadth_threshold).select("intent_id", "id"), "intent_id")
        rows = rows.join(pair_cosines(narrow, *semantic, "id"), ["query_id", "id"], "left")
    else:
        rows = rows.withColumn("cosine", F.lit(None).cast("double"))
    hits = F.size(F.filter("id_tokens", lambda t: F.contains(i("text"), t)))
    breadth = _or(i("host_breadth"), 0)
    phrases = F.array_distinct(F.split(F.array_join(F.coalesce(i("keyphrases"), F.array().cast("array<string>")), " "), r"\s+"))
    overlap = F.when(_or(F.size("keyphrases") > 0, False), F.size(F.array_intersect(phrases, "q_tokens"))).otherwise(0)
    score = (
        tuning.neutral_scale * i("neutral")
        + tuning.id_weight * hits
        + tuning.vocab_weight * _share(i("text"), i("vocab"))
        + tuning.query_weight * _share(i("text"), i("q_tokens"))
        + tuning.keyphrase_weight * overlap
        + F.when(i("cosine").isNotNull() & (breadth <= tuning.breadth_threshold), tuning.semantic_weight * F.greatest(F.lit(0.0), i("cosine") - tuning.semantic_floor)).otherwise(0.0)
        + F.when((hits == 0) & (breadth > tuning.breadth_threshold), -tuning.breadth_penalty * (breadth - tuning.breadth_threshold)).otherwise(0.0)
        + facet_penalties(tuning, i("intent_id"), i("i_domain"), i("i_action"), i("i_made"))
        + tuning.quality_weight * (F.when(_or(i("guidance_available"), False), 0.5).otherwise(0.0) + F.when(F.size(_inputs()) > 0, 0.5).otherwise(0.0))
        + F.when(i("payment.price_usd") > OUTLIER * i("median"), -tuning.price_outlier_penalty).otherwise(0.0)
    )
    scored = rows.withColumn("score", score)
    w = Window.partitionBy("query_id", "intent_id").orderBy(F.desc("score"), "ref_rank", "ep_ord")
    return scored.withColumn("rank", F.row_number().over(w)).where(i("rank") <= k).select(
        "query_id", "intent_id", "rank", "id", "origin", "method", "path", i("payment.price_usd").alias("price_usd"), F.slice(_inputs(), 1, 8).alias("inputs"),
        F.transform("payment.rails", lambda r: r["protocol"]).alias("rails"), "score",
    )


def host_breadth(refs: DataFrame) -> DataFrame:
    """(host, breadth): distinct intents whose materialized references lie on a host."""
    from ..functions.ids import host_of

    return refs.groupBy(host_of(F.col("origin")).alias("host")).agg(F.count_distinct("intent_id").cast("int").alias("breadth"))


def with_breadth(endpoints: DataFrame, refs: DataFrame) -> DataFrame:
    """``endpoints`` with host_breadth, 0 for hosts without a reference."""
    from ..functions.ids import host_of

    own = endpoints.drop("host_breadth").withColumn("__host", host_of(F.col("origin")))
    return own.join(host_breadth(refs), own["__host"] == F.col("host"), "left").withColumn("host_breadth", F.coalesce("breadth", F.lit(0))).drop("__host", "host", "breadth")
