"""Queries on sources, merging and labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import embed_text
from ..operators import labels, merge
from ..schemas import PAYMENT
from ..sources import openapi, registry, snapshots, vectors
from ..storage import new_path, saved
from . import views as v
from .catalog import _embed
from .views import E, with_

S, D = SparkSession, DataFrame


def registry_endpoints(spark: S, sf: str) -> D:
    """Line items as registry resources: an order's lines of one supplier are the ways to pay for a resource."""
    li = v.table(spark, sf, "lineitem")
    accept = F.struct(
        F.when(F.col("l_returnflag") == "R", "n/a").otherwise(F.col("l_partkey").cast("string")).alias("amount"), F.lit("0x833589fcd6edb6e08f4c7c32d4f71b54bda02913").alias("asset"), F.lit("base").alias("network"),
        F.lit(None).cast("string").alias("payTo"), F.lit("exact").alias("scheme"),
    )
    per = li.groupBy("l_orderkey", "l_suppkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", accept.alias("a")))), lambda x: x["a"]).alias("accepts"))
    null = F.lit(None).cast("string")
    res = per.select(
        F.when(F.col("l_orderkey") % 97 == 0, F.lit("not a url")).otherwise(F.concat(F.lit("https://S"), "l_suppkey", F.lit(".Example.com/v1/order/"), "l_orderkey", F.lit("?x=1"))).alias("resource"),
        F.when(F.col("l_orderkey") % 5 == 0, "mcp").when(F.col("l_orderkey") % 5 == 1, "http").alias("type"), "accepts", F.when(F.col("l_orderkey") % 2 == 0, F.lit("Order lines of a supplier")).alias("description"),
        F.lit("Orders").alias("serviceName"), F.array(F.lit("order"), F.lit("line")).alias("tags"), F.when(F.col("l_orderkey") % 3 == 0, "get").when(F.col("l_orderkey") % 3 == 1, "brew").alias("method"), null.alias("lastUpdated"),
    )
    out = registry.resources_to_endpoints(res, "2024-01-31")
    return out.select("id", "origin", "method", "path", "summary", "provider_fqn", F.round("payment.price_usd", 9).alias("price_usd"), F.size("payment.offers").alias("n_offers"), "search_text")


def service_endpoints(spark: S, sf: str) -> D:
    """Suppliers as services with nested endpoints from their lines' flags."""
    li = v.table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.min("l_partkey").alias("p"))
    e = F.struct(
        F.when(F.col("l_returnflag") == "A", "get").alias("method"), F.concat(F.lit("/v1/"), F.lower("l_returnflag")).alias("path"), F.when(F.col("l_returnflag") == "N", "New lines").alias("summary"), F.lit(None).cast("string").alias("description"),
        F.struct(F.when(F.col("l_returnflag") == "R", F.lit("$0.20/page")).alias("amountHint"), F.col("p").cast("string").alias("amount"), F.lit(None).cast("int").alias("decimals"), F.lit("usd").alias("currency")).alias("payment"),
    )
    per = li.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.struct("l_returnflag", e.alias("e")))).alias("x"))  # three flags at most
    svc = per.select(
        F.col("l_suppkey").cast("string").alias("id"), F.concat(F.lit("https://svc"), "l_suppkey", F.lit(".example.com/")).alias("url"), F.lit(None).cast("string").alias("serviceUrl"), F.lit("Lines by flag").alias("description"),
        F.array(F.lit("lines")).alias("tags"), F.transform("x", lambda y: y["e"]).alias("endpoints"),
    )
    out = registry.services_to_endpoints(svc, "2024-01-31")
    return out.select("origin", "method", "path", "summary", "description", "provider_fqn", F.round("payment.price_usd", 9).alias("price_usd"))


def page_resources(spark: S, sf: str) -> D:
    """Resource URLs in pages, which here hold the pages' own address and an API path of it."""
    p = v.table(spark, sf, "pages").select(F.concat("html", F.lit(' see <a href="'), F.regexp_replace("url", "^http:", "https:"), F.lit('">x</a> https://api.'), F.col("page_id") % 37, F.lit(".example.com/v2/items/"), F.col("page_id"), F.lit(" https://schema.org/v1/x")).alias("html"))
    return registry.resource_urls(p)


def page_origins(spark: S, sf: str) -> D:
    p = v.table(spark, sf, "pages").select(F.concat("html", F.lit(' <a href="'), "url", F.lit('"> https://schema.org/ https://www.x402scan.com/a')).alias("html"))
    return registry.origins_in(p)


def _docs(spark: S, sf: str) -> D:
    """An OpenAPI document for each supplier, with an operation for each of its lines' flags."""
    li = v.table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.min("l_partkey").alias("p"), F.max("l_quantity").alias("q"))
    op = F.concat(
        F.lit('"/v1/'), F.col("l_returnflag"), F.lit('": {"post": {"summary": "Lines '), F.col("l_returnflag"), F.lit('", "operationId": "op'), F.col("p"),
        F.lit('", "parameters": [{"name": "key", "in": "query"}, {"$ref": "#/components/parameters/P"}], "requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/B"}}}}, "x-payment-info": {"intent": "charge", "method": "x402", "amount": "'),
        F.col("p"), F.lit('"}, "responses": {"200": {}, "402": {}}}}'),
    )
    per = li.select("l_suppkey", "l_returnflag", op.alias("op")).groupBy("l_suppkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_returnflag", "op"))), lambda x: x["op"]), ", ").alias("ops"))
    head = '{"openapi": "3.1.0", "info": {"title": "Lines", "x-guidance": "use it"}, "components": {"parameters": {"P": {"name": "page", "in": "query"}}, "schemas": {"B": {"allOf": [{"properties": {"a": {}}}, {"items": {"properties": {"b": {}}}}]}}}, "paths": {'
    return per.select(F.concat(F.lit("https://lines"), "l_suppkey", F.lit(".example.com")).alias("origin"), F.concat(F.lit(head), "ops", F.when(F.col("l_suppkey") % 10 == 3, F.lit("")).otherwise("}}")).alias("doc"))


def openapi_endpoints(spark: S, sf: str) -> D:
    out = openapi.parse_openapi(_docs(spark, sf), "2024-01-31")
    return out.select("origin", "method", "path", "operation_id", "summary", F.array_join("inputs", ",").alias("inputs"), F.round("payment.price_usd", 9).alias("price_usd"), F.transform("payment.rails", lambda r: r["protocol"])[0].alias("rail"), "guidance_available", "search_text")


#: What a payment looked like before offers, by form: what an operation says, from its order's number {n}.
LEGACY = (
    '"x-payment-info": {"offers": [{"method": "evm", "amount": "{n}", "decimals": 3}]}',
    '"x-payment-info": {"method": "stripe", "price": {"amount": "{n}.5"}}',
    '"x-payment-info": {"amount": {n}000, "protocols": ["x402"]}',
    '"x-payment-info": {"amount": 50, "methods": [{"method": "tempo"}]}',
    '"x-faremeter-pricing": {"rates": {"call": "{n}"}}',
    '"pricing": {"dimensions": [{"tiers": [{"price_usd": {n}}]}]}',
    '"x-payment-info": {"protocols": [{"mpp": {}}, {"x402": {"on": true}}]}',
    '"x-payment-info": {"offers": [{"method": "card", "amount": {n}, "decimals": 0}]}',
)
#: An odd value in an operation, by kind: what is said there, the place, and the reason of its reject.
ODD = (
    ('"parameters": 5', "/parameters", "not a list"),
    ('"requestBody": {"content": ["text"]}', "/requestBody/content", "not an object"),
    ('"tags": true', "/tags", "not a list"),
    ('"x-payment-info": {"protocols": 7}', "/x-payment-info/protocols", "not a list"),
    ('"x-payment-info": {"methods": "all"}', "/x-payment-info/methods", "not a list"),
)


def _order_docs(spark: S, sf: str, said: Column, tail: Column) -> D:
    """A document for each customer, with an operation for each of their orders."""
    o = v.table(spark, sf, "orders")
    op = F.concat(F.lit('"/o/'), "o_orderkey", F.lit('": {"post": {"summary": "An order", '), F.when(F.col("o_orderkey") % 3 == 0, '"requestBody": {}, ').otherwise(""), said, F.lit("}}"))
    per = o.select("o_custkey", "o_orderkey", op.alias("op")).groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "op"))), lambda x: x["op"]), ", ").alias("ops"))  # a customer's orders
    doc = F.concat(F.lit('{"paths": {'), "ops", F.lit("}"), tail, F.lit("}"))
    return per.select(F.concat(F.lit("https://c"), "o_custkey", F.lit(".example.com")).alias("origin"), doc.alias("doc"), "o_custkey")


def _said(forms: tuple[str, ...]) -> Column:
    n = F.col("o_orderkey").cast("string")
    return F.replace(F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col("o_orderkey") % len(forms) + 1).cast("int")), F.lit("{n}"), n)


def legacy_payments(spark: S, sf: str) -> D:
    """Orders as operations whose payment is of a form from before offers; every third document names an asset."""
    assets = F.when(F.col("o_custkey") % 3 == 0, ', "x-faremeter-assets": {"a": {"chain": "base"}}').otherwise("")
    out = openapi.parse_openapi(_order_docs(spark, sf, _said(LEGACY), assets), "2024-01-31")
    rail = lambda r: F.concat_ws(":", r["protocol"], F.coalesce(r["version"], F.lit("-")), F.coalesce(F.array_join(r["networks"], "+"), F.lit("-")))
    return out.select("origin", "path", F.round("payment.price_usd", 9).alias("price_usd"), F.array_join(F.transform("payment.rails", rail), ",").alias("rails"), "schema_missing")


def openapi_rejects(spark: S, sf: str) -> D:
    """Orders as operations, two in seven of an odd shape, in documents of which some are unreadable as a whole."""
    odd = F.col("o_orderkey") % 7 < 2
    said = F.when(odd, _said(tuple(x for x, _, _ in ODD))).otherwise(F.lit('"tags": ["a"]'))
    docs = _order_docs(spark, sf, said, F.lit(""))
    kind = F.col("o_custkey") % 11
    broken = F.when(kind == 1, F.concat("doc", F.lit("]"))).when(kind == 2, "[]").when(kind == 3, '{"paths": 1}').when(kind == 4, "").when(kind == 5, F.repeat(F.lit("["), 100_000)).otherwise(F.col("doc"))
    rows, rejects = openapi.read_openapi(docs.withColumn("doc", broken), "2024-01-31")
    kept = rows.groupBy("origin").agg(F.count(F.lit(1)).alias("n")).select("origin", F.lit("kept").alias("reason"), F.lit("").alias("pointer"), "n")
    return rejects.groupBy("origin", "reason", "pointer").agg(F.count(F.lit(1)).alias("n")).select("origin", "reason", "pointer", "n").union(kept)


def _events(spark: S, sf: str) -> D:
    """Events as observed endpoint rows: the user is the origin, the type the path."""
    e = v.table(spark, sf, "events")
    return e.select(F.concat(F.lit("https://u"), F.col("user_id"), F.lit(".example.com")).alias("origin"), F.lit("GET").alias("method"), F.concat(F.lit("/"), "event_type").alias("path"), F.col("value"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("built_at"), F.col("event_id").alias("ep_ord"), F.dayofmonth("ts").alias("day"))


def first_sources(spark: S, sf: str) -> D:
    e = _events(spark, sf)
    rows = e.withColumn("source", F.element_at(F.array(*[F.lit(s) for s in ("x402scan", "paysh", "mpp", "bazaar", "other")]), (F.col("ep_ord") % 5 + 1).cast("int")))
    return merge.first_source(rows).select("origin", "path", "source", "ep_ord")


def origin_sources(spark: S, sf: str) -> D:
    e = _events(spark, sf)
    return merge.origin_sources(e.withColumn("source", F.when(F.col("day") > 25, "bazaar").when(F.col("day") > 20, "paysh").otherwise("mpp")))


def overridden(spark: S, sf: str) -> D:
    """Users who had errors are probed again: those rows replace all their others."""
    e = _events(spark, sf)
    fresh = e.where("path = '/error' AND day > 28").withColumn("provider_fqn", F.lit(None).cast("string"))
    inline = e.where("day <= 28").withColumn("provider_fqn", F.lit("inline"))
    sources = merge.origin_sources(inline.withColumn("source", F.lit("mpp")))
    return merge.override(inline, fresh, sources).select("origin", "path", "ep_ord", "provider_fqn")


def carried(spark: S, sf: str) -> D:
    """Prior rows of the first days carried into the users of the last ones, unless older than 20 days."""
    e = _events(spark, sf)
    merged, prior = e.where("day > 29"), e.where("day <= 29")
    return merge.carry_forward(merged, prior, F.lit("2024-01-30 00:00:00"), 20).select("origin", "path", "ep_ord", "built_at")


def carry_report(spark: S, sf: str) -> D:
    e = _events(spark, sf)
    return merge.carry_report(e.where("day > 29"), e.where("day <= 29"), F.lit("2024-01-30 00:00:00"), 20)


def merged_records(spark: S, sf: str) -> D:
    """Parts of two registries: one knows odd parts by a stub, the other has all but every fifth."""
    e = v.endpoints(spark, sf)
    a = e.withColumn("summary", F.when(F.col("ep_ord") % 2 == 1, F.lit("short")).otherwise(F.col("summary"))).withColumn("description", F.when(F.col("ep_ord") % 2 == 0, F.col("description")))
    a = a.withColumn("inputs", F.when(F.col("ep_ord") % 2 == 0, F.col("inputs")).otherwise(F.array().cast("array<string>"))).withColumn("operation_id", F.lit(None).cast("string"))
    b = e.where("ep_ord % 5 <> 4")
    return merge.merge_two(a, b).join(e.select("id", "ep_ord"), "id").select("ep_ord", "summary", "description", "operation_id", "payment.paid", F.round("payment.price_usd", 6).alias("price_usd"), F.array_join("inputs", ",").alias("inputs"))


def folded_records(spark: S, sf: str) -> D:
    """Events of a user and type as records of one id, folded in order; each knows some of the fields."""
    n, c = F.col("ep_ord"), F.col
    some = lambda cond, value: F.when(cond, value)
    none = F.array().cast("array<string>")
    rail = F.array(F.struct(F.lit("x402").alias("protocol"), F.lit("2").alias("version"), F.lit(None).cast("array<string>").alias("networks")))
    rows = _events(spark, sf).select(
        F.concat("origin", "path").alias("id"), "ep_ord", "origin", "method", "path", F.concat(F.lit("value "), c("value").cast("string")).alias("summary"),
        some(n % 5 == 0, F.concat(F.lit("about "), n)).alias("description"), some(n % 7 == 0, F.concat(F.lit("op"), n)).alias("operation_id"),
        F.when(n % 4 == 0, F.array(F.concat(F.lit("in"), n % 3))).otherwise(none).alias("inputs"), none.alias("tags"),
        some(n % 3 == 0, F.concat(F.lit("p"), n % 9)).alias("provider_fqn"), F.lit(None).cast("string").alias("provider_title"),
        some(n % 6 == 1, F.concat(F.lit("day "), c("day"))).alias("category"),
        F.struct(some(n % 2 == 1, c("value")).alias("price_usd"), (n % 10 == 0).alias("paid"), F.when(n % 8 == 0, rail).alias("rails")).alias("payment"),
        F.concat(F.lit("t"), n % 13).alias("search_text"),
    )
    return merge.fold(rows).select(
        "id", "origin", "path", "summary", "description", "operation_id", F.array_join("inputs", ",").alias("inputs"), "provider_fqn", "category", "paid",
        F.round("price_usd", 6).alias("price_usd"), F.coalesce(F.size("rails"), F.lit(0)).alias("rails"), "search_text",
    )


def content_hashes(spark: S, sf: str) -> D:
    return v.endpoints(spark, sf).select("ep_ord", labels.content_hash().alias("hash"))


def label_delta(spark: S, sf: str) -> D:
    e = v.endpoints(spark, sf)
    known = e.where("ep_ord % 4 <> 0").select(F.col("id").alias("key"), F.when(F.col("ep_ord") % 3 == 0, F.lit("0123456789abcdef")).when(F.col("ep_ord") % 3 == 1, labels.content_hash()).alias("content_hash"))
    return labels.label_delta(e, known).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def labelled_facets(spark: S, sf: str) -> D:
    e = v.faceted(spark, sf)
    rows = e.where("ep_ord % 3 = 0").select(F.col("id").alias("key"), F.lit("data").alias("regex_domain"), F.when(F.col("ep_ord") % 2 == 0, F.lit(" gov ")).alias("domain_corrected"), F.lit("lookup").alias("action"), F.when(F.col("ep_ord") % 9 == 0, F.lit("Answer")).alias("entity"), F.col("ep_ord").alias("pos"))
    out = labels.apply_facets(e, labels.load_labels(rows))
    return out.select("ep_ord", "facets.domain", "facets.action", "facets.output_entity", "facets.authored")


def bound_by_hand(spark: S, sf: str) -> D:
    e = v.endpoints(spark, sf)
    own = e.where("ep_ord % 10 = 3").select("origin", "method", "path", F.array(F.lit("data.items")).alias("capabilities"))
    return labels.apply_bindings(e, own).select("ep_ord", F.array_join("capabilities", ",").alias("capabilities"))


def newly_bound(spark: S, sf: str) -> D:
    e = v.endpoints(spark, sf)
    return labels.newly_bound(e.withColumn("capabilities", F.slice("capabilities", 1, 1)), e).join(e.select("id", "ep_ord"), "id").select("ep_ord", "intent_id")


def worklist(spark: S, sf: str) -> D:
    return labels.worklist(v.endpoints(spark, sf), ["cloud.domain_lookup"], {"ai.generate_image": 15, "comms.send_email": 10}).select("ep_ord", "summary")


def embedded_delta(spark: S, sf: str) -> D:
    """Texts that the cache lacks, embedded by their bytes' counts: a distinct text once."""
    e = v.endpoints(spark, sf).select("ep_ord", embed_text(F.col("summary"), F.col("description"), F.col("path"), F.col("inputs")).alias("text"))
    cache = e.where("ep_ord % 2 = 0").select(vectors.text_hash(F.col("text")).alias("text_hash"), F.when(F.col("ep_ord") % 4 == 0, F.lit("bytes")).otherwise("other").alias("model"), F.lit(8).alias("dim"))

    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.bincount(np.frombuffer(t.encode(), np.uint8) % 8, minlength=8).astype(float))

    return vectors.embed_new(e, cache, count, "bytes", 8).select("text_hash", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total"))


def embedding_cache(spark: S, sf: str) -> D:
    """The cache table after four runs: half of the texts, all of them under another model, all, and all again."""

    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.bincount(np.frombuffer(t.encode(), np.uint8) % 8, minlength=8).astype(float))

    path = new_path(spark, "embedding-cache")
    e = v.endpoints(spark, sf).select("ep_ord", embed_text(F.col("summary"), F.col("description"), F.col("path"), F.col("inputs")).alias("text"))
    for texts, model in ((e.where("ep_ord % 2 = 0"), "bytes"), (e, "other/bytes"), (e, "bytes"), (e, "bytes")):
        found = vectors.embed_cached(texts, path, count, model, 8)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    kept = found.union(vectors.read_cache(spark, path, "other/bytes", 8)).select("model", "text_hash", total.alias("total"))
    return kept.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text_hash").alias("texts"), F.sum("total").alias("total"))


def _snapshots(spark: S, sf: str) -> str:
    """Two versions of the catalog: parts of even number, then all of them."""
    root = new_path(spark, "catalog")
    e, i, refs = saved(v.endpoints(spark, sf), "endpoints"), v.intents(spark, sf), v.refs(spark, sf)
    snapshots.write_version(root, e.where("ep_ord % 2 = 0"), i, refs)
    snapshots.write_version(root, e, i, refs)
    return root


def catalog_versions(spark: S, sf: str) -> D:
    """What the commits of two versions say, counted while they were written."""
    return snapshots.commits(spark, _snapshots(spark, sf)).select("version", "endpoints", "priced", "newest", "capabilities", "refs")


def catalog_snapshot(spark: S, sf: str) -> D:
    """The current version's rows, read back, and whether the one before has them."""
    root = _snapshots(spark, sf)
    old = snapshots.read_version(spark, root, 1)["endpoints"].select("ep_ord", F.lit(True).alias("before"))
    now = snapshots.read_version(spark, root)["endpoints"]
    return now.join(old, "ep_ord", "left").select("ep_ord", "origin", "path", F.coalesce("before", F.lit(False)).alias("before"))


_T = "CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_partkey / 1000000.0 END"
_EV = "ev AS (SELECT concat('https://u', user_id, '.example.com') AS origin, concat('/', event_type) AS path, value, ts, event_id AS ep_ord, day(ts) AS day FROM events)"
_SRC = "list_extract(['x402scan', 'paysh', 'mpp', 'bazaar', 'other'], event_id % 5 + 1)"

ALL = {
    "registry_endpoints": (
        registry_endpoints,
        "WITH r AS (SELECT l_orderkey AS o, l_suppkey AS s, min(" + _T + ") AS price_usd, count(*) FILTER (l_returnflag <> 'R') AS n_offers FROM lineitem GROUP BY 1, 2),\n"
        "x AS (SELECT *, concat('https://s', s, '.example.com') AS origin, CASE WHEN o % 3 = 0 THEN 'GET' ELSE 'POST' END AS method, concat('/v1/order/', o) AS path FROM r WHERE o % 97 <> 0 AND o % 5 <> 0)\n"
        "SELECT sha256(concat_ws('|', origin, method, path)) AS id, origin, method, path, CASE WHEN o % 2 = 0 THEN 'Order lines of a supplier' ELSE 'Orders' END AS summary, concat('bazaar/s', s, '.example.com') AS provider_fqn, round(price_usd, 9) AS price_usd, n_offers, "
        "lower(concat_ws(' ', 'Orders', CASE WHEN o % 2 = 0 THEN 'Order lines of a supplier' END, path, 'order line')) AS search_text FROM x",
    ),
    "service_endpoints": (
        service_endpoints,
        "SELECT concat('https://svc', l_suppkey, '.example.com') AS origin, CASE WHEN l_returnflag = 'A' THEN 'GET' ELSE 'POST' END AS method, concat('/v1/', lower(l_returnflag)) AS path, CASE WHEN l_returnflag = 'N' THEN 'New lines' ELSE 'Lines by flag' END AS summary, 'Lines by flag' AS description, "
        "concat('mpp/svc', l_suppkey, '.example.com') AS provider_fqn, round(CASE WHEN l_returnflag = 'R' THEN 0.2 ELSE min(l_partkey) / 100.0 END, 9) AS price_usd FROM lineitem GROUP BY l_suppkey, l_returnflag",
    ),
    "page_resources": (
        page_resources,
        "WITH h AS (SELECT concat(html, ' see <a href=\"', regexp_replace(url, '^http:', 'https:'), '\">x</a> https://api.', page_id % 37, '.example.com/v2/items/', page_id, ' https://schema.org/v1/x') AS html FROM pages),\n"
        f"u AS (SELECT unnest(list_concat(regexp_extract_all(html, '{registry.RESOURCE_PATTERNS[0]}'), regexp_extract_all(html, '{registry.RESOURCE_PATTERNS[1]}'))) AS u FROM h)\n"
        "SELECT DISTINCT concat(lower(regexp_extract(u, '^https://[^/]*', 0)), regexp_extract(u, '^https://[^/]*(/.*)$', 1)) AS url FROM u WHERE NOT contains(u, 'x402scan.com') AND NOT contains(u, 'mppscan.com') AND NOT contains(u, 'schema.org')",
    ),
    "page_origins": (
        page_origins,
        f"WITH u AS (SELECT unnest(regexp_extract_all(concat(html, ' <a href=\"', url, '\"> https://schema.org/ https://www.x402scan.com/a'), '{registry.ORIGIN_PATTERN}')) AS u FROM pages)\n"
        "SELECT DISTINCT lower(regexp_extract(u, '^https://[^/]*', 0)) AS origin FROM u WHERE regexp_replace(u, '/$', '') NOT IN (" + ", ".join(f"'{o}'" for o in registry.ORIGIN_BLOCK) + ") AND NOT contains(u, 'x402scan') AND NOT contains(u, 'mppscan')",
    ),
    "openapi_endpoints": (
        openapi_endpoints,
        "SELECT concat('https://lines', l_suppkey, '.example.com') AS origin, 'POST' AS method, concat('/v1/', l_returnflag) AS path, concat('op', min(l_partkey)) AS operation_id, concat('Lines ', l_returnflag) AS summary, 'key,page,a,b' AS inputs, round(min(l_partkey) / 1000000.0, 9) AS price_usd, 'x402' AS rail, "
        "true AS guidance_available, lower(concat('Lines Lines ', l_returnflag, ' /v1/', l_returnflag, ' use it')) AS search_text FROM lineitem WHERE l_suppkey % 10 <> 3 GROUP BY l_suppkey, l_returnflag",
    ),
    "legacy_payments": (
        legacy_payments,
        """WITH o AS (SELECT concat('https://c', o_custkey, '.example.com') AS origin, concat('/o/', o_orderkey) AS path, o_orderkey AS n, o_orderkey % 8 AS f, o_custkey % 3 = 0 AS base FROM orders)
        SELECT origin, path, round(CASE f WHEN 0 THEN n / 1000.0 WHEN 1 THEN n + 0.5 WHEN 2 THEN CASE WHEN n * 1000 > 100 THEN n / 1000.0 END
                WHEN 4 THEN n / 1000000.0 WHEN 5 THEN n WHEN 7 THEN n END, 9) AS price_usd,
            CASE WHEN f IN (0, 2) THEN concat('x402:2:', CASE WHEN base THEN 'base' ELSE '' END)
                WHEN f IN (1, 7) THEN concat(CASE WHEN base THEN 'x402:2:base,' ELSE '' END, 'mpp:-:-')
                WHEN f = 3 THEN concat(CASE WHEN base THEN 'x402:2:base,' ELSE '' END, 'mpp:-:tempo')
                WHEN f = 6 THEN concat('x402:2:', CASE WHEN base THEN 'base+' ELSE '' END, 'x402,mpp:-:tempo')
                ELSE concat('x402:2:', CASE WHEN base THEN 'base' ELSE '-' END) END AS rails, n % 3 <> 0 AS schema_missing FROM o""",
    ),
    "openapi_rejects": (
        openapi_rejects,
        f"""WITH o AS (SELECT concat('https://c', o_custkey, '.example.com') AS origin, o_custkey % 11 AS k, o_orderkey AS n, o_orderkey % 7 < 2 AS odd, o_orderkey % 5 AS f FROM orders),
        whole AS (SELECT DISTINCT origin, CASE k WHEN 1 THEN 'not JSON' WHEN 2 THEN 'not an object' WHEN 3 THEN 'no paths' WHEN 4 THEN 'empty' ELSE 'nested too deeply' END AS reason,
            CASE WHEN k = 3 THEN '/paths' ELSE '' END AS pointer FROM o WHERE k BETWEEN 1 AND 5)
        SELECT origin, reason, pointer, 1 AS n FROM whole
        UNION ALL SELECT origin, {v.case('f', tuple(r for _, _, r in ODD))}, concat('/paths/~1o~1', n, '/post', {v.case('f', tuple(p for _, p, _ in ODD))}), 1 FROM o WHERE odd AND k NOT BETWEEN 1 AND 5
        UNION ALL SELECT origin, 'kept', '', count(*) FROM o WHERE NOT odd AND k NOT BETWEEN 1 AND 5 GROUP BY 1""",
    ),
    "first_sources": (
        first_sources,
        f"SELECT origin, path, source, ep_ord FROM (SELECT concat('https://u', user_id, '.example.com') AS origin, concat('/', event_type) AS path, {_SRC} AS source, event_id AS ep_ord, row_number() OVER (PARTITION BY user_id, event_type ORDER BY coalesce(list_position(['bazaar', 'mpp', 'paysh', 'x402scan'], {_SRC}), 1000), event_id) AS rn FROM events) WHERE rn = 1",
    ),
    "origin_sources": (origin_sources, "WITH " + _EV + " SELECT origin, CASE WHEN max(day) > 25 THEN 'bazaar' WHEN min(day) <= 20 THEN 'mpp' ELSE 'paysh' END AS source FROM ev GROUP BY 1"),
    "overridden": (
        overridden,
        "WITH " + _EV + ", fr AS (SELECT * FROM ev WHERE path = '/error' AND day > 28), il AS (SELECT * FROM ev WHERE day <= 28)\n"
        "SELECT origin, path, ep_ord, concat(CASE WHEN origin IN (SELECT origin FROM il) THEN 'mpp' ELSE 'openapi' END, '/', regexp_replace(origin, '^https://', '')) AS provider_fqn FROM fr UNION ALL SELECT origin, path, ep_ord, 'inline' FROM il WHERE origin NOT IN (SELECT origin FROM fr)",
    ),
    "carried": (
        carried,
        "WITH " + _EV + "\nSELECT origin, path, ep_ord, strftime(ts, '%Y-%m-%d %H:%M:%S') AS built_at FROM ev WHERE day > 29 OR (origin NOT IN (SELECT origin FROM ev WHERE day > 29) AND epoch(TIMESTAMP '2024-01-30 00:00:00') - epoch(date_trunc('second', ts)) <= 20 * 86400)",
    ),
    "carry_report": (
        carry_report,
        "WITH " + _EV + ", p AS (SELECT epoch(TIMESTAMP '2024-01-30 00:00:00') - epoch(date_trunc('second', ts)) > 20 * 86400 AS stale FROM ev WHERE day <= 29 AND origin NOT IN (SELECT origin FROM ev WHERE day > 29)) SELECT count(*) FILTER (NOT stale) AS carried, count(*) FILTER (stale) AS evicted FROM p",
    ),
    "merged_records": (
        merged_records,
        with_(E) + ", x AS (SELECT *, ep_ord % 2 = 1 AS odd, ep_ord % 5 <> 4 AS has_b, CASE WHEN ep_ord % 2 = 1 THEN 'short' ELSE summary END AS s_a, CASE WHEN ep_ord % 2 = 0 THEN description END AS d_a, CASE WHEN ep_ord % 2 = 0 THEN inputs_csv ELSE '' END AS i_a FROM e),\n"
        "y AS (SELECT *, (d_a IS NULL OR trim(d_a) = '') AND i_a = '' AND price_usd IS NULL AND (length(s_a) < 20 OR s_a = concat_ws(' ', method, path)) AS stub_a, coalesce(trim(description), '') = '' AND inputs_csv = '' AND operation_id IS NULL AND price_usd IS NULL AND (length(summary) < 20 OR summary = concat_ws(' ', method, path)) AS stub_b FROM x),\n"
        "z AS (SELECT *, CASE WHEN NOT has_b THEN false WHEN stub_a AND NOT stub_b THEN true WHEN NOT stub_a AND stub_b THEN false ELSE length(summary) > length(s_a) END AS tb FROM y)\n"
        "SELECT ep_ord, CASE WHEN tb THEN summary ELSE s_a END AS summary, CASE WHEN tb THEN coalesce(description, d_a) WHEN has_b THEN coalesce(d_a, description) ELSE d_a END AS description, CASE WHEN has_b THEN operation_id END AS operation_id, paid, round(price_usd, 6) AS price_usd, "
        "CASE WHEN tb THEN CASE WHEN inputs_csv <> '' THEN inputs_csv ELSE i_a END WHEN i_a <> '' THEN i_a WHEN has_b THEN inputs_csv ELSE i_a END AS inputs FROM z",
    ),
    "folded_records": (
        folded_records,
        "WITH " + _EV + """, r AS (SELECT concat(origin, path) AS id, origin, path, ep_ord, concat('value ', value) AS summary,
            CASE WHEN ep_ord % 5 = 0 THEN concat('about ', ep_ord) END AS description, CASE WHEN ep_ord % 7 = 0 THEN concat('op', ep_ord) END AS op,
            CASE WHEN ep_ord % 4 = 0 THEN concat('in', ep_ord % 3) END AS input, CASE WHEN ep_ord % 3 = 0 THEN concat('p', ep_ord % 9) END AS fqn,
            CASE WHEN ep_ord % 6 = 1 THEN concat('day ', day) END AS category, CASE WHEN ep_ord % 2 = 1 THEN value END AS price,
            ep_ord % 10 = 0 AS paid, ep_ord % 8 = 0 AS has_rails FROM ev),
        k AS (SELECT *, row_number() OVER w AS pos, length(summary) + CASE WHEN description IS NULL AND input IS NULL AND op IS NULL AND price IS NULL
            AND length(summary) < 20 THEN 0 ELSE 100000 END AS lead FROM r WINDOW w AS (PARTITION BY id ORDER BY ep_ord)),
        m AS (SELECT *, max(lead) OVER (PARTITION BY id ORDER BY ep_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS led FROM k),
        p AS (SELECT *, CASE WHEN led IS NULL OR lead > led THEN -pos ELSE pos END AS a FROM m)
        SELECT id, any_value(origin) AS origin, any_value(path) AS path, arg_min(summary, a) AS summary,
            arg_min(description, a) FILTER (description IS NOT NULL) AS description, arg_min(op, a) FILTER (op IS NOT NULL) AS operation_id,
            coalesce(arg_min(input, a) FILTER (input IS NOT NULL), '') AS inputs, arg_min(fqn, pos) FILTER (fqn IS NOT NULL) AS provider_fqn,
            arg_min(category, a) FILTER (category IS NOT NULL) AS category, bool_or(paid) AS paid,
            round(arg_min(price, a) FILTER (price IS NOT NULL), 6) AS price_usd, bool_or(has_rails)::INT AS rails,
            string_agg(concat('t', ep_ord % 13), ' ' ORDER BY pos) AS search_text FROM p GROUP BY id""",
    ),
    "content_hashes": (content_hashes, with_(E) + "SELECT ep_ord, sha256(concat_ws(chr(10), method, path, summary, coalesce(description, ''), inputs_csv_bar))[1:16] AS hash FROM (SELECT *, array_to_string(inputs, '|') AS inputs_csv_bar FROM e)"),
    "label_delta": (label_delta, with_(E) + "SELECT CASE WHEN ep_ord % 4 = 0 THEN 'new' WHEN ep_ord % 3 = 0 THEN 'changed' ELSE 'current' END AS status, count(*) AS n FROM e GROUP BY 1"),
    "labelled_facets": (
        labelled_facets,
        with_(E, v.F_SQL) + "SELECT ep_ord, CASE WHEN ep_ord % 3 <> 0 THEN domain WHEN ep_ord % 2 = 0 THEN 'gov' ELSE 'data' END AS domain, CASE WHEN ep_ord % 3 = 0 THEN 'lookup' END AS action, CASE WHEN ep_ord % 3 <> 0 THEN output_entity WHEN ep_ord % 9 = 0 THEN 'Answer' END AS output_entity, ep_ord % 3 = 0 AS authored FROM f",
    ),
    "bound_by_hand": (
        bound_by_hand,
        with_(E, v.CAPS, v.I) + ", h AS (SELECT DISTINCT origin, method, path FROM e WHERE ep_ord % 10 = 3), c AS (SELECT caps.ep_ord, string_agg(intent_id, ',' ORDER BY (ip - e.ph + 16) % 16) AS c FROM caps JOIN e USING (id) JOIN i ON i.ph = ip GROUP BY 1)\n"
        "SELECT e.ep_ord, CASE WHEN h.origin IS NOT NULL THEN 'data.items' ELSE coalesce(c, '') END AS capabilities FROM e LEFT JOIN h USING (origin, method, path) LEFT JOIN c USING (ep_ord)",
    ),
    "newly_bound": (newly_bound, with_(E, v.I) + "SELECT ep_ord, intent_id FROM e JOIN i ON i.ph = (e.ph + 1) % 16 WHERE bound AND also"),
    "worklist": (
        worklist,
        with_(E, v.CAPS, v.I) + ", x AS (SELECT DISTINCT ep_ord, intent_id FROM caps JOIN i ON i.ph = ip), t AS (SELECT ep_ord FROM x WHERE intent_id = 'cloud.domain_lookup'),\n"
        "n AS (SELECT ep_ord FROM (SELECT *, row_number() OVER (PARTITION BY intent_id ORDER BY ep_ord) AS rn FROM x WHERE ep_ord NOT IN (SELECT ep_ord FROM t) AND intent_id IN ('ai.generate_image', 'comms.send_email')) WHERE rn <= CASE intent_id WHEN 'ai.generate_image' THEN 15 ELSE 10 END)\n"
        "SELECT ep_ord, summary FROM e WHERE ep_ord IN (SELECT ep_ord FROM t UNION SELECT ep_ord FROM n)",
    ),
    "embedding_cache": (
        embedding_cache,
        with_(E) + f"""SELECT model, count(*) AS n, count(*) AS texts, CAST(sum(strlen(text)) AS DOUBLE) AS total FROM (
            SELECT DISTINCT trim(regexp_replace({_embed}, '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM e), (SELECT unnest(['bytes', 'other/bytes']) AS model) GROUP BY 1""",
    ),
    "catalog_versions": (
        catalog_versions,
        "WITH " + v.M + """ SELECT version, count(*) AS endpoints, count(price_usd) AS priced, '2024-01-31' AS newest,
            (SELECT count(*) FROM i) AS capabilities, (SELECT count(*) FROM m) AS refs
        FROM e, (SELECT unnest([1, 2]) AS version) WHERE version = 2 OR ep_ord % 2 = 0 GROUP BY 1""",
    ),
    "catalog_snapshot": (catalog_snapshot, with_(E) + "SELECT ep_ord, origin, path, ep_ord % 2 = 0 AS before FROM e"),
    "embedded_delta": (
        embedded_delta,
        with_(E) + f"""SELECT sha256(text) AS text_hash, CAST(strlen(text) AS DOUBLE) AS total FROM (
            SELECT text FROM (SELECT ep_ord, trim(regexp_replace({_embed}, '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM e)
            GROUP BY text HAVING NOT bool_or(ep_ord % 4 = 0))""",
    ),
}
