"""Queries on ids, texts, facets, the gate and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facets as ft
from ..functions import ids, money, text
from ..operators import gate, rank
from ..storage import saved, spread
from . import views as v
from .views import E, I, M, Q, with_

S, D = SparkSession, DataFrame


def endpoint_ids(spark: S, sf: str) -> D:
    e = v.endpoints(spark, sf)
    c = F.col
    slashed = F.concat("origin", F.lit("/"))
    return e.select("ep_ord", ids.endpoint_id(slashed, F.lower("method"), c("path")).alias("eid"), ids.endpoint_key(slashed, F.lower("method"), c("path")).alias("ekey"), ids.host_of(c("origin")).alias("host"), ids.canonical_origin(slashed).alias("canonical"))


def page_urls(spark: S, sf: str) -> D:
    p = v.table(spark, sf, "pages")
    u = F.col("url")
    return p.select("page_id", ids.url_origin(u).alias("origin"), ids.url_path(u).alias("path"), ids.canonical_url(u).alias("canonical"), ids.bare_host(u).alias("host"))


def amounts(spark: S, sf: str) -> D:
    o = v.table(spark, sf, "orders")
    c = F.col
    units = F.when(c("o_orderkey") % 7 == 0, F.lit("1.5")).otherwise(c("o_custkey").cast("string"))
    none = F.lit(None).cast("string")
    token = F.lit("0x833589fcd6edb6e08f4c7c32d4f71b54bda02913")
    currency = F.when(c("o_orderkey") % 3 == 0, "usd").when(c("o_orderkey") % 3 == 1, token)
    hint = F.concat(F.lit("$ "), c("o_custkey").cast("string"), F.lit(".25/page"))
    usd = money.base_units_to_usd(units, F.when(c("o_orderkey") % 5 == 0, F.lit(3)), none, currency)
    return o.select("o_orderkey", F.round(usd, 9).alias("usd"), F.round(money.amount_hint(hint), 6).alias("hint"))


def offer_prices(spark: S, sf: str) -> D:
    """Orders' lines as payment offers: the cheapest offer's price and the protocols."""
    rows = v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.struct(
        F.lit("charge").alias("intent"), F.when(F.col("l_returnflag") == "A", "x402").when(F.col("l_returnflag") == "N", "evm").otherwise("stripe").alias("method"),
        F.col("l_partkey").cast("string").alias("amount"), F.when(F.col("l_linestatus") == "F", "usd").alias("currency"), F.lit(None).cast("string").alias("description")).alias("o"))
    per = rows.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "o"))), lambda x: x["o"]).alias("offers"))  # an order's lines
    best = money.cheapest(F.col("offers"))
    return per.select("l_orderkey", F.round(best["price"], 9).alias("price"), F.array_join(money.rails(F.col("offers")), ",").alias("rails"))


def intent_texts(spark: S, sf: str) -> D:
    """What each intent is embedded as, and how many endpoints speak of it."""
    c = F.col
    of = {"id": c("id"), "label": c("label"), "description": c("description"), "aliases": c("aliases"), "domain": c("facets.domain"), "action": c("facets.action")}
    own = text.intent_text(of | {"consumes": c("consumes"), "produces": c("produces")})
    return v.intents(spark, sf).select(c("id").alias("intent_id"), own.alias("text"), c("parts").alias("n"))


def endpoint_texts(spark: S, sf: str) -> D:
    c = F.col
    e = v.endpoints(spark, sf)
    t = text.embed_text(c("summary"), c("description"), c("path"), c("inputs"))
    return e.select("ep_ord", t.alias("embed"), text.search_text(c("summary"), c("description"), c("path")).alias("search"), text.token_estimate(c("search_text")).alias("tokens"))


def document_tokens(spark: S, sf: str) -> D:
    """Binder tokens of all documents' whole texts, with their counts and document frequencies."""
    d = spread(v.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.explode(text.bind_tokens(F.col("text"))).alias("token"))
    return d.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("df"))


def request_tokens(spark: S, sf: str) -> D:
    q = v.queries(spark, sf)
    t = text.query_tokens(F.col("query"))
    s = text.search_tokens(F.col("query"))
    return q.select("query_id", F.array_join(F.sort_array(t), " ").alias("query_tokens"), F.array_join(F.transform(s, text.stem), " ").alias("stems"))


def endpoint_facets(spark: S, sf: str) -> D:
    return v.faceted(spark, sf).select("ep_ord", "facets.domain", "facets.primary_entity", "facets.output_entity", F.array_join("facets.modality", ",").alias("modality"))


def query_facets(spark: S, sf: str) -> D:
    f = ft.query_facets(F.col("query"))
    return v.queries(spark, sf).select("query_id", f["domain"].alias("domain"), f["primary_entity"].alias("primary_entity"), f["output_entity"].alias("output_entity"), F.array_join(f["modality"], ",").alias("modality"))


def held_entities(spark: S, sf: str) -> D:
    """Entities in a sentence made of each supplier's name and city."""
    s = v.table(spark, sf, "supplier").selectExpr("s_suppkey", "concat('Offer of www.shop', CAST(s_suppkey AS STRING), '.example.com in ', CASE s_suppkey % 2 WHEN 0 THEN 'Los Angeles, CA' ELSE 'the north' END) AS t")
    return s.select("s_suppkey", F.explode(text.held_entities(F.col("t"))).alias("x")).select("s_suppkey", "x.entity", "x.value")


def quality_gate(spark: S, sf: str) -> D:
    g = gate.grade(v.endpoints(spark, sf))
    return g.select("ep_ord", "verdict", "reason", F.array_join("flags", ",").alias("flags"), "completeness", gate.is_stub().alias("stub"), gate.is_thin().alias("thin"), ft.is_generic(F.col("summary"), F.col("path")).alias("generic"))


def gate_summary(spark: S, sf: str) -> D:
    return gate.gate_summary(gate.grade(v.endpoints(spark, sf))).select("kind", "name", F.round("value", 6).alias("value"))


def bundle_stats(spark: S, sf: str) -> D:
    return gate.bundle_stats(v.endpoints(spark, sf), v.intents(spark, sf))


def record_errors(spark: S, sf: str) -> D:
    e = v.endpoints(spark, sf).withColumn("id", F.when(F.col("ep_ord") % 17 == 0, F.lit("short")).otherwise(F.col("id"))).withColumn("summary", F.when(F.col("ep_ord") % 19 == 0, F.lit(None).cast("string")).otherwise(F.col("summary")))
    e = e.withColumn("capabilities", F.when(F.col("ep_ord") % 23 == 0, F.array(F.lit("Bad Id"))).otherwise(F.col("capabilities")))
    return gate.record_errors(e).groupBy(F.array_join("errors", ",").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


def document_mirrors(spark: S, sf: str) -> D:
    """Documents as endpoints: exact copies under other sources are mirrors, whatever their case and blanks."""
    d = v.table(spark, sf, "documents").select(F.concat(F.lit("https://"), "source", F.lit(".example.com")).alias("origin"), F.lit("GET").alias("method"), F.concat(F.lit("/"), "lang").alias("path"), F.col("text").alias("summary"), F.col("doc_id").alias("ep_ord"))
    return gate.dedupe_mirrors(d).select(F.col("ep_ord").alias("doc_id"), "origin")


def provider_slices(spark: S, sf: str) -> D:
    return v.endpoints(spark, sf).groupBy(gate.provider_slice().alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.count("payment.price_usd").alias("priced"))


def neutral_top(spark: S, sf: str) -> D:
    e = v.endpoints(spark, sf)
    return rank.rank_neutral(e, ["origin"], 5).select("origin", "rank", "ep_ord", "score")


def materialized(spark: S, sf: str) -> D:
    return rank.materialize(v.faceted(spark, sf), v.intents(spark, sf)).select("intent_id", "rank", "origin", "method", "path", "score")


def selected(spark: S, sf: str) -> D:
    """Endpoints of each intent's references, ranked, where a reference may meet several endpoints of its key."""
    e = v.faceted(spark, sf)
    refs = v.refs(spark, sf).select("intent_id", "rank", "origin", "method", "path").dropDuplicates(["intent_id", "origin", "method", "path"])
    return rank.select_for_intents(refs, e, v.intents(spark, sf)).select("intent_id", "rank", "ep_ord", "score")


def price_medians(spark: S, sf: str) -> D:
    o = v.table(spark, sf, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("price_usd"))
    return rank.price_medians(o, ["l_suppkey"])


def host_breadth(spark: S, sf: str) -> D:
    return rank.host_breadth(v.refs(spark, sf))


def resolved(spark: S, sf: str) -> D:
    """Top three endpoints of every customer's request for its intent."""
    e = v.faceted(spark, sf)
    refs = v.refs(spark, sf)
    e = saved(rank.with_breadth(e, refs), "endpoints")
    asks = v.queries(spark, sf).select("query_id", "query", F.element_at(F.array(*[F.lit(x) for x in v.IDS]), (F.col("ph") + 1).cast("int")).alias("intent_id"))
    keyed = refs.select("intent_id", "origin", "method", "path", "rank").groupBy("intent_id", "origin", "method", "path").agg(F.min("rank").alias("rank"))
    out = rank.resolve(asks, keyed, e, v.intents(spark, sf), 3)
    return out.select("query_id", "intent_id", "rank", F.round("score", 6).alias("score"), F.col("price_usd"))


_META = gate.META_FILE.replace("'", "''")
_GATE = (
    f"gc AS (SELECT *, (CASE WHEN trim(summary) <> '' THEN 1 ELSE 0 END) + (CASE WHEN trim(description) <> '' THEN 1 ELSE 0 END) + (CASE WHEN operation_id IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN len(inputs) > 0 THEN 1 ELSE 0 END) "
    f"+ (CASE WHEN price_usd IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN has_rails THEN 1 ELSE 0 END) + (CASE WHEN currency IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN has402 THEN 1 ELSE 0 END) + (CASE WHEN provider_title IS NOT NULL THEN 1 ELSE 0 END) AS completeness, "
    f"lower(trim(regexp_replace(summary, '[ \\t\\n\\r]+', ' ', 'g'))) AS s1, lower(trim(regexp_replace(coalesce(description, ''), '[ \\t\\n\\r]+', ' ', 'g'))) AS s2 FROM e),\n"
    f"gr AS (SELECT *, CASE WHEN regexp_matches(path, '{_META}') OR regexp_matches(path, '{gate.META_PATH}') THEN 'meta/well-known path' WHEN regexp_matches(origin, '{gate.PREVIEW_HOST}') THEN 'ephemeral preview deploy' "
    f"WHEN trim(summary) = '' OR regexp_matches(trim(summary), '{gate.STUB}') THEN 'stub: synthesized summary' "
    f"WHEN (s1 = '' OR s1 IN {gate.CONTENT_FREE!r} OR regexp_matches(s1, '{gate.BARE_PRICE}')) AND (s2 = '' OR s2 IN {gate.CONTENT_FREE!r} OR regexp_matches(s2, '{gate.BARE_PRICE}')) THEN 'content-free summary (boilerplate)' "
    f"WHEN completeness < 5 THEN concat('thin: only ', completeness, '/13 fields filled') END AS reason, (paid OR price_usd IS NOT NULL OR has_rails) AS pays FROM gc),\n"
    "g AS (SELECT *, CASE WHEN reason IS NULL THEN 'pass' ELSE 'drop' END AS verdict, CASE WHEN reason IS NULL THEN list_filter([CASE WHEN NOT pays THEN 'no-payment-detected' END, CASE WHEN pays THEN 'legacy-payment' END, "
    "CASE WHEN pays AND price_usd IS NULL THEN 'price-dynamic-or-unknown' END, CASE WHEN schema_missing THEN 'schema-missing' END], lambda x: x IS NOT NULL) ELSE [] END AS flags FROM gr)"
)
_BOIL = [p.replace("'", "''") for p in text.BOILERPLATE]
_embed = "concat_ws(' ', summary, description, path, array_to_string(inputs, ' '))"
for _p in _BOIL:
    _embed = f"regexp_replace({_embed}, '{_p}', ' ', 'g')"
_tok = lambda stop, least: f"list_filter(string_split(regexp_replace(lower({{}}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) > {least} AND t NOT IN ({', '.join(repr(s) for s in stop)}))"
_bind = f"list_filter(list_transform({_tok(text.BIND_STOP, 2)}, lambda t: regexp_replace(t, '(ing|ed|es|s)$', '')), lambda t: length(t) > 2)"
_search = f"list_filter(regexp_split_to_array(regexp_replace(lower({{}}), '[^a-z0-9._ \\t\\n\\r-]', ' ', 'g'), '[ \\t\\n\\r]+'), lambda t: length(t) > 1 AND t NOT IN ({', '.join(repr(s) for s in text.SEARCH_STOP)}))"
STEM_SQL = (
    "CASE WHEN length({0}) <= 4 THEN {0} WHEN {0} LIKE '%ies' THEN concat({0}[:-4], 'y') WHEN {0} LIKE '%sses' THEN {0}[:-3] WHEN {0} LIKE '%ing' AND length({0}) > 5 THEN {0}[:-4] WHEN {0} LIKE '%ed' THEN {0}[:-3] "
    "WHEN {0} LIKE '%es' THEN {0}[:-3] WHEN {0} LIKE '%s' AND {0} NOT LIKE '%ss' THEN {0}[:-2] ELSE {0} END"
)
_host = "regexp_extract(regexp_replace({}, '^https?://', ''), '^([^/]*)', 1)"
HOST_SQL = _host

_RESOLVE = (
    M + ",\n" + Q + ",\n"
    "keyed AS (SELECT intent_id, origin, method, path, min(rank) AS ref_rank FROM m GROUP BY ALL),\n"
    f"hb AS (SELECT {_host.format('origin')} AS host, count(DISTINCT intent_id) AS breadth FROM m GROUP BY 1),\n"
    "cand AS (SELECT f.*, keyed.intent_id, keyed.ref_rank FROM keyed JOIN f USING (origin, method, path)),\n"
    "med AS (SELECT intent_id, price_usd AS median FROM (SELECT intent_id, price_usd, row_number() OVER (PARTITION BY intent_id ORDER BY price_usd) rn, count(*) OVER (PARTITION BY intent_id) n FROM cand WHERE price_usd > 0) WHERE rn = n // 2 + 1),\n"
    + v._bonus_sql().split("mn AS")[0].replace("mb AS", "rb AS").replace("ms AS", "rs AS").replace("FROM mb", "FROM rb").replace("FROM f JOIN caps USING (id) JOIN i ON i.ph = caps.ip", "FROM cand f JOIN i USING (intent_id)").replace("f.*, i.intent_id,", "f.*, i.label,").replace(", caps.ip", "")
    + f"rt AS (SELECT rs.*, {v._neutral_sql()} + bonus END AS neutral, lower(concat_ws(' ', summary, coalesce(description, ''), path, array_to_string(inputs, ' '))) AS txt, "
    f"list_distinct({_tok(text.QUERY_STOP, 2).format('regexp_replace(intent_id, chr(94) || chr(91) || chr(94) || chr(46) || chr(93) || chr(42), chr(32))')}) AS idt, list_distinct({_tok(text.QUERY_STOP, 2).format('label')}) AS voc FROM rs),\n"
    f"ask AS (SELECT query_id, i.intent_id, list_distinct({_tok(text.QUERY_STOP, 2).format('query')}) AS qt FROM q JOIN i ON i.ph = q.ph),\n"
    "sc AS (SELECT ask.query_id, rt.intent_id, rt.ref_rank, rt.ep_ord, rt.price_usd, 0.15 * neutral + 25 * len(list_filter(idt, lambda t: contains(txt, t))) + 12 * (CASE WHEN len(voc) > 0 THEN len(list_filter(voc, lambda t: contains(txt, t))) / len(voc) ELSE 0 END) "
    "+ 10 * (CASE WHEN len(qt) > 0 THEN len(list_filter(qt, lambda t: contains(txt, t))) / len(qt) ELSE 0 END) + (CASE WHEN len(list_filter(idt, lambda t: contains(txt, t))) = 0 AND coalesce(breadth, 0) > 12 THEN -2.0 * (breadth - 12) ELSE 0 END) "
    f"+ 4 * ((CASE WHEN guidance THEN 0.5 ELSE 0 END) + (CASE WHEN len(inputs) > 0 THEN 0.5 ELSE 0 END)) + (CASE WHEN price_usd > 20 * median THEN -8 ELSE 0 END) AS score FROM ask JOIN rt USING (intent_id) LEFT JOIN med USING (intent_id) LEFT JOIN hb ON hb.host = {_host.format('rt.origin')})\n"
)

ALL = {
    "endpoint_ids": (
        endpoint_ids,
        with_(E) + f"SELECT ep_ord, sha256(concat_ws('|', origin, method, path)) AS eid, concat_ws('|', origin, method, path) AS ekey, {_host.format('origin')} AS host, origin AS canonical FROM e",
    ),
    "page_urls": (
        page_urls,
        "WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^(https?)://', 1)) AS sch, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS h, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '\\?([^#]*)', 1) AS qs, regexp_extract(url, '\\?', 0) AS qm FROM pages) "
        "SELECT page_id, concat(sch, '://', h) AS origin, CASE WHEN p = '' THEN '/' ELSE p END AS path, concat(sch, '://', h, CASE WHEN p = '' THEN '/' ELSE p END, CASE WHEN qm = '' THEN '' ELSE concat('?', qs) END) AS canonical, regexp_replace(h, '^www\\.', '') AS host FROM u",
    ),
    "amounts": (
        amounts,
        "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_custkey / pow(10, CASE WHEN o_orderkey % 5 = 0 THEN 3 WHEN o_orderkey % 3 = 1 THEN 6 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 6 END), 9) END AS usd, round(o_custkey + 0.25, 6) AS hint FROM orders",
    ),
    "offer_prices": (
        offer_prices,
        "SELECT l_orderkey, round(min(l_partkey / CASE WHEN l_linestatus = 'F' THEN 100.0 ELSE 1000000.0 END), 9) AS price, concat_ws(',', CASE WHEN bool_or(l_returnflag IN ('A', 'N')) THEN 'x402' END, CASE WHEN bool_or(l_returnflag NOT IN ('A', 'N')) THEN 'mpp' END) AS rails FROM lineitem GROUP BY 1",
    ),
    "intent_texts": (
        intent_texts,
        with_(E, I) + "SELECT intent_id, concat_ws(' ', replace(replace(intent_id, '.', ' '), '_', ' '), label, domain, action, consumes, produces) AS text, n FROM i",
    ),
    "endpoint_texts": (
        endpoint_texts,
        with_(E) + f"SELECT ep_ord, trim(regexp_replace({_embed}, '[ \\t\\n\\r]+', ' ', 'g')) AS embed, trim(regexp_replace(lower(concat_ws(' ', summary, description, path)), '[ \\t\\n\\r]+', ' ', 'g')) AS search, CAST(floor(length(search_text) / 4 + 0.5) AS BIGINT) AS tokens FROM e",
    ),
    "document_tokens": (document_tokens, f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_bind.format('text')}) AS token FROM documents) GROUP BY 1"),
    "request_tokens": (
        request_tokens,
        with_(Q) + f"SELECT query_id, array_to_string(list_sort(list_distinct({_tok(text.QUERY_STOP, 2).format('query')})), ' ') AS query_tokens, array_to_string(list_transform({_search.format('query')}, lambda t: {STEM_SQL.format('t')}), ' ') AS stems FROM q",
    ),
    "endpoint_facets": (endpoint_facets, with_(E, v.F_SQL) + "SELECT ep_ord, domain, primary_entity, output_entity, modality FROM f"),
    "query_facets": (
        query_facets,
        with_(Q) + f"SELECT query_id, {v.first_of('lower(query)', ft.DOMAIN_CUES)} AS domain, {v.first_of('lower(query)', ft.ENTITY_CUES)} AS primary_entity, {v.first_of('lower(query)', ft.OUTPUT_CUES)} AS output_entity, array_to_string({v.all_of('lower(query)', ft.MODALITY_CUES)}, ',') AS modality FROM q",
    ),
    "held_entities": (
        held_entities,
        "SELECT s_suppkey, 'Domain' AS entity, concat('www.shop', s_suppkey, '.example.com') AS value FROM supplier UNION ALL SELECT s_suppkey, 'Company', concat('Shop', s_suppkey) FROM supplier UNION ALL SELECT s_suppkey, 'Place', 'Los Angeles, CA' FROM supplier WHERE s_suppkey % 2 = 0",
    ),
    "quality_gate": (
        quality_gate,
        with_(E, _GATE) + f"SELECT ep_ord, verdict, reason, array_to_string(flags, ',') AS flags, completeness, (coalesce(trim(description), '') = '' AND len(inputs) = 0 AND operation_id IS NULL AND price_usd IS NULL AND (length(summary) < 20 OR summary = concat_ws(' ', method, path))) AS stub, "
        f"(NOT has200 AND len(inputs) = 0) AS thin, (regexp_matches(summary, '{ft.GENERIC_SUMMARY}') OR regexp_matches(path, '{ft.GENERIC_PATH}')) AS generic FROM g",
    ),
    "gate_summary": (
        gate_summary,
        with_(E, _GATE) + "SELECT 'total' AS kind, 'total' AS name, CAST(count(*) AS DOUBLE) AS value FROM g UNION ALL SELECT 'total', 'pass', count(*) FILTER (verdict = 'pass') FROM g UNION ALL SELECT 'total', 'drop', count(*) FILTER (verdict = 'drop') FROM g "
        "UNION ALL SELECT 'total', 'avg_completeness', round(avg(completeness) FILTER (verdict = 'pass'), 6) FROM g UNION ALL SELECT 'reason', reason, count(*) FROM g WHERE reason IS NOT NULL GROUP BY 2 UNION ALL SELECT 'flag', x, count(*) FROM (SELECT unnest(flags) AS x FROM g) GROUP BY 2",
    ),
    "bundle_stats": (bundle_stats, with_(E) + "SELECT count(*) AS endpoints, count(DISTINCT ph) AS capabilities, count(DISTINCT origin) AS origins FROM e"),
    "record_errors": (
        record_errors,
        with_(E) + "SELECT errors, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN ep_ord % 17 = 0 THEN 'id' END, CASE WHEN ep_ord % 19 = 0 THEN 'summary' END, CASE WHEN ep_ord % 23 = 0 THEN 'capabilities' END) AS errors FROM e) WHERE errors <> '' GROUP BY 1",
    ),
    "document_mirrors": (
        document_mirrors,
        "SELECT doc_id, origin FROM (SELECT doc_id, concat('https://', source, '.example.com') AS origin, row_number() OVER (PARTITION BY lang, lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) ORDER BY length(source), doc_id) AS rn FROM documents) WHERE rn = 1",
    ),
    "provider_slices": (
        provider_slices,
        with_(E) + "SELECT CASE WHEN provider_fqn LIKE 'x402scan%' THEN 'scan' WHEN provider_fqn LIKE 'bazaar%' THEN 'bazaar' ELSE 'rest' END AS slice, count(*) AS n, count(price_usd) AS priced FROM e GROUP BY 1",
    ),
    "neutral_top": (
        neutral_top,
        with_(E) + f"SELECT origin, rank, ep_ord, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY score DESC, ep_ord) AS rank FROM (SELECT *, {v.NEUTRAL} AS score, bool_or(paid OR has_rails) OVER (PARTITION BY origin) AS any_paid FROM e) WHERE paid OR has_rails OR NOT any_paid) WHERE rank <= 5",
    ),
    "materialized": (materialized, "WITH " + M + "\nSELECT intent_id, rank, origin, method, path, CAST(score AS DOUBLE) AS score FROM m"),
    "selected": (
        selected,
        "WITH " + M + ",\nkeys AS (SELECT DISTINCT intent_id, origin, method, path FROM m),\n"
        + v._bonus_sql().split("mn AS")[0].replace("mb AS", "sb AS").replace("ms AS", "ss AS").replace("FROM mb", "FROM sb").replace("FROM f JOIN caps USING (id) JOIN i ON i.ph = caps.ip", "FROM f JOIN keys USING (origin, method, path) JOIN i ON i.intent_id = keys.intent_id").replace(", caps.ip", "")
        + f"sn AS (SELECT *, {v._neutral_sql()} + bonus END AS score, bool_or(paid OR has_rails) OVER (PARTITION BY intent_id) AS any_paid FROM ss)\n"
        "SELECT intent_id, rank, ep_ord, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY intent_id ORDER BY score DESC, ep_ord) AS rank FROM sn WHERE paid OR has_rails OR NOT any_paid) WHERE rank <= 10",
    ),
    "price_medians": (
        price_medians,
        "SELECT l_suppkey, l_extendedprice AS median FROM (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem WHERE l_extendedprice > 0) WHERE rn = n // 2 + 1",
    ),
    "host_breadth": (host_breadth, "WITH " + M + f"\nSELECT {_host.format('origin')} AS host, count(DISTINCT intent_id) AS breadth FROM m GROUP BY 1"),
    "resolved": (
        resolved,
        "WITH " + _RESOLVE + "SELECT query_id, intent_id, rank, round(score, 6) AS score, price_usd FROM (SELECT *, row_number() OVER (PARTITION BY query_id, intent_id ORDER BY score DESC, ref_rank, ep_ord) AS rank FROM sc) WHERE rank <= 3",
    ),
}
