"""Endpoint-shaped views of the driver's tables, as Spark frames and as the same SQL for DuckDB.

An endpoint is a part, an intent one of the sixteen phrases that parts carry, a query a customer's request. The
columns are written once, in SQL that both engines read alike; structs and arrays are put together on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import spread

PHRASES = (
    "Search the web and return organic search results",
    "Scrape a web page to clean markdown text",
    "Look up the exchange rate of a currency pair",
    "Send an email message to a recipient",
    "Token balance of a wallet on ethereum",
    "Transcribe speech from an audio file",
    "Cheapest price of a product with price history",
    "Geocode a street address to latitude and longitude",
    "Company enrich with firmographic fields",
    "Generate an image from a text prompt",
    "GET /v1/items",
    "Premium API access",
    "Whois and dns lookup of a domain name",
    "Hotel reviews and booking places nearby",
    "Weather forecast as structured json",
    "$0.05 USDC per call",
)
IDS = (
    "web.search", "web.scrape_page", "finance.exchange_rates", "comms.send_email", "blockchain.token_balance", "ai.transcribe_audio", "commerce.price_history", "maps.geocode_address",
    "identity.company_enrich", "ai.generate_image", "data.items", "agent.premium_access", "cloud.domain_lookup", "travel.hotel_reviews", "data.weather_forecast", "utility.call_price",
)
DOMAINS = ("web", "web", "finance", "comms", "blockchain", "ai", "commerce", "maps", "identity", "ai", "data", "agent", "cloud", "travel", "data", "utility")
ACTIONS = ("search", "extract", "lookup", "send", "lookup", "transform", "lookup", "lookup", "enrich", "generate", "lookup", "lookup", "lookup", "search", "lookup", "lookup")
CONSUMES = ("Query", "Webpage", "Currency", "Contact", "WalletAddress", "AudioClip", "Product", "Location", "Company", "Query", "Query", "Query", "Domain", "Place", "City", "Money")
PRODUCES = ("SearchResults", "WebContent", "MarketQuote", "Message", "Money", "Text", "PriceSignal", "Location", "Company", "Image", "StructuredRecord", "Answer", "Brand", "Place", "StructuredRecord", "PriceSignal")
INPUTS = ("query", "url,format", "currency,base_amount", "to,subject,body", "wallet_address,chain", "audio_url", "product_uid,max-price", "street address", "company", "prompt", "", "", "domain", "city,place", "lat,lon", "")
#: One-hop parents of entities, as the subtype table of the catalog has them.
PARENTS = {"PostalAddress": "Place", "GeoCoordinates": "Place", "Location": "Place", "City": "Place", "Region": "Place", "Brand": "Company"}
BRIDGES = ("Place", "ProductCategory", "Company", "Person", "Domain")
OBSERVATIONS = ("PriceSignal", "MarketQuote", "SearchResults", "WebContent", "StructuredRecord")


def case(key: str, values: tuple[str, ...]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


PH = "(p_partkey % 16)"
#: Endpoint columns over ``part``.
PART = {
    "ep_ord": "p_partkey",
    "ph": PH,
    "origin": "CASE WHEN p_partkey % 43 = 0 THEN 'https://shop-git-main.vercel.app' WHEN p_partkey % 5 = 0 THEN concat('https://h', CAST(p_partkey % 97 AS STRING), '.vercel.app') ELSE concat('https://api', CAST(p_partkey % 61 AS STRING), '.example.com') END",
    "method": "CASE p_partkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END",
    "path": "CASE WHEN p_partkey % 41 = 0 THEN '/api/health' ELSE concat('/v1/', lower(p_type), '/', CAST(p_partkey % 23 AS STRING)) END",
    "summary": case(PH, PHRASES),
    "description": f"CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE concat(p_name, ' by ', p_brand, ': ', lower({case(PH, PHRASES)})) END",
    "inputs_csv": case(PH, INPUTS),
    "category": f"CASE WHEN p_partkey % 9 = 0 THEN {case(PH, DOMAINS)} END",
    "price_usd": "CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 59 = 0 THEN p_retailprice * 100 ELSE p_retailprice / 1000 END",
    "paid": "p_partkey % 3 <> 0",
    "has_rails": "p_partkey % 6 = 0",
    "currency": "CASE WHEN p_partkey % 2 = 0 THEN 'usd' END",
    "operation_id": "CASE WHEN p_partkey % 8 = 0 THEN concat('op', CAST(p_partkey AS STRING)) END",
    "provider_title": "CASE WHEN p_partkey % 10 = 0 THEN p_brand END",
    "provider_fqn": "CASE p_partkey % 4 WHEN 0 THEN concat('x402scan/', lower(p_brand)) WHEN 1 THEN concat('bazaar/', lower(p_brand)) WHEN 2 THEN concat('mpp/', lower(p_brand)) END",
    "has200": "p_partkey % 11 <> 0",
    "has402": "p_partkey % 2 = 1",
    "schema_missing": "p_partkey % 13 = 0",
    "guidance": "p_partkey % 6 = 1",
    "openapi_url": "CASE WHEN p_partkey % 5 = 2 THEN 'https://spec.example.com/openapi.json' END",
    "bound": "p_partkey % 5 <> 0",
    "also": "p_partkey % 3 = 0",
}


def sql(text: str) -> str:
    """Portable SQL for DuckDB: it calls a string type VARCHAR."""
    return text.replace("AS STRING)", "AS VARCHAR)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as endpoint rows of the declared shape."""
    rows = spread(table(spark, sf_dir, "part")).selectExpr("p_partkey", *[f"{v} AS {k}" for k, v in PART.items()])
    c = F.col
    none = F.lit(None).cast("string")
    split = F.when(c("inputs_csv") == "", F.array().cast("array<string>")).otherwise(F.split("inputs_csv", ","))
    rail = F.array(F.struct(F.lit("x402").alias("protocol"), F.lit("2").alias("version"), F.lit(None).cast("array<string>").alias("networks")))
    rails = F.when(c("has_rails"), rail).otherwise(F.array().cast("array<struct<protocol:string,version:string,networks:array<string>>>"))
    offers = F.array().cast("array<struct<intent:string,method:string,amount:string,currency:string,description:string>>")
    ids = F.array(*[F.lit(v) for v in IDS])
    caps = F.when(~c("bound"), F.array().cast("array<string>")).when(c("also"), F.array(F.element_at(ids, (c("ph") + 1).cast("int")), F.element_at(ids, ((c("ph") + 1) % 16 + 1).cast("int")))).otherwise(F.array(F.element_at(ids, (c("ph") + 1).cast("int"))))
    return rows.select(
        F.sha2(F.concat_ws("|", "origin", "method", "path", "ep_ord"), 256).alias("id"), "origin", "method", "path", "operation_id", "summary", "description",
        F.array().cast("array<string>").alias("tags"), "provider_fqn", "provider_title", "category", caps.alias("capabilities"), split.alias("inputs"),
        F.struct("price_usd", "paid", "currency", rails.alias("rails"), offers.alias("offers")).alias("payment"),
        F.struct(F.array().cast("array<string>").alias("categories"), F.lit(None).cast("map<string,string>").alias("docs")).alias("service"), F.struct("has200", "has402").alias("responses"),
        "schema_missing", c("guidance").alias("guidance_available"), "openapi_url", F.lower(F.concat_ws(" ", "summary", "description", "path")).alias("search_text"),
        F.lit(None).cast("array<string>").alias("keyphrases"), F.lit(None).cast("int").alias("host_breadth"), F.lit("2024-01-31").alias("built_at"), "ep_ord", "ph",
    )


E = sql(
    "e AS (SELECT *, sha256(concat_ws('|', origin, method, path, CAST(ep_ord AS STRING))) AS id, lower(concat_ws(' ', summary, description, path)) AS search_text, "
    "CASE WHEN inputs_csv = '' THEN [] ELSE string_split(inputs_csv, ',') END AS inputs FROM (SELECT " + ", ".join(f"{v} AS {k}" for k, v in PART.items()) + " FROM part))"
)
#: endpoint x intent (ph of the intent as ``ip``)
CAPS = "caps AS (SELECT id, ep_ord, ph AS ip FROM e WHERE bound UNION ALL SELECT id, ep_ord, (ph + 1) % 16 FROM e WHERE bound AND also)"
#: the intents, from the phrases that parts carry
I = (  # noqa: E741
    f"i AS (SELECT ph, {case('ph', IDS)} AS intent_id, {case('ph', PHRASES)} AS label, {case('ph', DOMAINS)} AS domain, {case('ph', ACTIONS)} AS action, "
    f"{case('ph', CONSUMES)} AS consumes, {case('ph', PRODUCES)} AS produces, n FROM (SELECT ph, count(*) AS n FROM e GROUP BY ph))"
)
Q = sql(f"q AS (SELECT c_custkey AS query_id, concat({case('(c_custkey % 16)', PHRASES)}, ' for ', lower(c_mktsegment), CASE WHEN c_custkey % 3 = 0 THEN ' near me' ELSE '' END) AS query, c_custkey % 16 AS ph, c_custkey % 10 AS k FROM customer)")


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases that parts carry, as intent rows."""
    n = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 16).cast("int").alias("ph")).agg(F.count(F.lit(1)).alias("n"))
    k = F.col("ph")
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), k + 1)
    none = F.lit(None).cast("string")
    port = lambda values: F.array(F.struct(of(values).alias("entity"), none.alias("role"), none.alias("format"), none.alias("cardinality")))
    return n.select(
        of(IDS).alias("id"), of(PHRASES).alias("label"), none.alias("description"), F.array().cast("array<string>").alias("aliases"), F.array().cast("array<string>").alias("schema_org"),
        port(CONSUMES).alias("consumes"), port(PRODUCES).alias("produces"), F.struct(of(DOMAINS).alias("domain"), of(ACTIONS).alias("action"), F.lit(None).cast("array<string>").alias("modality"), none.alias("freshness")).alias("facets"),
        k.alias("intent_ord"), F.col("n").alias("parts"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' requests: (query_id, query, ph, k)."""
    text = f"concat({case('(c_custkey % 16)', PHRASES)}, ' for ', lower(c_mktsegment), CASE WHEN c_custkey % 3 = 0 THEN ' near me' ELSE '' END)"
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS query_id", f"{text} AS query", "c_custkey % 16 AS ph", "c_custkey % 10 AS k")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, kind, bridge_eligible): the entities on the intents' ports, and the bridges."""
    ports = intents(spark, sf_dir).select(F.explode(F.concat("consumes", "produces")).alias("p")).select(F.col("p.entity").alias("name"))
    names = ports.union(ports.select(F.explode(F.array(*[F.lit(b) for b in BRIDGES])).alias("name"))).distinct()
    kind = F.when(F.col("name").isin(*OBSERVATIONS), "observation").otherwise("identity")
    return names.select("name", kind.alias("kind"), F.col("name").isin(*BRIDGES).alias("bridge_eligible"))


def parents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PARENTS.items()), "child string, parent string")


PARENT_SQL = "par AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PARENTS.items()) + ") t(child, parent))"
BRIDGE_LIST = "(" + ", ".join(f"'{b}'" for b in BRIDGES) + ")"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def first_of(text: str, values: list[tuple[str, str]]) -> str:
    """The first pattern's value, in DuckDB."""
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{v}'" for v, p in values) + " END"


def all_of(text: str, values: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '{p}') THEN '{v}' END" for v, p in values) + "], lambda x: x IS NOT NULL)"


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materialized references of the intents (see the operator)."""
    from ..operators.rank import materialize
    from ..storage import saved

    return saved(materialize(faceted(spark, sf_dir), intents(spark, sf_dir)), "refs")


def faceted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints with facets derived from their text."""
    from ..functions.facets import endpoint_corpus, endpoint_facets

    e = endpoints(spark, sf_dir)
    c = F.col
    f = endpoint_facets(endpoint_corpus(c("path"), c("summary"), c("description"), c("inputs"), c("category")), c("category"))
    whole = F.struct(f["domain"].alias("domain"), F.lit(None).cast("string").alias("action"), f["primary_entity"].alias("primary_entity"), f["output_entity"].alias("output_entity"), f["modality"].alias("modality"), F.lit(False).alias("authored"))
    return e.withColumn("facets", whole)


def _facet_sql() -> str:
    from ..functions import facets as t

    corpus = "lower(concat(path, ' ', summary, ' ', coalesce(description, ''), ' ', array_to_string(inputs, ' '), ' ', coalesce(category, '')))"
    cat = "CASE lower(category) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.CATEGORY_DOMAIN.items()) + " END"
    return (
        f"fc AS (SELECT *, {corpus} AS corpus FROM e),\nf AS (SELECT *, coalesce({cat}, {first_of('corpus', t.DOMAIN_KEYWORDS)}) AS domain, {first_of('corpus', t.PRIMARY_ENTITY_KEYWORDS)} AS primary_entity, "
        f"{first_of('corpus', t.OUTPUT_ENTITY_KEYWORDS)} AS output_entity, array_to_string({all_of('corpus', t.MODALITY_KEYWORDS)}, ',') AS modality FROM fc)"
    )


F_SQL = _facet_sql()


def _neutral_sql() -> str:
    from ..functions.facets import GENERIC_PATH, GENERIC_SUMMARY

    return (
        f"CASE WHEN regexp_matches(summary, '{GENERIC_SUMMARY}') OR regexp_matches(path, '{GENERIC_PATH}') THEN -100 ELSE "
        "(CASE WHEN length(description) > 20 THEN 3 ELSE 0 END) + least(len(inputs), 5) + (CASE WHEN price_usd IS NOT NULL THEN 2 ELSE 0 END) + (CASE WHEN paid THEN 1 ELSE 0 END) + (CASE WHEN guidance THEN 2 ELSE 0 END) "
        "+ (CASE WHEN openapi_url IS NOT NULL THEN 1 ELSE 0 END) + greatest(0, 6 - len(list_filter(string_split(path, '/'), lambda x: x <> ''))) + (CASE WHEN length(summary) > 12 THEN 1 ELSE 0 END)"
    )


def _bonus_sql() -> str:
    from ..operators.rank import ENTITY_INPUTS

    tokens = "CASE i.consumes " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(t) for t in v)}]" for k, v in ENTITY_INPUTS.items()) + " ELSE [] END"
    return (
        f"mb AS (SELECT f.*, i.intent_id, i.produces, i.consumes, caps.ip, {tokens} AS toks, lower(concat_ws(' ', path, summary, coalesce(description, ''))) AS hay, "
        "list_distinct(list_concat(list_transform(inputs, lambda x: lower(x)), flatten(list_transform(inputs, lambda x: list_filter(regexp_split_to_array(lower(x), '[_\\- \\t\\n\\r]+'), lambda y: y <> ''))))) AS parts "
        "FROM f JOIN caps USING (id) JOIN i ON i.ph = caps.ip),\n"
        "ms AS (SELECT *, CASE WHEN list_has_any(toks, parts) THEN 4 ELSE (CASE WHEN len(list_filter(toks, lambda t: contains(hay, t))) > 0 THEN 2 ELSE 0 END) + (CASE WHEN primary_entity = consumes THEN 2 ELSE 0 END) END "
        "+ (CASE WHEN produces = output_entity THEN 3 ELSE 0 END) AS bonus FROM mb),\n"
        f"mn AS (SELECT *, {_neutral_sql()} + bonus END AS score, bool_or(paid OR has_rails) OVER (PARTITION BY intent_id) AS any_paid FROM ms),\n"
        "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY intent_id ORDER BY score DESC, ep_ord) AS rank FROM mn WHERE paid OR has_rails OR NOT any_paid) WHERE rank <= 50)"
    )


NEUTRAL = _neutral_sql() + " END"
#: References of the intents: CTEs up to ``m``.
M = ",\n".join((E, CAPS, I, F_SQL, _bonus_sql()))
