"""Landed registry dumps, pages, prior snapshots and label files as endpoint rows and origins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import canonical_origin, canonical_url, endpoint_id, host_of, http_method, url_origin, url_path
from ..functions.money import amount_hint, base_units_to_usd, cheapest
from ..functions.patterns import some
from ..functions.text import search_text
from ..schemas import OFFERS, PROVIDER, REGISTRY_RESOURCE, SERVICE

SUMMARY = 200

# How resource URLs and service origins look in pages, and whose don't count.
RESOURCE_PATTERNS = (r"https://[a-zA-Z0-9._-]+\.[a-z]{2,}/v\d+/[a-zA-Z0-9_./-]+", r"https://[a-zA-Z0-9._-]+\.[a-z]{2,}/api/[a-zA-Z0-9_./-]+")
ORIGIN_PATTERN = r"https://[a-zA-Z0-9._-]+\.[a-z]{2,}(?:/[a-zA-Z0-9._/-]*)?"
RESOURCE_BLOCK = ("x402scan.com", "mppscan.com", "schema.org")
ORIGIN_BLOCK = ("https://www.x402scan.com", "https://www.mppscan.com", "https://mppscan.com", "https://x402scan.com", "https://schema.org", "https://merit.systems")
SNAPSHOT_EXTRAS = ("_source", "_completeness", "_flags", "_wellknown")


def read_resources(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY_RESOURCE).json(path)


def read_services(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SERVICE).json(path)


def read_providers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROVIDER).json(path)


def _rails(protocol: str, version: str | None = None) -> Column:
    return F.array(F.struct(F.lit(protocol).alias("protocol"), F.lit(version).cast("string").alias("version"), F.lit(None).cast("array<string>").alias("networks")))


def resources_to_endpoints(resources: DataFrame, built_at: str) -> DataFrame:
    """Registry resources as endpoint rows: those with a type that isn't http, or without a valid URL, fall out."""
    rows = resources.where("type IS NULL OR type = '' OR type = 'http'").withColumn("__origin", url_origin(F.col("resource"))).where("__origin IS NOT NULL")
    origin, path, method = canonical_origin(F.col("__origin")), url_path(F.col("resource")), http_method(F.coalesce("method", F.lit("POST")))
    accepts = F.filter(F.coalesce("accepts", F.array().cast(_ACCEPTS)), lambda a: F.coalesce(a["amount"].rlike("^[0-9]+$"), F.lit(False)))
    null = F.lit(None).cast("string")
    offers = F.transform(accepts, lambda a: F.struct(F.lit("charge").alias("intent"), F.lit("x402").alias("method"), a["amount"].alias("amount"), a["asset"].alias("currency"), null.alias("description")))
    price = F.array_min(F.transform(accepts, lambda a: base_units_to_usd(a["amount"], F.lit(None).cast("int"), a["asset"], null)))
    summary = F.left(F.coalesce(some(F.col("description")), some(F.col("serviceName")), path), F.lit(SUMMARY))
    payment = F.struct(price.alias("price_usd"), F.lit(True).alias("paid"), F.try_element_at("accepts", F.lit(1))["asset"].alias("currency"), _rails("x402", "2").alias("rails"), offers.cast(OFFERS).alias("offers"))
    return rows.select(
        endpoint_id(origin, method, path).alias("id"), origin.alias("origin"), method.alias("method"), path.alias("path"), summary.alias("summary"), "description", "tags",
        F.concat(F.lit("bazaar/"), F.regexp_replace(host_of(F.col("__origin")), r":\d+$", "")).alias("provider_fqn"), F.col("serviceName").alias("provider_title"), payment.alias("payment"),
        F.struct(F.lit(None).cast("boolean").alias("has200"), F.lit(True).alias("has402")).alias("responses"),
        F.lower(F.concat_ws(" ", some(F.col("serviceName")), some(F.col("description")), path, some(F.array_join("tags", " ")))).alias("search_text"), F.lit(built_at).alias("built_at"),
    )


_ACCEPTS = "array<struct<amount:string,asset:string,network:string,payTo:string,scheme:string>>"


def services_to_endpoints(services: DataFrame, built_at: str) -> DataFrame:
    """Nested endpoints of services as rows; services without a valid URL fall out."""
    rows = services.withColumn("__origin", url_origin(F.coalesce(some(F.col("serviceUrl")), F.col("url")))).where("__origin IS NOT NULL")
    rows = rows.withColumn("e", F.explode("endpoints"))
    origin, method, path = canonical_origin(F.col("__origin")), http_method(F.coalesce("e.method", F.lit("POST"))), F.coalesce(some(F.col("e.path")), F.lit("/"))
    null = F.lit(None).cast("string")
    price = F.coalesce(amount_hint(F.col("e.payment.amountHint")), base_units_to_usd(F.col("e.payment.amount"), F.col("e.payment.decimals"), null, F.col("e.payment.currency")))
    about = F.coalesce(some(F.col("e.description")), F.col("description"))
    payment = F.struct(price.alias("price_usd"), F.lit(True).alias("paid"), F.col("e.payment.currency").alias("currency"), _rails("mpp").alias("rails"), F.array().cast(OFFERS).alias("offers"))
    return rows.select(
        endpoint_id(origin, method, path).alias("id"), origin.alias("origin"), method.alias("method"), path.alias("path"),
        F.left(F.coalesce(some(F.col("e.summary")), some(F.col("e.description")), some(F.col("description")), path), F.lit(SUMMARY)).alias("summary"), about.alias("description"), "tags",
        F.concat(F.lit("mpp/"), host_of(origin)).alias("provider_fqn"), payment.alias("payment"), F.struct(F.lit(None).cast("boolean").alias("has200"), F.lit(True).alias("has402")).alias("responses"),
        F.lit("").alias("search_text"), F.lit(built_at).alias("built_at"),
    )


def service_origins(services: DataFrame) -> DataFrame:
    """(origin) of every service with a valid URL, those without endpoints too."""
    return services.select(canonical_origin(url_origin(F.coalesce(some(F.col("serviceUrl")), F.col("url")))).alias("origin")).where("origin IS NOT NULL").distinct()


def provider_origins(providers: DataFrame) -> DataFrame:
    """(origin) of providers with a URL and endpoints; a missing count keeps its provider."""
    kept = providers.where("service_url IS NOT NULL AND service_url <> '' AND (endpoint_count IS NULL OR endpoint_count <> 0)")
    return kept.select(canonical_origin(url_origin(F.col("service_url"))).alias("origin")).where("origin IS NOT NULL").distinct()


def resource_urls(pages: DataFrame, html: str = "html") -> DataFrame:
    """(url): distinct canonical resource URLs in pages."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(p), F.lit(0)) for p in RESOURCE_PATTERNS])
    urls = pages.select(F.explode(F.array_distinct(found)).alias("u"))
    for own in RESOURCE_BLOCK:
        urls = urls.where(~F.contains("u", F.lit(own)))
    return urls.select(canonical_url(F.col("u")).alias("url")).distinct()


def origins_in(pages: DataFrame, html: str = "html") -> DataFrame:
    """(origin): distinct service origins in pages."""
    urls = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(ORIGIN_PATTERN), F.lit(0)))).alias("u"))
    kept = urls.where(~F.regexp_replace("u", "/$", "").isin(*ORIGIN_BLOCK) & ~F.contains("u", F.lit("x402scan")) & ~F.contains("u", F.lit("mppscan")))
    origin = url_origin(F.col("u"))
    return kept.where(F.contains(host_of(origin), F.lit("."))).select(canonical_origin(origin).alias("origin")).distinct()


def clean_snapshot(snapshot: DataFrame) -> DataFrame:
    return snapshot.drop(*SNAPSHOT_EXTRAS)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """An authored label CSV: quoted fields, doubled quotes, line feeds inside; ``pos`` keeps the rows' order."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return rows.withColumn("pos", F.monotonically_increasing_id())


def load_intents(sources: DataFrame) -> DataFrame:
    """Intent rows with an id and a label, numbered in order of their id (the order of their files)."""
    kept = sources.where("id IS NOT NULL AND id <> '' AND label IS NOT NULL AND label <> ''").drop("intent_ord")
    return kept.withColumn("intent_ord", F.row_number().over(Window.orderBy("id")) - 1)  # the controlled vocabulary
