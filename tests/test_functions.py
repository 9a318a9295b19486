"""Unit values of the column expressions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from waymark.functions import facets, ids, money, text
from waymark.functions.patterns import matches

USDC = "0x833589fcD6eDb6E08f4c7C32D4f71b54bdA02913"


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()


def test_ids(spark):
    a, b, c = one(spark, ids.endpoint_id(F.lit("https://x.io/"), F.lit("get"), F.lit("/a")), ids.endpoint_id(F.lit("https://x.io"), F.lit("GET"), F.lit("a")), ids.endpoint_key(F.lit("https://x.io/"), F.lit("post"), F.lit("a")))
    assert a == b == hashlib.sha256(b"https://x.io|GET|/a").hexdigest() and c == "https://x.io|POST|a"


@pytest.mark.parametrize(
    "url,origin,path,canonical",
    [
        ("https://API.x.io/v1?q=1#f", "https://api.x.io", "/v1", "https://api.x.io/v1?q=1"),
        ("https://x.io", "https://x.io", "/", "https://x.io/"),
        ("http://x.io:80/a", "http://x.io", "/a", "http://x.io/a"),
        ("http://x.io:8080/a", "http://x.io:8080", "/a", "http://x.io:8080/a"),
        ("no url", None, None, "no url"),
    ],
)
def test_urls(spark, url, origin, path, canonical):
    assert tuple(one(spark, ids.url_origin(F.lit(url)), ids.url_path(F.lit(url)), ids.canonical_url(F.lit(url)))) == (origin, path, canonical)


def test_aliases(spark):
    moved = {"https://old.io": "https://new.io"}
    assert tuple(one(spark, ids.canonical_origin(F.lit("https://old.io/"), moved), ids.canonical_origin(F.lit("https://old.io/")), ids.canonical_origin(F.lit("https://x.io"), moved))) == ("https://new.io", "https://old.io", "https://x.io")


def test_money(spark):
    s, i = (lambda x: F.lit(x).cast("string")), (lambda x: F.lit(x).cast("int"))
    usd = lambda a, d=None, t=None, c=None: money.base_units_to_usd(s(a), i(d), s(t), s(c))
    assert tuple(one(spark, usd("1000", t=USDC), usd("5", c="usd"), usd("1000000", d=6), usd(None), usd("1.5"), usd("1000", c=USDC), usd("7"))) == (0.001, 0.05, 1.0, None, None, 0.001, 0.000007)
    assert tuple(one(spark, money.amount_hint(s("$0.20/page")), money.amount_hint(s("$ 3")), money.amount_hint(s("free")), money.amount_hint(s(None)))) == (0.2, 3.0, None, None)


def test_offers(spark):
    offer = lambda m, a, c: F.struct(F.lit("charge").alias("intent"), F.lit(m).alias("method"), F.lit(a).cast("string").alias("amount"), F.lit(c).cast("string").alias("currency"), F.lit(None).cast("string").alias("description"))
    row = one(spark, money.cheapest(F.array(offer("stripe", "5", "usd"), offer("evm", "50000", USDC), offer("x402", None, None))), money.rails(F.array(offer("stripe", "5", "usd"), offer("EVM", "1", None))))
    assert (row[0]["price"], row[0]["pos"], row[0]["currency"]) == (0.05, 0, "usd") and row[1] == ["x402", "mpp"]


def test_texts(spark):
    t = text.embed_text(F.lit("Start the Apify actor $0.01 pay-per-call"), F.lit("no API key required; 5 USDC weather"), F.lit("/v1/fx"), F.array(F.lit("city")))
    got = one(spark, t, text.search_text(F.lit(" A  b"), F.lit(""), F.lit("C")), text.token_estimate(F.lit("abcdefghij")))
    assert got[0] == "actor ; weather /v1/fx city" and got[1] == "a b c" and got[2] == 3


def test_tokens(spark):
    row = one(spark, text.bind_tokens(F.lit("Getting exchange rates for the prices")), text.query_tokens(F.lit("find the weather weather in Paris")), text.search_tokens(F.lit("What's x.y_z-1 of a Town")), text.intent_id_tokens(F.lit("finance.exchange_rates.live")))
    assert row[0] == ["gett", "exchange", "rat", "pric"] and row[1] == ["weather", "paris"] and row[2] == ["x.y_z-1", "of", "town"] and row[3] == ["exchange", "rates"]
    stems = {"cities": "city", "addresses": "address", "running": "runn", "boxes": "box", "cats": "cats", "towns": "town", "glass": "glass", "used": "used", "ring": "ring"}
    assert list(one(spark, *[text.stem(F.lit(k)) for k in stems])) == list(stems.values())


@pytest.mark.parametrize("finding,want", [("office in Los Angeles, CA now", {("Place", "Los Angeles, CA")}), ("see www.acme.com", {("Domain", "www.acme.com"), ("Company", "Acme")}), ("nothing here", set())])
def test_held_entities(spark, finding, want):
    assert {tuple(x) for x in one(spark, text.held_entities(F.lit(finding)))[0]} == want


def test_facets(spark):
    c = facets.endpoint_corpus(F.lit("/v1/fx"), F.lit("Exchange rate of a currency"), F.lit("json history"), F.array(F.lit("base")), F.lit(None).cast("string"))
    f = one(spark, facets.endpoint_facets(c, F.lit(None).cast("string")), facets.endpoint_facets(c, F.lit("GOV")), facets.query_facets(F.lit("cheapest airpods, on sale near me")))
    assert (f[0]["domain"], f[0]["primary_entity"], f[0]["output_entity"], f[0]["modality"]) == ("finance", "Currency", "MarketQuote", ["timeseries", "json"])
    assert f[1]["domain"] == "gov" and f[2]["domain"] == "maps" and f[2]["output_entity"] == "PriceSignal"


def test_boundaries_are_ascii(spark):
    assert tuple(one(spark, matches(F.lit("für"), r"\bf\b"), matches(F.lit("a f b"), r"\bf\b"), matches(F.lit("f_b"), r"\bf\b"))) == (True, True, False)
