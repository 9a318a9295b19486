"""Texts and tokens of endpoints, intents and queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import ascii_words, some, squeeze

#: Boilerplate that is cut from a text before it is embedded.
BOILERPLATE = (
    r"\$[ \t\n\r]?\d[\d.,]*",
    r"(?i)\b\d+(?:\.\d+)?[ \t\n\r]*usdc?\b",
    r"(?i)\bpay[ \t\n\r-]?per[ \t\n\r-]?(?:result|call|request|use)\b",
    r"(?i)\b(?:x402|mpp|micro[ \t\n\r-]?payments?)\b",
    r"(?i)\bno[ \t\n\r]+api[ \t\n\r-]?key[ \t\n\r]+(?:required|needed)?\b",
    r"(?i)\bwithout[ \t\n\r]+login\b",
    r"(?i)\bapify\b",
    r"(?i)\b(?:start|run|invoke)[ \t\n\r]+the\b",
)

#: Words that tokens leave out, for binding, for keyword search and for resolving.
BIND_STOP = tuple(
    "the a an and or of to for in on with by from get post put delete api key data your you this that is are be use using paid endpoint service via per call return returns request response price token usd usdc x402 mpp http https www com io app dev net org based one all any can will".split()
)
SEARCH_STOP = tuple("the and for with from that this your need want via what whats is are be am was were".split())
QUERY_STOP = tuple(
    (
        "the and for with from this that you your what are how get give need want find into out now can should would could please tell show make have "
        "use let know any some one all than then they api current today new app via using per data info service request response returns return will live real"
    ).split()
)


def search_text(*parts: Column) -> Column:
    """Parts that are not empty, joined, in lower case, blanks squeezed."""
    return squeeze(F.lower(F.concat_ws(" ", *[some(p) for p in parts])))


def embed_text(summary: Column, description: Column, path: Column, inputs: Column) -> Column:
    """The text that an endpoint is embedded and tokenized as, without boilerplate or origin."""
    out = F.concat_ws(" ", some(summary), some(description), some(path), F.filter(F.coalesce(inputs, F.array().cast("array<string>")), lambda x: x != ""))
    for p in BOILERPLATE:
        out = F.regexp_replace(out, ascii_words(p), " ")
    return squeeze(out)


def intent_text(i: dict[str, Column]) -> Column:
    """The text that an intent is embedded as, from its columns by name; a missing one adds nothing."""
    entities = lambda ports: F.transform(ports, lambda p: p["entity"])
    parts = [F.translate(i["id"], "._", "  "), i.get("label"), i.get("description"), i.get("aliases"), i.get("schema_org"), i.get("domain"), i.get("action")]
    parts += [entities(i[k]) for k in ("consumes", "produces") if k in i] + [i.get("modality")]
    return F.concat_ws(" ", *[p for p in parts if p is not None])


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 in lower case."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda t: t != "")


def bind_tokens(text: Column) -> Column:
    """Tokens for binding: over two letters, not a stop word, one ending cut, still over two letters."""
    kept = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0)), lambda t: ~t.isin(*BIND_STOP))
    less = lambda t, n: F.left(t, F.length(t) - n)
    cut = lambda t: F.when(t.endswith("ing"), less(t, 3)).when(t.endswith("ed") | t.endswith("es"), less(t, 2)).when(t.endswith("s"), less(t, 1)).otherwise(t)
    return F.filter(F.transform(kept, cut), lambda t: F.length(t) > 2)


def search_tokens(text: Column) -> Column:
    """Tokens for keyword search: dots, underscores and hyphens stay, over one letter, not a stop word."""
    split = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9._ \t\n\r\f\x0B-]", " "), r"[ \t\n\r\f\x0B]+")
    return F.filter(split, lambda t: (F.length(t) > 1) & ~t.isin(*SEARCH_STOP))


def stem(t: Column) -> Column:
    """A token without its plural or verb ending."""
    n = F.length(t)
    cut = lambda k: F.left(t, n - k)
    return (
        F.when(n <= 4, t)
        .when(t.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(t.endswith("sses"), cut(2))
        .when(t.endswith("ing") & (n > 5), cut(3))
        .when(t.endswith("ed"), cut(2))
        .when(t.endswith("es"), cut(2))
        .when(t.endswith("s") & ~t.endswith("ss"), cut(1))
        .otherwise(t)
    )


def query_tokens(text: Column) -> Column:
    """Distinct tokens for resolving: over two letters, not a stop word."""
    return F.array_distinct(F.filter(words(text), lambda t: (F.length(t) > 2) & ~t.isin(*QUERY_STOP)))


def intent_id_tokens(intent_id: Column) -> Column:
    """Query tokens of an intent's id without its domain."""
    return query_tokens(F.concat_ws(" ", F.slice(F.split(intent_id, r"\."), 2, 1000)))


def intent_vocab_tokens(label: Column, aliases: Column) -> Column:
    return query_tokens(F.concat_ws(" ", label, aliases))


def token_estimate(text: Column) -> Column:
    """Tokens of a payload: a quarter of its characters, halves rounded up."""
    return F.floor(F.length(text) / 4 + 0.5).cast("long")


#: How a domain name and a "City, ST" place look, and entities that findings may not name.
DOMAIN_NAME = r"(?i)\b([a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}\b"
PLACE_NAME = r"\b([A-Z][a-z]+(?:[ \t\n\r]+[A-Z][a-z]+)*),[ \t\n\r]*([A-Z]{2})\b"
FORBIDDEN_ENTITIES = ("Query", "StructuredRecord", "NamedEntity", "Org")


def held_entities(finding: Column) -> Column:
    """Entities that a finding's text names: array of (entity, value), distinct by value in lower case."""
    domain = F.lower(F.regexp_extract(finding, ascii_words(DOMAIN_NAME), 0))
    root = F.element_at(F.split(F.regexp_replace(domain, r"^www\.", ""), r"\."), 1)
    place = F.concat(F.regexp_extract(finding, ascii_words(PLACE_NAME), 1), F.lit(", "), F.regexp_extract(finding, ascii_words(PLACE_NAME), 2))
    pair = lambda e, v: F.struct(F.lit(e).alias("entity"), v.alias("value"))
    found = F.array(
        F.when(domain != "", pair("Domain", domain)),
        F.when(F.length(root) > 1, pair("Company", F.concat(F.upper(F.left(root, F.lit(1))), F.substring(root, 2, 1 << 30)))),
        F.when(place != ", ", pair("Place", place)),
    )
    return F.filter(found, lambda x: x.isNotNull())


def source_entities(explicit: Column, finding: Column, produced: Column) -> Column:
    """(entity, value, method, confidence): those given (forbidden types dropped), else the text's, else what the intent produces."""
    tag = lambda a, method, confidence: F.transform(a, lambda x: F.struct(x["entity"].alias("entity"), x["value"].alias("value"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence")))
    given = F.filter(F.coalesce(explicit, F.array().cast("array<struct<entity:string,value:string>>")), lambda x: ~x["entity"].isin(*FORBIDDEN_ENTITIES))
    text = held_entities(F.coalesce(finding, F.lit("")))
    made = F.transform(F.coalesce(produced, F.array().cast("array<string>")), lambda e: F.struct(e.alias("entity"), F.lit(None).cast("string").alias("value")))
    return F.when(F.size(given) > 0, tag(given, "explicit", "high")).when(F.size(text) > 0, tag(text, "heuristic", "medium")).otherwise(tag(made, "intent_produces", "low"))
