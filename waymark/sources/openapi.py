"""OpenAPI documents as endpoint rows: references are recursive, so the documents are walked in Python, batch by batch.

Documents are foreign. What can't be read is told in a table of rejects beside the rows, with the place where it went wrong,
and never ends a job: an operation of an odd shape is left out alone, a document that is unreadable as a whole. Spark sends
documents in batches of at most 64 MB, and rows go back by the thousand.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import canonical_origin, endpoint_id
from ..functions.money import cheapest
from ..functions.money import rails as rails_of
from ..functions.text import search_text
from ..storage import saved

LONGEST, SUMMARY, GUIDANCE, DEPTH = 2_000_000, 120, 500, 6
METHODS = ("get", "post", "put", "patch", "delete", "head", "options")
MPP_METHODS = ("tempo", "mpp", "stripe", "card", "lightning", "solana")
OFFER_KEYS = {"intent", "method", "amount", "currency", "description"}


def given(x) -> bool:
    """Whether a JSON value counts as there: empty objects and lists do, null, false, zero and empty texts don't."""
    return isinstance(x, (dict, list)) or bool(x)


def resolve(doc: dict, ref: str):
    """What a local reference points at, if that is an object."""
    if not ref.startswith("#/"):
        return None
    at = doc
    for part in ref[2:].split("/"):
        if not isinstance(at, dict):
            return None
        at = at.get(unquote(part))
    return at if isinstance(at, dict) else None


class Odd(Exception):
    """A value that isn't of the shape that its place wants."""

    def __init__(self, reason: str, *pointer: str):
        super().__init__(reason)
        self.pointer = "".join(f"/{p.replace('~', '~0').replace('/', '~1')}" for p in pointer)


def shaped(holder: dict, key: str, kind: type, *pointer: str):
    """A value of a kind, or an empty one where it is missing or null."""
    value = holder.get(key)
    if value is None:
        return kind()
    if not isinstance(value, kind):
        raise Odd(f"not {'a list' if kind is list else 'an object'}", *pointer, key)
    return value


def property_names(doc: dict, schema, depth: int = 0, known: dict | None = None) -> list[str]:
    """Property names of a schema, through references, combinations and items, in order.

    ``known`` remembers what references give at a depth: schemas that fan out into each other are walked once."""
    if not isinstance(schema, dict) or depth > DEPTH:
        return []
    known = {} if known is None else known
    if isinstance(ref := schema.get("$ref"), str):
        if (ref, depth) not in known:
            known[ref, depth] = property_names(doc, resolve(doc, ref), depth + 1, known)
        return known[ref, depth]
    names = dict.fromkeys(schema["properties"]) if isinstance(schema.get("properties"), dict) else {}
    below = [s for key in ("allOf", "oneOf", "anyOf") if isinstance(schema.get(key), list) for s in schema[key]] + [schema.get("items")]
    for s in below:
        names.update(dict.fromkeys(property_names(doc, s, depth + 1, known)))
    return list(names)


def input_names(op: dict, doc: dict, known: dict | None = None, pointer: tuple[str, ...] = ()) -> list[str]:
    """Names of an operation's parameters and of its body's properties, of every content type."""
    names: dict[str, None] = {}
    for p in shaped(op, "parameters", list, *pointer):
        if isinstance(p, dict):
            p = (resolve(doc, p["$ref"]) or p) if isinstance(p.get("$ref"), str) else p
            if isinstance(p.get("name"), str):
                names[p["name"]] = None
    body = op.get("requestBody")
    if isinstance(body, dict) and isinstance(body.get("$ref"), str):
        body = resolve(doc, body["$ref"])
    content = shaped(body, "content", dict, *pointer, "requestBody") if isinstance(body, dict) else {}
    for media in content.values():
        names.update(dict.fromkeys(property_names(doc, media.get("schema") if isinstance(media, dict) else None, 0, known)))
    return list(names)


def valid_offers(raw) -> list[dict]:
    """One offer, or those of ``offers``, if all are of the declared form; else none."""
    if not isinstance(raw, dict):
        return []
    offers = raw["offers"] if set(raw) == {"offers"} else [raw]
    if not isinstance(offers, list) or not offers:
        return []
    for o in offers:
        if not isinstance(o, dict) or set(o) - OFFER_KEYS or o.get("intent") not in ("charge", "session") or not isinstance(o.get("method"), str) or "amount" not in o:
            return []
        a = o["amount"]
        if a is not None and not (isinstance(a, str) and a.isascii() and a.isdigit() and (a == "0" or a[0] != "0")):
            return []
        if any(k in o and not isinstance(o[k], str) for k in ("currency", "description")):
            return []
    return [{k: o.get(k) for k in ("intent", "method", "amount", "currency", "description")} for o in offers]


_DECIMAL = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", re.ASCII)


def _number(x) -> float | None:
    """A finite number, or a text that writes one (none but blanks: zero)."""
    if isinstance(x, str):
        x = x.strip(" \t\n\r\f\v")
        if x and not _DECIMAL.fullmatch(x):
            return None
    elif not isinstance(x, (bool, int, float)):
        return None
    try:
        n = float(x or 0)
    except OverflowError:
        return None
    return n if math.isfinite(n) else None


def _scaled(amount: float, decimals: float) -> float:
    """An amount of base units; more decimals than a double holds leave nothing of it."""
    try:
        n = amount / 10.0**decimals
    except (OverflowError, ZeroDivisionError):
        return 0.0 if decimals > 0 else math.inf
    return n


def _at(x, *path):
    """A nested value, or None where the path leaves what is there."""
    for p in path:
        if isinstance(p, int):
            x = x[p] if isinstance(x, list) and len(x) > p else None
        else:
            x = x.get(p) if isinstance(x, dict) else None
    return x


def legacy_price(op: dict) -> float | None:
    """USD of forms from before offers: the first that gives a number."""
    info = op.get("x-payment-info")
    first, raw = _at(info, "offers", 0), _number(_at(info, "offers", 0, "amount"))
    if raw is not None:
        decimals = 6.0 if _at(first, "decimals") is None else _number(first["decimals"])
        if decimals is not None and math.isfinite(n := _scaled(raw, decimals)):
            return n
    if (n := _number(_at(info, "price", "amount"))) is not None:
        return n
    if (n := _number(_at(info, "amount"))) is not None and n > 100:
        return n / 1_000_000
    rates = _at(op, "x-faremeter-pricing", "rates")
    if isinstance(rates, dict) and given(rate := next(iter(rates.values()), None)) and (n := _number(rate)) is not None:
        return n / 1_000_000
    return _number(_at(op, "pricing", "dimensions", 0, "tiers", 0, "price_usd"))


def legacy_rails(doc: dict, op: dict, pointer: tuple[str, ...] = ()) -> list[dict]:
    """Payment protocols of forms from before offers; x402 where nothing says otherwise."""
    info = op.get("x-payment-info") if isinstance(op.get("x-payment-info"), dict) else {}
    at = (*pointer, "x-payment-info")
    assets = [a for a in shaped(doc, "x-faremeter-assets", dict).values() if isinstance(a, dict)]
    protocols = shaped(info, "protocols", list, *at)
    named = [p for p in protocols if isinstance(p, dict)]
    methods = {str(m.get("method", "")) for m in shaped(info, "offers", list, *at) if isinstance(m, dict)}
    tempo = any(isinstance(m, dict) and m.get("method") == "tempo" for m in shaped(info, "methods", list, *at))
    chains = [str(a["chain"]) for a in assets if a.get("chain")]
    on = [n for p in named for n, keys in (("x402", ("x402",)), ("tempo", ("mpp", "tempo"))) if any(given(p.get(k)) for k in keys)]
    networks = list(dict.fromkeys(chains + on + ["tempo"] * tempo))
    x402 = "x402" in [p for p in protocols if isinstance(p, str)] or "x402" in on or bool(methods & {"x402", "evm"}) or bool(assets)
    mpp = "tempo" in on or bool(methods & set(MPP_METHODS)) or tempo or "tempo" in chains or info.get("method") in ("tempo", "stripe")
    out = [{"protocol": "x402", "version": "2", "networks": [n for n in networks if n != "tempo"]}] if x402 else []
    out += [{"protocol": "mpp", "version": None, "networks": ["tempo"] if "tempo" in networks else None}] if mpp else []
    return out or [{"protocol": "x402", "version": "2", "networks": None}]


# The documents that a service extension names, and how their addresses begin.
SERVICE_DOCS = ("apiReference", "homepage", "llms")
ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:\S+")


def service_info(raw) -> tuple[list[str], dict[str, str] | None]:
    """Categories and named documents of a service extension; nothing of one whose shape is wrong anywhere."""
    if not isinstance(raw, dict):
        return [], None
    categories, docs = raw.get("categories", []), raw.get("docs", {})
    if not isinstance(categories, list) or not isinstance(docs, dict) or not all(isinstance(c, str) for c in categories):
        return [], None
    named = {k: docs[k] for k in SERVICE_DOCS if k in docs}
    if not all(isinstance(v, str) and ADDRESS.fullmatch(v) for v in named.values()):
        return [], None
    return categories, named or None


_LONE = re.compile("[\ud800-\udfff]")


def _clean(x):
    """A row's value without halves of surrogate pairs, which no encoding has."""
    if isinstance(x, str):
        return _LONE.sub("\ufffd", x)
    if isinstance(x, dict):
        return {_clean(k): _clean(v) for k, v in x.items()}
    return [_clean(v) for v in x] if isinstance(x, list) else x


def _document(text: str | None) -> dict:
    """A document that has paths, or what is wrong with it as a whole."""
    if not text:
        raise Odd("empty")
    if len(text) > LONGEST:
        raise Odd(f"over {LONGEST} characters")
    try:
        doc = json.loads(text)
    except RecursionError:
        raise Odd("nested too deeply") from None
    except ValueError:
        raise Odd("not JSON") from None
    if not isinstance(doc, dict):
        raise Odd("not an object")
    if not isinstance(doc.get("paths"), dict):
        raise Odd("no paths", "paths")
    return doc


def _text(x) -> str | None:
    return x if isinstance(x, str) else None


def operation(doc: dict, origin: str | None, path: str, method: str, op: dict, known: dict) -> dict:
    """The raw row of an operation; :class:`Odd` where a part of it isn't of its shape."""
    at = ("paths", path, method)
    info = doc.get("info") if isinstance(doc.get("info"), dict) else {}
    guidance = next((info[k] for k in ("x-agent-guidance", "x-guidance", "guidance") if info.get(k) is not None), None)
    categories, named = service_info(doc.get("x-service-info"))
    about = _text(op.get("description"))
    offers = valid_offers(op.get("x-payment-info"))
    paid = bool(offers) or any(given(op.get(k)) for k in ("x-payment-info", "x-faremeter-pricing", "pricing"))
    responses = op.get("responses") if isinstance(op.get("responses"), dict) else {}
    return {
        "origin": origin or _text(_at(doc, "servers", 0, "url")) or "https://unknown.invalid", "method": method.upper(), "path": path, "operation_id": _text(op.get("operationId")),
        "summary": _text(op.get("summary")) or (about or "")[:SUMMARY] or f"{method.upper()} {path}", "description": about,
        "tags": [t for t in shaped(op, "tags", list, *at) if isinstance(t, str)], "inputs": input_names(op, doc, known, at), "offers": offers, "paid": paid,
        "old_price": legacy_price(op) if paid else None, "old_rails": legacy_rails(doc, op, at) if paid else [], "has200": given(responses.get("200")), "has402": given(responses.get("402")),
        "body": given(op.get("requestBody")), "title": _text(info.get("title")), "about": _text(info.get("description")), "guidance": guidance if guidance is None else str(guidance)[:GUIDANCE],
        "categories": categories, "docs": named,
    }


def operations(origin: str | None, text: str | None) -> Iterator[dict]:
    """Raw rows of a document's operations, and rejects (reason, pointer) of what gives none: once for each place."""
    told: set[str] = set()

    def reject(e: Exception) -> Iterator[dict]:
        reason, pointer = (str(e), e.pointer) if isinstance(e, Odd) else (type(e).__name__, "")
        if pointer not in told:
            told.add(pointer)
            yield {"origin": origin, "reason": reason, "pointer": _clean(pointer)}

    try:
        doc = _document(text)
    except Odd as e:
        yield from reject(e)
        return
    known: dict = {}
    for path, item in doc["paths"].items():
        for method, op in (item.items() if isinstance(item, dict) else ()):
            if method in METHODS and isinstance(op, dict):
                try:
                    yield {k: _clean(v) for k, v in operation(doc, origin, path, method, op, known).items()}
                except (Odd, ArithmeticError, AttributeError, KeyError, RecursionError, TypeError, ValueError) as e:
                    yield from reject(e)


RAW = (
    "origin string, method string, path string, operation_id string, summary string, description string, tags array<string>, inputs array<string>, "
    "offers array<struct<intent:string,method:string,amount:string,currency:string,description:string>>, paid boolean, old_price double, "
    "old_rails array<struct<protocol:string,version:string,networks:array<string>>>, has200 boolean, has402 boolean, body boolean, title string, about string, guidance string, categories array<string>, docs map<string,string>, reason string, pointer string"
)
#: Rows that go back to Spark at once.
ROWS = 1000


def _raw(docs: DataFrame) -> DataFrame:
    """Raw rows, and rejects, which have a reason."""
    names = [c.split()[0] for c in RAW.replace("<", " <").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[dict] = []
            for origin, doc in zip(b["origin"], b["doc"]):
                rows += ({n: r.get(n) for n in names} for r in operations(origin, doc))
                while len(rows) >= ROWS:
                    yield pd.DataFrame(rows[:ROWS], columns=names)
                    rows = rows[ROWS:]
            yield pd.DataFrame(rows, columns=names)

    return docs.select("origin", "doc").mapInPandas(run, RAW)


def read_openapi(docs: DataFrame, built_at: str) -> tuple[DataFrame, DataFrame]:
    """(endpoint rows, rejects) of documents (origin, doc), which are walked once.

    A row for each path and HTTP method. Rejects (origin, reason, pointer) are operations of an odd shape, and documents that are
    unreadable as a whole, empty, over ``LONGEST`` characters or without paths; ``pointer`` is the JSON pointer of what is odd."""
    raw = saved(_raw(docs), "openapi-raw")
    return _endpoints(raw.where("reason IS NULL"), built_at), raw.where("reason IS NOT NULL").select("origin", "reason", "pointer")


def parse_openapi(docs: DataFrame, built_at: str) -> DataFrame:
    """Endpoint rows of documents (origin, doc): one for each path and HTTP method. See :func:`read_openapi` for what gives none."""
    return _endpoints(_raw(docs).where("reason IS NULL"), built_at)


def _endpoints(raw: DataFrame, built_at: str) -> DataFrame:
    raw = raw.withColumn("origin", canonical_origin(F.col("origin")))
    best = cheapest(F.col("offers"))
    has = F.size("offers") > 0
    null = F.lit(None)
    of_offers = F.transform(rails_of(F.col("offers")), lambda p: F.struct(p.alias("protocol"), F.when(p == "x402", "2").alias("version"), null.cast("array<string>").alias("networks")))
    payment = F.struct(
        F.when(F.col("paid"), F.coalesce(F.when(has, best["price"]), F.col("old_price"))).alias("price_usd"), F.col("paid").alias("paid"), F.when(has, best["currency"]).alias("currency"),
        F.when(has, of_offers).when(F.col("paid"), F.col("old_rails")).otherwise(F.array().cast("array<struct<protocol:string,version:string,networks:array<string>>>")).alias("rails"), F.col("offers").alias("offers"),
    )
    text = search_text(*[F.col(c) for c in ("title", "about", "summary", "description", "path")], F.array_join("tags", " "), F.col("guidance"))
    return raw.select(
        endpoint_id(F.col("origin"), F.col("method"), F.col("path")).alias("id"), "origin", "method", "path", "operation_id", "summary", "description", "tags", "inputs", payment.alias("payment"),
        F.struct("categories", "docs").alias("service"), F.struct("has200", "has402").alias("responses"),
        (F.col("paid") & F.col("method").isin("POST", "PUT", "PATCH") & ~F.col("body")).alias("schema_missing"), F.col("guidance").isNotNull().alias("guidance_available"),
        F.concat("origin", F.lit("/openapi.json")).alias("openapi_url"), text.alias("search_text"), F.lit(built_at).alias("built_at"),
    )
