"""Keys and addresses of endpoints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import map_of

#: Origins that moved, old to new; a deployment fills in its own.
ORIGIN_ALIASES: dict[str, str] = {}

HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")


def bare_origin(origin: Column) -> Column:
    return F.regexp_replace(origin, "/$", "")


def rooted(path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def endpoint_key(origin: Column, method: Column, path: Column) -> Column:
    """origin|METHOD|path, the path as it is."""
    return F.concat_ws("|", bare_origin(origin), F.upper(method), path)


def endpoint_id(origin: Column, method: Column, path: Column) -> Column:
    """SHA-256 of origin|METHOD|/path."""
    return F.sha2(F.concat_ws("|", bare_origin(origin), F.upper(method), rooted(path)), 256)


def canonical_origin(url: Column, aliases: dict[str, str] | None = None) -> Column:
    """An origin without its closing slash, or what it moved to."""
    bare, known = bare_origin(url), ORIGIN_ALIASES if aliases is None else aliases
    return F.coalesce(F.element_at(map_of(known), bare), bare) if known else bare


def url_origin(url: Column) -> Column:
    """scheme://host[:port] of a URL, null for what is none; host in lower case, default ports left out."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    port = F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), r":(\d+)$", 1)
    default = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    shown = F.when((port == "") | default, "").otherwise(F.concat(F.lit(":"), port))
    return F.concat(scheme, F.lit("://"), F.lower(F.try_parse_url(url, F.lit("HOST"))), shown)


def url_path(url: Column) -> Column:
    """Path of a URL, at least a slash; null for what is none."""
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.when(path == "", "/").otherwise(path)


def canonical_url(url: Column) -> Column:
    """origin + path + query of a URL, under its canonical origin; what is no URL stays as it is."""
    query = F.try_parse_url(url, F.lit("QUERY"))
    return F.coalesce(F.concat(canonical_origin(url_origin(url)), url_path(url), F.coalesce(F.concat(F.lit("?"), query), F.lit(""))), url)


def host_of(origin: Column) -> Column:
    """What stands after the scheme, up to the first slash."""
    return F.regexp_extract(F.regexp_replace(origin, "^https?://", ""), "^([^/]*)", 1)


def bare_host(origin: Column) -> Column:
    return F.regexp_replace(host_of(F.lower(origin)), r"^www\.", "")


def http_method(raw: Column) -> Column:
    """An HTTP method in capitals; POST for a missing or unknown one."""
    m = F.upper(raw)
    return F.when(m.isin(*HTTP_METHODS), m).otherwise("POST")


def resource_parts(url: Column, method: Column) -> Column:
    """(origin, method, path) of a resource URL, null for what is none."""
    parts = F.struct(canonical_origin(url_origin(url)).alias("origin"), F.upper(F.coalesce(method, F.lit("GET"))).alias("method"), url_path(url).alias("path"))
    return F.when(url_origin(url).isNotNull(), parts)
