"""Workload A: landed registry dumps and OpenAPI documents into one gated endpoint table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.gate import passing
from ..operators.merge import carry_forward, first_source, origin_sources, override
from ..schemas import ENDPOINT
from ..sources.openapi import parse_openapi
from ..sources.registry import clean_snapshot, provider_origins, resources_to_endpoints, service_origins, services_to_endpoints


def shaped(rows: DataFrame) -> DataFrame:
    """``rows`` with every declared column and field, those they lack as nulls; columns of their own stay."""
    return rows.sparkSession.createDataFrame([], ENDPOINT).unionByName(rows, allowMissingColumns=True)


def build_catalog(resources: DataFrame, services: DataFrame, providers: DataFrame, docs: DataFrame, prior: DataFrame | None, built_at: str) -> DataFrame:
    """Inline rows by source order, OpenAPI rows in place of their origins', prior rows of unseen origins, then the gate."""
    a = resources_to_endpoints(resources, built_at).withColumn("source", F.lit("bazaar"))
    b = services_to_endpoints(services, built_at).withColumn("source", F.lit("mpp"))
    # ties inside a source: the first by id
    rows = shaped(a).unionByName(shaped(b)).withColumn("ep_ord", F.xxhash64("id", "summary"))
    inline = first_source(rows)
    named = inline.select("origin", "source").union(service_origins(services).select("origin", F.lit("mpp"))).union(provider_origins(providers).select("origin", F.lit("paysh")))
    merged = override(inline, shaped(parse_openapi(docs, built_at)), origin_sources(named))
    if prior is not None:
        merged = carry_forward(merged, prior, F.lit(built_at))
    return passing(merged)


def regate(snapshot: DataFrame) -> DataFrame:
    """A saved snapshot's rows without what an earlier gate noted on them, gated anew."""
    return passing(clean_snapshot(snapshot))


def numbered(endpoints: DataFrame) -> DataFrame:
    """``endpoints`` with ``ep_ord``, a unique number in order of id within their hash part; no global sort."""
    parts = endpoints.withColumn("__p", F.pmod(F.xxhash64("id"), F.lit(4096)))
    n = F.row_number().over(Window.partitionBy("__p").orderBy("id"))
    return parts.withColumn("ep_ord", F.col("__p") * F.lit(1 << 40) + n).drop("__p")
