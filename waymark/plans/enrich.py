"""Workload B: facets, gate, mirrors, materialized intents and host breadth of an endpoint table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.facets import endpoint_corpus, endpoint_facets
from ..operators.gate import dedupe_mirrors, passing
from ..operators.rank import materialize, with_breadth
from ..storage import saved


@dataclass
class Catalog:
    endpoints: DataFrame
    intents: DataFrame
    refs: DataFrame


def with_facets(endpoints: DataFrame) -> DataFrame:
    """``endpoints`` with derived facets; authored ones stay."""
    c = F.col
    f = endpoint_facets(endpoint_corpus(c("path"), c("summary"), c("description"), c("inputs"), c("category")), c("category"))
    none = F.lit(None).cast("string")
    whole = F.struct(f["domain"].alias("domain"), none.alias("action"), f["primary_entity"].alias("primary_entity"), f["output_entity"].alias("output_entity"), f["modality"].alias("modality"), F.lit(False).alias("authored"))
    return endpoints.withColumn("facets", F.coalesce(F.col("facets"), whole) if "facets" in endpoints.columns else whole)


def enrich(endpoints: DataFrame, intents: DataFrame) -> Catalog:
    """Gate before the mirrors' shuffle, then materialize the intents once and give hosts their breadth."""
    clean = saved(dedupe_mirrors(passing(with_facets(endpoints))), "enriched")
    refs = saved(materialize(clean, intents), "refs")
    return Catalog(with_breadth(clean, refs), intents, refs)
