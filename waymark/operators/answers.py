"""What a request for an intent is told: its best endpoints and the intents related to its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import related_options
from .rank import resolve


def answers(asks: DataFrame, refs: DataFrame, endpoints: DataFrame, intents: DataFrame, links: DataFrame, best: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, intent_id, kind, rank, target, price_usd, inputs, rails, relation) of each (query_id, intent_id, query) ask.

    An endpoint's target is METHOD and URL, an option's its intent. ``best`` (intent_id, id) names each intent's
    endpoint. An unknown intent has no rows.
    """
    c = F.col
    url = F.concat("method", F.lit(" "), "origin", "path")
    found = resolve(asks, refs, endpoints, intents, k).select(
        "query_id", "intent_id", F.lit("endpoint").alias("kind"), "rank", url.alias("target"), "price_usd", "inputs", "rails",
        F.lit(None).cast("string").alias("relation"),
    )
    near = related_options(links, intents, best).select("intent_id", "rank", "target", c("relation_label").alias("relation"))
    none = F.array().cast("array<string>")
    options = asks.select("query_id", "intent_id").distinct().join(F.broadcast(near), "intent_id")  # pairs of the vocabulary
    return found.union(options.select(
        "query_id", "intent_id", F.lit("related").alias("kind"), "rank", "target", F.lit(None).cast("double").alias("price_usd"),
        none.alias("inputs"), none.alias("rails"), "relation",
    ))
