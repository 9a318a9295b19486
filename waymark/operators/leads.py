"""Leads for findings: what a finding names, what it is about, and the intents that take it further."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import source_entities
from .followups import candidates, fill


def topical_scores(hits: DataFrame) -> DataFrame:
    """(query_id, intent_id, topic): each intent's score at its first place among search hits
    (query_id, rank, kind, capability_id, score); hits on endpoints don't count."""
    own = hits.where("kind = 'capability' AND capability_id IS NOT NULL")
    return own.groupBy("query_id", F.col("capability_id").alias("intent_id")).agg(F.min_by("score", "rank").alias("topic"))


def top_routed(hits: DataFrame) -> DataFrame:
    """(query_id, routed): the first intent among search hits."""
    own = hits.where("kind = 'capability' AND capability_id IS NOT NULL")
    return own.groupBy("query_id").agg(F.min_by("capability_id", "rank").alias("routed"))


def held_entities(findings: DataFrame, routed: DataFrame, intents: DataFrame) -> DataFrame:
    """(query_id, pos, entity, kind, source_intent, exclude, method) of ``findings`` (query_id, finding, given, intent_id,
    exclude): the entities given, else those the text names, else what the source intent produces.

    The source intent is the one given, else the top routed. A finding without any entity gives no rows.
    """
    made = intents.select(F.col("id").alias("source_intent"), F.transform("produces", lambda p: p["entity"]).alias("made"))
    own = findings.join(routed, "query_id", "left").withColumn("source_intent", F.coalesce("intent_id", "routed"))
    own = own.join(F.broadcast(made), "source_intent", "left")  # the vocabulary
    held = own.withColumn("e", source_entities(F.col("given"), F.col("finding"), F.col("made")))
    each = held.select("query_id", "source_intent", "exclude", F.posexplode("e").alias("pos", "x"))
    return each.select("query_id", "pos", "x.entity", F.lit("identity").alias("kind"), "source_intent", "exclude", "x.method")


def leads(findings: DataFrame, hits: DataFrame, intents: DataFrame, parents: DataFrame, entities: DataFrame, best: DataFrame, limit: int = 8) -> DataFrame:
    """(query_id, rank, intent_id, bridge, score): follow-ups of every finding, up to ``limit``.

    ``hits`` are the search hits of each finding's text, as many as topics should count. Findings that hold nothing, or
    nothing that an intent consumes, have no row.
    """
    held = held_entities(findings, top_routed(hits), intents)
    return fill(candidates(held.drop("method"), intents, parents, entities, best, topical_scores(hits)), limit=limit)
