"""All keyword hits: the same by blocks, by joins and by a plain loop, and without a shuffle of hits."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import blocks, search


def tables(spark):
    rng = random.Random(5)
    words = "search searching cats city cities page webpage webpages market marketplace exchange ex.change rate rates the".split()
    text = lambda n: " ".join(rng.choice(words[: rng.randrange(1, len(words) + 1)]) for _ in range(rng.randrange(n)))
    rows = [(f"e{k}", k, rng.choice(["authenticate now", "x", None]), rng.choice([True, False, None]), (rng.choice([None, 1.0]),), rng.choice([text(9), text(9), None])) for k in range(150)]
    e = spark.createDataFrame(rows, "id string, ep_ord int, summary string, guidance_available boolean, payment struct<price_usd:double>, search_text string").repartition(3)
    q = spark.createDataFrame([(f"q{k}", text(6)) for k in range(25)] + [("none", None), ("stop", "the of"), ("twice", "webpages webpages rate")], "query_id string, query string")
    return q, e


def by_joins(q, e):
    own = e.select("id", "ep_ord", search.hit_factor().alias("factor"))
    hits = search.token_scores(q, e.select("id", F.col("search_text").alias("text")), "id").join(own, "id")
    return {(r["query_id"], r["id"], r["ep_ord"], r["score"]) for r in hits.withColumn("score", F.round(F.col("token_score") * F.col("factor"), 9)).collect()}


@pytest.mark.parametrize("bytes_", [400, 4_000_000])
def test_hits_by_blocks_and_joins(spark, bytes_, monkeypatch):
    monkeypatch.setattr(blocks, "QUERY_BYTES", bytes_)
    q, e = tables(spark)
    out = search.keyword_endpoints(q, e)
    assert out.dtypes == [("query_id", "string"), ("id", "string"), ("score", "double"), ("ep_ord", "int")]
    got = [(r["query_id"], r["id"], r["ep_ord"], round(r["score"], 9)) for r in out.collect()]
    assert len(got) == len(set(got)) > 500 and set(got) == by_joins(q, e)
    assert search.keyword_endpoints(q.limit(0), e).count() == search.keyword_endpoints(q, e.limit(0)).count() == 0


@pytest.mark.parametrize("products", [1, 700])
def test_hits_in_parts_of_a_batch(spark, products, monkeypatch):
    monkeypatch.setattr(blocks, "PRODUCTS", products)
    q, e = tables(spark)
    tokens, own = search.search_tokens(F.col("query")), search.search_tokens(F.col("search_text"))
    kernel = blocks.Hits(q.select("query_id", tokens.alias("tokens"), F.transform(tokens, search.stem).alias("stems")).toArrow())
    rows = e.where(F.size(own) > 0).select("id", "ep_ord", own.alias("tokens"), F.transform(own, search.stem).alias("stems"), search.hit_factor().alias("factor")).toArrow()
    batches = [b.slice(3, 40) for b in rows.to_batches()] + [b.slice(0, 3) for b in rows.to_batches()] + [b.slice(43) for b in rows.to_batches()]
    got = [(h["query_id"], r["id"], r["ep_ord"], round(h["score"], 9)) for b in batches for part in kernel.add(b) for r in part.to_pylist() for h in r["hits"]]
    assert len(got) == len(set(got)) and set(got) == by_joins(q, e)


def test_hits_are_made_where_endpoints_lie(spark):
    q, e = tables(spark)
    plan = search.keyword_endpoints(q, e)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan  # what deals the test's own rows
