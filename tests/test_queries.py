"""Every registered query of the library against its SQL on the smallest tables, and the plan of the flagship."""

import math
from collections import Counter

import duckdb
import pytest

from waymark.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each module's kinds; all of them run in the driver's own comparison.
CHECKED = ["endpoint_facets", "quality_gate", "document_mirrors", "materialized", "resolved", "bound", "keyword_search", "arm_guard", "inverse_links", "lateral_flow", "followups_pool", "registry_endpoints", "carried", "merged_records", "judged_precision", "agent_runs", "heldout", "multi_label", "probe_scores", "embedded_delta", "intent_texts", "payload_sizes", "floor_sweep", "endpoint_top_k", "classified",
           "searched", "answered", "resolved_by_facets", "finding_leads", "followups_filled", "folded_records", "entity_rollup", "domain_rollup",
           "grown_forward_flow", "grown_lateral_flow", "grown_consumers", "grown_entity_sets", "grown_subtypes", "grown_entity_rollup", "vector_intents",
           "found", "embedding_cache", "catalog_versions", "catalog_snapshot", "openapi_endpoints", "legacy_payments", "openapi_rejects", "keyword_top", "int8_top_k", "int8_reranked", "pair_cosines", "resolved_semantic", "sparse_cosines", "bound_catalog", "catalog_bind_report", "catalog_sweep", "bind_report",
           "regated", "merged_labels", "inferred_links", "service_documents"]


def norm(v):
    return (None if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_is_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == Counter(tuple(norm(r[k]) for k in at) for r in res.fetchall()) and got


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_followups_are_filled_in_one_native_stage(spark, sf):
    """The greedy fill is that of a plain loop over each pool, and no Python runs."""
    df = QUERIES["followups_filled"](spark, sf)
    assert "Pandas" not in df._jdf.queryExecution().executedPlan().toString()
    from waymark.operators import followups

    rows = [(q, f"i{(q * 7 + k * 3) % 11}", f"b{k % 4}", f"d{k % 5}", float(30 - k), 0.5, k) for q in range(20) for k in range(q + 1)]
    pool = spark.createDataFrame(rows, "query_id long, intent_id string, bridge string, domain string, score double, relevance double, ord int")
    want = []
    for q in range(20):
        chosen: list = []
        for r in [r for r in rows if r[0] == q]:
            room = len(chosen) < 8 and all(c[1] != r[1] for c in chosen)
            if room and sum(c[2] == r[2] for c in chosen) < 3 and sum(c[3] == r[3] for c in chosen) < 2:
                chosen.append(r)
        want += [(q, n + 1, r[1], r[2], r[4]) for n, r in enumerate(chosen)]
    assert sorted(map(tuple, followups.fill(pool).collect())) == want


@pytest.mark.parametrize("block", [300, 4_000_000])
def test_blocks_of_queries_find_the_same(spark, block, monkeypatch):
    import numpy as np

    from waymark.operators import blocks, search

    monkeypatch.setattr(blocks, "QUERY_BYTES", block)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block)
    monkeypatch.setattr(blocks, "PRODUCTS", 60)
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((23, 4)), rng.standard_normal((50, 4))
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "query_id long, vec array<double>")
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(y)], "ep_ord long, vec array<double>").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["ep_ord"]) for r in search.block_top_k(spark, queries, rows, 5, "ep_ord").collect())
    assert got == [(q, n + 1, int(k)) for q in range(23) for n, k in enumerate(np.argsort(-(y @ x[q]), kind="stable")[:5])]


@pytest.mark.parametrize("block", [400, 4_000_000])
def test_keyword_top_is_the_top_of_all_hits(spark, block, monkeypatch):
    """Common and rare words, stems and compounds, ties, and blocks of a few rows."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from waymark.operators import blocks, search

    monkeypatch.setattr(blocks, "QUERY_BYTES", block)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 4 * block)
    monkeypatch.setattr(blocks, "INDEXED", 7)
    rng = random.Random(4)
    words = "search searching cats city cities page webpage webpages market marketplace exchange ex.change rate rates the".split()
    text = lambda n: " ".join(rng.choice(words[: rng.randrange(1, len(words) + 1)]) for _ in range(rng.randrange(n)))
    rows = [(f"e{k}", k, rng.choice(["authenticate now", "x", None]), rng.choice([True, False, None]), (rng.choice([None, 1.0]),), text(9)) for k in range(150)]
    e = spark.createDataFrame(rows, "id string, ep_ord long, summary string, guidance_available boolean, payment struct<price_usd:double>, search_text string").repartition(3)
    q = spark.createDataFrame([(k, text(6)) for k in range(25)] + [(99, None)], "query_id long, query string")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ep_ord")
    every = search.keyword_endpoints(q, e).withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(w)).where("rank <= 4")
    cols = ["query_id", "rank", "id", "score"]
    got = search.keyword_top(q, e, 4)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, every.select(cols).collect()))


@pytest.mark.parametrize("name", ["sparse_cosines", "bound", "catalog_sweep"])
def test_beyond_the_bound_of_tokens(spark, sf, duck, name, monkeypatch):
    from waymark.operators import binder

    monkeypatch.setattr(binder, "IDF_TOKENS", 10)
    test_query_is_its_sql(spark, sf, duck, name)


def test_a_tied_best_list_is_by_order(spark):
    from waymark.operators import search

    rows = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(500)], "vec_id long, vec array<float>").repartition(5)
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [-1.0, 0.0])], "query_id long, vec array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in search.block_top_k(spark, q, rows, 3, "vec_id").collect())
    assert got == [(q, n + 1, n) for q in (1, 2) for n in range(3)]
    assert search.pair_cosines(spark.createDataFrame([(1, 3), (1, 3), (7, 3)], "query_id long, vec_id long"), q, rows, "vec_id").collect() == [(1, 3, 1.0)]


def test_materialize_limits_before_the_shuffle(spark, sf):
    plan = QUERIES["neutral_top"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "part", "rank", "target"] and {r["part"] for r in df.collect()} == {"endpoint", "capability", "step"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
