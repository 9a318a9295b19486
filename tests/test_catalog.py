"""The catalog built from landed files, end to end, and parts that no table exercises."""

import json

import pytest
from pyspark.sql import functions as F

from waymark import schemas
from waymark.operators import evaluate, labels, merge
from waymark.plans import catalog
from waymark.sources import openapi, registry, snapshots, vectors

from .test_operators import endpoint, table

DOC = {
    "info": {"title": "Weather", "description": "Forecasts by city", "x-guidance": "Ask for a city"},
    "x-service-info": {"categories": ["weather"], "docs": {"homepage": "https://spec.io/", "other": 1}},
    "paths": {"/v1/forecast": {"post": {
        "summary": "Forecast of a city's weather", "operationId": "forecast", "description": "Hourly forecast as structured json",
        "parameters": [{"name": "city", "in": "query"}], "x-payment-info": {"price": {"amount": "0.02"}, "protocols": ["x402"]},
        "responses": {"200": {}, "402": {}},
    }}},
}


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_build_catalog_from_files(spark, tmp_path):
    accepts = [{"amount": "20000", "asset": "0x833589fcd6edb6e08f4c7c32d4f71b54bda02913", "network": "base", "payTo": None, "scheme": "exact"}]
    about = {"accepts": accepts, "description": "Weather of a city by the hour", "serviceName": "Weather", "tags": ["weather"], "method": "GET"}
    resources = registry.read_resources(spark, lines(tmp_path / "r.json", [
        {"resource": "https://One.io/v1/weather?x=1", "type": "http"} | about,
        {"resource": "https://spec.io/v1/old", "type": "http"} | about,
        {"resource": "https://one.io/health", "type": "http"} | about,
        {"resource": "not a url"} | about,
        {"resource": "https://one.io/v1/tool", "type": "mcp"} | about,
    ]))
    pay = {"amountHint": "$0.10", "amount": None, "decimals": None, "currency": "usd"}
    service = {"id": "s", "url": "https://two.io/", "description": "Maps of places near by", "tags": ["maps"]}
    services = registry.read_services(spark, lines(tmp_path / "s.json", [
        service | {"endpoints": [{"method": "get", "path": "/v1/places", "summary": "Places near an address", "payment": pay}]},
    ]))
    providers = registry.read_providers(spark, lines(tmp_path / "p.json", [
        {"fqn": "a/spec", "title": "Spec", "service_url": "https://spec.io/", "endpoint_count": 1},
        {"fqn": "a/none", "title": "None", "service_url": "https://none.io/", "endpoint_count": 0},
    ]))
    docs = spark.createDataFrame([("https://spec.io", json.dumps(DOC)), ("https://bad.io", "{")], "origin string, doc string")
    prior = table(spark, [
        endpoint(1, origin="https://prior.io", built_at="2024-01-20", description="A prior row's text", operation_id="p", provider_title="P"),
        endpoint(2, origin="https://stale.io", built_at="2023-01-01"),
        endpoint(3, origin="https://one.io", path="/v1/gone", built_at="2024-01-20"),
    ])
    got = {(r["origin"], r["path"]): r for r in catalog.build_catalog(resources, services, providers, docs, prior, "2024-01-31").collect()}
    # the document's rows replace its origin's; meta paths are gated; seen origins and stale rows aren't carried
    assert set(got) >= {("https://one.io", "/v1/weather"), ("https://spec.io", "/v1/forecast"), ("https://prior.io", "/v1/1")}
    assert {o for o, _ in got} <= {"https://one.io", "https://two.io", "https://spec.io", "https://prior.io"}
    assert not {("https://spec.io", "/v1/old"), ("https://one.io", "/health"), ("https://one.io", "/v1/tool"), ("https://one.io", "/v1/gone")} & set(got)
    spec = got["https://spec.io", "/v1/forecast"]
    assert spec["service"]["docs"] == {"homepage": "https://spec.io/"} and spec["service"]["categories"] == ["weather"]
    assert spec["provider_fqn"] is not None and spec["payment"]["price_usd"] == 0.02


def test_build_catalog_of_nothing(spark):
    empty = lambda s: spark.createDataFrame([], s)
    docs = empty("origin string, doc string")
    assert catalog.build_catalog(empty(schemas.REGISTRY_RESOURCE), empty(schemas.SERVICE), empty(schemas.PROVIDER), docs, None, "2024-01-31").count() == 0


def test_catalog_is_written_and_read_again(spark, tmp_path):
    rows = table(spark, [endpoint(n, origin=f"https://h{n % 3}.io") for n in range(20)])
    root, refs = str(tmp_path / "c"), rows.select("id", F.lit(1).alias("rank"))
    assert snapshots.versions(spark, root) == [] and snapshots.commits(spark, root).count() == 0
    with pytest.raises(ValueError):
        snapshots.read_version(spark, root)
    assert snapshots.write_version(root, rows, rows.select("id"), refs) == 1
    back = snapshots.read_version(spark, root)["endpoints"]
    assert sorted(r["id"] for r in back.collect()) == sorted(r["id"] for r in rows.collect())
    # a write that fails midway leaves the old version, and its number for the next
    broken = refs.withColumn("rank", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception):
        snapshots.write_version(root, rows.limit(2), rows.select("id"), broken)
    assert snapshots.versions(spark, root) == [1] and snapshots.read_version(spark, root)["endpoints"].count() == 20
    (tmp_path / "c" / "commits" / "00000002").mkdir()  # a commit that was begun
    assert snapshots.versions(spark, root) == [1]
    (tmp_path / "c" / "commits" / "00000002").rmdir()
    assert snapshots.write_version(root, rows.limit(5), rows.select("id").limit(3), refs.limit(0)) == 2
    assert snapshots.read_version(spark, root)["endpoints"].count() == 5 and snapshots.read_version(spark, root, 1)["endpoints"].count() == 20
    assert [tuple(r)[0:1] + tuple(r)[2:] for r in snapshots.commits(spark, root).orderBy("version").collect()] == [(1, 20, 20, "2024-01-01", 20, 20), (2, 5, 5, "2024-01-01", 3, 0)]


def test_embeddings_are_cached_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")

    def embed(s):
        return s.map(lambda x: [float(len(x)), 1.0])

    assert vectors.read_cache(spark, path, "m", 2).count() == 0
    assert sorted(r["vec"][0] for r in vectors.embed_cached(texts("a", "a", "bb", None), path, embed, "m", 2).collect()) == [1.0, 2.0]
    for _ in range(2):
        assert sorted(r["vec"][0] for r in vectors.embed_cached(texts("bb", "ccc"), path, embed, "m", 2).collect()) == [2.0, 3.0]
    assert vectors.embed_cached(texts("a"), path, embed, "other model", 2).count() == 1
    assert vectors.read_cache(spark, path, "m", 2).count() == 3 and vectors.read_cache(spark, path, "m", 3).count() == 0
    plan = vectors.read_cache(spark, path, "m", 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan


def test_labels_are_read_and_merged(spark, tmp_path):
    (tmp_path / "l.csv").write_text(
        'key,regex_domain,domain_corrected,action,entity\na,web,,lookup,"A ""quoted"", entity"\na,web, gov ,search,"two\nlines"\n" ",web,x,y,z\nb,data,,,\n'
    )
    got = {r["key"]: r for r in labels.load_labels(registry.read_labels(spark, str(tmp_path / "l.csv"))).collect()}
    assert set(got) == {"a", "b"} and tuple(got["a"])[1:] == ("gov", "search", "two\nlines") and tuple(got["b"])[1:] == ("data", None, None)


def test_worklist_is_written_and_read_as_labels(spark, tmp_path):
    rows = table(spark, [endpoint(n, summary=f'A "quoted", text\nof {n}') for n in range(9)])
    labels.write_worklist(rows, str(tmp_path / "w"), 2)
    back = registry.read_labels(spark, str(tmp_path / "w"))
    assert sorted(r["summary"] for r in back.collect()) == sorted(r["summary"] for r in rows.collect()) and len(list((tmp_path / "w").glob("*.csv"))) == 2


def test_merged_labels_are_settled_by_place(spark):
    new = spark.createDataFrame([("a", "x", "h", 1), ("a", "y", "h", 2), ("b", " ", "h", 3)], "key string, action string, content_hash string, pos long")
    old = spark.createDataFrame([("b", "o", "h", 1), ("b", "p", "h", 0), ("a", "o", "h", 9)], new.schema)
    none = table(spark, [endpoint(1)])
    assert sorted((r["key"], r["action"]) for r in labels.merge_labels(old, new, none).collect()) == [("a", "y"), ("b", "o")]


def test_service_info():
    whole = {"categories": ["a"], "docs": {"homepage": "https://a.io/", "llms": "https://a.io/l"}}
    assert openapi.service_info(whole) == (["a"], whole["docs"])
    for wrong in (None, [], "x", {"categories": "a"}, {"categories": [1]}, {"docs": []}, {"categories": ["a"], "docs": {"homepage": "no address"}}):
        assert openapi.service_info(wrong) == ([], None)
    assert openapi.service_info({"docs": {"more": 1}}) == ([], None)


def test_probe_guard(spark):
    rows = [("p", "clean", "a", 1.0), ("p", "clean", "b", 0.5), ("q", "clean", "a", 0.5), ("q", "clean", "b", 0.5), ("d", "decoy", "a", 1.0), ("d", "decoy", "b", 0.0)]
    scored = spark.createDataFrame(rows, "probe string, type string, config string, p_3 double")
    assert [tuple(r) for r in evaluate.probe_guard(scored, "a").collect()] == [("p", "b", 0.5)]


def test_fold_is_a_loop_over_pairs(spark):
    """Any order of stubs and longer summaries: the fold is the pairwise merge, record by record."""
    import random

    rng = random.Random(3)
    rows, n = [], 0
    for key in range(5):
        for _ in range(rng.randint(1, 6)):
            n += 1
            rows.append(endpoint(key, summary=rng.choice(["", "x", "short", "a summary that is long enough", "another summary, longer than that"]),
                description=rng.choice([None, "text", "other text"]), inputs=rng.choice([[], ["a"], ["b", "c"]]), operation_id=rng.choice([None, "op"]),
                payment=PRICED if rng.random() < 0.4 else FREE, ep_ord=n, search_text=f"t{n}", provider_fqn=rng.choice([None, "p", "q"])))
    got = {r["id"]: r for r in merge.fold(table(spark, rows)).collect()}
    names = ("summary", "description", "operation_id", "inputs", "provider_fqn", "search_text")
    for key in range(5):
        own = [r for r in rows if r["id"] == f"{key:064x}"]
        best = own[0]
        for r in own[1:]:
            step = merge.merge_two(table(spark, [best]), table(spark, [r])).first().asDict(recursive=True)
            best = best | {k: step[k] for k in (*names, "payment")} | {"payment": step["payment"] | {"currency": None, "offers": []}}
        want = got[f"{key:064x}"]
        assert [want[k] for k in names] == [best[k] for k in names] and want["paid"] == best["payment"]["paid"] and want["price_usd"] == best["payment"]["price_usd"]


PRICED = {"price_usd": 0.01, "paid": True, "currency": None, "rails": [], "offers": []}
FREE = {"price_usd": None, "paid": False, "currency": None, "rails": [], "offers": []}
