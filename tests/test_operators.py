"""Operators on tiny tables, against plain-Python versions where their order of steps matters."""

import json
import random

import pytest
from pyspark.sql import functions as F

from waymark import schemas
from waymark.operators import arm, audit, bind, evaluate, followups, gate, graph, merge, rank, search
from waymark.sources import openapi, registry, vectors
from waymark.tuning import Tuning

PAID = {"price_usd": 0.01, "paid": True, "currency": "usd", "rails": [{"protocol": "x402", "version": "2", "networks": None}], "offers": []}


def endpoint(n, **own):
    base = {
        "id": f"{n:064x}", "origin": "https://a.io", "method": "GET", "path": f"/v1/{n}", "operation_id": None, "summary": "Look up the weather", "description": None, "tags": [], "provider_fqn": None, "provider_title": None,
        "category": None, "capabilities": ["data.weather"], "inputs": ["city"], "facets": None, "payment": PAID, "service": None, "responses": None, "schema_missing": False, "guidance_available": False, "openapi_url": None,
        "search_text": "weather", "keyphrases": None, "host_breadth": None, "built_at": "2024-01-01", "ep_ord": n,
    }
    return base | own


def table(spark, rows):
    return spark.createDataFrame(rows, schemas.ENDPOINT)


def test_gate(spark):
    free = PAID | {"price_usd": None, "paid": False, "rails": []}
    rows = [
        endpoint(1), endpoint(2, path="/.well-known/x"), endpoint(3, summary="GET /v1/x"), endpoint(4, origin="https://a-git-main.vercel.app"), endpoint(5, summary="API endpoint"), endpoint(6, payment=free, inputs=[]),
        endpoint(7, payment=free, description="d", operation_id="o", tags=["t"], provider_title="p"), endpoint(8, summary=None, description=None), endpoint(9, summary="$5 usd", description="real words"),
    ]
    got = {r["ep_ord"]: r for r in gate.grade(table(spark, rows)).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {1: "pass", 2: "drop", 3: "drop", 4: "drop", 5: "drop", 6: "drop", 7: "pass", 8: "drop", 9: "pass"}
    assert got[1]["completeness"] == 5 and got[1]["flags"] == ["legacy-payment"] and got[7]["flags"] == ["no-payment-detected"] and got[6]["reason"].startswith("thin: only 2/13")


def test_gate_of_nothing(spark):
    none = table(spark, [])
    assert gate.passing(none).count() == 0 and gate.dedupe_mirrors(none).count() == 0
    assert {r["name"]: r["value"] for r in gate.gate_summary(gate.grade(none)).collect()} == {"total": 0, "pass": 0, "drop": 0, "avg_completeness": 0}


def test_mirrors(spark):
    rows = [
        endpoint(1, origin="https://long.example.com", path="/A"), endpoint(2, origin="https://x.fly.dev", path="/a"), endpoint(3, origin="https://b.io", path="/a", summary="LOOK  up the weather"), endpoint(4, summary="", path="/a"),
        endpoint(5, summary="", path="/a", origin="https://c.io"), endpoint(6, summary="", path="/a"), endpoint(7, path="/a", method="POST"),
    ]
    df = table(spark, rows)
    for shape in (df, df.repartition(5), df.orderBy(F.desc("ep_ord")).coalesce(1)):
        assert sorted(r["ep_ord"] for r in gate.dedupe_mirrors(shape).collect()) == [3, 4, 5, 7]


def test_neutral_rank(spark):
    free = PAID | {"paid": False, "rails": [], "price_usd": None}
    rows = [endpoint(1), endpoint(2, description="a description of over twenty"), endpoint(3, payment=free, description="a description of over twenty"), endpoint(4, path="/health"), endpoint(5)]
    got = rank.rank_neutral(table(spark, rows), ["origin"], 3).orderBy("rank").collect()
    assert [r["ep_ord"] for r in got] == [2, 1, 5] and got[0]["score"] == got[1]["score"] + 3
    alone = rank.rank_neutral(table(spark, [endpoint(1, payment=free)]), ["origin"]).collect()
    assert len(alone) == 1


def decide_by_hand(rows, t):
    out = []
    d_rank = {r["i"]: k for k, r in enumerate(sorted(rows, key=lambda r: (-r["dense"], r["o"])))}
    s_rank = {r["i"]: k for k, r in enumerate(sorted(rows, key=lambda r: (-r["sparse"], r["o"])))}
    dense = sorted((r["dense"] for r in rows), reverse=True)
    best, second = dense[0], dense[1] if len(dense) > 1 else float("-inf")
    cand = [r | {"promoted": r["dense"] < t.dense_floor} for r in rows if r["dense"] >= t.dense_floor or r["sparse"] >= t.strong_sparse_floor]
    cand.sort(key=lambda r: (r["promoted"], -(1 / (t.rrf_k + d_rank[r["i"]]) + 1 / (t.rrf_k + s_rank[r["i"]])), r["o"]))
    for k, r in enumerate(cand):
        lead = r["dense"] - (second if r["dense"] >= best else best)
        ok = k < t.top_k and r["sparse"] >= t.sparse_floor
        out.append((r["i"], k + 1, r["promoted"], ok and (r["sparse"] >= t.strong_sparse_floor or lead >= t.dense_margin)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_decide(spark, seed):
    rnd = random.Random(seed)
    t = Tuning(dense_floor=0.5, sparse_floor=0.2, strong_sparse_floor=0.6, dense_margin=0.2, top_k=2)
    rows, want = [], {}
    for key in range(40):
        n = rnd.choice([1, 2, 6])
        own = [{"i": f"i{k}", "o": k, "dense": rnd.choice([0.1, 0.3, 0.5, 0.5, 0.7, 0.9]), "sparse": rnd.choice([0.0, 0.1, 0.2, 0.6, 0.8])} for k in range(n)]
        want[key] = decide_by_hand(own, t)
        rows += [(key, r["i"], r["o"], r["dense"], r["sparse"]) for r in own]
    df = spark.createDataFrame(rows, "key int, intent_id string, intent_ord int, dense double, sparse double")
    got: dict = {k: [] for k in want}
    for r in bind.decide(df.repartition(7), "key", t).orderBy("key", "place").collect():
        got[r["key"]].append((r["intent_id"], r["place"], r["promoted"], r["bound"]))
    assert got == want


def test_dense_block_and_top_k(spark):
    rows = spark.createDataFrame([(k, [float(k % 5), 1.0]) for k in range(20)], "id int, vec array<float>")
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "query_id string, vec array<float>")
    got = search.block_top_k(spark, q, rows.repartition(3), 3, "id").orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [("a", 4), ("a", 9), ("a", 14), ("b", 0), ("b", 1), ("b", 2)]
    assert search.block_top_k(spark, q.limit(0), rows, 3, "id").count() == 0


def test_token_scores(spark):
    q = spark.createDataFrame([(1, "scraping webpage cats"), (2, "the of")], "query_id int, query string")
    c = spark.createDataFrame([("a", "page scraping cat"), ("b", "scrape")], "key string, text string")
    got = {(r["query_id"], r["key"]): round(r["token_score"], 6) for r in search.token_scores(q, c, "key").collect()}
    # scraping exactly, webpage as a compound of page; cats and cat are too short to share a stem
    assert got == {(1, "a"): 0.5}


def test_guard_and_routing(spark):
    order = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "b"), (3, 1, "a")], "query_id int, rank int, intent_id string")
    sup = spark.createDataFrame([(1, "b", 1.5, 1), (1, "c", 1.5, 2), (2, "b", 1.5, 1), (2, "a", 0.1, 2), (3, "b", 2.0, 1)], "query_id int, intent_id string, support double, first int")
    got = {(r["query_id"], r["rank"]): r["intent_id"] for r in arm.guard(order, sup).collect()}
    assert got == {(1, 1): "b", (1, 2): "a", (2, 1): "a", (2, 2): "b", (3, 1): "a"}


def test_integrity(spark):
    port = lambda e: [{"entity": e, "role": None, "format": None, "cardinality": None}]
    base = {k: None for k in ("description", "aliases", "schema_org", "facets", "negative_terms", "links", "related")}
    rows = [base | {"id": i, "label": i, "consumes": port(c), "produces": port(p), "intent_ord": n} for n, (i, c, p) in enumerate([("a", "X", "Y"), ("b", "Y", "Z"), ("c", "Q", "Q")])]
    intents = spark.createDataFrame(rows, schemas.INTENT)
    links = spark.createDataFrame([("a", "pipes_to", "b"), ("a", "pipes_to", "c"), ("a", "sibling_of", "a"), ("b", "sibling_of", "a"), ("a", "broader_of", "zz")], "from string, type string, to string")
    related = spark.createDataFrame([("c", "nope"), ("c", "c")], "from string, to string")
    vocab = spark.createDataFrame([("X",), ("Y",), ("Z",)], "entity string")
    got = sorted((r["kind"], r["intent_id"], r["target"]) for r in audit.integrity(intents, links, related, vocab).collect())
    assert got == [("asymmetric_link", "b", "a"), ("dangling_link", "a", "zz"), ("dangling_related", "c", "nope"), ("pipes_to_flow", "a", "c"), ("self_link", "a", "a"), ("self_link", "c", "c"), ("unknown_entity", "c", "Q"), ("unknown_entity", "c", "Q")]


def test_related_order(spark):
    intents = spark.createDataFrame([("a.x", "X"), ("a.y", "Y"), ("a.z", "Z"), ("a.w", "W")], "id string, label string")
    links = spark.createDataFrame([("a.x", "pipes_to", "a.w", None, 0), ("a.x", "sibling_of", "a.y", None, 1), ("a.x", "alternative_of", "a.z", None, 2), ("a.x", "pipes_to", "a.z", None, 3), ("a.x", "fed_by", "gone", None, 4), ("a.x", "fed_by", "a.x", None, 5)], "from string, type string, to string, note string, pos int")
    best = spark.createDataFrame([("a.z", "e1")], "intent_id string, id string")
    got = [(r["target"], r["relation_label"], r["endpoint_id"]) for r in graph.related_options(links, intents, best).orderBy("rank").collect()]
    assert got == [("a.z", "alternative", "e1"), ("a.y", "related", None), ("a.w", "next step", None)]


def test_greedy_fill(spark):
    rnd = random.Random(5)
    rows = [(q, f"i{rnd.randrange(12)}", f"b{rnd.randrange(2)}", f"d{rnd.randrange(4)}", rnd.random(), n) for q in range(6) for n in range(20)]
    df = spark.createDataFrame(rows, "query_id int, intent_id string, bridge string, domain string, score double, ord int")
    got: dict = {}
    for r in followups.fill(df.repartition(5)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["intent_id"])
    for q in range(6):
        want, e, d = [], {}, {}
        for _, i, b, dom, _, _ in sorted((r for r in rows if r[0] == q), key=lambda r: r[5]):
            if len(want) < 8 and i not in want and e.get(b, 0) < 3 and d.get(dom, 0) < 2:
                want.append(i)
                e[b], d[dom] = e.get(b, 0) + 1, d.get(dom, 0) + 1
        assert got.get(q, []) == want


def test_merge(spark):
    free = PAID | {"price_usd": None, "paid": False, "rails": []}
    a = table(spark, [endpoint(1, summary="short", payment=free, inputs=[], search_text="x"), endpoint(2, summary="the same length", description="mine"), endpoint(3)])
    b = table(spark, [endpoint(1, description="longer", search_text="y"), endpoint(2, summary="the very length", description=None)])
    got = {int(r["id"], 16): r for r in merge.merge_two(a, b).collect()}
    assert got[1]["summary"] == "Look up the weather" and got[1]["payment"]["paid"] and got[1]["inputs"] == ["city"] and got[1]["search_text"] == "x y"
    assert got[2]["summary"] == "the same length" and got[2]["description"] == "mine" and len(got) == 3
    folded = {int(r["id"], 16): r for r in merge.fold(a.union(b.withColumn("ep_ord", F.col("ep_ord") + 10))).collect()}
    assert folded[1]["summary"] == "Look up the weather" and folded[1]["paid"] and folded[3]["price_usd"] == 0.01


def test_carry_forward(spark):
    now = table(spark, [endpoint(1)])
    prior = table(spark, [endpoint(2), endpoint(3, origin="https://old.io", built_at="2023-01-01"), endpoint(4, origin="https://new.io", built_at="2024-01-20"), endpoint(5, origin="https://odd.io", built_at="soon")])
    assert sorted(r["ep_ord"] for r in merge.carry_forward(now, prior, F.lit("2024-01-31")).collect()) == [1, 4, 5]


def test_openapi(spark):
    doc = {
        "info": {"title": "T", "x-guidance": "hint"},
        "components": {"schemas": {"A": {"properties": {"q": {}, "file": {}}}, "R": {"$ref": "#/components/schemas/R"}}},
        "paths": {
            "/lookup": {"get": {"parameters": [{"name": "id"}], "summary": "Look"}, "trace": {}},
            "/upload": {"post": {"requestBody": {"content": {"multipart/form-data": {"schema": {"allOf": [{"$ref": "#/components/schemas/A"}, {"$ref": "#/components/schemas/R"}]}}}}, "x-payment-info": {"offers": [{"intent": "charge", "method": "stripe", "amount": "5", "currency": "usd"}]}, "responses": {"402": {}}}},
            "/old": {"post": {"x-payment-info": {"price": {"amount": "0.5"}, "protocols": ["x402"], "extra": 1}}},
        },
    }
    docs = spark.createDataFrame([("https://x.io/", json.dumps(doc)), ("https://bad.io", "{"), ("https://null.io", None), ("https://big.io", "[" * 2_000_001)], "origin string, doc string")
    got = {r["path"]: r for r in openapi.parse_openapi(docs, "2024-01-01").collect()}
    assert set(got) == {"/lookup", "/upload", "/old"}
    assert got["/lookup"]["inputs"] == ["id"] and not got["/lookup"]["payment"]["paid"] and got["/lookup"]["guidance_available"]
    up = got["/upload"]
    assert up["inputs"] == ["q", "file"] and up["payment"]["price_usd"] == 0.05 and [r["protocol"] for r in up["payment"]["rails"]] == ["mpp"] and up["responses"]["has402"] and up["summary"] == "POST /upload"
    assert got["/old"]["payment"]["price_usd"] == 0.5 and got["/old"]["schema_missing"] and [r["protocol"] for r in got["/old"]["payment"]["rails"]] == ["x402"]


def _doc(op, **top):
    return json.dumps({"paths": {"/a": {"get": op}, "/good": {"get": {"summary": "Good"}}}} | top)


PAY = {"x-payment-info": {"amount": 500}}
#: Foreign shapes: the document, and the place and reason of its one reject.
FOREIGN = [
    (_doc({"parameters": 5}), "/paths/~1a/get/parameters", "not a list"),
    (_doc({"requestBody": {"content": [1]}}), "/paths/~1a/get/requestBody/content", "not an object"),
    (_doc({"tags": True}), "/paths/~1a/get/tags", "not a list"),
    (_doc(PAY, **{"x-faremeter-assets": [1]}), "/x-faremeter-assets", "not an object"),
    (_doc({"x-payment-info": {"protocols": 3}}), "/paths/~1a/get/x-payment-info/protocols", "not a list"),
    (_doc({"x-payment-info": {"methods": 3}}), "/paths/~1a/get/x-payment-info/methods", "not a list"),
    (_doc({"x-payment-info": {"offers": {"a": 1}}}), "/paths/~1a/get/x-payment-info/offers", "not a list"),
    ('{"paths": ' * 60_000, "", "nested too deeply"), ('{"paths": {}', "", "not JSON"), ("7", "", "not an object"), ('{"paths": []}', "/paths", "no paths"), (None, "", "empty"), ("", "", "empty"), (" " * 2_000_001, "", "over 2000000 characters"),
]


def test_foreign_documents_are_rejected_and_end_nothing(spark):
    docs = spark.createDataFrame([(f"https://d{k}.io", d) for k, (d, _, _) in enumerate(FOREIGN)], "origin string, doc string")
    rows, rejects = openapi.read_openapi(docs, "2024-01-01")
    assert sorted((r["origin"], r["pointer"], r["reason"]) for r in rejects.collect()) == sorted((f"https://d{k}.io", p, w) for k, (_, p, w) in enumerate(FOREIGN))
    assert sorted(r["origin"] + r["path"] for r in rows.collect()) == sorted(f"https://d{k}.io/good" for k, (d, _, _) in enumerate(FOREIGN) if d and "good" in d)


def test_odd_numbers_and_letters_are_read(spark):
    amounts = {"nan": None, "Infinity": None, "1e400": None, " 12 ": 12.0, "": 0.0, True: 1.0, "1_0": None, 10**400: None}
    ops = {f"/{k}": {"get": {"x-payment-info": {"price": {"amount": a}}}} for k, a in enumerate(amounts)}
    for k, (decimals, _) in enumerate(((400, 0.0), (0, 5.0), ("x", None), (None, 0.000005))):
        ops[f"/d{k}"] = {"get": {"x-payment-info": {"offers": [{"amount": "5", "decimals": decimals}]}}}
    ops["/s"] = {"get": {"summary": "half \ud800 pair", "tags": ["\udfff"], "x-payment-info": {"price": {"amount": 1}}}}
    got = {r["path"]: r for r in openapi.parse_openapi(spark.createDataFrame([("https://x.io", json.dumps({"paths": ops}))], "origin string, doc string"), "2024-01-01").collect()}
    assert [got[f"/{k}"]["payment"]["price_usd"] for k in range(len(amounts))] == list(amounts.values())
    assert [got[f"/d{k}"]["payment"]["price_usd"] for k in range(4)] == [0.0, 5.0, None, 0.000005]
    assert got["/s"]["summary"] == "half \ufffd pair" and got["/s"]["tags"] == ["\ufffd"]


def test_schemas_that_fan_out_are_walked_once():
    names = [f"S{k}" for k in range(40)]
    schemas_ = {n: {"properties": {n: {}}, "allOf": [{"$ref": f"#/components/schemas/{m}"} for m in names]} for n in names}
    doc = {"components": {"schemas": schemas_}}
    found = openapi.property_names(doc, {"$ref": "#/components/schemas/S0"})
    assert set(found) == set(names) and found[0] == "S0"


def test_registry_rows(spark):
    rows = [("https://a.io/x", None, None, "", None, None, "put", None), ("https://a.io", "mcp", None, None, None, None, None, None), ("nope", None, None, None, None, None, None, None), ("https://b.io", "http", [("12", USDC, None, None, None), ("x", None, None, None, None)], "d" * 300, "svc", ["t"], None, None)]
    got = {r["origin"]: r for r in registry.resources_to_endpoints(spark.createDataFrame(rows, schemas.REGISTRY_RESOURCE), "2024-01-01").collect()}
    assert set(got) == {"https://a.io", "https://b.io"}
    assert got["https://a.io"]["method"] == "PUT" and got["https://a.io"]["summary"] == "/x" and got["https://a.io"]["payment"]["price_usd"] is None
    b = got["https://b.io"]
    assert b["path"] == "/" and b["method"] == "POST" and len(b["summary"]) == 200 and b["payment"]["price_usd"] == 0.000012 and len(b["payment"]["offers"]) == 1


USDC = "0x833589fcd6edb6e08f4c7c32d4f71b54bda02913"


def test_quantize_rounds_halves_up(spark):
    v = spark.createDataFrame([("a", [127.0, -2.5, 2.5, 0.4]), ("z", [0.0, 0.0, 0.0, 0.0]), ("dead", [1.0] * 4)], "text_hash string, vec array<float>")
    got = {r["text_hash"]: (r["scale"], list(r["q"])) for r in vectors.quantize(v, v.where("text_hash <> 'dead'")).collect()}
    assert got == {"a": (1.0, [127, -2, 3, 0]), "z": (1.0, [0, 0, 0, 0])}


def test_measures(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 3), (3, None), (4, 7)], "query_id int, rank int").withColumn("mode", F.lit("m"))
    r = evaluate.report(ranks, ["mode"]).first()
    assert (r["n"], r["hit_1"], r["hit_3"], r["hit_5"]) == (4, 0.25, 0.5, 0.5) and abs(r["mrr"] - (1 + 1 / 3 + 1 / 7) / 4) < 1e-12
    hits = spark.createDataFrame([("on", "p", 1, "good thing", "https://x.io/a"), ("on", "p", 2, "other", "https://x.io/rel/b"), ("on", "p", 3, "good decoy", "https://x.io/c")], "config string, probe string, rank int, summary string, url string")
    rules = spark.createDataFrame([("p", "clean", "good", "/rel/", "decoy")], "probe string, type string, relevant string, relevant_path string, decoy string")
    p = evaluate.probes(hits, rules).first()
    assert (p["p_1"], round(p["p_3"], 6), p["first_relevant"], p["decoys_5"]) == (1.0, round(2 / 3, 6), 1, 1)


@pytest.mark.parametrize("answer,url", [("CHOSEN: <https://x.io/a/>.", "https://x.io/a"), ("see https://a.io then `https://b.io/p?q=1`", "https://b.io/p"), ("chosen none\nhttps://c.io", "https://c.io"), (None, None)])
def test_picked_url(spark, answer, url):
    assert spark.createDataFrame([(answer,)], "a string").select(evaluate.picked_url(F.col("a")).alias("u")).first()["u"] == url
