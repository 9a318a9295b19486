"""Entity flow where an entity is on very many ports: the same rows as by brute force, and pairs that no shuffle carries."""

import random

import pytest
from pyspark.sql import functions as F

from waymark import schemas
from waymark.operators import graph


def shuffled(df) -> int:
    """Rows in all of the shuffles of ``df``, which was collected."""

    def walk(node) -> int:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        below = node.children()
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
        return own + sum(walk(below.apply(k)) for k in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def intents_of(spark, rows):
    """Intents (id, domain, entities consumed, entities produced), in order; an entity is a name or (name, role)."""
    port = lambda e: {"entity": e if isinstance(e, str) or e is None else e[0], "role": None if isinstance(e, str) or e is None else e[1], "format": None, "cardinality": None}
    base = {k: None for k in ("label", "description", "aliases", "schema_org", "negative_terms", "links", "related")}
    facets = lambda d: {"domain": d, "action": None, "modality": None, "freshness": None}
    return spark.createDataFrame([base | {"id": i, "facets": facets(d), "consumes": [port(e) for e in c], "produces": [port(e) for e in p], "intent_ord": n} for n, (i, d, c, p) in enumerate(rows)], schemas.INTENT)


def some(seed: int = 3):
    """Intents with several ports, repeated ports, missing entities and domains, and parents that are repeated or their own child."""
    rng = random.Random(seed)
    names = [f"P{k}" for k in range(12)] + ["B", "C", None]
    pick = lambda n: [rng.choice([(e, rng.choice(["constraint", "x", None])), e]) if (e := rng.choice(names)) else None for _ in range(rng.randrange(n))]
    rows = [(f"i{k}", rng.choice(["d1", "d2", None]) if k > 8 else "d1", pick(5), pick(4)) for k in range(60)]
    parents = [(f"P{k}", "BC"[k % 2]) for k in range(0, 12, 2)] + [("P0", "C"), ("P2", "B"), ("P2", "B"), ("B", "B"), ("C", None), (None, "B")]
    return rows, parents


def entity(port):
    return port if isinstance(port, str) or port is None else port[0]


def role(port):
    return None if isinstance(port, str) or port is None else port[1]


def many(spark, users: int, kids: int):
    """Intents that all take an entity of many kinds, and make some of these."""
    rows = [(f"i{k}", f"d{k % 3}", ["B" if k % 10 else f"P{k}"], [f"P{k % kids}"]) for k in range(users)]
    return intents_of(spark, rows), spark.createDataFrame([(f"P{k}", "B") for k in range(kids)], "child string, parent string")


@pytest.mark.parametrize("block", [2, 1024])
def test_consumers_by_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", block)
    rows, parents = some()
    want = {}
    for n, (i, d, consumes, _) in enumerate(rows):
        for port in consumes:
            e = entity(port)
            for held in [e] + [c for c, p in parents if p is not None and p == e]:
                want.setdefault((held, i, e), (held, i, d, role(port), e, n))
    got = graph.consumers_by_entity(intents_of(spark, rows), spark.createDataFrame(parents, "child string, parent string")).collect()
    order = lambda rows: sorted(map(str, map(tuple, rows)))
    assert order(got) == order(want.values())


def test_consumers_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 64)
    intents, parents = many(spark, 400, 500)
    out = graph.consumers_by_entity(intents, parents)
    assert len(out.collect()) == 360 * 501 + 40 and shuffled(out) < 40_000
    assert out.where("held = 'P7'").select(F.countDistinct("intent_id")).first()[0] == 360


@pytest.mark.parametrize("block", [2, 1024])
@pytest.mark.parametrize("domains", [("d1", "d2", "d3"), ("d1", "d2", None), (None, "d1"), ("d1",), (None,)])
def test_lateral_flow_by_brute_force(spark, block, domains, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", block)
    rows, parents = some()
    rng = random.Random(1)
    rows = [(i, domains[0] if n < 3 else rng.choice(domains), c, p) for n, (i, _, c, p) in enumerate(rows)]
    entities = [(f"P{k}", [None, "observation", "identity"][k % 3], k % 5 != 0) for k in range(12)] + [("B", "identity", True), ("B", "identity", True), ("C", None, False), (None, "identity", True)]
    want = set()
    for held in {e for e, kind, ok in entities if ok and kind != "observation" and e}:
        own = {held} | {p for c, p in parents if c == held and p}
        for i, d, consumes, _ in rows:
            port = next((x for x in consumes if entity(x) in own), None)
            source = next(((x[1],) for x in rows if d is None or x[1] is None or x[1] != d), None)
            if port and source:
                want.add((held, source[0], i, d, role(port)))
    got = graph.lateral_flow(intents_of(spark, rows), spark.createDataFrame(parents, "child string, parent string"), spark.createDataFrame(entities, "name string, kind string, bridge_eligible boolean")).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_lateral_pairs_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 64)
    intents, parents = many(spark, 400, 500)
    entities = parents.select(F.col("child").alias("name"), F.lit("identity").alias("kind"), F.lit(True).alias("bridge_eligible"))
    out = graph.lateral_flow(intents, parents, entities)
    assert len(out.collect()) == 360 * 500 + 40 and shuffled(out) < 40_000


@pytest.mark.parametrize("block", [2, 1024])
def test_forward_flow_by_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", block)
    rows, parents = some()
    want = []
    for i, _, _, produces in rows:
        for made in filter(entity, produces):
            for e, match in [(entity(made), "exact")] + [(p, "parent") for c, p in parents if c == entity(made)]:
                want += [(i, j, e, match, role(made), role(used)) for j, _, consumes, _ in rows for used in consumes if e is not None and entity(used) == e and i != j and "constraint" not in (role(made), role(used))]
    got = graph.forward_flow(intents_of(spark, rows), spark.createDataFrame(parents, "child string, parent string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and got


def test_a_frequent_entity_is_no_single_task(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 64)
    intents, parents = many(spark, 400, 300)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = graph.forward_flow(intents, parents).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    pairs = [r["count"] for r in found]
    assert sum(pairs) > 360 * 399 and max(pairs) < 0.6 * sum(pairs)
