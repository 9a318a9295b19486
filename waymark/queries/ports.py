"""Entity flow over ports that grow with the tables: every customer who ordered is an intent.

It takes the part of its first order line (every tenth one that part's brand), and makes the part of its last. A part of
every fourth number is a kind of its brand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, graph
from ..storage import saved
from . import views as v

S, D = SparkSession, DataFrame


def _intents(spark: S, sf: str) -> D:
    at = (F.col("o_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")  # line numbers repeat
    lines = v.table(spark, sf, "lineitem").join(v.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ends = lines.groupBy("o_custkey").agg(F.min_by("l_partkey", at).alias("takes"), F.max_by("l_partkey", at).alias("makes"))
    c = v.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    brand = v.table(spark, sf, "part").select(F.col("p_partkey").alias("takes"), "p_brand")
    rows = ends.join(c, F.col("o_custkey") == F.col("c_custkey")).join(brand, "takes")
    none = F.lit(None).cast("string")

    def port(entity, every: int):
        return F.array(F.struct(entity.alias("entity"), F.when(F.col("c_custkey") % every == 0, "constraint").alias("role"), none.alias("format"), none.alias("cardinality")))

    part = lambda k: F.concat(F.lit("P"), F.col(k))
    return saved(
        rows.select(
            F.concat(F.lit("svc."), "c_custkey").alias("id"), port(F.when(F.col("c_custkey") % 10 == 0, F.col("p_brand")).otherwise(part("takes")), 13).alias("consumes"), port(part("makes"), 11).alias("produces"),
            F.struct(F.concat(F.lit("n"), "c_nationkey").alias("domain")).alias("facets"), F.col("c_custkey").alias("intent_ord"),
        ),
        "grown-intents",
    )


def _parents(spark: S, sf: str) -> D:
    return v.table(spark, sf, "part").where("p_partkey % 4 = 0").select(F.concat(F.lit("P"), "p_partkey").alias("child"), F.col("p_brand").alias("parent"))


def _entities(spark: S, sf: str) -> D:
    p = v.table(spark, sf, "part")
    kind = F.when(F.col("p_partkey") % 7 == 0, "observation").otherwise("identity")
    parts = p.select(F.concat(F.lit("P"), "p_partkey").alias("name"), kind.alias("kind"), (F.col("p_partkey") % 5 == 0).alias("bridge_eligible"))
    return parts.union(p.select("p_brand", F.lit("identity"), F.lit(True)).distinct())


def grown_forward_flow(spark: S, sf: str) -> D:
    return graph.forward_flow(_intents(spark, sf), _parents(spark, sf)).select("from", "to", "entity", "match")


def grown_lateral_flow(spark: S, sf: str) -> D:
    return graph.lateral_flow(_intents(spark, sf), _parents(spark, sf), _entities(spark, sf)).select("entity", "from_domain", "to", "to_domain")


def grown_consumers(spark: S, sf: str) -> D:
    return graph.consumers_by_entity(_intents(spark, sf), _parents(spark, sf)).select("held", "intent_id", "domain", "port_entity")


def grown_entity_sets(spark: S, sf: str) -> D:
    by_intent, _ = graph.entity_index(_intents(spark, sf), _parents(spark, sf))
    return by_intent.select("intent_id", F.array_join("produces", ",").alias("produces"), F.array_join("consumes", ",").alias("consumes"))


def grown_subtypes(spark: S, sf: str) -> D:
    _, closure = graph.entity_index(_intents(spark, sf), _parents(spark, sf))
    return closure.select("entity", F.array_join(F.sort_array("members"), ",").alias("members"))


def grown_entity_rollup(spark: S, sf: str) -> D:
    out = audit.entity_rollup(_intents(spark, sf))
    return out.select("entity", F.array_join("produced_by", ",").alias("produced_by"), F.array_join("consumed_by", ",").alias("consumed_by"))


_G = """WITH ln AS (SELECT o_custkey, l_partkey, (o_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    nd AS (SELECT o_custkey AS c, arg_min(l_partkey, k) AS takes, arg_max(l_partkey, k) AS makes FROM ln GROUP BY 1),
    i AS (SELECT concat('svc.', c) AS intent_id, c AS ord, concat('n', c_nationkey) AS domain, CASE WHEN c % 10 = 0 THEN p_brand ELSE concat('P', takes) END AS consumes,
        concat('P', makes) AS produces, c % 13 = 0 AS c_fixed, c % 11 = 0 AS p_fixed FROM nd JOIN customer ON c_custkey = c JOIN part ON p_partkey = takes),
    par AS (SELECT concat('P', p_partkey) AS child, p_brand AS parent FROM part WHERE p_partkey % 4 = 0)"""
_MADE = ", made AS (SELECT intent_id, produces AS port, 'exact' AS match, p_fixed FROM i UNION ALL SELECT intent_id, parent, 'parent', p_fixed FROM i JOIN par ON child = produces)"

ALL = {
    "grown_forward_flow": (
        grown_forward_flow,
        _G + _MADE + """ SELECT made.intent_id AS "from", i.intent_id AS "to", port AS entity, match FROM made JOIN i ON i.consumes = port
        WHERE made.intent_id <> i.intent_id AND NOT p_fixed AND NOT c_fixed""".replace("NOT p_fixed", "NOT made.p_fixed"),
    ),
    "grown_lateral_flow": (
        grown_lateral_flow,
        _G + """, held AS (SELECT concat('P', p_partkey) AS held FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 7 <> 0 UNION SELECT p_brand FROM part),
        hx AS (SELECT held, held AS port FROM held UNION ALL SELECT held, parent FROM held JOIN par ON child = held),
        pr AS (SELECT DISTINCT held, i.intent_id AS dst, i.domain AS td FROM hx JOIN i ON i.consumes = port), dm AS (SELECT domain, min(ord) AS o FROM i GROUP BY 1)
        SELECT held AS entity, arg_min(dm.domain, dm.o) AS from_domain, dst AS "to", td AS to_domain FROM pr, dm WHERE dm.domain <> td GROUP BY 1, 3, 4""",
    ),
    "grown_consumers": (
        grown_consumers,
        _G + """ SELECT DISTINCT * FROM (SELECT consumes AS held, intent_id, domain, consumes AS port_entity FROM i
        UNION ALL SELECT child, intent_id, domain, consumes FROM i JOIN par ON parent = consumes)""",
    ),
    "grown_entity_sets": (grown_entity_sets, _G + " SELECT intent_id, produces, consumes FROM i"),
    "grown_subtypes": (
        grown_subtypes,
        _G + """ SELECT entity, array_to_string(list_sort(list_concat([entity], coalesce(kids, []))), ',') AS members
        FROM (SELECT child AS entity FROM par UNION SELECT parent FROM par) LEFT JOIN (SELECT parent, list(child) AS kids FROM par GROUP BY 1) k ON k.parent = entity""",
    ),
    "grown_entity_rollup": (
        grown_entity_rollup,
        _G + """ SELECT entity, coalesce(string_agg(p, ',' ORDER BY ord), '') AS produced_by, coalesce(string_agg(c, ',' ORDER BY ord), '') AS consumed_by
        FROM (SELECT produces AS entity, intent_id AS p, NULL AS c, ord FROM i UNION ALL SELECT consumes, NULL, intent_id, ord FROM i) GROUP BY 1""",
    ),
}
