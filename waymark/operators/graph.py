"""The intent graph: links, inverse links, entity flow, related options."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key, on either side of a join, that meet in one place.
BLOCK = 1024
#: relations' inverses, order and labels.
INVERSE = {"alternative_of": "alternative_of", "sibling_of": "sibling_of", "broader_of": "narrower_of", "narrower_of": "broader_of", "pipes_to": "fed_by"}
RELATION_ORDER = ("alternative_of", "narrower_of", "broader_of", "sibling_of", "pipes_to", "fed_by")
RELATION_LABEL = {"alternative_of": "alternative", "broader_of": "more specific", "narrower_of": "more general", "sibling_of": "related", "pipes_to": "next step", "fed_by": "prior step"}
RELATION_GROUP = {"pipes_to": "next", "alternative_of": "alternatives", "sibling_of": "alternatives", "broader_of": "drill-down", "narrower_of": "generalize", "fed_by": "prior"}


def ports(intents: DataFrame) -> DataFrame:
    """(intent_id, side, pos, entity, role, domain) of every port."""
    side = lambda c: intents.select(F.col("id").alias("intent_id"), F.lit(c).alias("side"), F.posexplode(c).alias("pos", "p"), F.col("facets.domain").alias("domain"))
    return side("produces").union(side("consumes")).select("intent_id", "side", "pos", F.col("p.entity").alias("entity"), F.col("p.role").alias("role"), "domain")


def merge_related(links: DataFrame, related: DataFrame) -> DataFrame:
    """Authored links (from, type, to, note, pos) and related intents (from, to, pos) as siblings, unless linked already."""
    extra = related.join(links.select("from", "to"), ["from", "to"], "left_anti")
    first = extra.withColumn("rn", F.row_number().over(Window.partitionBy("from", "to").orderBy("pos"))).where("rn = 1")
    more = first.select("from", F.lit("sibling_of").alias("type"), "to", F.lit(None).cast("string").alias("note"), (F.col("pos") + 1_000_000).alias("pos"))
    return links.select("from", "type", "to", "note", "pos").union(more)


def merge_inferred(authored: DataFrame, inferred: DataFrame) -> DataFrame:
    """Authored links, and of the inferred ones the first to each target that isn't linked."""
    new = inferred.join(authored.select("from", "to"), ["from", "to"], "left_anti")
    first = new.withColumn("rn", F.row_number().over(Window.partitionBy("from", "to").orderBy("pos"))).where("rn = 1").drop("rn")
    return authored.select("from", "type", "to", "note", "pos").union(first.select("from", "type", "to", "note", "pos"))


def add_inverse(links: DataFrame, intents: DataFrame) -> DataFrame:
    """``links`` and the inverse of each one whose target is known and has no link back; the first of several."""
    known = intents.select(F.col("id").alias("__id"))
    inverse = F.element_at(F.create_map(*[F.lit(x) for p in INVERSE.items() for x in p]), F.col("type"))
    back = links.select(F.col("to").alias("from"), inverse.alias("type"), F.col("from").alias("to"), "pos", F.col("from").alias("__src"))
    back = back.where("type IS NOT NULL AND `from` <> `to`").join(known, F.col("from") == F.col("__id"), "left_semi").join(links.select("from", "to"), ["from", "to"], "left_anti")
    w = Window.partitionBy("from", "to").orderBy("pos", "type")
    one = back.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return links.select("from", "type", "to", "note", "pos").union(one.select("from", "type", "to", F.lit("auto-generated inverse").alias("note"), (F.col("pos") + 2_000_000).alias("pos")))


def link_capabilities(endpoints: DataFrame, refs: DataFrame) -> DataFrame:
    """``endpoints`` with the intents that refer to them added to their capabilities."""
    from ..functions.ids import rooted

    key = F.concat_ws("|", "origin", F.upper("method"), rooted(F.col("path")))
    sets = refs.groupBy(key.alias("__key")).agg(F.sort_array(F.collect_set("intent_id")).alias("__more"))  # an endpoint's intents
    own = endpoints.withColumn("__key", F.concat_ws("|", "origin", "method", "path")).join(sets, "__key", "left")
    none = F.array().cast("array<string>")
    return own.withColumn("capabilities", F.array_union(F.coalesce("capabilities", none), F.coalesce("__more", none))).drop("__key", "__more")


def _expanded(entities: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """Rows under their own entity (exact) and under its parent, one hop."""
    up = entities.join(parents, entities[column] == parents["child"]).select(entities["*"], F.col("parent").alias("port_entity"), F.lit("parent").alias("match"))
    return entities.select("*", F.col(column).alias("port_entity"), F.lit("exact").alias("match")).union(up)


def _met(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` and ``right`` joined on ``key``, which may be frequent on both sides.

    A key's rows are dealt by their hash into blocks of about ``BLOCK``, and each block of one side meets each of the other:
    what is shuffled is a 1,000th of the pairs or the rows themselves, no task gets a whole key, and pairs are made last."""
    frequent = lambda df, n: F.broadcast(df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(n)).where(F.col(n) > 1))  # noqa: E731 one key in BLOCK rows at most
    blocks = {"__l": frequent(left, "__ln"), "__r": frequent(right, "__rn")}
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        rows = df.where(F.col(key).isNotNull()).join(blocks["__l"], key, "left").join(blocks["__r"], key, "left")
        at = F.pmod(F.xxhash64(*df.columns), F.coalesce(f"{own}n", F.lit(1))).cast("int").alias(own)
        each = F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}n", F.lit(1)) - 1)).alias(other)
        return rows.select(*df.columns, at, each).repartition(n, key, "__l", "__r")

    return dealt(left, "__l", "__r").join(dealt(right, "__r", "__l"), [key, "__l", "__r"]).drop("__l", "__r")


def forward_flow(intents: DataFrame, parents: DataFrame) -> DataFrame:
    """(from, to, entity, match, from_role, to_role): a produced entity meets a consumed one, itself or its parent."""
    p = ports(intents)
    made = _expanded(p.where("side = 'produces'").select(F.col("intent_id").alias("from"), F.col("entity").alias("made"), F.col("role").alias("from_role")), "made", parents)
    used = p.where("side = 'consumes'").select(F.col("intent_id").alias("to"), F.col("entity").alias("port_entity"), F.col("role").alias("to_role"))
    free = lambda c: F.coalesce(F.col(c) != "constraint", F.lit(True))
    return _met(made.where(free("from_role")), used.where(free("to_role")), "port_entity").where(F.col("from") != F.col("to")).select("from", "to", F.col("port_entity").alias("entity"), "match", "from_role", "to_role")


def lateral_flow(intents: DataFrame, parents: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, from_domain, to, to_domain, to_role): a bridge entity leads to a consumer in another domain.

    ``entities`` (name, kind, bridge_eligible). The source domain is that of the first intent, in order, that has
    another domain or none; one row for each entity and consumer.
    """
    held = entities.where("bridge_eligible AND coalesce(kind, '') <> 'observation' AND name IS NOT NULL").select(F.col("name").alias("held")).distinct()
    up = parents.groupBy(F.col("child").alias("held")).agg(F.sort_array(F.collect_set("parent")).alias("up"))  # an entity's parents
    none = F.array().cast("array<string>")
    at = held.join(up, "held", "left").select("held", F.array_union(F.array("held"), F.coalesce("up", none)).alias("ports")).select("held", "ports", F.explode("ports").alias("port_entity"))
    used = ports(intents).where("side = 'consumes' AND entity IS NOT NULL").select(F.col("intent_id").alias("to"), "pos", F.col("entity").alias("port_entity"), F.col("domain").alias("to_domain"), F.col("role").alias("to_role"))
    first = Window.partitionBy("to", "port_entity").orderBy("intent_ord", "pos")
    once = used.join(intents.select(F.col("id").alias("to"), "intent_ord"), "to").withColumn("rn", F.row_number().over(first)).where("rn = 1")
    # a consumer's first port of a held entity counts: it is told by the entities on the ports before, without a look at other pairs
    before = Window.partitionBy("to").orderBy("intent_ord", "pos", "port_entity").rowsBetween(Window.unboundedPreceding, -1)
    once = once.withColumn("before", F.collect_list("port_entity").over(before))
    # the first domain, in order of first intents, or for its own consumers the second
    domains = intents.groupBy(F.col("facets.domain").alias("d")).agg(F.min("intent_ord").alias("o")).orderBy(F.asc_nulls_last("o"), "d").limit(2)
    two = domains.agg(F.sort_array(F.collect_list(F.struct(F.col("o").isNull().alias("last"), "o", "d"))).alias("two"))
    one = F.coalesce(F.col("to_domain") != F.col("two")[0]["d"], F.lit(True))
    other = F.when(one, F.col("two")[0]["d"]).otherwise(F.get("two", F.lit(1))["d"])
    led = once.join(F.broadcast(two)).where(one | (F.size("two") > 1)).select("to", "port_entity", "to_domain", "to_role", other.alias("from_domain"), "before")
    found = _met(led, at, "port_entity").where((F.size("before") == 0) | ~F.arrays_overlap("before", "ports"))
    return found.select(F.col("held").alias("entity"), "from_domain", "to", "to_domain", "to_role")


def consumers_by_entity(intents: DataFrame, parents: DataFrame) -> DataFrame:
    """(held, intent_id, domain, role, port_entity, intent_ord): who consumes a held entity, itself or by its parent."""
    used = ports(intents).where("side = 'consumes' AND intent_id IS NOT NULL").join(intents.select(F.col("id").alias("intent_id"), "intent_ord"), "intent_id")
    # an intent's ports of one entity are one before they meet the entity's children, of whom each is there once
    w = Window.partitionBy("intent_id", "entity").orderBy("pos", "intent_ord")
    once = used.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("intent_id", "domain", "role", F.col("entity").alias("port_entity"), "intent_ord")
    kids = parents.where("NOT child <=> parent").select(F.col("child").alias("held"), F.col("parent").alias("port_entity")).distinct()
    out = ["held", "intent_id", "domain", "role", "port_entity", "intent_ord"]
    return once.withColumn("held", F.col("port_entity")).select(out).union(_met(once, kids, "port_entity").select(out))


def entity_index(intents: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(intent_id, produces, consumes) as sorted distinct entities, and (entity, members): itself and its children."""
    p = ports(intents)
    of = lambda side: F.sort_array(F.collect_set(F.when(F.col("side") == side, F.col("entity")))).alias(side)
    by_intent = p.groupBy("intent_id").agg(of("produces"), of("consumes"))
    all_ = parents.select(F.col("child").alias("entity")).union(parents.select("parent")).distinct()
    kids = parents.groupBy(F.col("parent").alias("entity")).agg(F.sort_array(F.collect_list("child")).alias("kids"))
    closure = all_.join(kids, "entity", "left").select("entity", F.concat(F.array("entity"), F.coalesce("kids", F.array().cast("array<string>"))).alias("members"))
    return by_intent, closure


def related_options(links: DataFrame, intents: DataFrame, best: DataFrame) -> DataFrame:
    """(intent_id, rank, relation, relation_label, group, target, label, note, endpoint_id): an intent's links by relation.

    One for each target; links to itself or to nothing fall out. ``best`` (intent_id, id) is each intent's endpoint.
    """
    order = F.array_position(F.array(*[F.lit(x) for x in RELATION_ORDER]), F.col("type"))
    known = intents.select(F.col("id").alias("to"), "label")
    rows = links.where("`from` <> `to`").join(known, "to").withColumn("o", order)
    once = rows.withColumn("rn", F.row_number().over(Window.partitionBy("from", "to").orderBy("o", "pos"))).where("rn = 1")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("from").orderBy("o", "pos", "to")))
    out = ranked.join(best.select(F.col("intent_id").alias("to"), F.col("id").alias("endpoint_id")), "to", "left")
    as_map = lambda d: F.create_map(*[F.lit(x) for p in d.items() for x in p])
    return out.select(F.col("from").alias("intent_id"), "rank", F.col("type").alias("relation"), F.element_at(as_map(RELATION_LABEL), F.col("type")).alias("relation_label"), F.element_at(as_map(RELATION_GROUP), F.col("type")).alias("group"), F.col("to").alias("target"), "label", "note", "endpoint_id")


def majority_domains(refs: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(intent_id, domain): the most frequent domain of an intent's references, the first seen of equal ones."""
    from .rank import refs_to_endpoints

    each = refs_to_endpoints(refs, endpoints).where("facets.domain IS NOT NULL").groupBy("intent_id", F.col("facets.domain").alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.min("ref_rank").alias("r"))
    w = Window.partitionBy("intent_id").orderBy(F.desc("n"), "r")
    return each.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("intent_id", "domain")
