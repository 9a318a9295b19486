"""Audits of a bound catalog, and integrity of the intent graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import bare_host
from ..functions.text import bind_tokens
from .graph import ports

#: Compatible domains of the audit; the ranker's pairs differ (see tuning).
AUDIT_DOMAINS = (("travel", "maps"), ("maps", "travel"), ("finance", "crypto"), ("crypto", "finance"))
SYMMETRIC = ("alternative_of", "sibling_of")
TYPED = ("Place", "Company", "Person", "Product", "ProductCategory", "Domain", "CryptoAsset", "WalletAddress")


def orphans(endpoints: DataFrame) -> DataFrame:
    return endpoints.where("capabilities IS NULL OR size(capabilities) = 0")


def bind_rate(endpoints: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    b = F.count_if(F.size("capabilities") > 0)
    return endpoints.agg(n.alias("total"), b.alias("bound"), (n - b).alias("orphans"), (b / n).alias("bind_rate"))


def orphan_hosts(endpoints: DataFrame, k: int = 50, samples: int = 3) -> DataFrame:
    """(rank, host, n, samples): the hosts with the most orphans and the first paths of each."""
    rows = orphans(endpoints).select(bare_host(F.col("origin")).alias("host"), "ep_ord", "path")
    n = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.min("ep_ord").alias("o"))
    top = n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "o"))).where(F.col("rank") <= k)
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("host").orderBy("ep_ord"))).where(F.col("rn") <= samples)
    lists = first.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "path"))), lambda x: x["path"]).alias("samples"))
    return top.join(lists, "host").select("rank", "host", "n", "samples")


def uncovered_terms(endpoints: DataFrame, vocabulary: DataFrame, k: int = 100) -> DataFrame:
    """(rank, term, df, weight): orphans' terms that no intent has, by idf x df. ``vocabulary``: (term)."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("summary", "description", "path", "search_text")])
    own = orphans(endpoints)
    total = own.agg(F.count(F.lit(1)).alias("total"))
    df = own.select(F.explode(F.array_distinct(bind_tokens(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = df.join(F.broadcast(vocabulary), "term", "left_anti").crossJoin(total).withColumn("weight", F.col("df") * F.log(F.col("total") / (1 + F.col("df"))))  # one row of totals
    top = weighed.orderBy(F.desc("weight"), "term").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("weight"), "term"))).select("rank", "term", "df", "weight")


def orphan_prefixes(endpoints: DataFrame, k: int = 50) -> DataFrame:
    """(prefix, n): the most frequent two-part path beginnings of orphans."""
    parts = F.filter(F.split(F.coalesce("path", F.lit("")), "/"), lambda x: x != "")
    prefix = F.array_join(F.slice(parts, 1, 2), "/")
    return orphans(endpoints).groupBy(F.when(prefix == "", "(root)").otherwise(prefix).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "prefix").limit(k)


def binding_precision(endpoints: DataFrame, intents: DataFrame, pairs: tuple = AUDIT_DOMAINS) -> DataFrame:
    """Per intent and, as intent_id null, in all: bound, mismatches of domain and action, their denominators and rates."""
    own = intents.select(F.col("id").alias("intent_id"), F.col("facets.domain").alias("d"), F.col("facets.action").alias("a"))
    each = endpoints.select(F.explode("capabilities").alias("intent_id"), F.col("facets.domain").alias("ed"), F.col("facets.action").alias("ea")).join(F.broadcast(own), "intent_id")
    ok = F.col("ed") == F.col("d")
    for intent, endpoint in pairs:
        ok = ok | ((F.col("d") == intent) & (F.col("ed") == endpoint))
    dom, act = F.col("d").isNotNull() & F.col("ed").isNotNull(), F.col("a").isNotNull() & F.col("ea").isNotNull()
    sums = each.rollup("intent_id").agg(
        F.count(F.lit(1)).alias("bound"), F.count_if(dom & ~ok).alias("domain_mismatch"), F.count_if(dom).alias("domain_denom"), F.count_if(act & (F.col("ea") != F.col("a"))).alias("action_mismatch"), F.count_if(act).alias("action_denom")
    )
    rate = lambda n: F.when(F.col(f"{n}_denom") > 0, F.col(f"{n}_mismatch") / F.col(f"{n}_denom")).alias(f"{n}_rate")
    return sums.select("*", rate("domain"), rate("action"))


def bind_comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """(intent_id, before, after, delta): endpoints of each intent in two bindings."""
    n = lambda df, name: df.select(F.explode("capabilities").alias("intent_id")).groupBy("intent_id").agg(F.count(F.lit(1)).alias(name))
    both = n(before, "before").join(n(after, "after"), "intent_id", "full_outer").na.fill(0, ["before", "after"])
    return both.select("intent_id", "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def catalog_rollup(refs: DataFrame, hosts: int = 8, samples: int = 6) -> DataFrame:
    """(intent_id, endpoints, hosts, samples): an intent's references, most frequent hosts and first paths."""
    from ..functions.ids import host_of

    rows = refs.select("intent_id", "rank", "path", host_of(F.col("origin")).alias("host"))
    n = rows.groupBy("intent_id").agg(F.count(F.lit(1)).alias("endpoints"))
    by_host = rows.groupBy("intent_id", "host").agg(F.count(F.lit(1)).alias("c"), F.min("rank").alias("r"))
    w = Window.partitionBy("intent_id").orderBy(F.desc("c"), "r")
    top = by_host.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= hosts).groupBy("intent_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "host"))), lambda x: x["host"]).alias("hosts"))
    first = rows.where(F.col("rank") <= samples).groupBy("intent_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("samples"))
    return n.join(top, "intent_id").join(first, "intent_id")


def integrity(intents: DataFrame, links: DataFrame, related: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(kind, intent_id, target): issues of an intent graph.

    ``links`` (from, type, to), ``related`` (from, to), ``vocabulary`` (entity). Kinds: self_link, dangling_link,
    dangling_related, unknown_entity, asymmetric_link, pipes_to_flow.
    """
    ids = intents.select(F.col("id").alias("to")).distinct()
    issue = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("from").alias("intent_id"), F.col("to").alias("target"))
    other = links.where("`from` <> `to`")
    back = links.select(F.col("from").alias("to"), F.col("to").alias("from"), F.col("type").alias("back"))
    p = ports(intents)
    sets = p.groupBy("intent_id").agg(F.collect_set(F.when(F.col("side") == "produces", F.col("entity"))).alias("made"), F.collect_set(F.when(F.col("side") == "consumes", F.col("entity"))).alias("used"))
    pipes = links.where("type = 'pipes_to'").join(ids, "to", "left_semi").join(sets.select(F.col("intent_id").alias("from"), "made"), "from").join(sets.select(F.col("intent_id").alias("to"), "used"), "to")
    unknown = p.join(F.broadcast(vocabulary), "entity", "left_anti").select(F.lit("unknown_entity").alias("kind"), "intent_id", F.col("entity").alias("target"))
    return (
        issue(links.where("`from` = `to`"), "self_link")
        .union(issue(related.where("`from` = `to`"), "self_link"))
        .union(issue(other.join(ids, "to", "left_anti"), "dangling_link"))
        .union(issue(related.where("`from` <> `to`").join(ids, "to", "left_anti"), "dangling_related"))
        .union(unknown)
        .union(issue(other.where(F.col("type").isin(*SYMMETRIC)).join(back, ["from", "to"]).where("back <> type").dropDuplicates(["from", "to", "type"]), "asymmetric_link"))
        .union(issue(pipes.where((F.size("made") > 0) & (F.size("used") > 0) & ~F.arrays_overlap("made", "used")), "pipes_to_flow"))
    )


def contributed(intents: DataFrame, known: DataFrame, entities: DataFrame, links: DataFrame) -> DataFrame:
    """(id, valid, errors, warnings) of contributed intents.

    ``known`` (id); ``entities`` (name, kind, deprecated, absorbs): an absorbed name counts as known; ``links`` (from, to).
    """
    vocabulary = entities.select("name", "kind", F.coalesce("deprecated", F.lit(False)).alias("deprecated")).union(
        entities.select(F.explode("absorbs").alias("name"), F.lit(None).cast("string"), F.lit(False))
    ).dropDuplicates(["name"])
    at = ports(intents).join(F.broadcast(vocabulary), F.col("entity") == F.col("name"), "left")
    text = lambda head: F.concat(F.lit(head), F.lit(": "), F.col("entity"))
    error = F.when(F.col("name").isNull(), text("unknown entity")).when(F.col("kind") == "abstract", text("abstract entity")).when(F.col("deprecated"), text("deprecated entity"))
    errors = at.select(F.col("intent_id").alias("id"), error.alias("e")).where("e IS NOT NULL").distinct()
    label = F.lower(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("description", F.lit(""))))
    typed = F.exists(F.array(*[F.lit(t.lower()) for t in TYPED]), lambda t: F.contains(label, t))
    asks = ports(intents).where("entity = 'Query'").select(F.col("intent_id").alias("id")).distinct()
    warnings = (
        intents.select("id").join(known.select("id"), "id", "left_anti").select("id", F.lit("new capability").alias("w"))
        .union(links.join(known.select(F.col("id").alias("to")), "to", "left_anti").where("`from` <> `to`").select(F.col("from").alias("id"), F.concat(F.lit("unknown link target: "), F.col("to"))).distinct())
        .union(intents.where(typed).join(asks, "id", "left_semi").select("id", F.lit("a typed entity may apply")))
    )
    none = F.array().cast("array<string>")
    e = errors.groupBy("id").agg(F.sort_array(F.collect_list("e")).alias("errors"))
    w = warnings.groupBy("id").agg(F.sort_array(F.collect_list("w")).alias("warnings"))
    out = intents.select("id").join(e, "id", "left").join(w, "id", "left")
    return out.select("id", F.col("errors").isNull().alias("valid"), F.coalesce("errors", none).alias("errors"), F.coalesce("warnings", none).alias("warnings"))


def check_bindings(bindings: DataFrame, endpoints: DataFrame, known: DataFrame) -> DataFrame:
    """(level, subject): unknown capabilities are errors, endpoint keys that aren't indexed warnings."""
    key = lambda: F.concat_ws("|", F.regexp_replace("origin", "/$", ""), F.upper("method"), F.col("path"))
    caps = bindings.select(F.explode("capabilities").alias("id")).distinct().join(known.select("id"), "id", "left_anti").select(F.lit("error").alias("level"), F.col("id").alias("subject"))
    keys = bindings.select(key().alias("k")).distinct().join(endpoints.select(key().alias("k")).distinct(), "k", "left_anti").select(F.lit("warning"), F.col("k"))
    return caps.union(keys)


def check_queries(queries: DataFrame, refs: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(query_id, problem) of an evaluation set: ``queries`` (query_id, intent_id, endpoint_id)."""
    no_intent = queries.where("intent_id IS NOT NULL").join(refs.select("intent_id").distinct(), "intent_id", "left_anti").select("query_id", F.lit("intent without candidates").alias("problem"))
    no_endpoint = queries.where("endpoint_id IS NOT NULL").join(endpoints.select(F.col("id").alias("endpoint_id")), "endpoint_id", "left_anti").select("query_id", F.lit("endpoint not indexed"))
    return no_intent.union(no_endpoint)


def coverage(losing: DataFrame, endpoints: DataFrame, k: int = 20) -> DataFrame:
    """(host, losses, present): the hosts that lost the most, absent ones first. ``losing``: (origin)."""
    have = endpoints.select(bare_host(F.col("origin")).alias("host")).distinct().withColumn("present", F.lit(True))
    n = losing.groupBy(bare_host(F.col("origin")).alias("host")).agg(F.count(F.lit(1)).alias("losses"))
    out = n.join(have, "host", "left").withColumn("present", F.coalesce("present", F.lit(False)))
    return out.orderBy("present", F.desc("losses"), "host").limit(k)


def provider_corpus(endpoints: DataFrame) -> DataFrame:
    """(provider, id, text): the first endpoint of each provider, or of its origin, with the provider's text."""
    provider = F.coalesce(F.when(F.col("provider_fqn") != "", F.col("provider_fqn")), F.col("origin"))
    w = Window.partitionBy("provider").orderBy("ep_ord")
    first = endpoints.withColumn("provider", provider).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return first.select("provider", "id", F.lower(F.concat_ws(" ", "provider", "provider_title", "summary", "search_text")).alias("text"))


def entity_rollup(intents: DataFrame) -> DataFrame:
    """(entity, produced_by, consumed_by): the intents with the entity on a port, once for each port, in their order."""
    sides = ports(intents).join(intents.select(F.col("id").alias("intent_id"), "intent_ord"), "intent_id")
    at = F.struct("intent_ord", "pos", "intent_id")
    of = lambda side: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == side, at))), lambda x: x["intent_id"])
    return sides.groupBy("entity").agg(of("produces").alias("produced_by"), of("consumes").alias("consumed_by"))


def domain_rollup(intents: DataFrame, refs: DataFrame) -> DataFrame:
    """(domain, intents, endpoints): a domain's intents in their order and their references; without a domain: other."""
    n = refs.groupBy("intent_id").agg(F.count(F.lit(1)).alias("n"))
    own = intents.select(F.col("id").alias("intent_id"), "intent_ord", F.coalesce("facets.domain", F.lit("other")).alias("domain"))
    names = F.transform(F.sort_array(F.collect_list(F.struct("intent_ord", "intent_id"))), lambda x: x["intent_id"])
    return own.join(n, "intent_id", "left").groupBy("domain").agg(names.alias("intents"), F.coalesce(F.sum("n"), F.lit(0)).alias("endpoints"))
