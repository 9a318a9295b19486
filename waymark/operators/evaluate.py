"""Retrieval evaluation over query sets.

Ranks are tables (query_id, rank), null for a miss; every measure keeps misses in its denominator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.facets import query_facets
from ..functions.patterns import ascii_words
from ..functions.text import query_tokens, search_tokens

MISSING = 999


def _n(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def hit_at(k: int) -> Column:
    return F.coalesce(_n(F.col("rank") <= k) / F.count(F.lit(1)), F.lit(0.0))


def mrr() -> Column:
    return F.coalesce(F.sum(F.coalesce(1 / F.col("rank"), F.lit(0.0))) / F.count(F.lit(1)), F.lit(0.0))


def rank_of(hits: DataFrame, expected: DataFrame, on: str) -> DataFrame:
    """(query_id, rank): the best rank of the hits (query_id, rank, <on>) that match the expected (query_id, <on>)."""
    found = hits.join(expected.select("query_id", on), ["query_id", on]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return expected.select("query_id").distinct().join(found, "query_id", "left")


def discover_rank(hits: DataFrame, expected: DataFrame, refs: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(query_id, rank): the first hit that is the expected endpoint, or the expected intent where that has a reference
    that is indexed. ``hits`` (query_id, rank, kind, hit_id); ``expected`` (query_id, intent_id, endpoint_id)."""
    from .rank import refs_to_endpoints

    live = refs_to_endpoints(refs, endpoints).select("intent_id").distinct().withColumn("live", F.lit(True))
    want = expected.join(live, "intent_id", "left")
    ok = ((F.col("kind") == "endpoint") & (F.col("hit_id") == F.col("endpoint_id"))) | ((F.col("kind") == "capability") & (F.col("hit_id") == F.col("intent_id")) & F.col("live"))
    found = hits.join(want, "query_id").where(ok).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return expected.select("query_id").join(found, "query_id", "left")


def report(ranks: DataFrame, by: list[str]) -> DataFrame:
    """hit@1, hit@3, hit@5 and MRR for each value of ``by``."""
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), hit_at(1).alias("hit_1"), hit_at(3).alias("hit_3"), hit_at(5).alias("hit_5"), mrr().alias("mrr"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, before, after, change) of queries that improved or regressed; a miss ranks last."""
    a, b = before.select("query_id", F.coalesce("rank", F.lit(MISSING)).alias("before")), after.select("query_id", F.coalesce("rank", F.lit(MISSING)).alias("after"))
    both = a.join(b, "query_id", "full_outer").na.fill(MISSING, ["before", "after"])
    return both.where("before <> after").withColumn("change", F.when(F.col("after") < F.col("before"), "improved").otherwise("regressed"))


def method_table(ranks: DataFrame) -> DataFrame:
    """(method, n, disc_1, disc_3, mrr, tokens) of ranks (method, query_id, rank, tokens); percent of queries."""
    return ranks.groupBy("method").agg(F.count(F.lit(1)).alias("n"), (100 * hit_at(1)).alias("disc_1"), (100 * hit_at(3)).alias("disc_3"), mrr().alias("mrr"), F.avg("tokens").alias("tokens"))


def heldout(queries: DataFrame, hits: DataFrame, intents: DataFrame, low: float = 0.3) -> DataFrame:
    """(split, n, discover_1, discover_3, mean_overlap, low_overlap) by split, and in all with split null.

    ``queries`` (query_id, query, split, expect: array, first the anchor); ``hits`` (query_id, rank, intent_id).
    """
    own = intents.select(F.col("id").alias("anchor"), query_tokens(F.concat_ws(" ", "label", "aliases")).alias("vocab"))
    q = queries.withColumn("anchor", F.try_element_at("expect", F.lit(1))).join(F.broadcast(own), "anchor", "left").withColumn("words", query_tokens(F.col("query")))
    overlap = F.when(F.size("words") > 0, F.size(F.array_intersect("words", F.coalesce("vocab", F.array().cast("array<string>")))) / F.size("words")).otherwise(0.0)
    top = hits.join(queries.select("query_id", "expect"), "query_id").where(F.array_contains("expect", F.col("intent_id"))).groupBy("query_id").agg(F.min("rank").alias("rank"))
    rows = q.select("query_id", F.coalesce("split", F.lit("dev")).alias("split"), overlap.alias("overlap")).join(top, "query_id", "left")
    return rows.rollup("split").agg(F.count(F.lit(1)).alias("n"), _n(F.col("rank") <= 1).alias("discover_1"), _n(F.col("rank") <= 3).alias("discover_3"), F.avg("overlap").alias("mean_overlap"), _n(F.col("overlap") < low).alias("low_overlap"))


def multi_label(queries: DataFrame, hits: DataFrame, links: DataFrame) -> DataFrame:
    """One row: recalls at 1 and 3, hard negatives passed, related links found, queries with a facet.

    ``queries`` (query_id, query, kind, expect, related); ``hits`` (query_id, rank, intent_id); ``links`` (from, to).
    """
    top = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "intent_id")))).alias("t"))
    q = queries.join(top, "query_id", "left").withColumn("ids", F.coalesce(F.transform("t", lambda x: x["intent_id"]), F.array().cast("array<string>")))
    near = links.groupBy(F.col("from").alias("anchor")).agg(F.collect_set("to").alias("near"))
    q = q.withColumn("anchor", F.try_element_at("expect", F.lit(1))).join(F.broadcast(near), "anchor", "left")
    first = F.coalesce(F.array_contains("expect", F.try_element_at("ids", F.lit(1))), F.lit(False))
    none = F.array().cast("array<string>")
    related = F.coalesce("related", none)
    facets = query_facets(F.col("query"))
    tagged = facets["domain"].isNotNull() | facets["primary_entity"].isNotNull() | facets["output_entity"].isNotNull() | (F.size(facets["modality"]) > 0)
    return q.agg(
        F.count(F.lit(1)).alias("total"), _n(first).alias("recall_1"), _n(F.arrays_overlap("expect", "ids")).alias("recall_3"), _n((F.col("kind") == "hard_negative") & first).alias("hard_negative_pass"),
        _n(F.col("kind") == "hard_negative").alias("hard_negative_total"), F.coalesce(F.sum(F.size(F.array_intersect(related, F.coalesce("near", none)))), F.lit(0)).alias("related_found"),
        F.coalesce(F.sum(F.size(related)), F.lit(0)).alias("related_expected"), _n(tagged).alias("facet_coverage"),
    )


def resolve_accuracy(refs: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(intent_id, refs, found, ok): references of each intent that are indexed; ok with at least one."""
    from .rank import refs_to_endpoints

    found = refs_to_endpoints(refs, endpoints).groupBy("intent_id").agg(F.count(F.lit(1)).alias("found"))
    n = refs.groupBy("intent_id").agg(F.count(F.lit(1)).alias("refs"))
    return n.join(found, "intent_id", "left").na.fill(0, ["found"]).withColumn("ok", F.col("found") > 0)


def bridge_scenarios(scenarios: DataFrame, intents: DataFrame, parents: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, matched, missing, passed) of scenarios (id, held: array of entities, source_domain, expect, min_hits, max_lateral)."""
    from .graph import ports

    kids = F.broadcast(parents)
    bridges = entities.where("bridge_eligible").select(F.col("name").alias("e"))
    watched = entities.where("kind = 'observation'").select(F.col("name").alias("entity"))
    # names that are bridges, or children of one
    open_ = bridges.union(parents.join(bridges, F.col("parent") == F.col("e"), "left_semi").select("child")).distinct()
    held = scenarios.select("id", "source_domain", F.explode("held").alias("entity")).where("entity <> 'Query'")
    held = held.join(F.broadcast(watched), "entity", "left_anti").join(F.broadcast(open_), F.col("entity") == F.col("e"), "left_semi")
    reach = held.withColumn("port", F.col("entity")).union(held.join(kids, F.col("entity") == F.col("child")).select("entity", "id", "source_domain", F.col("parent").alias("port")))
    used = ports(intents).where("side = 'consumes'").select("intent_id", F.col("entity").alias("port"), "domain").join(F.broadcast(open_), F.col("port") == F.col("e"), "left_semi")
    hits = reach.join(used, "port").where("source_domain IS NULL OR domain IS NULL OR domain <> source_domain").groupBy("id").agg(F.sort_array(F.collect_set("intent_id")).alias("matched"))
    none = F.array().cast("array<string>")
    rows = scenarios.join(hits, "id", "left").withColumn("matched", F.coalesce("matched", none)).withColumn("expect", F.coalesce("expect", none))
    missing = F.array_except("expect", "matched")
    n = F.size(F.array_intersect("expect", "matched"))
    ok = F.when(F.col("max_lateral") == 0, F.size("matched") == 0).when(F.col("min_hits").isNotNull(), n >= F.col("min_hits")).otherwise(F.size(missing) == 0)
    return rows.select("id", "matched", missing.alias("missing"), ok.alias("passed"))


def usefulness(leads: DataFrame, judged: DataFrame, steps: DataFrame) -> DataFrame:
    """One row of measures of leads (step_id, rank, intent_id, domain, callable) for steps (step_id, held_bridge).

    ``judged`` (step_id, intent_id, good: boolean).
    """
    top = leads.where(F.col("rank") <= 8)
    m = top.join(judged, ["step_id", "intent_id"], "left")
    a = m.agg(
        F.avg(F.col("callable").cast("int")).alias("callable_precision"), (_n(F.col("good")) / F.greatest(_n(F.col("good").isNotNull()), F.lit(1))).alias("relevance_precision"),
        _n((F.col("rank") <= 6) & F.col("good")).alias("good_hits"), _n(~F.col("good")).alias("bad_hits"),
    )
    d = top.where("rank <= 6 AND domain IS NOT NULL").groupBy("step_id").agg(F.count_distinct("domain").alias("d")).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("domains"))
    s = steps.agg(F.count(F.lit(1)).alias("steps"), F.avg(F.col("held_bridge").cast("int")).alias("identity_recall"))
    g = judged.agg(_n(F.col("good")).alias("good_total"))
    one = a.crossJoin(d).crossJoin(s).crossJoin(g)  # a row each
    return one.select("callable_precision", "relevance_precision", "identity_recall", (F.col("good_hits") / F.greatest("good_total", F.lit(1))).alias("good_recall_6"), (F.col("bad_hits") / (F.col("steps") * 8)).alias("bad_rate_8"), (F.col("domains") / F.col("steps")).alias("domain_diversity"))


def next_step_recall(surfaced: DataFrame, gold: DataFrame, k: int = 8) -> DataFrame:
    """One row: macro, micro, truncated. ``surfaced`` (task_id, rank, intent_id), ``gold`` (task_id, intent_id)."""
    at = gold.join(surfaced, ["task_id", "intent_id"], "left")
    per = at.groupBy("task_id").agg(_n(F.col("rank") <= k).alias("hits"), F.count(F.lit(1)).alias("n"), _n(F.col("rank") > k).alias("cut"))
    return per.agg(F.avg(F.col("hits") / F.col("n")).alias("macro"), (F.sum("hits") / F.sum("n")).alias("micro"), F.sum("cut").alias("truncated"))


def judged_precision(hits: DataFrame, judgments: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """(arm, p_1, p_3): mean share of judged-good hits among a query's first k, by arm. ``hits`` (arm, query_id, rank, url)."""
    m = hits.join(judgments, ["query_id", "url"], "left").withColumn("ok", F.coalesce(F.col("good").cast("int"), F.lit(0)))
    per = m.groupBy("arm", "query_id").agg(*[F.coalesce(F.avg(F.when(F.col("rank") <= k, F.col("ok"))), F.lit(0.0)).alias(f"p_{k}") for k in ks])
    return per.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"p_{k}").alias(f"p_{k}") for k in ks])


def head_to_head(hits: DataFrame, judgments: DataFrame, a: str, b: str) -> DataFrame:
    """(outcome, n): queries whose first hit is good in both arms, neither, or one."""
    first = hits.where(F.col("rank") == 1).join(judgments, ["query_id", "url"], "left").select("arm", "query_id", F.coalesce("good", F.lit(False)).alias("ok"))
    side = lambda arm: first.where(F.col("arm") == arm).select("query_id", F.col("ok").alias(arm))
    both = side(a).join(side(b), "query_id", "full_outer").na.fill(False)
    outcome = F.when(F.col(a) & F.col(b), "both").when(F.col(a), f"only {a}").when(F.col(b), f"only {b}").otherwise("neither")
    return both.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def attribution(losses: DataFrame, hits: DataFrame, judgments: DataFrame, routed: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, bucket) of lost queries (query_id, intent_id): ranking if a good hit is among the first ``k``, else
    binding-coverage if the intent was routed, else routing."""
    good = hits.where(F.col("rank") <= k).join(judgments.where("good"), ["query_id", "url"], "left_semi").select("query_id").distinct().withColumn("has", F.lit(True))
    ok = routed.where(F.col("rank") <= k).select("query_id", "intent_id").distinct().withColumn("ok", F.lit(True))
    rows = losses.join(good, "query_id", "left").join(ok, ["query_id", "intent_id"], "left")
    return rows.select("query_id", F.when(F.col("has"), "ranking").when(F.col("ok"), "binding-coverage").otherwise("routing").alias("bucket"))


def probes(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """(config, probe, type, p_1, p_3, p_5, first_relevant, decoys_5) of hits (config, probe, rank, summary, url).

    ``rules`` (probe, type, relevant, relevant_path, decoy): patterns, null for none. A path that matches is relevant
    whatever the decoy says; a summary that matches only if the decoy doesn't.
    """
    path = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "^https?://", ""), "^[^/]+", "")
    test = lambda text, rule: F.coalesce(F.regexp_like(text, F.concat(F.lit("(?i)"), rule)), F.lit(False))
    m = hits.join(F.broadcast(rules), "probe").withColumn("path", path)
    by_path, decoy = test(F.col("path"), F.col("relevant_path")), test(F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.col("path")), F.col("decoy"))
    m = m.withColumn("rel", by_path | (test(F.coalesce("summary", F.lit("")), F.col("relevant")) & ~decoy)).withColumn("dec", decoy & ~by_path)
    at = lambda k: F.coalesce(F.avg(F.when(F.col("rank") <= k, F.col("rel").cast("int"))), F.lit(0.0)).alias(f"p_{k}")
    return m.groupBy("config", "probe", "type").agg(at(1), at(3), at(5), F.min(F.when(F.col("rel"), F.col("rank"))).alias("first_relevant"), _n((F.col("rank") <= 5) & F.col("dec")).alias("decoys_5"))


def probe_guard(scored: DataFrame, base: str) -> DataFrame:
    """(probe, config, drop): clean probes whose P@3 fell against the base configuration."""
    clean = scored.where("type = 'clean'")
    own = clean.where(F.col("config") == base).select("probe", F.col("p_3").alias("was"))
    return clean.where(F.col("config") != base).join(own, "probe").where("p_3 < was - 0.001").select("probe", "config", (F.col("was") - F.col("p_3")).alias("drop"))


def regression_gate(now: DataFrame, baseline: DataFrame, tolerance: float = 2.0, mrr_tolerance: float = 0.02) -> DataFrame:
    """(method, metric, now, baseline, ok): each metric at least the baseline's less a tolerance."""
    long = lambda df, name: df.select("method", F.expr("stack(3, 'disc_1', disc_1, 'disc_3', disc_3, 'mrr', mrr) AS (metric, value)")).withColumnRenamed("value", name)
    both = long(now, "now").join(long(baseline, "baseline"), ["method", "metric"])
    slack = F.when(F.col("metric") == "mrr", mrr_tolerance).otherwise(tolerance)
    return both.withColumn("ok", F.col("now") >= F.col("baseline") - slack)


def bare_url(url: Column) -> Column:
    """A URL without wrapping marks, query, fragment or closing slashes."""
    u = F.regexp_replace(F.trim(url), r"^[<`'\"(]+", "")
    u = F.regexp_replace(u, r"[>`'\".,)\]]+$", "")
    return F.regexp_replace(F.element_at(F.split(u, "[?#]"), 1), "/+$", "")


def picked_url(answer: Column) -> Column:
    """The URL of an answer's last line that says CHOSEN, else its last URL; null without one."""
    lines = F.filter(F.split(F.coalesce(answer, F.lit("")), r"\r?\n"), lambda x: x.rlike("(?i)CHOSEN"))
    chosen = F.regexp_extract(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")), r"https?://\S+", 0)
    urls = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"https?://\S+"), F.lit(0))
    return F.when(chosen != "", bare_url(chosen)).when(F.size(urls) > 0, bare_url(F.element_at(urls, -1)))


def agent_runs(runs: DataFrame, endpoints: DataFrame, refs: DataFrame, prefix: int = 17) -> DataFrame:
    """(backend, n, hits, known, tokens, calls) of runs (run_id, backend, expect, answer, tokens, calls).

    A picked URL is known if it is an endpoint's, or if one of the two begins with the other, that longer than 16
    characters: an equi-join on the first 17 and a check. It hits if it is in the expected intent's answer key.
    """
    own = endpoints.select(bare_url(F.concat("origin", "path")).alias("u"), "capabilities")
    picked = runs.withColumn("url", picked_url(F.col("answer")))
    near = own.where(F.length("u") >= prefix).select("u", F.left("u", F.lit(prefix)).alias("head")).distinct()
    lead = picked.where(F.length("url") >= prefix).withColumn("head", F.left("url", F.lit(prefix))).join(near, "head").where(F.col("url").startswith(F.col("u")) | F.col("u").startswith(F.col("url")))
    exact = picked.join(own.select("u").distinct(), picked["url"] == F.col("u"), "left_semi").select("run_id")
    known = exact.union(lead.select("run_id")).distinct().withColumn("known", F.lit(1))
    key = own.select("u", F.explode("capabilities").alias("expect")).union(refs.select(bare_url(F.concat("origin", "path")), F.col("intent_id"))).distinct()
    hit = picked.join(key, (picked["url"] == key["u"]) & (picked["expect"] == key["expect"]), "left_semi").select("run_id").distinct().withColumn("hit", F.lit(1))
    rows = picked.join(known, "run_id", "left").join(hit, "run_id", "left")
    return rows.groupBy("backend").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.coalesce(F.sum("known"), F.lit(0)).alias("known"), F.avg("tokens").alias("tokens"), F.avg("calls").alias("calls"))


def judging_pool(hits: DataFrame, arms: list[str], k: int = 3) -> DataFrame:
    """(query_id, url, arm, text): every arm's first ``k``, a URL once with the first arm's text."""
    order = F.array_position(F.array(*[F.lit(a) for a in arms]), F.col("arm"))
    w = Window.partitionBy("query_id", "url").orderBy("o", "rank")
    rows = hits.where((F.col("rank") <= k) & (order > 0)).withColumn("o", order)
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("query_id", "url", "arm", "text")


def judge_agreement(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """One row (n, agreement) of (query_id, url, good) tables."""
    both = pred.select("query_id", "url", F.col("good").alias("p")).join(gold.select("query_id", "url", F.col("good").alias("g")), ["query_id", "url"])
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p") == F.col("g")).cast("int")).alias("agreement"))


#: Fixed values of query generation: verbs that make a phrase useful, and what is put before and after it.
ACTION_WORDS = (
    r"(?i)\b(send|find|get|lookup|enrich|scrape|call|price|register|upload|solve|transcribe|generate|compare|track|search|convert|validate|check|create|host|tip|fax|email|buy|sell|rent|deploy|"
    r"analyze|monitor|fetch|extract|translate|summarize)\b"
)
PREFIXES = ("", "I need to ", "find a paid api to ", "agent wants to ")
SUFFIXES = ("", " via micropayment")


def generate_queries(intents: DataFrame, refs: DataFrame, endpoints: DataFrame, per_intent: int = 3) -> DataFrame:
    """(query_id, query, intent_id, endpoint_id): phrases of an intent in eight frames, the first ``per_intent`` of 12 to
    120 characters; an intent's first reference must be indexed, and a query stands once."""
    from ..functions.ids import endpoint_id

    first = refs.where("rank = 1").select("intent_id", endpoint_id(F.col("origin"), F.col("method"), F.col("path")).alias("endpoint_id")).join(endpoints.select(F.col("id").alias("endpoint_id")), "endpoint_id", "left_semi")
    none = F.array().cast("array<string>")
    phrases = F.array_distinct(F.filter(F.concat(F.array("label"), F.array("description"), F.coalesce("aliases", none)), lambda x: x.isNotNull()))
    each = intents.select(F.col("id").alias("intent_id"), "intent_ord", F.posexplode(phrases).alias("p", "phrase")).join(first, "intent_id")
    t = F.trim("phrase")
    useful = (F.length(t) >= 10) & ((F.length(t) >= 28) | t.rlike(ascii_words(ACTION_WORDS)) | (F.size(F.split(t, r"\s+")) >= 4))
    frames = [F.struct(F.lit(k).alias("f"), F.trim(F.concat(F.lit(a), F.col("phrase"), F.lit(b))).alias("query")) for k, (a, b) in enumerate((a, b) for a in PREFIXES for b in SUFFIXES)]
    rows = each.where(useful).select("intent_id", "intent_ord", "endpoint_id", "p", F.explode(F.array(*frames)).alias("x")).select("*", "x.f", "x.query").where(F.length("query").between(12, 120))
    w = Window.partitionBy("intent_id").orderBy("p", "f")
    kept = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_intent)
    once = kept.withColumn("rn", F.row_number().over(Window.partitionBy(F.lower(F.trim("query"))).orderBy("intent_ord", "n"))).where("rn = 1")
    return once.select(F.concat(F.translate("intent_id", "._", "--"), F.lit("-"), F.col("n")).alias("query_id"), "query", "intent_id", "endpoint_id")


def payload_tokens(hits: DataFrame, text: Column) -> DataFrame:
    """(query_id, tokens): a quarter of the characters of each query's rendered hits."""
    return hits.groupBy("query_id").agg(F.floor(F.sum(F.length(text)) / 4 + 0.5).cast("long").alias("tokens"))


def content_words(text: Column) -> Column:
    return F.array_distinct(search_tokens(text))
