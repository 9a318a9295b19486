"""Evaluation queries: labelled documents, orders and events as query sets, hits and judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facets, text
from ..operators import evaluate
from . import views as v
from .binding import _ALL_ARM
from .catalog import _tok
from .flow import L as _LINKS
from .views import E, M, with_

S, D = SparkSession, DataFrame


def _hits(spark: S, sf: str) -> D:
    """Lines as hits: an order is a query, its return flag the arm, a line number the rank, the part the URL."""
    return v.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank")).agg(F.min("l_partkey").cast("string").alias("url"))


def _judgments(spark: S, sf: str) -> D:
    """Quality labels as judgments of parts, for every order that has the part."""
    lab = v.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("url"), (F.col("quality") == 1).alias("good"))
    return _hits(spark, sf).select("query_id", "url").distinct().join(lab, "url")


def _ranks(spark: S, sf: str, flag: str) -> D:
    """(query_id, rank): where an order's first part of its cheapest supplier stands among its lines with a flag."""
    li = v.table(spark, sf, "lineitem")
    want = li.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.min("l_suppkey").alias("k"))
    hits = li.where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("l_suppkey").alias("k"))
    return evaluate.rank_of(hits, want, "k")


def mode_report(spark: S, sf: str) -> D:
    rows = None
    for flag in ("A", "N", "R"):
        one = _ranks(spark, sf, flag).withColumn("mode", F.lit(flag))
        rows = one if rows is None else rows.union(one)
    out = evaluate.report(rows, ["mode"])
    return out.select("mode", "n", *[F.round(c, 6).alias(c) for c in ("hit_1", "hit_3", "hit_5", "mrr")])


def rank_changes(spark: S, sf: str) -> D:
    return evaluate.compare(_ranks(spark, sf, "A"), _ranks(spark, sf, "N"))


def method_table(spark: S, sf: str) -> D:
    li = v.table(spark, sf, "lineitem")
    ranks = li.groupBy(F.col("l_linestatus").alias("method"), F.col("l_orderkey").alias("query_id")).agg(F.min(F.when(F.col("l_quantity") > 25, F.col("l_linenumber"))).alias("rank"), F.sum("l_quantity").alias("tokens"))
    return evaluate.method_table(ranks).select("method", "n", *[F.round(c, 6).alias(c) for c in ("disc_1", "disc_3", "mrr", "tokens")])


def regression_gate(spark: S, sf: str) -> D:
    li = v.table(spark, sf, "lineitem")

    def table(rows: D) -> D:
        return evaluate.method_table(rows.groupBy(F.col("l_linestatus").alias("method"), F.col("l_orderkey").alias("query_id")).agg(F.min(F.when(F.col("l_quantity") > 25, F.col("l_linenumber"))).alias("rank"), F.sum("l_quantity").alias("tokens")))

    return evaluate.regression_gate(table(li), table(li.where("l_returnflag <> 'R'"))).select("method", "metric", F.round("now", 6).alias("now"), F.round("baseline", 6).alias("baseline"), "ok")


def judged_precision(spark: S, sf: str) -> D:
    out = evaluate.judged_precision(_hits(spark, sf), _judgments(spark, sf))
    return out.select("arm", "n", F.round("p_1", 6).alias("p_1"), F.round("p_3", 6).alias("p_3"))


def head_to_head(spark: S, sf: str) -> D:
    return evaluate.head_to_head(_hits(spark, sf), _judgments(spark, sf), "A", "N")


def loss_attribution(spark: S, sf: str) -> D:
    hits = _hits(spark, sf)
    losses = v.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") % 16).alias("intent_id"))
    routed = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), (F.col("l_suppkey") % 16).alias("intent_id"))
    return evaluate.attribution(losses, hits.where("arm = 'A'"), _judgments(spark, sf), routed).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def judging_pool(spark: S, sf: str) -> D:
    hits = _hits(spark, sf).withColumn("text", F.concat("arm", F.lit(":"), "rank"))
    return evaluate.judging_pool(hits, ["N", "A"]).select("query_id", "url", "arm", "text")


def judge_agreement(spark: S, sf: str) -> D:
    gold = _judgments(spark, sf)
    pred = gold.withColumn("good", F.col("url").cast("long") % 7 != 0)
    return evaluate.judge_agreement(pred, gold).select("n", F.round("agreement", 6).alias("agreement"))


def payload_sizes(spark: S, sf: str) -> D:
    """Tokens of what each order's hits would send to a model."""
    hits = _hits(spark, sf)
    return evaluate.payload_tokens(hits, F.concat("arm", F.lit(":"), "url"))


def heldout(spark: S, sf: str) -> D:
    from .binding import _order

    q = v.queries(spark, sf)
    ids = F.array(*[F.lit(x) for x in v.IDS])
    one = q.groupBy("query", "ph").agg(F.min("query_id").alias("query_id"))
    own = one.select("query_id", "query", F.when(F.col("query_id") % 2 == 0, "test").alias("split"), F.array(F.element_at(ids, (F.col("ph") + 1).cast("int"))).alias("expect"))
    return evaluate.heldout(own, _order(spark, sf), v.intents(spark, sf)).select("split", "n", "discover_1", "discover_3", F.round("mean_overlap", 6).alias("mean_overlap"), "low_overlap")


def multi_label(spark: S, sf: str) -> D:
    from .binding import _order
    from .flow import _links

    ids = F.array(*[F.lit(x) for x in v.IDS])
    one = v.queries(spark, sf).groupBy("query", "ph").agg(F.min("query_id").alias("query_id"))
    at = lambda k: F.element_at(ids, ((F.col("ph") + k) % 16 + 1).cast("int"))
    own = one.select("query_id", "query", F.when(F.col("query_id") % 3 == 0, "hard_negative").otherwise("multi_label").alias("kind"), F.array(at(0), at(1)).alias("expect"), F.array(at(2), at(5)).alias("related"))
    return evaluate.multi_label(own, _order(spark, sf), _links(spark, sf))


def resolve_accuracy(spark: S, sf: str) -> D:
    refs = v.refs(spark, sf).select("intent_id", "origin", "method", "path").distinct().withColumn("rank", F.lit(1))
    half = v.endpoints(spark, sf).groupBy("origin", "method", "path").agg(F.min("ep_ord").alias("o")).where("o % 2 = 0")
    return evaluate.resolve_accuracy(refs, half)


def next_step_recall(spark: S, sf: str) -> D:
    li = v.table(spark, sf, "lineitem")
    surfaced = li.groupBy(F.col("l_orderkey").alias("task_id"), (F.col("l_suppkey") % 16).alias("intent_id")).agg(F.min("l_linenumber").alias("rank"))
    gold = li.select(F.col("l_orderkey").alias("task_id"), (F.col("l_partkey") % 16).alias("intent_id")).distinct()
    return evaluate.next_step_recall(surfaced, gold, 3).select(F.round("macro", 6).alias("macro"), F.round("micro", 6).alias("micro"), "truncated")


def generated_queries(spark: S, sf: str) -> D:
    return evaluate.generate_queries(v.intents(spark, sf), _first_refs(spark, sf), _by_key(spark, sf)).select("query_id", "query", "intent_id")


def _first_refs(spark: S, sf: str) -> D:
    return v.refs(spark, sf)


def _by_key(spark: S, sf: str) -> D:
    """Endpoints under the id of their key."""
    from ..functions.ids import endpoint_id

    return v.endpoints(spark, sf).select(endpoint_id(F.col("origin"), F.col("method"), F.col("path")).alias("id")).distinct()


def picked_urls(spark: S, sf: str) -> D:
    """Agents' answers made of orders and pages: the URL picked from each."""
    p = v.table(spark, sf, "pages").select("page_id", F.concat(F.lit("Looking at `https://first.example.com/x?q=1`.\n"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("CHOSEN: <"), F.col("url"), F.lit(">.\nDone, see https://last.example.com/y/"))).otherwise(F.concat(F.lit("so "), F.col("url"), F.lit(")")))).alias("answer"))
    return p.select("page_id", evaluate.picked_url(F.col("answer")).alias("url"))


def agent_runs(spark: S, sf: str) -> D:
    """Customers as runs of three backends that pick an endpoint's URL, a longer one, or none."""
    e = v.endpoints(spark, sf)
    ids = F.array(*[F.lit(x) for x in v.IDS])
    first = e.groupBy("ph").agg(F.min_by(F.concat("origin", "path"), "ep_ord").alias("u"))
    c = v.queries(spark, sf).join(first, "ph")
    runs = c.select(F.col("query_id").alias("run_id"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("query_id") % 3 + 1).cast("int")).alias("backend"), F.element_at(ids, (F.col("query_id") % 16 + 1).cast("int")).alias("expect"), F.when(F.col("k") < 4, F.concat(F.lit("CHOSEN "), "u")).when(F.col("k") < 7, F.concat(F.lit("see "), "u", F.lit("/more"))).otherwise("none").alias("answer"), F.col("k").cast("double").alias("tokens"), F.lit(1.0).alias("calls"))
    refs = v.refs(spark, sf).select("intent_id", "origin", "path")
    return evaluate.agent_runs(runs, e, refs).select("backend", "n", "hits", "known", F.round("tokens", 6).alias("tokens"), "calls")


def probe_scores(spark: S, sf: str) -> D:
    """Keyword hits of each phrase as probes: relevant, path and decoy patterns from the phrases' own words."""
    from .binding import _arm

    e = v.endpoints(spark, sf)
    hits = _arm(spark, sf, e).join(e.select("id", "summary", F.concat("origin", "path").alias("url"), "ph"), "id").join(v.queries(spark, sf).select("query_id", F.col("ph").alias("qph")), "query_id")
    rules = v.intents(spark, sf).select(F.col("intent_ord").alias("probe"), F.when(F.col("intent_ord") % 2 == 0, "clean").otherwise("collision").alias("type"), F.regexp_extract("label", r"^(\w+ \w+)", 1).alias("relevant"), F.when(F.col("intent_ord") % 4 == 0, F.lit("/economy/")).alias("relevant_path"), F.when(F.col("intent_ord") % 3 == 0, F.lit("/1[0-9]$")).alias("decoy"))
    rules = rules.withColumn("relevant", F.when(F.col("relevant") != "", F.col("relevant")))
    rows = hits.select(F.when(F.col("query_id") % 2 == 0, "on").otherwise("off").alias("config"), F.col("qph").alias("probe"), "query_id", "rank", "summary", "url", F.col("ep_ord"))
    return evaluate.probes(rows, rules).select("config", "probe", "type", *[F.round(c, 6).alias(c) for c in ("p_1", "p_3", "p_5")], "first_relevant", "decoys_5")


_AT = "min(l_suppkey) OVER (PARTITION BY l_orderkey)"
_RANKS = "w AS (SELECT l_orderkey AS q, min(l_suppkey) AS k FROM lineitem GROUP BY 1),\n" + ",\n".join(f"r{f} AS (SELECT w.q, min(l_linenumber) AS rank FROM w LEFT JOIN lineitem ON l_orderkey = q AND l_suppkey = k AND l_returnflag = '{f}' GROUP BY 1)" for f in "ANR")
_HITS = "h AS (SELECT l_returnflag AS arm, l_orderkey AS q, l_linenumber AS rank, CAST(min(l_partkey) AS VARCHAR) AS url FROM lineitem GROUP BY 1, 2, 3),\nj AS (SELECT DISTINCT h.q, url, quality = 1 AS good FROM h JOIN labels ON CAST(doc_id AS VARCHAR) = url)"
_REP = "SELECT '{0}' AS mode, count(*) AS n, round(count(*) FILTER (rank <= 1) / count(*), 6) AS hit_1, round(count(*) FILTER (rank <= 3) / count(*), 6) AS hit_3, round(count(*) FILTER (rank <= 5) / count(*), 6) AS hit_5, round(sum(coalesce(1 / rank, 0)) / count(*), 6) AS mrr FROM r{0}"
_MT = "SELECT method, count(*) AS n, 100 * count(*) FILTER (rank <= 1) / count(*) AS disc_1, 100 * count(*) FILTER (rank <= 3) / count(*) AS disc_3, sum(coalesce(1 / rank, 0)) / count(*) AS mrr, avg(tokens) AS tokens FROM (SELECT l_linestatus AS method, l_orderkey, min(CASE WHEN l_quantity > 25 THEN l_linenumber END) AS rank, sum(l_quantity) AS tokens FROM lineitem {} GROUP BY 1, 2) GROUP BY 1"

_IDS = "[" + ", ".join(f"'{x}'" for x in v.IDS) + "]"
_WORDS = f"list_distinct({_tok(text.QUERY_STOP, 2)})"
_UNIQUE = ",\nu AS (SELECT query, ph, min(query_id) AS query_id FROM q GROUP BY 1, 2)"
_HELDOUT = (
    _ALL_ARM + _UNIQUE
    + f""",
    uo AS (SELECT u.query_id, CASE WHEN u.query_id % 2 = 0 THEN 'test' ELSE 'dev' END AS split, i.intent_id,
        {_WORDS.format('query')} AS words, {_WORDS.format('label')} AS vocab FROM u LEFT JOIN i ON i.ph = u.ph),
    ur AS (SELECT uo.query_id, min(ord.rank) AS rank FROM uo JOIN ord ON ord.query_id = uo.query_id AND ord.intent_id = uo.intent_id GROUP BY 1),
    ov AS (SELECT split, rank, CASE WHEN len(words) > 0 THEN len(list_intersect(words, coalesce(vocab, []))) / len(words) ELSE 0 END AS overlap
        FROM uo LEFT JOIN ur USING (query_id))
    SELECT split, count(*) AS n, count(*) FILTER (rank <= 1) AS discover_1, count(*) FILTER (rank <= 3) AS discover_3,
        round(avg(overlap), 6) AS mean_overlap, count(*) FILTER (overlap < 0.3) AS low_overlap FROM ov GROUP BY ROLLUP (split)"""
)
_CUES = " OR ".join(f"{v.first_of('lower(query)', t)} IS NOT NULL" for t in (facets.DOMAIN_CUES, facets.ENTITY_CUES, facets.OUTPUT_CUES))
_MULTI_LABEL = (
    _ALL_ARM + _UNIQUE + ",\n" + _LINKS
    + f""",
    x AS (SELECT query_id, query, query_id % 3 = 0 AS hard, [{_IDS}[ph % 16 + 1], {_IDS}[(ph + 1) % 16 + 1]] AS expect,
        [{_IDS}[(ph + 2) % 16 + 1], {_IDS}[(ph + 5) % 16 + 1]] AS related FROM u),
    top AS (SELECT query_id, list(intent_id ORDER BY rank) AS ids FROM ord WHERE rank <= 3 GROUP BY 1),
    near AS (SELECT src AS anchor, list(DISTINCT dst) AS near FROM l GROUP BY 1),
    y AS (SELECT x.*, coalesce(ids, []) AS ids, coalesce(near, []) AS near, coalesce(list_contains(expect, ids[1]), false) AS first,
        {_CUES} OR len({v.all_of('lower(query)', facets.MODALITY_CUES)}) > 0 AS tagged
        FROM x LEFT JOIN top USING (query_id) LEFT JOIN near ON anchor = expect[1])
    SELECT count(*) AS total, count(*) FILTER (first) AS recall_1, count(*) FILTER (list_has_any(expect, ids)) AS recall_3,
        count(*) FILTER (hard AND first) AS hard_negative_pass, count(*) FILTER (hard) AS hard_negative_total,
        CAST(sum(len(list_intersect(related, near))) AS BIGINT) AS related_found, CAST(sum(len(related)) AS BIGINT) AS related_expected,
        count(*) FILTER (tagged) AS facet_coverage FROM y"""
)
_PROBES = (
    _ALL_ARM
    + """,
    ph AS (SELECT CASE WHEN arm.query_id % 2 = 0 THEN 'on' ELSE 'off' END AS config, q.ph AS probe, arm.rank, e.summary,
        regexp_replace(regexp_replace(concat(e.origin, e.path), '^https?://', ''), '^[^/]+', '') AS path
        FROM arm JOIN e USING (id) JOIN q ON q.query_id = arm.query_id),
    ru AS (SELECT ph AS probe, CASE WHEN ph % 2 = 0 THEN 'clean' ELSE 'collision' END AS type,
        nullif(regexp_extract(label, '^(\\w+ \\w+)', 1), '') AS relevant FROM i),
    pm AS (SELECT config, probe, type, rank, (probe % 4 = 0 AND contains(lower(path), '/economy/')) AS by_path,
        (probe % 3 = 0 AND regexp_matches(concat_ws(' ', summary, path), '/1[0-9]$')) AS decoy,
        coalesce(contains(lower(summary), lower(relevant)), false) AS named FROM ph JOIN ru USING (probe)),
    pr AS (SELECT *, by_path OR (named AND NOT decoy) AS rel FROM pm)
    SELECT config, probe, type, """
    + ", ".join(f"round(coalesce(avg(CAST(rel AS INTEGER)) FILTER (rank <= {k}), 0), 6) AS p_{k}" for k in (1, 3, 5))
    + ", min(rank) FILTER (rel) AS first_relevant, count(*) FILTER (rank <= 5 AND decoy AND NOT by_path) AS decoys_5 FROM pr GROUP BY 1, 2, 3"
)

ALL = {
    "mode_report": (mode_report, "WITH " + _RANKS + "\n" + " UNION ALL ".join(_REP.format(f) for f in "ANR")),
    "rank_changes": (rank_changes, "WITH " + _RANKS + "\nSELECT q AS query_id, a AS before, b AS after, CASE WHEN b < a THEN 'improved' ELSE 'regressed' END AS change FROM (SELECT rA.q, coalesce(rA.rank, 999) AS a, coalesce(rN.rank, 999) AS b FROM rA JOIN rN USING (q)) WHERE a <> b"),
    "method_table": (method_table, "SELECT method, n, round(disc_1, 6) AS disc_1, round(disc_3, 6) AS disc_3, round(mrr, 6) AS mrr, round(tokens, 6) AS tokens FROM (" + _MT.format("") + ")"),
    "regression_gate": (
        regression_gate,
        "WITH a AS (" + _MT.format("") + "), b AS (" + _MT.format("WHERE l_returnflag <> 'R'") + "), x AS (" + " UNION ALL ".join(f"SELECT a.method, '{m}' AS metric, a.{m} AS now, b.{m} AS baseline, {t} AS slack FROM a JOIN b USING (method)" for m, t in (("disc_1", 2.0), ("disc_3", 2.0), ("mrr", 0.02)))
        + ") SELECT method, metric, round(now, 6) AS now, round(baseline, 6) AS baseline, now >= baseline - slack AS ok FROM x",
    ),
    "judged_precision": (
        judged_precision,
        "WITH " + _HITS + ", p AS (SELECT arm, h.q, coalesce(avg(CASE WHEN rank <= 1 THEN CASE WHEN good THEN 1.0 ELSE 0 END END), 0) AS p1, coalesce(avg(CASE WHEN rank <= 3 THEN CASE WHEN good THEN 1.0 ELSE 0 END END), 0) AS p3 FROM h LEFT JOIN j ON j.q = h.q AND j.url = h.url GROUP BY 1, 2) SELECT arm, count(*) AS n, round(avg(p1), 6) AS p_1, round(avg(p3), 6) AS p_3 FROM p GROUP BY 1",
    ),
    "head_to_head": (
        head_to_head,
        "WITH " + _HITS + ", f AS (SELECT arm, h.q, coalesce(good, false) AS ok FROM h LEFT JOIN j ON j.q = h.q AND j.url = h.url WHERE rank = 1), b AS (SELECT coalesce(x.ok, false) AS a, coalesce(y.ok, false) AS n FROM (SELECT * FROM f WHERE arm = 'A') x FULL JOIN (SELECT * FROM f WHERE arm = 'N') y USING (q)) "
        "SELECT CASE WHEN a AND n THEN 'both' WHEN a THEN 'only A' WHEN n THEN 'only N' ELSE 'neither' END AS outcome, count(*) AS n FROM b GROUP BY 1",
    ),
    "loss_attribution": (
        loss_attribution,
        "WITH " + _HITS + ", l AS (SELECT o_orderkey AS q, o_custkey % 16 AS i FROM orders WHERE o_orderstatus = 'F'), g AS (SELECT DISTINCT h.q FROM h JOIN j ON j.q = h.q AND j.url = h.url WHERE good AND rank <= 3 AND arm = 'A'), r AS (SELECT DISTINCT l_orderkey AS q, l_suppkey % 16 AS i FROM lineitem WHERE l_linenumber <= 3) "
        "SELECT CASE WHEN g.q IS NOT NULL THEN 'ranking' WHEN r.q IS NOT NULL THEN 'binding-coverage' ELSE 'routing' END AS bucket, count(*) AS n FROM l LEFT JOIN g USING (q) LEFT JOIN r ON r.q = l.q AND r.i = l.i GROUP BY 1",
    ),
    "judging_pool": (
        judging_pool,
        "WITH " + _HITS + " SELECT q AS query_id, url, arm, concat(arm, ':', rank) AS text FROM (SELECT *, row_number() OVER (PARTITION BY q, url ORDER BY list_position(['N', 'A'], arm), rank) AS rn FROM h WHERE rank <= 3 AND arm <> 'R') WHERE rn = 1",
    ),
    "judge_agreement": (judge_agreement, "WITH " + _HITS + " SELECT count(*) AS n, round(avg(CASE WHEN (CAST(url AS BIGINT) % 7 <> 0) = good THEN 1.0 ELSE 0 END), 6) AS agreement FROM j"),
    "payload_sizes": (payload_sizes, f"WITH {_HITS} SELECT q AS query_id, CAST(floor(sum(length(concat(arm, ':', url))) / 4 + 0.5) AS BIGINT) AS tokens FROM h GROUP BY 1"),
    "heldout": (heldout, _HELDOUT),
    "multi_label": (multi_label, _MULTI_LABEL),
    "resolve_accuracy": (
        resolve_accuracy,
        "WITH " + M + ",\nk AS (SELECT DISTINCT intent_id, origin, method, path FROM m), hf AS (SELECT origin, method, path FROM e GROUP BY ALL HAVING min(ep_ord) % 2 = 0) SELECT intent_id, count(*) AS refs, count(hf.origin) AS found, count(hf.origin) > 0 AS ok FROM k LEFT JOIN hf USING (origin, method, path) GROUP BY 1",
    ),
    "next_step_recall": (
        next_step_recall,
        "WITH s AS (SELECT l_orderkey AS t, l_suppkey % 16 AS i, min(l_linenumber) AS r FROM lineitem GROUP BY 1, 2), g AS (SELECT DISTINCT l_orderkey AS t, l_partkey % 16 AS i FROM lineitem), p AS (SELECT g.t, count(*) FILTER (r <= 3) AS h, count(*) AS n, count(*) FILTER (r > 3) AS c FROM g LEFT JOIN s USING (t, i) GROUP BY 1) "
        "SELECT round(avg(h / n), 6) AS macro, round(sum(h) / sum(n), 6) AS micro, CAST(sum(c) AS BIGINT) AS truncated FROM p",
    ),
    "generated_queries": (
        generated_queries,
        "WITH " + M + ",\nfr AS (SELECT '' AS a, '' AS b, 0 AS f UNION ALL SELECT '', ' via micropayment', 1 UNION ALL SELECT 'I need to ', '', 2 UNION ALL SELECT 'I need to ', ' via micropayment', 3 UNION ALL SELECT 'find a paid api to ', '', 4 UNION ALL SELECT 'find a paid api to ', ' via micropayment', 5 UNION ALL SELECT 'agent wants to ', '', 6 UNION ALL SELECT 'agent wants to ', ' via micropayment', 7),\n"
        f"g AS (SELECT i.intent_id, i.ph, trim(concat(a, label, b)) AS query, f FROM i, fr WHERE i.intent_id IN (SELECT intent_id FROM m WHERE rank = 1) AND length(label) >= 10 AND (length(label) >= 28 OR regexp_matches(label, '{evaluate.ACTION_WORDS}') OR len(string_split(label, ' ')) >= 4)),\n"
        "n AS (SELECT *, row_number() OVER (PARTITION BY intent_id ORDER BY f) AS k FROM g WHERE length(query) BETWEEN 12 AND 120) SELECT concat(translate(intent_id, '._', '--'), '-', k) AS query_id, query, intent_id FROM n WHERE k <= 3",
    ),
    "picked_urls": (
        picked_urls,
        "SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '[>`.,)\\]]+$', ''), '^[^?#]*', 0), '/+$', '') AS url FROM pages",
    ),
    "agent_runs": (
        agent_runs,
        "WITH " + M + ",\n" + v.Q + ",\nfu AS (SELECT ph, arg_min(concat(origin, path), ep_ord) AS u FROM e GROUP BY 1), ru AS (SELECT query_id, list_extract(['a', 'b', 'c'], query_id % 3 + 1) AS backend, query_id % 16 AS x, k, CASE WHEN k < 4 THEN u WHEN k < 7 THEN concat(u, '/more') END AS url, u FROM q JOIN fu USING (ph)),\n"
        "key AS (SELECT DISTINCT ip AS x, concat(origin, path) AS u FROM caps JOIN e USING (id))\n"
        "SELECT backend, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM key WHERE key.x = ru.x AND key.u = ru.url)) AS hits, count(url) AS known, round(avg(k), 6) AS tokens, 1.0 AS calls FROM ru GROUP BY 1",
    ),
    "probe_scores": (probe_scores, _PROBES),
}
