"""Quality gate, record checks and mirror collapse of endpoint tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import bare_origin, host_of
from ..functions.patterns import matches, squeeze

# Paths, hosts and texts that the gate drops.
META_FILE = r"(?i)(/\.well-known/|/robots\.txt|/llms\.txt|sitemap|/favicon|openapi\.json|swagger\.json)"
META_PATH = r"(?i)^/(api/)?(health|healthz|status|ping|metrics|version|info)/?$"
BIND_META = r"(?i)(robots\.txt|llms\.txt|sitemap|\.well-known|openapi\.json|swagger\.json|/status$|favicon)"
STUB = r"(?i)^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)[ \t\n\r]+/"
PREVIEW_HOST = r"(?i)-git-[a-z0-9-]+\.vercel\.app$"
PAAS_HOST = r"(?i)(\.workers\.dev|\.up\.railway\.app|\.vercel\.app|\.run\.app|\.fly\.dev|\.onrender\.com)$"
CONTENT_FREE = ("premium api access", "premium api", "api access", "access to protected content", "protected content", "handler", "endpoint", "api endpoint", "protected endpoint")
BARE_PRICE = r"(?i)^\$?\d[\d.,]*[ \t\n\r]?(usdc?|usd|eth|dai|sol|matic)([ \t\n\r]+(on|per)[ \t\n\r]+[\w-]+)?$"
FIELDS, LEAST_FIELDS = 13, 5
STUB_SUMMARY = 20


def content_free(text: Column) -> Column:
    s = F.lower(squeeze(F.coalesce(text, F.lit(""))))
    return (s == "") | s.isin(*CONTENT_FREE) | matches(s, BARE_PRICE)


def _filled(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def _some(a: Column) -> Column:
    return F.coalesce(F.size(a) > 0, F.lit(False))


def completeness() -> Column:
    """How many of an endpoint's thirteen descriptive fields are filled."""
    c = F.col
    filled = [
        _filled(c("summary")),
        _filled(c("description")),
        F.coalesce(c("operation_id") != "", F.lit(False)),
        _some(c("tags")),
        _some(c("inputs")),
        c("payment.price_usd").isNotNull(),
        _some(c("payment.offers")),
        _some(c("payment.rails")),
        F.coalesce(c("payment.currency") != "", F.lit(False)),
        _some(c("service.categories")),
        F.coalesce(F.size(F.map_keys("service.docs")) > 0, F.lit(False)),
        F.coalesce(c("responses.has402"), F.lit(False)),
        F.coalesce(c("provider_title") != "", F.lit(False)),
    ]
    return sum((f.cast("int") for f in filled), F.lit(0))


def grade(endpoints: DataFrame) -> DataFrame:
    """``endpoints`` with verdict (pass or drop), reason, flags and completeness.

    Null texts count as empty. The first failing test gives the reason; dropped rows have no flags.
    """
    summary = F.trim(F.coalesce(F.col("summary"), F.lit("")))
    path, origin = F.coalesce(F.col("path"), F.lit("")), F.coalesce(F.col("origin"), F.lit(""))
    df = endpoints.withColumn("completeness", completeness())
    reason = (
        F.when(matches(path, META_FILE) | matches(path, META_PATH), "meta/well-known path")
        .when(matches(origin, PREVIEW_HOST), "ephemeral preview deploy")
        .when((summary == "") | matches(summary, STUB), "stub: synthesized summary")
        .when(content_free(F.col("summary")) & content_free(F.col("description")), "content-free summary (boilerplate)")
        .when(F.col("completeness") < LEAST_FIELDS, F.concat(F.lit("thin: only "), F.col("completeness"), F.lit(f"/{FIELDS} fields filled")))
    )
    offers, rails = _some(F.col("payment.offers")), _some(F.col("payment.rails"))
    priced = F.col("payment.price_usd").isNotNull()
    pays = F.coalesce(F.col("payment.paid"), F.lit(False)) | offers | priced | rails
    flags = F.array(
        F.when(~pays, "no-payment-detected"),
        F.when(pays & ~offers, "legacy-payment"),
        F.when(pays & ~priced, "price-dynamic-or-unknown"),
        F.when(F.coalesce(F.col("schema_missing"), F.lit(False)), "schema-missing"),
        F.when(offers & F.coalesce(~F.col("responses.has402"), F.lit(False)), "no-402-declared"),
    )
    df = df.withColumn("reason", reason).withColumn("verdict", F.when(F.col("reason").isNull(), "pass").otherwise("drop"))
    none = F.array().cast("array<string>")
    return df.withColumn("flags", F.when(F.col("verdict") == "pass", F.filter(flags, lambda x: x.isNotNull())).otherwise(none))


def passing(endpoints: DataFrame) -> DataFrame:
    return grade(endpoints).where("verdict = 'pass'").drop("verdict", "reason", "flags", "completeness")


def gate_summary(graded: DataFrame) -> DataFrame:
    """(kind, name, value): totals, mean completeness of what passes, counts by reason and by flag."""
    total = graded.agg(
        F.count(F.lit(1)).cast("double").alias("total"),
        F.count_if(F.col("verdict") == "pass").cast("double").alias("pass"),
        F.count_if(F.col("verdict") == "drop").cast("double").alias("drop"),
        F.coalesce(F.avg(F.when(F.col("verdict") == "pass", F.col("completeness"))), F.lit(0.0)).alias("avg_completeness"),
    )
    head = total.select(F.expr("stack(4, 'total', total, 'pass', `pass`, 'drop', `drop`, 'avg_completeness', avg_completeness) AS (name, value)")).select(F.lit("total").alias("kind"), "name", "value")
    each = graded.select(F.explode(F.concat(F.transform(F.array_compact(F.array("reason")), lambda x: F.struct(F.lit("reason").alias("kind"), x.alias("name"))), F.transform("flags", lambda x: F.struct(F.lit("flag").alias("kind"), x.alias("name"))))).alias("x"))
    return head.union(each.groupBy("x.kind", "x.name").agg(F.count(F.lit(1)).cast("double").alias("value")))


def bundle_stats(endpoints: DataFrame, intents: DataFrame) -> DataFrame:
    """One row: endpoints, capabilities, origins."""
    a = endpoints.agg(F.count(F.lit(1)).alias("endpoints"), F.count_distinct("origin").alias("origins"))
    return a.crossJoin(intents.agg(F.count(F.lit(1)).alias("capabilities"))).select("endpoints", "capabilities", "origins")  # a row each


def is_stub() -> Column:
    """No description, inputs, operation id or price, and a summary that is short or METHOD path."""
    summary = F.coalesce(F.col("summary"), F.lit(""))
    short = (F.length(summary) < STUB_SUMMARY) | (summary == F.concat_ws(" ", "method", "path"))
    bare = ~_filled(F.col("description")) & ~_some(F.col("inputs")) & F.coalesce(F.col("operation_id") == "", F.lit(True)) & F.col("payment.price_usd").isNull()
    return bare & short


def is_thin() -> Column:
    """Neither a declared 200 response nor inputs."""
    return ~F.coalesce(F.col("responses.has200"), F.lit(False)) & ~_some(F.col("inputs"))


#: Schema names of the record check.
PROTOCOLS = ("x402", "mpp")
CAPABILITY_ID = r"^[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)+$"


def record_errors(endpoints: DataFrame) -> DataFrame:
    """(id, errors) of records that break the schema."""
    bad = {
        "id": ~F.coalesce(F.col("id").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "origin": F.col("origin").isNull(),
        "method": ~F.coalesce(F.col("method").isin("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"), F.lit(False)),
        "path": F.col("path").isNull(),
        "summary": F.col("summary").isNull(),
        "payment": F.col("payment").isNull(),
        "search_text": F.col("search_text").isNull(),
        "price": F.coalesce(F.col("payment.price_usd") < 0, F.lit(False)),
        "capabilities": F.coalesce(F.exists("capabilities", lambda x: ~F.coalesce(x.rlike(CAPABILITY_ID), F.lit(False))), F.lit(False)),
        "protocol": F.coalesce(F.exists("payment.rails", lambda r: ~F.coalesce(r["protocol"].isin(*PROTOCOLS), F.lit(False))), F.lit(False)),
    }
    errors = F.filter(F.array(*[F.when(c, k) for k, c in bad.items()]), lambda x: x.isNotNull())
    return endpoints.select("id", errors.alias("errors")).where(F.size("errors") > 0)


def dedupe_mirrors(endpoints: DataFrame) -> DataFrame:
    """``endpoints`` without mirrors of one endpoint under other origins.

    Rows with the same method, lower-case path and squeezed lower-case summary are mirrors; without a summary,
    only rows of one origin are. The one whose host is no platform's stays, then the shortest host, then the
    first by ``ep_ord``. The long key is hashed before it is shuffled.
    """
    summary = F.lower(squeeze(F.coalesce(F.col("summary"), F.lit(""))))
    path = F.coalesce(F.col("path"), F.lit(""))
    shared = F.concat_ws("|", F.coalesce(F.col("method"), F.lit("")), F.lower(path), summary)
    own = F.concat_ws("|", F.lit("__uniq__"), F.coalesce(F.col("origin"), F.lit("")), F.coalesce(F.col("method"), F.lit("")), path)
    host = F.regexp_replace(F.coalesce(F.col("origin"), F.lit("")), "^https?://", "")
    w = Window.partitionBy("__key").orderBy(matches(host, PAAS_HOST).cast("int"), F.length(host), "ep_ord")
    keyed = endpoints.withColumn("__key", F.sha2(F.when(summary != "", shared).otherwise(own), 256))
    return keyed.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__key", "__rn")


def provider_slice() -> Column:
    """Which of three slices of the catalog an endpoint's provider is of: a scanner, the bazaar, or the rest."""
    fqn = F.coalesce(F.col("provider_fqn"), F.lit(""))
    return F.when(fqn.startswith("x402scan") | fqn.startswith("mppscan"), "scan").when(fqn.startswith("bazaar"), "bazaar").otherwise("rest")


def origin_hosts(endpoints: DataFrame) -> DataFrame:
    return endpoints.select(bare_origin(F.col("origin")).alias("origin"), host_of(F.col("origin")).alias("host")).distinct()
