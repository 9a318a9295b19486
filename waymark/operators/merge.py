"""Merging of registry rows, enriched rows and prior rows into one endpoint table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import endpoint_key, host_of
from .gate import is_stub

STALE_DAYS = 30
SOURCE_ORDER = ("bazaar", "mpp", "paysh", "x402scan")


def first_source(inline: DataFrame) -> DataFrame:
    """``inline`` rows (with ``source``), the first source's row of each origin|METHOD|path, then the first by ep_ord."""
    order = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SOURCE_ORDER]), F.col("source")), F.lit(0))
    w = Window.partitionBy("__key").orderBy(F.when(order == 0, 1000).otherwise(order), "ep_ord")
    keyed = inline.withColumn("__key", endpoint_key(F.col("origin"), F.col("method"), F.col("path")))
    return keyed.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__key", "__rn")


def origin_sources(rows: DataFrame) -> DataFrame:
    """(origin, source): the first source, in order, that named an origin."""
    order = F.array_position(F.array(*[F.lit(s) for s in SOURCE_ORDER]), F.col("source"))
    return rows.groupBy("origin").agg(F.min(F.struct(F.when(order == 0, 1000).otherwise(order).alias("o"), "source")).alias("s")).select("origin", F.col("s.source").alias("source"))


def override(inline: DataFrame, enriched: DataFrame, sources: DataFrame) -> DataFrame:
    """Enriched rows, and the inline rows of origins that have none. A missing provider becomes source/host.

    The big side is joined with distinct origins only.
    """
    tag = F.concat_ws("/", F.coalesce("source", F.lit("openapi")), host_of(F.col("origin")))
    own = enriched.join(sources, "origin", "left").withColumn("provider_fqn", F.coalesce(F.when(F.col("provider_fqn") != "", F.col("provider_fqn")), tag)).drop("source")
    rest = inline.join(enriched.select("origin").distinct(), "origin", "left_anti")
    return own.unionByName(rest.drop("source") if "source" in rest.columns else rest, allowMissingColumns=True)


def carry_forward(merged: DataFrame, prior: DataFrame, built_at: Column, days: int = STALE_DAYS) -> DataFrame:
    """``merged`` and the prior rows of origins not seen this run, unless their built_at is older than ``days``.

    A built_at that doesn't parse keeps its row.
    """
    return merged.unionByName(_carried(merged, prior, built_at, days).where("NOT __stale").drop("__stale"), allowMissingColumns=True)


def _carried(merged: DataFrame, prior: DataFrame, built_at: Column, days: int) -> DataFrame:
    unseen = prior.join(merged.select("origin").distinct(), "origin", "left_anti")
    age = built_at.cast("timestamp").cast("double") - F.col("built_at").try_cast("timestamp").cast("double")
    return unseen.withColumn("__stale", F.coalesce(age > days * 86_400, F.lit(False)))


def carry_report(merged: DataFrame, prior: DataFrame, built_at: Column, days: int = STALE_DAYS) -> DataFrame:
    """One row: carried, evicted."""
    return _carried(merged, prior, built_at, days).agg(F.count_if(~F.col("__stale")).alias("carried"), F.count_if("__stale").alias("evicted"))


def merge_two(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer merge of two tables by id, field by field: id and the merged columns.

    The preferred record is the one that is no stub, else the one with the longer summary (``a`` of equal ones);
    its missing fields come from the other; paid if either is; search texts are joined.
    """
    fields = ["origin", "method", "path", "operation_id", "summary", "description", "inputs", "tags", "provider_fqn", "provider_title", "category", "payment", "search_text"]
    side = lambda df, p: df.withColumn("__stub", is_stub()).select(F.col("id").alias(f"{p}id"), *[F.col(c).alias(f"{p}{c}") for c in [*fields, "__stub"]])
    both = side(a, "a_").join(side(b, "b_"), F.col("a_id") == F.col("b_id"), "full_outer")
    c = F.col
    longer = F.length("b_summary") > F.length("a_summary")
    take_b = F.when(c("a_id").isNull(), True).when(c("b_id").isNull(), False).when(c("a___stub") & ~c("b___stub"), True).when(~c("a___stub") & c("b___stub"), False).otherwise(F.coalesce(longer, F.lit(False)))
    both = both.withColumn("__b", take_b)
    pick = lambda n: F.when(c("__b"), c(f"b_{n}")).otherwise(c(f"a_{n}"))
    other = lambda n: F.when(c("__b"), c(f"a_{n}")).otherwise(c(f"b_{n}"))
    filled = lambda n: F.when(F.size(pick(n)) > 0, pick(n)).otherwise(F.coalesce(other(n), pick(n)))
    p, o = pick("payment"), other("payment")
    payment = F.struct(
        F.coalesce(p["price_usd"], o["price_usd"]).alias("price_usd"),
        (F.coalesce(p["paid"], F.lit(False)) | F.coalesce(o["paid"], F.lit(False))).alias("paid"),
        F.when(F.size(p["rails"]) > 0, p["rails"]).otherwise(F.coalesce(o["rails"], p["rails"])).alias("rails"),
    )
    return both.select(
        F.coalesce("a_id", "b_id").alias("id"),
        *[F.coalesce(pick(n), other(n)).alias(n) for n in ("origin", "method", "path", "summary", "description", "operation_id", "provider_title", "category")],
        filled("inputs").alias("inputs"),
        filled("tags").alias("tags"),
        F.coalesce("a_provider_fqn", "b_provider_fqn").alias("provider_fqn"),
        payment.alias("payment"),
        F.trim(F.concat_ws(" ", F.when(c("a_search_text") != "", c("a_search_text")), F.when(c("b_search_text") != "", c("b_search_text")))).alias("search_text"),
    )


def fold(rows: DataFrame) -> DataFrame:
    """Any number of records of one id, merged in ``ep_ord`` order, field by field: a row for each id.

    A record leads from its place on if all before it are stubs and it is none, or, among equals in that, if its summary
    is longer than all of theirs. Each field comes from the last leader that has it, then from the others in order;
    paid if any is; search texts are joined in order. An id has as many records as sources named it.
    """
    c = F.col
    seen = Window.partitionBy("id").orderBy("ep_ord")
    lead = F.struct((~is_stub()).cast("int").alias("own"), F.length(F.coalesce("summary", F.lit(""))).alias("n"))
    at = rows.withColumn("__lead", lead).withColumn("__pos", F.row_number().over(seen))
    best = F.max("__lead").over(seen.rowsBetween(Window.unboundedPreceding, -1))
    at = at.withColumn("__at", F.when(best.isNull() | (c("__lead") > best), -c("__pos")).otherwise(c("__pos")))
    text = lambda n: F.min_by(n, F.when(c(n).isNotNull(), c("__at")))
    many = lambda x: F.coalesce(F.min_by(x, F.when(F.size(x) > 0, c("__at"))), F.min_by(x, F.when(x.isNotNull(), c("__at"))))
    price, said = c("payment.price_usd"), F.trim(F.coalesce("search_text", F.lit("")))
    return at.groupBy("id").agg(
        *[text(n).alias(n) for n in ("origin", "method", "path", "operation_id", "summary", "description", "provider_title", "category")],
        many(c("inputs")).alias("inputs"),
        many(c("tags")).alias("tags"),
        F.min_by("provider_fqn", F.when(c("provider_fqn").isNotNull(), c("__pos"))).alias("provider_fqn"),
        F.max(F.coalesce("payment.paid", F.lit(False))).alias("paid"),
        F.min_by(price, F.when(price.isNotNull(), c("__at"))).alias("price_usd"),
        many(c("payment.rails")).alias("rails"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(said != "", F.struct("__pos", said.alias("t"))))), lambda x: x["t"]), " ").alias("search_text"),
    )
