"""Authored bindings and facet labels: applying, checking, deltas, merging and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash() -> Column:
    """First 16 hex digits of the SHA-256 over method, path, summary, description (by line feeds) and inputs (by bars)."""
    none = F.lit("")
    text = [F.coalesce(F.col(c), none) for c in ("method", "path", "summary", "description")]
    inputs = F.coalesce(F.array_join("inputs", "|"), none)
    return F.substring(F.sha2(F.concat_ws("\n", *text, inputs), 256), 1, 16)


def apply_bindings(endpoints: DataFrame, bindings: DataFrame) -> DataFrame:
    """``endpoints`` with the capabilities of authored bindings (origin, method, path, capabilities) in place of theirs."""
    key = lambda: F.concat_ws("|", F.regexp_replace("origin", "/$", ""), F.upper("method"), F.col("path"))
    own = bindings.select(key().alias("__key"), F.col("capabilities").alias("__caps")).dropDuplicates(["__key"])
    out = endpoints.withColumn("__key", key()).join(own, "__key", "left")
    return out.withColumn("capabilities", F.coalesce("__caps", "capabilities")).drop("__key", "__caps")


def apply_facets(endpoints: DataFrame, labels: DataFrame) -> DataFrame:
    """``endpoints`` with authored labels (key, domain, action, entity): output_entity is replaced or cleared."""
    own = labels.select(F.col("key").alias("id"), F.struct("domain", "action", "entity").alias("__l"))
    f, lab = F.col("facets"), F.col("__l")
    authored = F.struct(
        F.coalesce(lab["domain"], f["domain"]).alias("domain"), F.coalesce(lab["action"], f["action"]).alias("action"), f["primary_entity"].alias("primary_entity"),
        lab["entity"].alias("output_entity"), f["modality"].alias("modality"), F.lit(True).alias("authored"),
    )
    return endpoints.join(own, "id", "left").withColumn("facets", F.when(lab.isNotNull(), authored).otherwise(f)).drop("__l")


def load_labels(rows: DataFrame) -> DataFrame:
    """(key, domain, action, entity) of a label CSV's rows (with ``pos``): blank keys dropped, the corrected domain first,
    the last row of a key."""
    text = lambda c: F.when(F.trim(c) != "", F.trim(c))
    clean = rows.select(text("key").alias("key"), F.coalesce(text("domain_corrected"), text("regex_domain")).alias("domain"), text("action").alias("action"), text("entity").alias("entity"), "pos").where("key IS NOT NULL")
    w = Window.partitionBy("key").orderBy(F.desc("pos"))
    return clean.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "pos")


def label_delta(endpoints: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, status): new (no label), changed (both hashes there and different) or current."""
    now = endpoints.select("id", content_hash().alias("now"))
    old = labels.select(F.col("key").alias("id"), F.coalesce("content_hash", F.lit("")).alias("was"))
    status = F.when(F.col("was").isNull(), "new").when((F.col("was") != "") & (F.col("was") != F.col("now")), "changed").otherwise("current")
    return now.join(old, "id", "left").select("id", status.alias("status"))


def merge_labels(old: DataFrame, new: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Returned labels that have an action over the old ones, every hash computed anew where the endpoint is known.

    Of several labels of one key the last by ``pos`` counts, where the tables have it; then the least by their columns in order."""
    both = old.withColumn("p", F.lit(1)).unionByName(new.where("action IS NOT NULL AND trim(action) <> ''").withColumn("p", F.lit(0)))
    order = ["p", *[F.desc("pos")] * ("pos" in old.columns), *sorted(c for c in old.columns if c not in ("key", "pos"))]
    one = both.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where("rn = 1").drop("rn", "p")
    fresh = endpoints.select(F.col("id").alias("key"), content_hash().alias("__h"))
    return one.join(fresh, "key", "left").withColumn("content_hash", F.coalesce("__h", "content_hash")).drop("__h")


def newly_bound(before: DataFrame, after: DataFrame, n: int | None = None) -> DataFrame:
    """(id, intent_id) pairs bound after and not before; the first ``n`` by id, if given."""
    pairs = lambda df: df.select("id", F.explode("capabilities").alias("intent_id")).distinct()
    new = pairs(after).join(pairs(before), ["id", "intent_id"], "left_anti")
    return new.orderBy("id", "intent_id").limit(n) if n is not None else new


def worklist(endpoints: DataFrame, targets: list[str], noisy: dict[str, int]) -> DataFrame:
    """Label work: every endpoint of the target intents, and the first so many of each noisy one."""
    hit = F.arrays_overlap("capabilities", F.array(*[F.lit(t) for t in targets])) if targets else F.lit(False)
    rows = endpoints.withColumn("__t", F.coalesce(hit, F.lit(False)))
    caps = F.create_map(*[F.lit(x) for p in noisy.items() for x in p]) if noisy else None
    picked = rows.where("__t")
    if caps is not None:
        each = rows.where("NOT __t").withColumn("__i", F.explode("capabilities")).withColumn("__n", F.element_at(caps, F.col("__i"))).where("__n IS NOT NULL")
        w = Window.partitionBy("__i").orderBy("ep_ord")
        more = each.withColumn("__rn", F.row_number().over(w)).where("__rn <= __n").drop("__i", "__n", "__rn").dropDuplicates(["id"])
        picked = picked.unionByName(more)
    return picked.drop("__t")


WORK_COLUMNS = ("id", "origin", "method", "path", "summary", "description", "domain")


def write_worklist(work: DataFrame, path: str, parts: int = 1) -> None:
    """A work-list as CSV in order of ``ep_ord``, quoted as label files are read (:func:`..sources.registry.read_labels`), in as
    many files as labellers share it between; each has the header."""
    rows = work.select("ep_ord", *[c for c in WORK_COLUMNS[:-1] if c in work.columns], *([F.col("facets.domain").alias("domain")] if "facets" in work.columns else []))
    dealt = rows.repartitionByRange(parts, "ep_ord").sortWithinPartitions("ep_ord").drop("ep_ord")
    dealt.write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
