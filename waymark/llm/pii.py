"""Personal data by boosted trees over candidate spans, in DataFrame functions only.

Four validated patterns give the base spans. High-recall generators propose further candidates, which may
overlap each other and the base: addresses spelled with (at), addresses of four parts in brackets or of eight
hexadecimal groups, card numbers of 13 digits or more with any separator, telephone numbers without a plus sign.
A candidate that passes its base pattern's check is an example for its kind, one that can't be personal data by
its form is an example against, and one of a relaxed form is what the trees decide about.

Every candidate has a handful of features of format and context, each a yes or no, none of which is the check or
what sets the relaxed forms apart. Examples counted by kind, features and half (of the texts, by their hash) make a
table that the number of feature combinations bounds. Gradient boosting learns from one half; the other calibrates
each kind's threshold: the lowest score from which on ``PRECISION`` of the examples are for the kind (with one of
either added, so a few examples prove nothing). What reaches it and has a relaxed form is added, except where a
base span has the place.

The trees become one column expression; texts are read once, and no Python runs on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved
from .names import free

KINDS = ("email", "ip", "card", "phone")

#: Base patterns. Possessive and anchored at the start of a run, so that long runs take linear time; they match what
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, [0-9]+(\.[0-9]+){3}, [0-9]([ -]?[0-9])+ and
#: \+[0-9][ ().0-9-]+[0-9] match, leftmost and without overlap.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Generators: what may be personal data, far too much of it. Possessive, for linear time.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9.-]++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]++(?:(?:\.|\[\.\])[0-9]++){3,7}+|[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){3,7}+)",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20.-]?[0-9]){11,18}+(?![0-9])",
    "phone": r"(?:\G|(?<![0-9+(]))[+(]?[0-9][\x20().0-9/-]{5,20}[0-9](?![0-9])",
}

#: Relaxed forms that the base patterns don't take.
RELAXED = {
    "email": r"\A[A-Za-z0-9._%+-]+\x20?[(\[]at[)\]]\x20?(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,12}\z",
    "ip": r"\A(?:[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7})\z",
    "card": r"\A[0-9]{2,6}(?:[\x20.-]?[0-9]{2,6})+\z",
    "phone": r"\A(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-]{1,2}[0-9]{2,8}){1,4}\z",
}

#: Words near a span that speak for its kind.
CUES = {
    "email": "mail|contact|write|send",
    "ip": "ip|host|server|addr|login|client",
    "card": "card|visa|credit|debit|master|amex|pay",
    "phone": "phone|tel|call|mobile|cell|fax|dial|contact",
}
CONTEXT = 32

#: Candidates' features, from the lowest bit.
FEATURES = ("cue before", "cue after", "blank before", "blank after", "line", "grouped", "usual length", "uniform", "layout", "lead", "dotted")
#: How a kind's parts are usually laid out, and how it usually begins.
LAYOUT = {
    "email": r"[A-Za-z]{2,12}\z",
    "ip": r"\A[0-9]{1,3}(?:[.\[\]]{1,3}[0-9]{1,3}){3}\z",
    "card": r"\A(?:[0-9]{13,19}|[0-9]{4}(?:[\x20.-][0-9]{4,6}){2,3}(?:[\x20.-][0-9]{1,3})?)\z",
    "phone": r"\([0-9]{2,5}\)|(?<![0-9])[0-9]{3}[\x20./-][0-9]{4}\z",
}
LEAD = {
    "email": r"\A[A-Za-z]",
    "ip": r"\A(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])(?![0-9])",
    "card": r"\A4",
    "phone": r"\A\+?\(?(?:0|1|[2-9][0-9]{0,2})(?![0-9])",
}

TREES, RATE, L2, PRECISION = 24, 0.3, 1.0, 0.9
#: Matches whose places are summed up at once; the sums of such blocks are summed up in turn.
BLOCK = 64

_PLACED = "array<struct<s:int,e:int,m:string,b:string,a:string>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def found(text: Column, pattern: str) -> Column:
    """Matches of a pattern, leftmost and without overlap: array of (s, e, m, b, a), in characters, end exclusive.

    ``b`` and ``a`` are up to ``CONTEXT`` characters before and after, as far as the next match.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def zipped(h: Column, g: Column) -> Column:
        each = F.arrays_zip(F.slice(g, 1, F.size(h)).alias("g"), h.alias("m"), F.slice(g, 2, F.size(h)).alias("n"))
        return F.transform(
            each,
            lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["m"]).alias("n"), x["m"].alias("m"), F.right(x["g"], F.lit(CONTEXT)).alias("b"), F.left(x["n"], F.lit(CONTEXT)).alias("a")),
        )

    def block(z: Column, k: Column) -> Column:
        return F.aggregate(
            F.slice(z, k * BLOCK + 1, BLOCK),
            F.struct(F.lit(0).alias("at"), F.array().cast(_PLACED).alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["g"] + x["n"]).alias("at"),
                F.concat(
                    acc["out"],
                    F.array(F.struct((acc["at"] + x["g"]).alias("s"), (acc["at"] + x["g"] + x["n"]).alias("e"), x["m"].alias("m"), x["b"].alias("b"), x["a"].alias("a"))),
                ).alias("out"),
            ),
        )

    def shifted(blocks: Column) -> Column:
        bases = F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )
        moved = lambda y, o: F.struct((y["s"] + o).alias("s"), (y["e"] + o).alias("e"), y["m"].alias("m"), y["b"].alias("b"), y["a"].alias("a"))
        return F.flatten(F.zip_with(blocks, bases, lambda x, o: F.transform(x["out"], lambda y: moved(y, o))))

    of = let(zipped(hits, gaps), lambda z: let(F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda k: block(z, k)), shifted))
    return F.when(text.rlike(pattern), of).otherwise(F.array().cast(_PLACED))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(d))
    total = F.aggregate(
        places,
        F.lit(0),
        lambda s, k: s + F.element_at(F.when((F.length(d) - k) % 2 == 1, F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])).otherwise(F.array(*[F.lit(v) for v in range(10)])), F.coalesce(F.substring(d, k, F.lit(1)).try_cast("int"), F.lit(0)) + 1),
    )
    return F.when(F.length(d) > 0, total % 10 == 0).otherwise(F.lit(False))


def passes(kind: str, m: Column) -> Column:
    """A kind's check of a match of its pattern."""
    if kind == "email":
        return m.rlike(r"\A[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++\z")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return (F.size(F.split(m, r"\.")) == 4) & F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    d = digits(m)
    if kind == "card":
        return F.length(d).between(16, 19) & m.rlike(r"\A[0-9](?:[\x20-]?[0-9])++\z") & F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))
    return F.length(d).between(8, 15) & m.rlike(r"\A\+[0-9][\x20().0-9-]+[0-9]\z")


def relaxed(kind: str, m: Column) -> Column:
    """Whether a candidate that is no base span has a form that personal data can have."""
    d = digits(m)
    form = m.rlike(RELAXED[kind])
    if kind == "ip":
        return form & F.forall(F.split(m, r"\[\.\]"), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return form & F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return form & F.length(d).between(7, 15) & ~m.rlike(r"\A[0-9]{4}[./-][0-9]{2}[./-][0-9]{2}\z|\A[0-9]{1,3}(?:\.[0-9]{1,3}){3}\z")
    return form


def _bits(kind: str, x: Column) -> Column:
    """A candidate's features as bits."""
    d, m = digits(x["m"]), x["m"]
    usual = {"email": F.length(m).between(8, 48), "ip": F.length(m).between(7, 39), "card": F.length(d).between(13, 19), "phone": F.length(d).between(9, 12)}[kind]
    cue = rf"(?<![a-z])(?:{CUES[kind]})"
    flags = (
        F.lower(x["b"]).rlike(cue),
        F.lower(x["a"]).rlike(cue),
        x["b"].rlike(r"(?:\A|[\s:(\"'<=>|;,])\z"),
        x["a"].rlike(r"\A(?:[\s,;.)\"'>!?|<]|\z)"),
        x["b"].rlike(r"\n[^\n]{0,8}\z"),
        m.rlike(r"[0-9][\x20().:\[\]-]{1,3}[0-9]"),
        usual,
        d.rlike(r"\A([0-9])\1*\z") if kind != "email" else m.rlike(r"(.)\1\1"),
        m.rlike(LAYOUT[kind]),
        m.rlike(LEAD[kind]),
        F.contains(m, F.lit(".")),
    )
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(flags)), F.lit(0))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, half, base_<kind>: array of (s, e), loose_<kind>: array of (s, e, bits, side)) of every row.

    ``side`` is 1 for examples of the kind, 0 for those against, -1 for what is to be decided. Null texts count as
    empty, which have no candidates; repeated rows and null ids are searched each by itself; an empty table gives
    no rows; other columns are not read. Time and memory are linear in the length of a text and its matches.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hits = [found(text, BASE[k]).alias(f"b_{k}") for k in KINDS] + [found(text, LOOSE[k]).alias(f"l_{k}") for k in KINDS]
    rows = rows.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"), *hits)

    def base(k: str) -> Column:
        return F.transform(F.filter(f"b_{k}", lambda x: passes(k, x["m"])), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(f"base_{k}")

    def side(k: str, m: Column) -> Column:
        return F.when(passes(k, m), 1).when(relaxed(k, m), -1).otherwise(0)

    def loose(k: str) -> Column:
        return F.transform(f"l_{k}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _bits(k, x).alias("bits"), side(k, x["m"]).alias("side"))).alias(f"loose_{k}")

    return rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "half", *[base(k) for k in KINDS], *[loose(k) for k in KINDS])


@dataclass
class Tree:
    """Two levels of questions about feature bits, and the four leaves' values (no-no, no-yes, yes-no, yes-yes)."""

    first: int
    second: tuple[int, int]
    leaves: tuple[float, float, float, float]

    def value(self, bits: int) -> float:
        a = bits >> self.first & 1
        return self.leaves[2 * a + (bits >> self.second[a] & 1)]

    def column(self, bits: Column) -> Column:
        yes = lambda k: bits.bitwiseAND(F.lit(1 << k)) != 0
        low, high = self.second
        return F.when(yes(self.first), F.when(yes(high), self.leaves[3]).otherwise(self.leaves[2])).otherwise(F.when(yes(low), self.leaves[1]).otherwise(self.leaves[0]))


@dataclass
class Booster:
    base: float
    trees: list[Tree]
    threshold: float  # a score from which on a candidate counts; infinite if none does
    held_out: tuple[int, int] = (0, 0)  # examples of the calibrating half that reach it, and those for the kind

    def score(self, bits: int) -> float:
        return self.base + sum(t.value(bits) for t in self.trees)

    def column(self, bits: Column) -> Column:
        return sum((t.column(bits) for t in self.trees), F.lit(self.base))


def boost(table: dict[int, tuple[int, int]], held_out: dict[int, tuple[int, int]]) -> Booster:
    """Gradient boosting of logistic loss on counts: feature bits -> (examples, those for the kind), of either half."""
    n, ok = sum(a for a, _ in table.values()), sum(b for _, b in table.values())
    if not n or not ok:
        return Booster(0.0, [], math.inf)
    base = math.log((ok + 0.5) / (n - ok + 0.5))
    score = dict.fromkeys(table, base)
    trees: list[Tree] = []
    for _ in range(TREES):
        grad, hess = {}, {}
        for b, (a, y) in table.items():
            p = 1 / (1 + math.exp(-score[b]))
            grad[b], hess[b] = y - a * p, a * p * (1 - p)

        def gain(rows: list[int]) -> float:
            return sum(grad[b] for b in rows) ** 2 / (sum(hess[b] for b in rows) + L2)

        def split(rows: list[int]) -> tuple[float, int]:
            return max((gain([b for b in rows if b >> k & 1]) + gain([b for b in rows if not b >> k & 1]), -k) for k in range(len(FEATURES)))

        # of equal trees the one whose first question tells most by itself
        halved = {k: ([b for b in table if not b >> k & 1], [b for b in table if b >> k & 1]) for k in range(len(FEATURES))}
        first = max(halved, key=lambda k: (round(sum(split(h)[0] for h in halved[k]), 9), round(sum(map(gain, halved[k])), 9), -k))
        halves = [[b for b in table if (b >> first & 1) == side] for side in (0, 1)]
        second = tuple(-split(rows)[1] for rows in halves)
        leaves = []
        for side in (0, 1):
            for low in (0, 1):
                rows = [b for b in halves[side] if (b >> second[side] & 1) == low]
                leaves.append(RATE * sum(grad[b] for b in rows) / (sum(hess[b] for b in rows) + L2))
        trees.append(Tree(first, second, tuple(leaves)))
        for b in table:
            score[b] += trees[-1].value(b)
    booster, a, y = Booster(base, trees, math.inf), 0, 0
    at = {b: booster.score(b) for b in held_out}
    for value in sorted(set(at.values()), reverse=True):  # equal scores stand or fall together
        a += sum(held_out[b][0] for b in at if at[b] == value)
        y += sum(held_out[b][1] for b in at if at[b] == value)
        if y + 1 >= PRECISION * (a + 2):
            booster.threshold, booster.held_out = value - 1e-9, (a, y)
    return booster


def _tagged(kind: str):
    """Binds the kind: a lambda's second parameter would be the place in the array."""
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["bits"].alias("bits"), x["side"].alias("side"))


def fit(cands: DataFrame) -> dict[str, Booster]:
    """A booster for each kind, from the counts over all candidates (at most 2**len(FEATURES) rows a kind and half)."""
    one = cands.select("half", F.explode(F.concat(*[F.transform(f"loose_{k}", _tagged(k)) for k in KINDS])).alias("x")).where("x.side >= 0")
    counts = one.groupBy("x.kind", "half", "x.bits").agg(F.count(F.lit(1)).alias("n"), F.sum("x.side").alias("ok")).collect()
    of = lambda k, half: {r["bits"]: (r["n"], r["ok"]) for r in counts if r["kind"] == k and r["half"] == half}
    return {k: boost(of(k, 0), of(k, 1)) for k in KINDS}


def _chosen(model: Booster, number: int):
    return lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), F.lit(number).alias("k"), (model.column(x["bits"]) - model.threshold).alias("p"), F.lit(False).alias("base")
    )


def added(cands: DataFrame, models: dict[str, Booster]) -> DataFrame:
    """(uid, k, s, e): candidates of a relaxed form that reach their kind's threshold and overlap no base span.

    Of candidates that overlap in a row, those of one kind stay: the one that passes its threshold by most (ties:
    the kind listed first); candidates of one kind never overlap.
    """
    live = [(n, k) for n, k in enumerate(KINDS) if not math.isinf(models[k].threshold)]
    none = F.array().cast("array<struct<s:int,e:int,k:int,p:double,base:boolean>>")

    def scored(n: int, k: str) -> Column:
        each = F.transform(F.filter(f"loose_{k}", lambda x: x["side"] == -1), _chosen(models[k], n))
        return F.filter(each, lambda x: x["p"] >= 0)

    more = F.concat(none, *[scored(n, k) for n, k in live])
    mark = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(-1).alias("k"), F.lit(0.0).alias("p"), F.lit(True).alias("base"))
    base = F.concat(*[F.transform(f"base_{k}", mark) for k in KINDS])
    rows = cands.select("uid", base.alias("base"), more.alias("more")).where(F.size("more") > 0)
    rows = rows.select("uid", F.explode(F.concat("base", "more")).alias("x")).select("uid", "x.*")
    own, before = Window.partitionBy("uid"), (Window.unboundedPreceding, -1)
    ended = F.max(F.when(F.col("base"), F.col("e"))).over(own.orderBy("s", F.desc("base"), "e", "k").rowsBetween(*before))
    begun = F.min(F.when(F.col("base"), F.col("s"))).over(own.orderBy(F.desc("s"), "base", "e", "k").rowsBetween(*before))
    rows = rows.withColumns({"ended": ended, "begun": begun}).where("NOT base AND coalesce(ended <= s, true) AND coalesce(begun >= e, true)")
    order = own.orderBy("s", "e", "k")
    fresh = F.coalesce(F.max("e").over(order.rowsBetween(*before)) <= F.col("s"), F.lit(True)).cast("int")
    rows = rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max(F.struct("p", (-F.col("k")).alias("k"))).over(Window.partitionBy("uid", "island"))
    return rows.withColumn("best", best).where(F.col("k") == -F.col("best.k")).select("uid", "k", "s", "e")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans: array of (kind, start, end, base)) of every row of ``docs``, by kind as listed, then start.

    Null and empty texts have none. Repeated rows and null ids are scanned each by itself; an empty table gives
    no rows; other columns are not read. Equal scores stand or fall together.
    """
    cands = saved(candidates(docs, id_col, text_col), "pii-candidates")
    # a list for each document, as long as its own candidates
    lists = added(cands, fit(cands)).groupBy("uid").agg(F.collect_list(F.struct("k", "s", "e")).alias("more"))
    rows = cands.select("uid", "doc_id", *[f"base_{k}" for k in KINDS]).join(lists, "uid", "left")

    def flagged(base: bool):
        return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(base).alias("base"))

    def named(k: str):
        return lambda x: F.struct(F.lit(k).alias("kind"), x["s"].cast("long").alias("start"), x["e"].cast("long").alias("end"), x["base"].alias("base"))

    def of(n: int, k: str) -> Column:
        extra = F.filter(F.coalesce("more", F.array().cast("array<struct<k:int,s:int,e:int>>")), lambda x: x["k"] == n)
        return F.transform(F.sort_array(F.concat(F.transform(f"base_{k}", flagged(True)), F.transform(extra, flagged(False)))), named(k))

    return rows.select("doc_id", F.concat(*[of(n, k) for n, k in enumerate(KINDS)]).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", mask: str = "[PII]") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``mask``; spans that overlap make one.

    Null texts stay null and texts without spans as they are; repeated rows are redacted each by itself; an empty
    table gives none; other columns, of whatever name, are kept.
    """
    uid, marks = free(docs, "__uid", "__spans")
    rows = saved(docs.withColumn(uid, F.monotonically_increasing_id()), "pii-docs")
    pairs = F.transform("spans", lambda s: F.struct(s["start"].cast("int").alias("s"), s["end"].cast("int").alias("e")))
    each = spans(rows, uid, text_col).where(F.size("spans") > 0).select(F.col("doc_id").alias(uid), F.explode(pairs).alias("x")).select(uid, "x.*")
    order = Window.partitionBy(uid).orderBy("s", "e")
    fresh = F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("s"), F.lit(True)).cast("int")
    each = each.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    apart = each.groupBy(uid, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    # with the end of the span before, so that a piece of the text is cut once
    apart = apart.withColumn("at", F.coalesce(F.lag("e").over(Window.partitionBy(uid).orderBy("s")), F.lit(0)))
    marked = apart.groupBy(uid).agg(F.sort_array(F.collect_list(F.struct("s", "e", "at"))).alias(marks))
    text = F.col(f"`{text_col}`")

    def block(k: Column) -> Column:
        """Text and masks of a block of spans: the block's own text is cut out once."""
        part = F.slice(marks, k * BLOCK + 1, BLOCK)
        begin = part[0]["at"]
        own = F.substring(text, begin + 1, F.element_at(part, -1)["e"] - begin)
        return let(own, lambda t: F.array_join(F.transform(part, lambda x: F.concat(F.substring(t, x["at"] - begin + 1, x["s"] - x["at"]), F.lit(mask))), ""))

    rest = F.substring(text, F.element_at(marks, -1)["e"] + 1, F.length(text))
    done = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(marks) - 1) / BLOCK).cast("int")), block), ""), rest)
    both = rows.join(marked, uid, "left")
    return both.withColumn(text_col, F.when(F.size(marks) > 0, done).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])
