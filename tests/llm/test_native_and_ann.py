import re

import numpy as np
import pytest

from waymark.llm import ann, pii, queries


def luhn(d):
    return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(x):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(v) <= 255 for v in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


TEXTS = [
    "a@b.com-x@y.org and a@b.com_c@d.org, ..@x.y.z @no.one a@b a@b.c.", "1.2.3.4.5 256.1.1.1 001.002.003.004 9.9.9 12.34.56.78.90.12.34.56", "4111-1111-1111-1111 4111111111111111 41111111111111112 0000 0000 0000 0000",
    "+1 (555) 555-0100 +12 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 ++49 30 1234567", "é😀 x@y.de 😀+4930123456789", "1" * 5000 + " " + "a" * 5000 + "@x", ".".join(["1"] * 3000), "a." * 2000 + "@b.c", "-".join(["12"] * 2000), None, "",
]


def test_base_spans(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] for r in pii.spans(df).collect()}
    for k, t in enumerate(TEXTS):
        assert got[k] == base_spans(t or ""), t


def test_pii_edges(spark, docs, none):
    out = pii.spans(docs).collect()
    assert len(out) == docs.count() and pii.spans(none).count() == 0
    seven = next(r for r in out if r["doc_id"] == 7)
    assert [s["kind"] for s in seven["spans"] if s["base"]] == ["email", "ip", "card", "phone"]
    red = pii.redacted(docs)
    assert red.columns == docs.columns
    text = next(r["text"] for r in red.collect() if r["doc_id"] == 7)
    assert text == "[PII] mail [PII] ip [PII] or 300.1.1.1 call [PII] now"


def test_pii_stays_native(spark, docs):
    assert not re.search("Python|Pandas|Arrow", pii.spans(docs)._jdf.queryExecution().toString())
    assert not re.search("Python|Pandas|Arrow", pii.candidates(docs)._jdf.queryExecution().toString())


def test_boosting_learns_and_calibrates():
    # bit 0 makes candidates pass, bit 1 spoils half of them
    table = {0: (500, 5), 1: (400, 398), 2: (500, 0), 3: (100, 50)}
    m = pii.boost(table, table)
    assert m.score(1) >= m.threshold > max(m.score(0), m.score(2), m.score(3)) and m.held_out == (400, 398)
    none = float("inf")
    assert pii.boost({}, {}).threshold == pii.boost({0: (5, 0)}, {0: (5, 0)}).threshold == none
    assert pii.boost(table, {1: (3, 3)}).threshold == none  # three examples prove nothing
    assert pii.boost(table, {1: (400, 200)}).threshold == none  # the other half says otherwise


def test_tree_column_is_its_value(spark):
    from pyspark.sql import functions as F

    table = {b: (10 + b, b % 7) for b in range(64)}
    m = pii.boost(table, table)
    rows = spark.range(64).select(F.col("id").cast("int").alias("b"), m.column(F.col("id").cast("int")).alias("s")).collect()
    assert m.trees and all(abs(r["s"] - m.score(r["b"])) < 1e-9 for r in rows)


#: By kind: base form, what can't be personal data, and a relaxed form that the method has to add.
PLANTED = {
    "email": ("mail me: ann{0}@host{0}.org today", "see x{0}@localhost;now", "mail me: ann{0} (at) host{0}.org today"),
    "ip": ("login from 10.0.{0}.7 today", "version:1.2.3.{0}.5.6x", "login from 10[.]0[.]{0}[.]7 today"),
    "card": ("paid by card 4111 1111 1111 1111 on day {0}", "id:x4111111111111{0:03}x", "paid by card 4111.1111.1111.1111 on day {0}"),
    "phone": ("call +1 (555) 555-01{0:02} now", "x/2024-01-{0:02}/y", "call (555) 555-01{0:02} now"),
}


def test_the_trees_add_spans(spark):
    """Through the whole query: every kind's relaxed forms are added, nothing else is, and the base stays."""
    texts = [(form, k, f.format(n)) for n in range(10, 50) for k, forms in PLANTED.items() for form, f in enumerate(forms)]
    df = spark.createDataFrame([(n, t) for n, (_, _, t) in enumerate(texts)], "doc_id long, text string")
    added, wrong = dict.fromkeys(pii.KINDS, 0), []
    for r in pii.spans(df).collect():
        form, kind, text = texts[r["doc_id"]]
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] == base_spans(text)
        more = [s for s in r["spans"] if not s["base"]]
        if form == 2 and [s["kind"] for s in more] == [kind]:
            added[kind] += 1
        else:
            wrong += more
    assert added == dict.fromkeys(pii.KINDS, 40) and not wrong
    models = pii.fit(pii.candidates(df))
    assert all(m.trees and m.held_out[1] >= pii.PRECISION * m.held_out[0] > 0 for m in models.values())


def test_long_texts_take_linear_time(spark):
    import time

    seconds = []
    for n in (4_000, 16_000):
        text = " ".join(f"é{k}@host{k}.org" for k in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        row = pii.spans(df).first()
        seconds.append(time.time() - began)
        assert len(row["spans"]) == n and row["spans"][-1]["end"] == len(text)
        red = pii.redacted(df).first()["text"]
        assert red == " ".join("é[PII]" for _ in range(n))
    assert seconds[1] < 10 + 5 * seconds[0]


def exact(ids, x, k):
    out = {}
    for q in range(len(ids)):
        s = x @ x[q]
        order = [n for n in np.lexsort((ids, -s)) if n != q][:k]
        out[int(ids[q])] = [int(ids[n]) for n in order]
    return out


def test_neighbours_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 10)).astype(np.float32)
    x[100:160] = x[100]  # one vector, many ids
    rows = [(k, [float(v) for v in x[k]], "extra") for k in range(400)] + [(7, [float(v) for v in x[7]], "again")]
    bad = [(1000, None, "n"), (1001, [0.0] * 10, "z"), (1002, [float("nan")] * 10, "q"), (1003, [1.0, None] * 5, "h"), (1004, [float("inf")] * 10, "i"), (1005, [1.0] * 9, "s"), (None, [1.0] * 10, "m")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, list string")
    out = ann.search(df, df.select("vec_id").withColumnRenamed("vec_id", "query_id")).collect()
    got: dict = {}
    for r in out:
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = exact(np.arange(400), x.astype(np.float64), 20)
    assert set(got) == set(want)
    hits = 0
    for q, ranks in got.items():
        assert sorted(ranks) == list(range(1, 21))
        near = [ranks[k] for k in range(1, 21)]
        assert all(abs(s - float(x[q].astype(np.float64) @ x[v].astype(np.float64))) < 1e-9 for v, s in near)
        assert all(a[1] > b[1] or a[1] == b[1] and a[0] < b[0] for a, b in zip(near, near[1:]))
        hits += len({v for v, _ in near} & set(want[q]))
    assert hits >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    df = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(n)], "vec_id long, embedding array<float>")
    out = ann.search(df, df.selectExpr("vec_id as query_id")).collect()
    assert len(out) == n * (n - 1)


def test_recall_on_given_vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    want = exact(ids, x, 20)
    got: dict = {}
    for r in queries.op6_neighbours(spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    assert sum(len(got[q] & set(want[q])) for q in got) >= 0.9 * sum(len(want[q]) for q in got)


def card(rng, lead, sep):
    """A number of 16 digits that passes Luhn."""
    d = lead + "".join(str(rng.integers(10)) for _ in range(15 - len(lead)))
    d = next(d + c for c in "0123456789" if luhn(d + c))
    return sep.join(d[k : k + 4] for k in range(0, 16, 4))


def planted(rng, n):
    """Texts without any cue: (kind if a relaxed form has to be found, text)."""
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 7))
    phone = lambda: f"({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
    digits = lambda k: "".join(str(c) for c in rng.integers(1, 10, k))
    out = []
    for _ in range(n):
        bad = str(rng.choice([1, 2, 3, 5, 6, 7, 8, 9])) + digits(15)
        bad = bad if not luhn(bad) else bad[:-1] + str((int(bad[-1]) + 1) % 10)
        out += [(None, t) for t in (card(rng, "4", ""), bad, f"+1 {phone()}", f"{rng.integers(1, 255)}.{rng.integers(1, 255)}.7.9", f"2024-0{rng.integers(1, 9)}-11", digits(8), f"{digits(7)}/{digits(2)}/{digits(2)}")]
        # look-alikes of a relaxed form, and the forms themselves
        out += [(None, card(rng, "98", ".")), (None, f"{digits(4)}/{digits(2)}/{digits(4)}"), ("card", card(rng, "4", ".")), ("phone", phone())]
    return [(k, f"{word()} {t} {word()}") for k, t in out]


def test_the_trees_tell_relaxed_forms_from_look_alikes(spark):
    """Without cues, by what a number looks like alone: precision and recall of what is added."""
    texts = planted(np.random.default_rng(3), 150)
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    hit = dict.fromkeys(pii.KINDS, 0)
    wrong = dict.fromkeys(pii.KINDS, 0)
    for r in pii.spans(df).collect():
        for s in r["spans"]:
            if not s["base"]:
                (hit if s["kind"] == texts[r["doc_id"]][0] else wrong)[s["kind"]] += 1
    for kind in ("card", "phone"):
        assert hit[kind] >= 0.9 * 150 and wrong[kind] <= 0.1 * (hit[kind] + wrong[kind]), (kind, hit, wrong)


def _odd_vectors(kind):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6000, 32))
    if kind == "large numbers":
        return x * 1e30
    if kind == "one very large":
        x[17] *= 1e30
        return x
    if kind == "small numbers":
        return x * 1e-30
    if kind == "lengths of all sizes":
        return x * np.exp(3 * rng.standard_normal((6000, 1)))
    if kind == "a common part":
        return x * 1e-3 + 1000
    x[:3000] = x[rng.integers(0, 3, 3000)] + 0.002 * rng.standard_normal((3000, 32))  # "near copies"
    return x[rng.permutation(6000)]


@pytest.mark.parametrize("kind", ["large numbers", "one very large", "small numbers", "lengths of all sizes", "a common part", "near copies"])
def test_recall_on_odd_vectors(spark, kind):
    x = _odd_vectors(kind)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = np.arange(0, len(x), 20)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    last = dict(zip(asked.tolist(), -np.sort(-score, axis=1)[:, 19]))
    got: dict = dict.fromkeys(asked.tolist(), 0)
    for r in ann.search(df, df.where("vec_id % 20 = 0").selectExpr("vec_id as query_id")).collect():
        got[r["query_id"]] += r["score"] >= last[r["query_id"]] - 1e-9 * abs(last[r["query_id"]])
    found = np.array(list(got.values())) / 20
    assert found.mean() >= 0.95 and found.min() >= 0.6
