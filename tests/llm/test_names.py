from waymark.llm import ann, decontam, langid, names, pii, simhash

HELPERS = ("__at", "__bucket", "__stays", "__lang_pred", "__score", "__text", "__uid", "__spans", "__TEXT_")
TEXTS = ("The quick brown fox jumps over the lazy dog today", "the quick brown fox jumps over the lazy dog today", "mail a.b@c.example.com now please", "Le renard brun saute par dessus le chien", None, "")


def frame(spark):
    rows = [(k, t, "en", *[f"{h}{k}" for h in HELPERS]) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{h}` string" for h in HELPERS)).repartition(3)


def same(got, docs, but=()):
    """Every row that is kept has its caller's values."""
    assert got.columns == docs.columns
    want = {r["doc_id"]: r.asDict() for r in docs.collect()}
    rows = got.collect()
    for r in rows:
        assert {c: v for c, v in r.asDict().items() if c not in but} == {c: v for c, v in want[r["doc_id"]].items() if c not in but}
    return sorted(r["doc_id"] for r in rows)


def test_free_names(spark):
    assert names.free(frame(spark), "__at", "x", "__Text", "x") == ("___at", "x", "___Text", "_x")


def test_stages_keep_columns_of_any_name(spark, monkeypatch):
    docs = frame(spark)
    items = spark.createDataFrame([(1, TEXTS[3])], "item_id long, text string")
    assert same(simhash.keep_one(docs), docs) == [0, 2, 3, 4]
    assert same(langid.keep_known(docs), docs) == [0, 1, 2, 3]
    assert same(decontam.keep_clean(docs, items), docs) == [0, 1, 2, 4, 5]
    monkeypatch.setattr(decontam, "BROADCAST_ITEMS", 0)
    assert same(decontam.keep_clean(docs, items), docs) == [0, 1, 2, 4, 5]
    red = pii.redacted(docs)
    assert same(red, docs, ("text",)) == list(range(6)) and {r["doc_id"]: r["text"] for r in red.collect()}[2] == "mail [PII] now please"


def test_scores_are_of_the_doubles_that_came(spark):
    import numpy as np

    x = np.random.default_rng(2).normal(size=(60, 8))
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    for r in ann.search(v, v.where("vec_id < 3").selectExpr("vec_id AS query_id"), 5).collect():
        assert abs(r["score"] - x[r["query_id"]] @ x[r["vec_id"]]) < 1e-14
