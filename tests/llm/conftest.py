import pytest

#: Documents with what may go wrong: nulls, empty and blank texts, repeats, a very long text, odd characters.
LONG = " ".join(f"word{k % 977} the of and" for k in range(40_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en"),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \n\t ", "fr"),
    (None, "Le renard brun saute par-dessus le chien paresseux près de la rivière", "fr"),
    (None, None, None),
    (5, LONG, "en"),
    (6, "日本語のテキスト 😀 <|endoftext|> naïve café  double\n\nlines\ttab", None),
    (7, "4111 1111 1111 1111 mail a.b@c.example.com ip 10.0.0.1 or 300.1.1.1 call +1 (555) 555-0100 now", "en"),
    (8, "x", "de"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, key string, ids string, spans string, start string, uid string"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with columns whose names clash with the operators' own."""
    rows = [(i, t, lang, "s", len(t or ""), "a", 0.5, "k", "i", "p", "b", "u") for i, t, lang in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
