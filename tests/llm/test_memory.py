import tracemalloc
from types import SimpleNamespace

import pyarrow as pa

from waymark.llm import langid, tokens


def test_a_worker_lets_go_of_encoders_and_parses_in_bounded_memory():
    """What a worker of the language stage holds at once, after the packing stage has run in it."""
    tokens.encoder(tokens.vocabulary())
    automata = langid.build({"en": "the quick brown fox jumps over it " * 400, "fr": "le renard brun saute par dessus lui " * 400})
    assert automata.table.nbytes <= 4 * langid.DENSE_CELLS <= 32 << 20
    texts = ["the brown fox jumps over the river " * 86] * 1000
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    try:
        out = list(langid._told(SimpleNamespace(value=automata), ["doc_id", "lang", "score"])(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert not tokens._ENCODERS
    assert {x for b in out for x in b.column(1).to_pylist()} == {"en"} and sum(b.num_rows for b in out) == 1000
    assert most < 60e6  # 114 MB with three times the text at once
