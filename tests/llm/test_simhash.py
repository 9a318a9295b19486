import random
import re

import numpy as np
import pytest
import xxhash

from waymark.llm import graph, simhash


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, bits=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


@pytest.mark.parametrize("bits", range(5))
def test_keys_meet_within_four_bits(bits):
    rng = np.random.default_rng(bits)
    a = rng.integers(0, 2**64, 400, dtype=np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for bit in rng.choice(64, bits, replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    (r1, k1), (r2, k2) = simhash.keys(a), simhash.keys(b)
    assert all(set(k1[r1 == n]) & set(k2[r2 == n]) for n in range(len(a)))


def test_documents(spark, docs, none):
    from .conftest import ROWS

    out = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert len(out) == len(ROWS)
    fps = [by_hand(t) for _, t, _ in ROWS]
    root = groups(fps)
    least = {r: min((ROWS[k][0] for k in range(len(ROWS)) if root[k] == r and ROWS[k][0] is not None), default=None) for r in set(root)}
    want = sorted((str(ROWS[k][0]), f"{fps[k]:016x}", str(least[root[k]])) for k in range(len(ROWS)))
    assert sorted((str(a), b, str(c)) for a, b, c in out) == want
    assert simhash.near_duplicates(none).count() == 0


def test_keep_one(spark, docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # 1 once; blank texts are one group, whose smallest id is 2; rows without an id stay
    assert sorted(i for i in ids if i is not None) == [1, 2, 5, 6, 7, 8] and ids.count(None) == 2


def test_keep_one_of_repeated_ids(spark):
    """Two texts of one id: the one that belongs to its group's winner stays, in every partitioning."""
    a, b = "one two three four five six seven eight", "an unlike text with other words in it altogether"
    rows = [(1, a, "k"), (1, b, "k"), (1, b, "k"), (2, b, "k"), (3, a, "k"), (0, "x y z", "k")]
    for n in (1, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(n)
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns
        assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(0, "x y z"), (1, b), (1, a)]


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_links_of_large_groups(spark, block):
    """A chain of near fingerprints in blocks of any size gives the same components as all pairs."""
    rnd = random.Random(3)
    fps, at = [], rnd.getrandbits(64)
    for _ in range(300):
        at ^= 1 << rnd.randrange(64)
        fps.append(at)
    fps += [rnd.getrandbits(64) for _ in range(100)]
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r["node"]: r["root"] for r in graph.components(simhash.links(df, block=block)).collect()}
    want = groups(fps)
    for k in range(len(fps)):
        for j in range(k):
            assert (roots.get(signed[k], signed[k]) == roots.get(signed[j], signed[j])) == (want[k] == want[j])


def test_components_of_odd_links(spark):
    rows = [(1, 2), (2, 1), (3, 3), (None, 4), (5, 6), (6, 7), (7, 8), (8, 5), (9, 2)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k != v} == {2: 1, 9: 1, 6: 5, 7: 5, 8: 5}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
