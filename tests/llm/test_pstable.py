import numpy as np
import pytest

from waymark.llm import pstable, queries

from ..conftest import SMALL


def brute(rows, cosine=0.95):
    """{position: (n_links, component)} by all pairs, for rows (vec_id, vector)."""
    ok = [k for k, (_, v) in enumerate(rows) if v is not None and None not in v and np.isfinite(v).all() and any(v)]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x, i in enumerate(ok):
        for j in ok[:x]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, links[k], least.get(find(k)), i == least.get(find(k))) for k, (i, _) in enumerate(rows)]


def told(df):
    return [tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in df.collect()]


def order(rows):
    return sorted(rows, key=str)


def groups(seed=1, n=60, d=16, copies=5, noise=0.02):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    near = np.concatenate([base, *(base[: n // 2] + noise * rng.normal(size=(n // 2, d)) * np.linalg.norm(base[: n // 2], axis=1)[:, None] / np.sqrt(d) * 3 for _ in range(copies))])
    return [(int(k), [float(np.float32(c)) for c in v]) for k, v in zip(rng.permutation(len(near)), near)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_equals_all_pairs(spark, kind):
    rows = groups()
    rows += [(1000 + k, v) for k, (_, v) in enumerate(rows[:7])] + [(2000, [3 * c for c in rows[0][1]]), (2001, [-c for c in rows[0][1]])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    assert order(told(pstable.near_duplicates(df.repartition(5)))) == order(brute(rows))


def test_hot_buckets_are_compared_in_blocks_and_pairs_count_once(spark):
    """A third of the rows in one tight group, in blocks of eight."""
    rng = np.random.default_rng(5)
    c = rng.normal(size=24)
    rows = [(k, (c + 0.03 * rng.normal(size=24)).tolist()) for k in range(70)] + [(100 + k, rng.normal(size=24).tolist()) for k in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert order(told(pstable.near_duplicates(df, block=8))) == order(brute(rows))


def test_query_equals_all_pairs(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    x = pstable.unit(np.array([v for _, v in rows]))
    links = (x @ x.T >= 0.95).sum(1) - 1
    assert sorted((a, b) for a, b, *_ in told(queries.op12_embedding_dedup(spark, SMALL))) == sorted((i, int(n)) for (i, _), n in zip(rows, links))


def test_recall_at_the_threshold_is_the_designed_one(spark):
    """Pairs of cosine 0.95 to 0.951 among strangers, in as many projections and tables as a large table gets."""
    rng = np.random.default_rng(7)
    a = pstable.unit(rng.normal(size=(4000, 32)))
    side = rng.normal(size=a.shape)
    side = pstable.unit(side - (side * a).sum(1, keepdims=True) * a)
    cos = rng.uniform(0.95, 0.951, (len(a), 1))
    b = cos * a + np.sqrt(1 - cos**2) * side
    k, tables = pstable.design([pstable.unit(rng.normal(size=(500, 32)))], 10**8, 0.95)
    width = pstable.WIDTH * pstable.radius_of(0.95)
    met = (pstable.bucket_keys(a, k, tables, width) == pstable.bucket_keys(b, k, tables, width)).any(1).mean()
    assert k > 5 and met >= pstable.RECALL - 0.015


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, 1.0]), (7, None), (8, [0.0, 0.0]), (9, [nan, 1.0]), (10, [1.0, None]), (11, [inf, 1.0]), (12, []), (13, [1.0, 0.0, 0.0]), (14, [1e-300, 0.0]), (15, [1e300, 1e298])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, component_id string, n_links int")
    got = told(pstable.near_duplicates(df))
    assert order(got) == order(
        [(1, 4, 1, True), (1, 4, 1, True), (None, 4, 1, False), (14, 4, 1, False), (15, 4, 1, False), (None, 0, None, True)]
        + [(i, 0, i, True) for i in (7, 8, 9, 10, 11, 12, 13)]
    )
    assert told(pstable.near_duplicates(df.limit(0))) == []
    assert told(pstable.near_duplicates(df.where("vec_id = 7"))) == [(7, 0, 7, True)]
