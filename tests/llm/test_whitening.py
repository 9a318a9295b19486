import math

import numpy as np
import pytest

from waymark.llm import queries, whitening

from ..conftest import SMALL


def brute(vectors, wanted=8):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    y = (x * n - s).astype(float) / n
    cov = y.T @ y / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(wanted, int((e > 1e-10 * e.sum()).sum()))
    return n, [int(((r * n - s) ** 2).sum()) for r in x], y @ v[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(cov)


def check(got, vectors, apart=True):
    n, dev, white, explained = brute(vectors)
    k = white.shape[1]
    assert len(got) == n * k
    m = np.zeros((n, k))
    for r in got:
        i, j = r["vec_id"], r["component"] - 1
        assert r["n"] == n and r["deviation"] == dev[i] and abs(r["explained"] / explained[j] - 1) < 1e-9 and r["identity_error"] < 1e-9
        m[i, j] = r["whitened"]
    if apart:  # components of unequal eigenvalues are told but for their sign
        sign = np.sign((m * white).sum(0))
        assert np.abs(m * sign - white).max() < 1e-7
    return m


def test_query_equals_an_eigen_decomposition(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    order = {r["vec_id"]: k for k, r in enumerate(rows)}
    got = [r.asDict() | {"vec_id": order[r["vec_id"]]} for r in queries.op13_whitening(spark, SMALL).collect()]
    check(got, [r["embedding"] for r in rows])


def frame(spark, vectors, kind="float"):
    return spark.createDataFrame([(k, v, "c") for k, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>, component string")


@pytest.mark.parametrize("n,d", [(2, 3), (5, 12), (40, 3), (300, 20)])
def test_shapes(spark, n, d):
    v = np.random.default_rng(n).normal(size=(n, d)) * np.arange(1, d + 1)
    got = whitening.whiten(frame(spark, v.tolist()).repartition(3)).collect()
    check(got, v)


def test_equal_eigenvalues_come_as_often_as_they_occur(spark):
    v = [[sign * 8.0 * (k == j) for j in range(12)] for k in range(12) for sign in (1, -1)]
    got = whitening.whiten(frame(spark, v)).collect()
    m = check(got, v, apart=False)
    assert m.shape == (24, 8) and np.allclose(m.T @ m / 24, np.eye(8))


def test_settled_values_are_not_taken_for_all_values(spark):
    """A second direction of the largest eigenvalue among many small ones, in a wider space than the steps taken."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 60)) * 0.05
    v[:, :10] *= 60
    got = whitening.whiten(frame(spark, v.tolist())).collect()
    check(got, v)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 0.5], [0.0, 0.1, 3.0], [5.0, 1.0, 1.0], [5.0, 1.0, 1.0]]
    rows = [(k % 3 if k < 3 else None, v, 1, "y") for k, v in enumerate(good)]
    rows += [(10, None, 1, "y"), (11, [1.0, None, 2.0], 1, "y"), (12, [nan, 1.0, 1.0], 1, "y"), (13, [1.0, -inf, 1.0], 1, "y"), (14, [1.0, 2.0], 1, "y"), (15, [], 1, "y"), (16, [1e300, 0.0, 0.0], 1, "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, x string")
    got = whitening.whiten(df).collect()
    assert {r["vec_id"] for r in got} == {0, 1, 2, None} and len(got) == 4 * 2 and {r["n"] for r in got} == {4}
    same = [r["whitened"] for r in sorted(got, key=lambda r: r["component"]) if r["vec_id"] in (2, None)]
    assert same[::2] == same[1::2]
    for few in (df.limit(0), df.where("vec_id = 0"), df.where("vec_id = 2 OR vec_id IS NULL"), df.where("vec_id = 15")):
        assert whitening.whiten(few).count() == 0


def test_deviation_is_exact_and_null_beyond_64_bits():
    x = np.array([[10**12, 1], [0, 5]])
    assert whitening.deviations(x, 2, [10**12, 6]) == [None, None]
    x = np.array([[100_000 + 7, 99_000]])
    assert whitening.deviations(x, 10**5, [10**10, 99 * 10**8]) == [(7 * 10**5) ** 2]
