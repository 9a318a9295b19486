"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Centred rows X are never gathered. A step sends one right vector v to the tasks; each multiplies its rows by it
(X v) and those products by its rows again (Xᵀ u), and the tasks' sums, a few numbers a dimension, are added up by
Spark. A left vector is as long as the table, so it is kept as the coefficients that make it of X's columns, and its
products with all earlier left vectors come from the same pass: both sides are reorthogonalised in full. The driver
holds d numbers for each of at most d steps; the singular values and right vectors of the small bidiagonal matrix are
the deviations and the components.

A Krylov space that is exhausted or whose leading values have settled is followed by another one from a fresh
direction, until a fresh one's leading value, settled too, is below what is wanted: so equal eigenvalues come as often
as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Scaled entries from here on have no exact double; vectors that hold one take no part, like non-finite ones.
LARGEST = 2.0**53
#: Residual of a settled singular value, as a share of the largest, and squared deviations that count as none.
SETTLED, NOTHING = 1e-13, 1e-13
SEED = 13


@dataclass
class Whitening:
    """What was fitted: n, the sums S (exact), the components (rows, by falling eigenvalue), eigenvalues and trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    steps: int


def rows_of(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the integer vectors of the rows that take part, one row each, repeated ids too.

    Dropped are vectors that are null, hold a null or non-finite entry or one beyond ``LARGEST``, and those of another
    length than most (of equally common lengths the smaller one counts)."""
    scaled = F.transform(F.col(vec_col).cast("array<double>"), lambda c: F.floor(c * SCALE) + SHIFT)
    odd = F.exists(vec_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) * SCALE >= LARGEST))
    rows = vectors.where(F.col(vec_col).isNotNull()).where(~F.coalesce(odd, F.lit(True)))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("x"))
    top = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
    return rows.join(F.broadcast(top), F.size("x") == F.col("d")).select("vec_id", "x")


def _integers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            if b.num_rows:
                x = _integers(b.column(1))
                exact = x if np.abs(x).max(initial=0) < 2**62 // len(x) else x.astype(object)
                part = exact.sum(0).astype(object)
                total = part if total is None else total + part
                n += len(x)
        if total is not None:
            every = [n, *total.tolist()]
            cols = [pa.array(range(-1, len(every) - 1), pa.int32()), pa.array([str(v) for v in every])]
            yield pa.RecordBatch.from_arrays(cols, names=["at", "v"])

    parts = rows.mapInArrow(run, "at int, v string")
    out = {r["at"]: int(r["v"]) for r in parts.groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}  # a row for each dimension
    return out.pop(-1, 0), [out[k] for k in sorted(out)]


def _added(rows: DataFrame, work) -> np.ndarray:
    """Sum over all batches of ``work(integers)``, a flat array of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = work(_integers(b.column(1)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "v"])

    summed = rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(summed))
    for r in summed:
        out[r["at"]] = r["v"]
    return out


def _fresh(rng: np.random.Generator, v: np.ndarray, d: int) -> np.ndarray:
    """A unit vector at right angles to the rows of ``v``."""
    w = rng.standard_normal(d)
    for _ in range(3):
        w -= v.T @ (v @ w)
        w /= np.linalg.norm(w)
    return w


def bidiagonalise(product, d: int, wanted: int, scale: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(singular values, right vectors as rows, passes) of the ``wanted`` largest singular triples.

    ``product(c, C)`` makes p = X c in one pass over the rows and returns p·p, Xᵀp and (X C)ᵀp; ``scale`` is the
    Frobenius norm of X. One pass serves X v, the reorthogonalisation of u and Xᵀu."""
    rng = np.random.default_rng(SEED)
    v, c, z = np.zeros((0, d)), np.zeros((0, d)), np.zeros((0, d))  # right vectors, coefficients of left ones, Xᵀu of these
    b = np.zeros((0, 0))
    passes, begins, fresh, tiny = 0, 0, True, NOTHING * scale
    beta = 0.0
    right = np.zeros(d)
    while True:
        if fresh:
            if len(v) == d:
                break
            right, beta, begins, fresh = _fresh(rng, v, d), 0.0, len(v), False
        coef = right - beta * c[-1] if beta else right.copy()
        k = len(v)
        pp, xp, up = product(coef, c)
        passes += 1
        coef, xp, rest = coef - up @ c, xp - up @ z, pp - up @ up
        if k and rest < 0.5 * pp:  # cancelled: measure again what is left
            pp, xp, up = product(coef, c)
            passes += 1
            coef, xp, rest = coef - up @ c, xp - up @ z, pp - up @ up
        alpha = np.sqrt(max(rest, 0.0))
        grown = np.zeros((k + 1, k + 1))
        grown[:k, :k] = b
        if beta:
            grown[k - 1, k] = beta
        v = np.vstack([v, right])
        if alpha <= tiny:  # X v lies in what the left vectors span: the space is exhausted
            b, fresh = grown, True
            c, z = np.vstack([c, np.zeros(d)]), np.vstack([z, np.zeros(d)])
        else:
            grown[k, k] = alpha
            b = grown
            c, z = np.vstack([c, coef / alpha]), np.vstack([z, xp / alpha])
            w = z[-1] - alpha * right
            for _ in range(2):
                w -= v.T @ (v @ w)
            beta = float(np.linalg.norm(w))
            if beta <= tiny or len(v) == d:
                fresh = True
            else:
                right = w / beta
        left, s, _ = np.linalg.svd(b)
        if fresh and len(v) == d:
            break
        # a triple's residual is beta times the last entry of its left vector
        settled = fresh or np.all(beta * np.abs(left[-1, : min(wanted, len(s))]) <= SETTLED * s[0])
        if len(s) >= wanted and settled:
            own_left, own, _ = np.linalg.svd(b[begins:, begins:])
            lead = fresh or beta * abs(own_left[-1, 0]) <= SETTLED * s[0]
            if begins and lead and own[0] < s[wanted - 1] * (1 - 1e-9):
                break
            if lead:
                fresh = True
    _, s, vt = np.linalg.svd(b)
    return s[:wanted], (vt @ v)[:wanted], passes


def fit(rows: DataFrame, wanted: int = COMPONENTS) -> Whitening | None:
    """Whitening of the table ``rows`` (vec_id, x) that :func:`rows_of` made and the caller has saved; None if it is empty.

    Components whose deviation is nothing are left out, so there are at most as many as the rows' rank."""
    n, sums = _sums(rows)
    if not n or not sums:
        return Whitening(n, sums, np.zeros((0, len(sums))), np.zeros(0), 0.0, 0) if n else None
    d = len(sums)
    mean = _Centre(n, sums)
    trace = float(_added(rows, lambda x: np.array([(mean(x) ** 2).sum()]))[0]) / n
    if trace <= 0:
        return Whitening(n, sums, np.zeros((0, d)), np.zeros(0), 0.0, 0)

    def product(coef: np.ndarray, c: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        both = np.vstack([coef, c]).T

        def work(x: np.ndarray) -> np.ndarray:
            y = mean(x)
            p = y @ both
            return np.concatenate([y.T @ p[:, 0], p.T @ p[:, 0]])

        out = _added(rows, work)
        return out[d], out[:d], out[d + 1 :]

    s, right, passes = bidiagonalise(product, d, min(wanted, d), np.sqrt(trace * n))
    e = s**2 / n
    keep = e > NOTHING * trace
    return Whitening(n, sums, right[keep], e[keep], trace, passes)


class _Centre:
    """x - S/n in double precision, of the exact quotient and remainder."""

    def __init__(self, n: int, sums: list[int]):
        self.whole = np.array([s // n for s in sums], np.int64)
        self.part = np.array([(s % n) / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n x - S)²; None where it is no 64-bit number."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    kind = np.int64 if most * most * max(1, len(sums)) < 2**63 else object
    y = x.astype(kind) * n - np.array(sums, kind)
    whole = (y * y).sum(1).tolist() if len(sums) else [0] * len(x)
    return [w if w < 2**63 else None for w in whole]


def transform(rows: DataFrame, of: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained) of every row and component."""
    mean, factors = _Centre(of.n, of.sums), of.components.T / np.sqrt(of.eigenvalues)
    explained = of.eigenvalues / of.trace if len(of.eigenvalues) else np.zeros(0)
    k = len(explained)
    schema = {"vec_id": "long", "component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _integers(b.column(1))
            at = np.repeat(np.arange(len(x)), k)
            cols = [
                b.column(0).take(pa.array(at)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(at), of.n)),
                pa.array(deviations(x, of.n, of.sums), pa.int64()).take(pa.array(at)),
                pa.array((mean(x) @ factors).ravel()),
                pa.array(np.tile(explained, len(x))),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=list(schema))

    return rows.mapInArrow(run, ", ".join(map(" ".join, schema.items())))


def identity_error(rows: DataFrame, of: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    k = len(of.eigenvalues)
    if not k:
        return 0.0
    mean, factors = _Centre(of.n, of.sums), of.components.T / np.sqrt(of.eigenvalues)

    def work(x: np.ndarray) -> np.ndarray:
        w = mean(x) @ factors
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    out = _added(rows, work) / of.n
    m = out[:k]
    return float(np.abs(out[k:].reshape(k, k) - np.outer(m, m) - np.eye(k)).max())


def whiten(vectors: DataFrame, wanted: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row that takes part and every component.

    Who takes part :func:`rows_of` says. Rows with null or repeated ids count and come back each by itself. A
    component's sign is the one that makes its largest entry positive (of equal ones the first), the same for all rows.
    There are fewer components than ``wanted`` where the rows' rank is smaller: none, and so no rows, for an empty
    table, a single row or equal rows. A deviation beyond 64 bits is null. Other columns are not read.
    """
    rows = saved(rows_of(vectors, id_col, vec_col), "integers")
    of = fit(rows, wanted)
    if of is None or not len(of.eigenvalues):
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    lead = np.abs(of.components).argmax(1)
    of.components *= np.sign(of.components[np.arange(len(lead)), lead])[:, None]
    return transform(rows, of).withColumn("identity_error", F.lit(identity_error(rows, of)))
