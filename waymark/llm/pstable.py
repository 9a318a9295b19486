"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are scaled to length one, where a cosine is a distance. A table cuts ``k`` random projections of a vector into
cells of ``WIDTH`` radii; vectors that share all cells of a table share its bucket, and every pair of a bucket is
checked exactly, in double precision. ``k`` is the least that leaves a vector few strangers in its buckets, judged by the
distances in a sample; the number of tables is what finds a pair exactly at the threshold with probability ``RECALL``
(nearer ones oftener).

Equal vectors are one node with a count. A bucket of more than a block is compared in pairs of blocks, each a task's
run, so no bucket is one task's. Links are never listed: a run gives each vector's number of new links, leaving out
pairs that an earlier table's bucket holds too, and a forest that joins what its links join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, partitions, saved
from .graph import components

COSINE = 0.95
#: Width of a cell in radii, and the chance that the tables find a pair at exactly the threshold.
WIDTH, RECALL = 4.0, 0.97
#: Strangers that a vector may be compared with in a table, on average; vectors of the sample that this is judged by.
STRANGERS, SAMPLE = 2048, 2048
MOST_PROJECTIONS = 40
#: Vectors, and bytes of them as doubles, that a run holds at most, about; cosines that it holds at once.
BLOCK, BLOCK_BYTES, COSINES = 4096, 32 << 20, 1 << 20
SEED = 12


def collision(distance: float, width: float) -> float:
    """Probability that a projection puts two vectors of this distance into one cell (p-stable law of the normal)."""
    if distance <= 0:
        return 1.0
    u = width / distance
    return math.erf(u / math.sqrt(2)) - math.sqrt(2 / math.pi) / u * (1 - math.exp(-u * u / 2))


def radius_of(cosine: float) -> float:
    return math.sqrt(2 - 2 * cosine)


def design(sample: list[np.ndarray], n: int, cosine: float) -> tuple[int, int]:
    """(projections a table, tables) for ``n`` vectors of which unit vectors are sampled."""
    radius = radius_of(cosine)
    width = WIDTH * radius
    bins = np.linspace(0, 2, 201)
    seen = np.zeros(200)
    for x in sample:
        far = np.sqrt(np.maximum(2 - 2 * (x @ x.T)[np.triu_indices(len(x), 1)], 0))
        seen += np.histogram(np.minimum(far[far > radius], 2), bins)[0]
    pairs = sum(len(x) for x in sample) * (sum(len(x) for x in sample) - 1) / 2
    p = np.array([collision(d, width) for d in (bins[1:] + bins[:-1]) / 2])
    k = next((k for k in range(1, MOST_PROJECTIONS) if not pairs or n * (seen @ p**k) / pairs <= STRANGERS), MOST_PROJECTIONS)
    found = collision(radius, width) ** k
    return k, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - found)))


@lru_cache(8)
def _projections(d: int, k: int, tables: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, d])
    mix = rng.integers(0, 1 << 63, (tables, k + 1), dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
    return rng.standard_normal((d, tables * k)) / width, rng.random(tables * k), mix


def bucket_keys(x: np.ndarray, k: int, tables: int, width: float) -> np.ndarray:
    """Each unit vector's bucket in each table (rows x tables); the length of the vectors is part of it."""
    a, offset, mix = _projections(x.shape[1], k, tables, width)
    cells = np.floor(x @ a + offset).astype(np.int64).view(np.uint64).reshape(len(x), tables, k)
    return ((cells * mix[None, :, :k]).sum(2) + np.uint64(x.shape[1]) * mix[None, :, k]).view(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length."""
    length = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    begins = np.append(0, np.cumsum(length))[:-1]
    for d in np.unique(length).tolist():
        rows = np.flatnonzero(length == d)
        yield rows, flat[begins[rows][:, None] + np.arange(d)]


def valid_vector(vec_col: str) -> object:
    """The vector, or null where it is null, zero or holds a null or non-finite component."""
    c = F.col(vec_col)
    odd = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(c.isNotNull() & ~odd & F.exists(c, lambda v: v != 0), c)


def _new_links(same: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether pairs of buckets (pairs x tables up to this one) meet first in the last table."""
    eq = same == other
    return eq[:, -1] & ~eq[:, :-1].any(1)


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Let pairs (a, b) have one label, in place; a label is the smallest index."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        hook = np.arange(len(label))
        np.minimum.at(hook, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(hook[hook], hook):
            hook = hook[hook]
        label[:] = hook[label]


def compare(x: np.ndarray, y: np.ndarray | None, keys_x: np.ndarray, keys_y: np.ndarray, m_x: np.ndarray, m_y: np.ndarray, cosine: float):
    """Links among unit vectors ``x``, or between them and ``y``: new links of each, and a label that linked ones share."""
    within = y is None
    y = x if within else y
    n_x, n_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    label = np.arange(len(x) if within else len(x) + len(y))
    step = max(1, COSINES // len(y))
    for s in range(0, len(x), step):
        r, c = np.nonzero(x[s : s + step] @ y.T >= cosine)
        r += s
        if within:
            r, c = r[c > r], c[c > r]
        if not len(r):
            continue
        _joined(label, r, c if within else c + len(x))
        for q in range(0, len(r), COSINES):
            a, b = r[q : q + COSINES], c[q : q + COSINES]
            new = _new_links(keys_x[a], keys_y[b])
            a, b = a[new], b[new]
            n_x += np.bincount(a, m_y[b], len(x)).astype(np.int64)
            n_y += np.bincount(b, m_x[a], len(y)).astype(np.int64)
    return (n_x + n_y if within else np.concatenate([n_x, n_y])), label


def _keys_of(k: int, tables: int, width: float):
    """nodes (node, m, v) -> (t, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in _by_length(b.column(2)):
                for s in range(0, len(rows), 2048):
                    keys = bucket_keys(unit(x[s : s + 2048]), k, tables, width)
                    cols = [pa.array(np.tile(np.arange(tables, dtype=np.int32), len(keys))), pa.array(keys.ravel())]
                    yield pa.RecordBatch.from_arrays(cols, names=["t", "key"])

    return run


def _rows_of(k: int, tables: int, width: float):
    """nodes (node, m, v) -> (t, key, node, m, keys, x): a row for each table, with the keys up to this one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, m = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for rows, x in _by_length(b.column(2)):
                for s in range(0, len(rows), 512):
                    part = np.ascontiguousarray(x[s : s + 512])
                    keys = bucket_keys(unit(part), k, tables, width)
                    raw = pa.array([v.tobytes() for v in part], pa.binary())
                    for t in range(tables):
                        upto = np.ascontiguousarray(keys[:, : t + 1])
                        cols = [np.full(len(part), t, np.int32), keys[:, t].copy(), node[rows[s : s + 512]], m[rows[s : s + 512]]]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array([v.tobytes() for v in upto], pa.binary()), raw], names=["t", "key", "node", "m", "keys", "x"])

    return run


def _matches(dtype: str, cosine: float):
    """Rows sorted by run (t, key, i, j) and part -> (kind, a, b): links (kind 0) of node a, or joined nodes a, b (kind 1)."""

    def one(cols: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        part, node, m, keys, x = cols
        x = unit(np.stack([np.frombuffer(v, dtype) for v in x]))
        keys = np.stack([np.frombuffer(v, np.int64) for v in keys])
        cut = int(np.searchsorted(part, part[0], "right"))
        if cut == len(part):
            n, label = compare(x, None, keys, keys, m, m, cosine)
        else:
            n, label = compare(x[:cut], x[cut:], keys[:cut], keys[cut:], m[:cut], m[cut:], cosine)
        some = n > 0
        yield 0, node[some], n[some]
        led = label != np.arange(len(label))
        yield 1, node[led], node[label[led]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def work(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            new = np.append(True, np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0))
            starts = np.append(np.flatnonzero(new), len(new))
            found: dict[int, list] = {0: [], 1: []}
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                i, j = cols[2][s], cols[3][s]
                if e - s > 1 and (i == j or cols[4][s] != cols[4][e - 1]):  # a pair of blocks of which one is empty has no pairs
                    for kind, a, b in one([c[s:e] for c in cols[4:]]):
                        found[kind].append((a, b))
            for kind, some in found.items():
                if some:
                    a, b = (np.concatenate(c) for c in zip(*some))
                    for q in range(0, len(a), 50_000):
                        cols_out = [np.full(len(a[q : q + 50_000]), kind, np.int32), a[q : q + 50_000], b[q : q + 50_000]]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, cols_out)], names=["kind", "a", "b"])

        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(9)]
            held = cols if held is None else [np.concatenate(c) for c in zip(held, cols)]
            last = np.all([c == c[-1] for c in held[:4]], axis=0)  # of the run that may go on
            upto = len(last) - int(last[::-1].argmin()) if not last.all() else 0
            if upto:
                yield from work([c[:upto] for c in held])
                held = [c[upto:] for c in held]
        if held is not None and len(held[0]):
            yield from work(held)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Linked are rows whose vectors the tables bring together and whose cosine is ``cosine`` or more; ``component_id`` is the
    smallest non-null id reachable over links, ``kept`` marks the row of that id. Every row counts, so repeated rows link
    with each other; vectors of different lengths never link. A vector that is null, zero or holds null or non-finite
    components links with nothing and stands alone. A row without an id is kept if its component has no id at all. An
    empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    kind = "float" if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else "double"
    dtype = "<f4" if kind == "float" else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("v")).select("vec_id", valid_vector("v").alias("v"))
    grouped = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("m"))
    nodes = saved(grouped.select(F.monotonically_increasing_id().alias("node"), "m", "v", "least_id"), "vectors")
    head = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    if head["n"]:
        sample = nodes.select("node", "v").orderBy(F.xxhash64("v"), "node").limit(max(2, min(SAMPLE, (BLOCK_BYTES // 8) // head["d"]))).select("v").toArrow()
        k, tables = design([unit(x) for _, x in _by_length(sample.column("v").combine_chunks())], head["n"], cosine)
        block = max(2, min(block, BLOCK_BYTES // (8 * head["d"])))
        args = (k, tables, WIDTH * radius_of(cosine))
        three = nodes.select("node", "m", "v")
        sizes = three.mapInArrow(_keys_of(*args), "t int, key long").groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"))
        hot = saved(sizes.where(F.col("n") > block).select("t", "key", F.ceil(F.col("n") / F.lit(block // 2)).cast("int").alias("parts")), "hot-buckets")
        keyed = three.mapInArrow(_rows_of(*args), "t int, key long, node long, m long, keys binary, x binary").join(hot, ["t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        dealt = keyed.withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        runs = dealt.select("t", "key", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p", "node", "m", "keys", "x")
        runs = runs.repartition(partitions(nodes, 1.5 * tables), "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "p", "node")
        found = saved(runs.mapInArrow(_matches(dtype, cosine), "kind int, a long, b long"), "vector-links")
    else:
        found = spark.createDataFrame([], "kind int, a long, b long")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    roots = components(found.where("kind = 1").select("a", "b").distinct()).withColumnRenamed("node", "linked")
    of = nodes.select("node", "m", "least_id").join(counts, "node", "left").join(roots, F.col("node") == F.col("linked"), "left")
    of = saved(of.select("node", "least_id", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")), "linked-vectors")
    least = of.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = nodes.select("node", "v").join(of.join(least, "root").select("node", "n_links", "component_id"), "node").select("v", "n_links", "component_id")
    linked = rows.where("v IS NOT NULL").join(known, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if head["n"]:
        discard(hot)
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
