"""Packing along a space-filling curve.

A document's token ids are hashed into a signed count vector, which is scaled to unit length and projected
to four dimensions by a seeded normal matrix. Each coordinate is spread over 15 bits by the normal curve's
(logistic) integral, and the four give a Hilbert key: documents with near keys have near vectors. Documents
are range-sorted by key, laid end to end along the curve, and cut every ``length`` tokens, so that a
sequence holds neighbouring documents and only the last one can need padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved
from .order import starts
from .tokens import ENCODE_BYTES, ENCODE_ROWS, bounded, encoder, groups, let_go, trim

LENGTH = 2048
END_ID = 1
HASHED = 256
DIMS, BITS = 4, 15
SEED = 20


@lru_cache(1)
def _projection(vocab: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    slot = rng.integers(0, HASHED, vocab)
    sign = rng.choice([-1.0, 1.0], vocab)
    return slot, sign, rng.standard_normal((HASHED, DIMS))


def hilbert(coords: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points (n x dims) with coordinates below 2**bits."""
    x = [coords[:, d].astype(np.int64) for d in range(coords.shape[1])]
    dims = len(x)
    # from the highest bit down, undo the rotation and reflection of the cell that the point lies in
    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for d in range(dims):
            inside = (x[d] & bit) != 0
            swap = np.where(inside, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(inside, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
    for d in range(1, dims):  # Gray code across the dimensions
        x[d] = x[d] ^ x[d - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & (1 << b)) != 0, (1 << b) - 1, 0)
    x = [v ^ turn for v in x]
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | (v >> b & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert key of each document's ids; documents without ids get the key of the zero vector."""
    slot, sign, matrix = _projection()
    v = np.zeros((len(ids), HASHED))
    for k, x in enumerate(ids):
        if len(x):
            v[k] = np.bincount(slot[x], sign[x], HASHED)
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    z = (v / np.where(norm == 0, 1, norm)) @ matrix
    u = 1 / (1 + np.exp(-1.702 * z))
    return hilbert(np.minimum(u * (1 << BITS), (1 << BITS) - 1).astype(np.int64))


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, uid, key, n, ids): ids of every whole text and the end id, as little-endian bytes of the
    encoder's width; null texts count as empty. ``uid`` tells repeated rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            texts = b.column(2)
            sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in texts])
            for i, j in groups(sizes, ENCODE_BYTES, ENCODE_ROWS):
                ids = enc.encode(texts.slice(i, j - i))
                keys = curve_keys([np.frombuffer(x, enc.dtype) for x in ids])
                n = np.array([len(x) // enc.dtype.itemsize + 1 for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(keys), pa.array(n), pa.array([x + end for x in ids], pa.binary())],
                    names=["doc_id", "uid", "key", "n", "ids"],
                )

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, uid long, key long, n long, ids binary")


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): every document's ids, cut into pieces.

    ``start`` counts the document's ids before the piece, ``offset`` the sequence's; ``ids`` are little-endian
    unsigned 32-bit. Sequences 0, 1, ... hold ``length`` ids each without a gap, the last one perhaps fewer.
    Null and empty texts give one piece with the end id alone; repeated rows and null ids are documents of
    their own; equal keys go by doc_id (nulls first). An empty table gives no rows. Other columns are not read.
    """
    docs_ids = saved(encoded(docs, tokenizer, end_id, id_col, text_col), "packing-ids")
    placed = starts(docs_ids.select("key", "doc_id", "uid", "n"), ["key", "doc_id", "uid"], "n").select("uid", "start")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            rows = list(zip(*[b.column(k).to_pylist() for k in range(3)]))
            for i in range(0, len(rows), 256):
                out: list[tuple] = []
                for (doc_id, n, at), raw in zip(rows[i : i + 256], b.column(3).slice(i, 256)):
                    ids = np.frombuffer(raw.as_buffer(), "<u2" if len(raw.as_buffer()) == 2 * n else "<u4").astype("<u4")
                    done = 0
                    while done < n:
                        offset = (at + done) % length
                        take = min(n - done, length - offset)
                        out.append((doc_id, done, take, n, (at + done) // length, offset, ids[done : done + take].tobytes()))
                        done += take
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:6]], pa.array(cols[6], pa.binary())], names=names)

    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    return docs_ids.select("uid", "doc_id", "n", "ids").join(placed, "uid").select("doc_id", "n", "start", "ids").mapInArrow(
        cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n, ids): each sequence's ids as an array, the last one padded unless its length is a power of two.

    ``packed`` are :func:`pieces`; no pieces give no sequences."""

    def join(key: tuple, table: pa.Table) -> pa.Table:
        t = table.sort_by("offset")
        ids = np.frombuffer(b"".join(t.column("ids").to_pylist()), "<u4").astype(np.int32)
        full = len(ids) if len(ids) & (len(ids) - 1) == 0 else length
        return pa.table({"sequence_id": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(ids)], pa.int64()), "ids": pa.array([np.append(ids, np.full(full - len(ids), pad_id, np.int32))], pa.list_(pa.int32()))})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, "sequence_id long, n long, ids array<int>")
