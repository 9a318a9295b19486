"""Binding decided in the task that holds an endpoint: dense block, TF-IDF rows, ranks and settings in one pass.

The controlled vocabulary (intents' vectors and postings) and the documents' idf go to the tasks if they fit stated bounds.
Then an endpoint never leaves its row: its tokens are counted and scaled in place, its scores with all intents are a block,
ranks and settings are decided there, and only candidates, or a sweep's counts, come out. Nothing is shuffled but document
frequencies. With more tokens than the bound the documents' weights are made by joins, and each document brings those of the
intents' tokens to the same block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import matches
from ..functions.text import bind_tokens
from ..storage import saved, spread
from ..tuning import Tuning
from . import bind
from .gate import BIND_META

#: Tokens of all documents whose idf is broadcast, postings of the vocabulary, and components of its vectors.
IDF_TOKENS, POSTINGS, COMPONENTS = 1_000_000, 2_000_000, 4_000_000
#: Scores that a task holds at once.
SCORES = 1_000_000


@dataclass
class Vocabulary:
    """Intents in order, as a task needs them; ``tokens`` are theirs alone, ``idf_tokens`` all documents'."""

    ids: pa.Array
    matrix: np.ndarray | None
    tokens: pa.Array
    starts: np.ndarray  # of each token's postings
    intents: np.ndarray
    weights: np.ndarray
    idf_tokens: pa.Array | None
    idf: np.ndarray | None

    def sparse(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, intent, part of the cosine) of rows' binder tokens, or of (token, weight) beyond the bound; parts of one
        pair are to be added up."""
        rows = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
        flat = column.flatten()
        if pa.types.is_struct(flat.type):
            token, weight = flat.flatten()
            return self._parts(rows, pc.index_in(token, self.tokens).to_numpy(zero_copy_only=False).astype(np.int64), weight.to_numpy(zero_copy_only=False))
        flat = flat.dictionary_encode()
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n_tokens = max(1, len(flat.dictionary))
        pair, n = np.unique(rows * n_tokens + codes, return_counts=True)
        row, code = pair // n_tokens, pair % n_tokens
        idf = self.idf[pc.index_in(flat.dictionary, self.idf_tokens).to_numpy(zero_copy_only=False).astype(np.int64)] if len(flat.dictionary) else np.zeros(0)
        weight = n * idf[code]
        norm = np.sqrt(np.bincount(row, weight * weight, len(column)))
        weight = weight / np.where(norm == 0, 1.0, norm)[row]
        own = pc.fill_null(pc.index_in(flat.dictionary, self.tokens), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
        return self._parts(row[own >= 0], own[own >= 0], weight[own >= 0])

    def _parts(self, row: np.ndarray, own: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        many = self.starts[own + 1] - self.starts[own]
        at = np.repeat(self.starts[own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(row, many), self.intents[at], np.repeat(weight, many) * self.weights[at]


def vocabulary(docs: DataFrame, intents: DataFrame, key: str, text: Column, intent_text: Column) -> tuple[Vocabulary, DataFrame | None]:
    """The vocabulary of ``intents`` (intent_id, intent_ord, vec if there is one), and beyond ``IDF_TOKENS`` (key, tokens):
    what the documents' tokens among the intents' weigh.

    idf counts all ``docs``. More intents than ``COMPONENTS`` and ``POSTINGS`` allow are an error: every document is ranked against all."""
    n = docs.count()
    each = spread(docs.select(key, text.alias("text"))).select(F.explode(F.array_distinct(bind_tokens(F.col("text")))).alias("token"))
    df = each.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = saved(df.withColumn("idf", F.log(F.lit(n) / (1 + F.col("df")))), "idf")
    post = saved(bind.token_counts(intents, "intent_id", intent_text), "postings")
    dense = "vec" in intents.columns
    wide = intents.agg(F.sum(F.size("vec"))).first()[0] or 0 if dense else 0
    if wide > COMPONENTS or post.count() > POSTINGS:
        raise ValueError(f"the intents have over {COMPONENTS} components or {POSTINGS} postings; a task can't hold them")
    rows = intents.select("intent_id", *["vec"] * dense).orderBy("intent_ord").toArrow()
    ids = rows.column("intent_id").combine_chunks()
    matrix = np.array(rows.column("vec").to_pylist(), np.float64).reshape(len(ids), -1) if dense else None
    few = idf.count() <= IDF_TOKENS
    known = (idf if few else idf.join(post.select("token").distinct(), "token", "left_semi")).select("token", "idf").toArrow()
    known_tokens, values = known.column("token").combine_chunks(), known.column("idf").to_numpy()
    # the intents' own weights; a token that no document has counts as one of df 0
    p = post.toArrow().sort_by([("token", "ascending"), ("intent_id", "ascending")])
    at = pc.index_in(p.column("intent_id").combine_chunks(), ids).to_numpy(zero_copy_only=False).astype(np.int64)
    seen = pc.fill_null(pc.index_in(p.column("token").combine_chunks(), known_tokens), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    weight = p.column("n").to_numpy() * np.append(values, np.log(n or 1))[seen]
    norm = np.sqrt(np.bincount(at, weight * weight, len(ids)))
    flat = p.column("token").combine_chunks().dictionary_encode()
    begins = np.append(0, np.cumsum(np.bincount(flat.indices.to_numpy(zero_copy_only=False), minlength=len(flat.dictionary))))
    vocab = Vocabulary(ids, matrix, flat.dictionary, begins, at, weight / np.where(norm == 0, 1.0, norm)[at], known_tokens if few else None, values if few else None)
    if few:
        return vocab, None
    own = bind.tfidf(bind.token_counts(docs, key, text), idf, n, key).join(post.select("token").distinct(), "token", "left_semi")
    return vocab, own.groupBy(key).agg(F.collect_list(F.struct("token", "weight")).alias("tokens"))  # of the intents' tokens alone


def sparse_cosines(docs: DataFrame, intents: DataFrame, key: str, text: Column, intent_text: Column) -> DataFrame:
    """(key, intent_id, sparse) of pairs that share a token; an intent has one row."""
    vocab, weights = vocabulary(docs, intents.withColumn("intent_ord", F.col("intent_id")), key, text, intent_text)
    rows = spread(docs.select(key, text.alias("text"))).select(key, bind_tokens(F.col("text")).alias("tokens")) if weights is None else weights
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    names = [key, "intent_id", "sparse"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                row, intent, value = v.sparse(part.column(1))
                pair, at = np.unique(row * max(1, len(v.ids)) + intent, return_inverse=True)
                total = np.bincount(at, value, len(pair)) if len(pair) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(pair // max(1, len(v.ids)))), v.ids.take(pa.array(pair % max(1, len(v.ids)))), pa.array(total)], names=names)

    kinds = dict(docs.dtypes)
    return rows.where(F.size("tokens") > 0).mapInArrow(run, f"`{key}` {kinds[key]}, intent_id {dict(intents.dtypes)['intent_id']}, sparse double")


def decided(dense: np.ndarray, sparse: np.ndarray, ids: list[str], t: Tuning, ranks: tuple[np.ndarray, ...]) -> dict[str, np.ndarray]:
    """What a setting makes of blocks of scores (rows x intents in order): arrays of the same shape."""
    d, s, best, second = ranks
    floor = np.array([t.floor_overrides.get(i, t.dense_floor) for i in ids])
    strong = sparse >= t.strong_sparse_floor
    passed = dense >= floor
    candidate, promoted = passed | strong, ~passed & strong
    order = np.lexsort((-(1 / (t.rrf_k + d) + 1 / (t.rrf_k + s)), promoted, ~candidate), axis=-1)
    place = np.empty(order.shape, np.int32)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(1, order.shape[1] + 1, dtype=np.int32), order.shape), 1)
    slot = candidate & (place <= t.top_k)
    sparse_ok = slot & (sparse >= t.sparse_floor)
    lead = dense - np.where(dense >= best, second, best)
    return {"candidate": candidate, "place": place, "promoted": promoted, "slot": slot, "sparse_ok": sparse_ok, "bound": sparse_ok & (strong | (lead >= t.dense_margin))}


def _ranks(dense: np.ndarray, sparse: np.ndarray) -> tuple[np.ndarray, ...]:
    """What no setting changes: ranks from 0 over all intents, and the best and second dense score."""
    out = []
    for x in (dense, sparse):
        rank = np.empty(x.shape, np.int64)
        np.put_along_axis(rank, np.argsort(-x, axis=1, kind="stable"), np.broadcast_to(np.arange(x.shape[1]), x.shape), 1)
        out.append(rank)
    top = -np.sort(-dense, axis=1)[:, :2]
    second = top[:, 1:2] if dense.shape[1] > 1 else np.full((len(dense), 1), -np.inf)
    return out[0], out[1], top[:, :1], second


def _blocks(vocab: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(keys, dense, sparse) of slices of rows (key, tokens, vec)."""
    n = len(vocab.ids)
    step = max(1, SCORES // max(1, n))
    for b in batches:
        for s in range(0, b.num_rows if n else 0, step):
            part = b.slice(s, step)
            x = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
            row, intent, value = vocab.sparse(part.column(1))
            sparse = np.bincount(row * n + intent, value, part.num_rows * n).reshape(-1, n)
            yield part.column(0), x @ vocab.matrix.T, sparse


def _live(endpoints: DataFrame, weights: DataFrame | None, key: str, text: Column) -> DataFrame:
    """(key, tokens, vec) of endpoints with a vector that are no meta files."""
    live = endpoints.where(~matches(F.coalesce("path", F.lit("")), BIND_META) & F.col("vec").isNotNull())
    if weights is None:
        rows = spread(live.select(key, F.coalesce(text, F.lit("")).alias("text"), "vec"))
        return rows.select(key, bind_tokens(F.col("text")).alias("tokens"), "vec")
    none = F.array().cast(weights.schema["tokens"].dataType)
    return live.select(key, "vec").join(weights, key, "left").select(key, F.coalesce("tokens", none).alias("tokens"), "vec")


FIELDS = ("place", "promoted", "slot", "sparse_ok", "bound")


def bind_endpoints(endpoints: DataFrame, intents: DataFrame, key: str, text: Column, intent_text: Column, tuning: Tuning = Tuning()) -> DataFrame:
    """(key, intent_id, place, promoted, slot, sparse_ok, bound, dense, sparse): the candidates of each endpoint, as
    :func:`.bind.decide` says.

    ``endpoints``: key, path, vec and what ``text`` reads; ``intents``: intent_id, intent_ord, vec and what ``intent_text``
    reads. Vectors are of one length. Endpoints without a vector and meta files have no candidates; without a text they have
    sparse scores of zero."""
    vocab, weights = vocabulary(endpoints, intents, key, text, intent_text)
    shared = endpoints.sparkSession.sparkContext.broadcast(vocab)
    names = [key, "intent_id", *FIELDS, "dense", "sparse"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for keys, dense, sparse in _blocks(v, batches):
            told = decided(dense, sparse, v.ids.to_pylist(), tuning, _ranks(dense, sparse))
            r, c = np.nonzero(told["candidate"])
            cols = [keys.take(pa.array(r)), v.ids.take(pa.array(c)), *(pa.array(told[f][r, c]) for f in FIELDS), pa.array(dense[r, c]), pa.array(sparse[r, c])]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"`{key}` {dict(endpoints.dtypes)[key]}, intent_id string, place int, promoted boolean, slot boolean, sparse_ok boolean, bound boolean, dense double, sparse double"
    return _live(endpoints, weights, key, text).mapInArrow(run, schema)


COUNTS = ("bound", "promoted_sparse", "gated_sparse", "gated_margin")


def floor_sweep(endpoints: DataFrame, intents: DataFrame, key: str, text: Column, intent_text: Column, settings: list[Tuning]) -> DataFrame:
    """(setting, bound, promoted_sparse, gated_sparse, gated_margin) of each setting, all in one pass over the endpoints.

    Scores and ranks are made once a block; a task gives a row a setting. A setting without candidates has zeros."""
    spark = endpoints.sparkSession
    asked = spark.range(len(settings)).select(F.col("id").cast("int").alias("setting"))
    vocab, weights = vocabulary(endpoints, intents, key, text, intent_text)
    shared = spark.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        total = np.zeros((len(settings), 4), np.int64)
        for _, dense, sparse in _blocks(v, batches):
            ranks = _ranks(dense, sparse)
            for k, t in enumerate(settings):
                told = decided(dense, sparse, v.ids.to_pylist(), t, ranks)
                some, b, s = (told[f].any(1) for f in ("candidate", "bound", "sparse_ok"))
                total[k] += [b.sum(), (told["bound"] & told["promoted"]).any(1).sum(), (some & ~b & ~s).sum(), (some & ~b & s).sum()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(settings), dtype=np.int32)), *map(pa.array, total.T)], names=["setting", *COUNTS])

    parts = _live(endpoints, weights, key, text).mapInArrow(run, "setting int, " + ", ".join(f"{c} long" for c in COUNTS))
    counts = parts.groupBy("setting").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return asked.join(counts, "setting", "left").na.fill(0)
