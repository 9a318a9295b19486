"""Where a stated query set meets a table of rows: tasks hold bounded blocks of both and keep each query's best.

A kernel is made of the queries, takes the rows of a task batch by batch, and gives at most ``k`` rows a query when they
are through; one window merges the tasks'. Up to ``QUERY_BYTES`` of queries are broadcast and rows stay where they are; beyond,
queries and rows meet in pairs of blocks, which Spark shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a query set that is broadcast, and of the queries or rows of a block beyond that.
QUERY_BYTES = BLOCK_BYTES = 32 << 20
#: Scores that a task holds at once.
PRODUCTS = 4_000_000
#: Rows whose postings a task holds at once.
INDEXED = 16_384


class Best:
    """The ``k`` best (score, order) of each query so far, with a payload; equal scores go by order."""

    def __init__(self, n: int, k: int):
        self.k, self.n = k, n
        self.query, self.score = np.zeros(0, np.int64), np.zeros(0)
        self.order: np.ndarray | None = None
        self.payload: np.ndarray | None = None
        #: What a score has to reach to be among a query's best.
        self.floor = np.full(n, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, order: np.ndarray, payload: np.ndarray | None = None) -> None:
        if not len(query):
            return
        if self.order is not None:
            query, score, order = np.append(self.query, query), np.append(self.score, score), np.append(self.order, order)
            payload = None if payload is None else np.append(self.payload, payload)
        by = np.lexsort((order, -score, query))
        query = query[by]
        starts = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        kept = place < self.k
        by, full = by[kept], place == self.k - 1
        self.query, self.score, self.order = query[kept], score[by], order[by]
        self.payload = None if payload is None else payload[by]
        self.floor[query[full]] = self.score[np.flatnonzero(full[kept])]


def meet(queries: DataFrame, rows: DataFrame, kernel: Callable[[pa.Table], object], schema: str, weight: Column, row_weight: Column) -> DataFrame:
    """What ``kernel`` finds where ``queries`` and ``rows`` meet, as ``schema`` says.

    ``weight`` and ``row_weight`` are about the bytes of a query and a row, ``kernel(table of queries)`` an object with
    ``add(batch of rows)`` and ``result()``, a record batch."""
    size = queries.agg(F.sum(weight)).first()[0] or 0
    if size <= QUERY_BYTES:
        shared = rows.sparkSession.sparkContext.broadcast(queries.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = kernel(shared.value)
            for batch in batches:
                if batch.num_rows:
                    state.add(batch)
            yield state.result()

        return rows.mapInArrow(run, schema)
    q_blocks = -(-size // BLOCK_BYTES)
    r_blocks = -(-(rows.agg(F.sum(row_weight)).first()[0] or 1) // BLOCK_BYTES)
    part = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("__qb", part(q_blocks)).withColumn("__rb", spread(r_blocks))
    right = rows.withColumn("__rb", part(r_blocks)).withColumn("__qb", spread(q_blocks))

    own, its = queries.columns, rows.columns

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        state = kernel(a.select(own))
        for batch in b.select(its).to_batches():
            if batch.num_rows:
                state.add(batch)
        return pa.Table.from_batches([state.result()])

    return left.groupBy("__qb", "__rb").cogroup(right.groupBy("__qb", "__rb")).applyInArrow(both, schema)


def ranked(found: DataFrame, k: int, order: str) -> DataFrame:
    """The ``k`` best of each query over all tasks, with their rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), order)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def matrix_of(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Nearest:
    """Kernel of the largest inner products: queries (query_id, vec), rows (order, vec), or (order, scale, q) with packed
    bytes, whose product is the scale times that of the bytes."""

    def __init__(self, queries: pa.Table, k: int, order: str):
        self.ids, self.name = queries.column("query_id").combine_chunks(), order
        self.best = Best(len(self.ids), k)
        self.matrix = matrix_of(queries.column("vec")) if len(self.ids) else np.zeros((0, 0))
        self.kind: pa.DataType | None = None

    def add(self, batch: pa.RecordBatch) -> None:
        self.kind = batch.column(0).type
        if not len(self.ids):
            return
        step = max(1, PRODUCTS // len(self.ids))
        for s in range(0, batch.num_rows, step):
            part = batch.slice(s, step)
            order = part.column(0).to_numpy(zero_copy_only=False)
            if part.num_columns == 3:
                x = np.frombuffer(b"".join(part.column(2).to_pylist()), np.int8).reshape(len(order), -1).astype(np.float64)
                scores = self.matrix @ x.T * part.column(1).to_numpy(zero_copy_only=False)
            else:
                scores = self.matrix @ matrix_of(part.column(1)).T
            cut, m = self.best.floor, len(order)
            if m > self.best.k:
                cut = np.maximum(cut, np.partition(scores, m - self.best.k, axis=1)[:, m - self.best.k])
            r, c = np.nonzero(scores >= cut[:, None])
            self.best.add(r, scores[r, c], order[c].astype(str) if order.dtype == object else order[c])

    def result(self) -> pa.RecordBatch:
        b = self.best
        order = pa.array([], self.kind or pa.int64()) if b.order is None else pa.array(b.order, self.kind)
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(b.query)), order, pa.array(b.score)], names=["query_id", self.name, "score"])


class Postings:
    """Kernel of keyword search: queries (query_id, tokens, stems), rows (id, ep_ord, tokens, stems, factor).

    A block of rows is an inverted index. Each different query token's postings are made once, with its best score: 10 exact, 6
    by stem, 5 as a compound's ending (tenths). A query leaves a block aside whose bound, its tokens' best scores times
    the block's best factor, can't reach its ``k`` best so far; in others the longest postings whose bounds together
    can't reach them are only looked up for rows that the shorter ones name.
    """

    EXACT, STEM, COMPOUND, LEAST, LONGER = 10, 6, 5, 4, 3

    def __init__(self, queries: pa.Table, k: int):
        self.ids = queries.column("query_id").combine_chunks()
        tokens, stems = queries.column("tokens").to_pylist(), queries.column("stems").to_pylist()
        self.best = Best(len(self.ids), k)
        self.known: dict[str, int] = {}
        self.stems: list[str] = []
        self.asked: list[list[int]] = []
        for words, roots in zip(tokens, stems):
            own = []
            for word, root in zip(words or [], roots or []):
                if word not in self.known:
                    self.known[word] = len(self.stems)
                    self.stems.append(root)
                own.append(self.known[word])
            self.asked.append(own)

    @staticmethod
    def index(column: pa.Array) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """Number of each token, rows in order of token, and where each token's begin."""
        flat = column.flatten().dictionary_encode()
        codes = flat.indices.to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
        starts = np.append(0, np.cumsum(np.bincount(codes, minlength=len(flat.dictionary))))
        return {t: k for k, t in enumerate(flat.dictionary.to_pylist())}, rows[np.argsort(codes, kind="stable")], starts

    def add(self, batch: pa.RecordBatch) -> None:
        for s in range(0, batch.num_rows, INDEXED):
            self._block(batch.slice(s, INDEXED))

    def _block(self, part: pa.RecordBatch) -> None:
        ids, order = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
        factor = part.column(4).to_numpy(zero_copy_only=False)
        most = factor.max()
        whole, roots = self.index(part.column(2)), self.index(part.column(3))
        tenths = np.zeros(len(ids), np.int32)

        def postings(index: tuple[dict[str, int], np.ndarray, np.ndarray], token: str) -> np.ndarray:
            at = index[0].get(token)
            return index[1][index[2][at] : index[2][at + 1]] if at is not None else index[1][:0]

        lists: list[tuple[np.ndarray, np.ndarray, int]] = []
        for token, number in self.known.items():
            tenths[:] = 0
            for n in range(self.LEAST, len(token) - self.LONGER + 1):
                tenths[postings(whole, token[-n:])] = self.COMPOUND
            tenths[postings(roots, self.stems[number])] = self.STEM
            tenths[postings(whole, token)] = self.EXACT
            rows = np.flatnonzero(tenths)
            lists.append((rows, tenths[rows], int(tenths.max(initial=0))))
        found = []
        for q, asked in enumerate(self.asked):
            own = sorted((lists[t] for t in asked if lists[t][2]), key=lambda x: len(x[0]))
            least, n = self.best.floor[q], len(asked)
            reach = lambda bound: round(bound / 10 / n * most, 9)
            if not own or reach(sum(x[2] for x in own)) < least:
                continue
            rest, first = 0, len(own)  # lists from ``first`` on can't bring a row in by themselves
            while first > 1 and reach(rest + own[first - 1][2]) < least:
                first -= 1
                rest += own[first][2]
            tenths[:] = 0
            for rows, value, _ in own[:first]:
                tenths[rows] += value
            named = np.flatnonzero(tenths)
            for rows, value, _ in own[first:]:
                at = np.minimum(np.searchsorted(rows, named), len(rows) - 1)
                tenths[named] += np.where(rows[at] == named, value[at], 0)
            score = np.round(tenths[named] / 10 / n * factor[named], 9)
            kept = score >= least
            named, score = named[kept], score[kept]
            if len(named) > self.best.k:  # of this block the best, ties by order
                cut = np.partition(score, len(score) - self.best.k)[len(score) - self.best.k]
                named, score = named[score >= cut], score[score >= cut]
                by = np.lexsort((order[named], -score))[: self.best.k]
                named, score = named[by], score[by]
            found.append((np.full(len(named), q), score, order[named], ids[named]))
        if found:
            self.best.add(*(np.concatenate(c) for c in zip(*found)))

    def result(self) -> pa.RecordBatch:
        b = self.best
        order, ids = (np.zeros(0, np.int64), np.zeros(0, object)) if b.order is None else (b.order, b.payload)
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(b.query)), pa.array(ids, pa.string()), pa.array(b.score), pa.array(order, pa.int64())], names=["query_id", "id", "score", "ep_ord"])


class Hits:
    """Kernel of all keyword hits: queries (query_id, tokens, stems), rows (id, ep_ord, tokens, stems, factor), where a row's
    stems are those of its tokens, one each. Gives (id, ep_ord, hits: array of query_id and score), ``PRODUCTS`` hits at once.

    A query's token scores in a row 10 exactly, 6 by stem, 5 as a compound that ends in a row's token (tenths), once a place in the query."""

    VALUES = (Postings.COMPOUND, Postings.STEM, Postings.EXACT)

    def __init__(self, queries: pa.Table):
        self.ids = queries.column("query_id").combine_chunks()
        known: dict[str, int] = {}
        self.whole, self.stems, self.ends = ({}, {}, {})  # numbers of the queries' tokens by token, stem and ending
        at, of = [], []
        tokens, stems = queries.column("tokens").to_pylist(), queries.column("stems").to_pylist()
        self.size = np.array([len(words or []) for words in tokens], np.float64)
        for q, (words, roots) in enumerate(zip(tokens, stems)):
            for word, root in zip(words or [], roots or []):
                if word not in known:
                    n = known[word] = len(known)
                    self.whole[word] = [n]
                    self.stems.setdefault(root, []).append(n)
                    for k in range(Postings.LEAST, len(word) - Postings.LONGER + 1):
                        self.ends.setdefault(word[-k:], []).append(n)
                at.append(known[word])
                of.append(q)
        number = np.array(at, np.int64)
        self.tokens, self.query = len(known), np.array(of, np.int64)[np.argsort(number, kind="stable")]
        self.count = np.bincount(number, minlength=self.tokens)
        self.begin = np.cumsum(self.count) - self.count
        self.step = max(1, PRODUCTS // max(1, len(at)))

    @staticmethod
    def spans(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
        """begin[0], begin[0] + 1, ... count[0] of them, and so on."""
        return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not len(self.query):
            return
        flat = batch.column(2).flatten().dictionary_encode()
        codes = flat.indices.to_numpy(zero_copy_only=False)
        first = np.zeros(len(flat.dictionary), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        number, value, count = [], [], []  # of the queries' tokens that a different token of the rows hits
        for token, root in zip(flat.dictionary.to_pylist(), batch.column(3).flatten().take(pa.array(first)).to_pylist()):
            own = (self.ends.get(token, ()), self.stems.get(root, ()), self.whole.get(token, ()))
            for v, hit in zip(self.VALUES, own):
                number += hit
                value += [v] * len(hit)
            count.append(sum(map(len, own)))
        number, value, count = np.array(number, np.int64), np.array(value, np.int8), np.array(count, np.int64)
        begin = np.cumsum(count) - count
        offsets, n = batch.column(2).offsets.to_numpy(), len(self.ids)
        offsets, factor = offsets - offsets[0], batch.column(4).to_numpy(zero_copy_only=False)
        for s in range(0, batch.num_rows, self.step):
            e = min(batch.num_rows, s + self.step)
            c = codes[offsets[s] : offsets[e]]
            row = np.repeat(np.repeat(np.arange(e - s), np.diff(offsets[s : e + 1])), count[c])
            at = self.spans(begin[c], count[c])
            key, v = row * self.tokens + number[at], value[at]
            best = np.zeros((e - s) * self.tokens, np.int8)
            for x in self.VALUES:
                best[key[v == x]] = x
            key = np.flatnonzero(best)
            row, token = key // self.tokens, key % self.tokens
            met = np.repeat(row * n, self.count[token]) + self.query[self.spans(self.begin[token], self.count[token])]
            tenths = np.bincount(met, np.repeat(best[key], self.count[token]), minlength=(e - s) * n)
            hit = np.flatnonzero(tenths)
            row, q = hit // n, hit % n
            score = tenths[hit] / 10 / self.size[q] * factor[s:e][row]
            hits = pa.StructArray.from_arrays([self.ids.take(pa.array(q)), pa.array(score)], ["query_id", "score"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=e - s))).astype(np.int32)), hits)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), batch.column(1).slice(s, e - s), lists], names=["id", "ep_ord", "hits"])
