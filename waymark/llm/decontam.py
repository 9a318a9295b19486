"""Benchmark decontamination by size-partitioned MinHash containment search.

An item leaks into a document if at least ``THRESHOLD`` of the item's distinct five-word shingles occur in it,
anywhere in the whole text. A MinHash sketch of a long document can't show a short item, so the sketches are
the items': items are partitioned by size (powers of two), and all items of a partition keep as many
bottom-k MinHash values as guarantee a hit, floor((1 - threshold) * largest size) + 1. If an item is contained
to the threshold, at least one value of its sketch is a shingle of the document, so the search misses nothing.
Partitions whose smallest item needs more shingles than a document has are skipped. Each candidate is then
verified by exact containment of the shingles' words.

Words are lower-cased and cut at blanks and ASCII punctuation. An item of one to four words has one shingle,
all its words; an item without words leaks nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved
from .names import free
from .tokens import bounded, groups

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: The items are broadcast up to this many, of this many bytes together; beyond it sketches are joined.
BROADCAST_ITEMS, BROADCAST_BYTES = 20_000, 8_000_000

_BLANKS = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def normal(text: str | None) -> bytes:
    """A text's words, joined by single spaces."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANKS).split())


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS[:] = []
        for base in (_BASE, inverse):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def shingles(texts: list[bytes], lengths: list[int]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each shingle length: (text number, start byte in it, end byte, hash) of every shingle of the
    normalised texts. Equal shingles have equal hashes; the reverse is checked where it matters."""
    joined = b" \n ".join(texts)  # a word of its own between two texts
    data = np.frombuffer(b" " + joined + b" ", np.uint8)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    blank = np.flatnonzero(data == 32)
    first, last = blank[:-1] + 1, blank[1:]
    word = last > first  # not between two blanks beside an empty text
    first, last = first[word], last[word]
    stop = data[first] == 10 if len(first) else np.zeros(0, bool)
    owner = np.cumsum(stop)
    base = np.cumsum([0, *[len(t) + 3 for t in texts[:-1]]]) + 1
    out = {}
    for n in lengths:
        if len(first) < n:
            z = np.zeros(0, np.int64)
            out[n] = (z, z, z, np.zeros(0, np.uint64))
            continue
        a, b = first[: len(first) - n + 1], last[n - 1 :]
        ok = (owner[: len(a)] == owner[n - 1 :]) & ~stop[: len(a)]
        a, b, doc = a[ok], b[ok], owner[: len(ok)][ok]
        h = (total[b] - total[a]) * down[a]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        out[n] = (doc, a - base[doc], b - base[doc], h)
    return out


@dataclass
class Items:
    ids: list[int | None]
    sizes: list[int]  # distinct shingles
    of: dict[bytes, list[int]]  # items of each shingle
    sketch: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by shingle length: hash, item, least shingles
    #: what an item needs at least
    need: list[int]


def index(rows: list[tuple[int | None, str | None]], threshold: float = THRESHOLD) -> Items:
    """Sketches of items (id, text), partitioned by size."""
    ids, sizes, of, need = [], [], {}, []
    entries: dict[int, list[tuple[int, int, int]]] = {}
    own: list[tuple[int, dict[bytes, int]]] = []
    for item_id, text in rows:
        words = normal(text)
        n_words = words.count(b" ") + 1 if words else 0
        if not n_words:
            continue
        length = min(SHINGLE_WORDS, n_words)
        _, a, b, h = shingles([words], [length])[length]
        mine = {words[i:j]: v for i, j, v in zip(a.tolist(), b.tolist(), h.tolist())}
        k = len(ids)
        ids.append(item_id)
        sizes.append(len(mine))
        need.append(int(np.ceil(threshold * len(mine) - 1e-9)))
        own.append((length, mine))
        for s in mine:
            of.setdefault(s, []).append(k)
    largest: dict[int, int] = {}
    least: dict[int, int] = {}
    for n in sizes:
        c = n.bit_length()
        largest[c] = max(n, largest.get(c, 0))
        least[c] = min(n, least.get(c, n))
    for k, (length, mine) in enumerate(own):
        c = sizes[k].bit_length()
        keep = int((1 - threshold) * largest[c] + 1e-9) + 1
        for v in sorted(set(mine.values()))[:keep]:
            entries.setdefault(length, []).append((v, k, int(np.ceil(threshold * least[c] - 1e-9))))
    sketch = {}
    for length, found in entries.items():
        found.sort()
        sketch[length] = (np.array([x[0] for x in found], np.uint64), np.array([x[1] for x in found], np.int64), np.array([x[2] for x in found], np.int64))
    return Items(ids, sizes, of, sketch, need)


class _Search:
    """Looks a group of texts up in the items' sketches."""

    def __init__(self, items: Items):
        self.items = items
        self.filters = {}
        for length, (h, _, _) in items.sketch.items():
            bits = max(16, min(24, 6 + len(h).bit_length()))
            table = np.zeros(1 << bits, bool)
            table[h >> np.uint64(64 - bits)] = True
            self.filters[length] = (table, np.uint64(64 - bits))

    def run(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(text, item, matching shingles) of every leak."""
        items, out = self.items, []
        all_shingles = shingles(texts, sorted(items.sketch)) if texts else {}
        counts = {n: np.bincount(x[0], minlength=len(texts)) for n, x in all_shingles.items()}
        pairs: dict[int, set[int]] = {}
        for length, (h, item, least) in items.sketch.items():
            doc, _, _, found = all_shingles[length]
            table, shift = self.filters[length]
            at = np.flatnonzero(table[found >> shift])
            left, right = np.searchsorted(h, found[at], "left"), np.searchsorted(h, found[at], "right")
            for d, lo, hi in zip(doc[at].tolist(), left.tolist(), right.tolist()):
                for e in range(lo, hi):
                    if counts[length][d] >= least[e]:
                        pairs.setdefault(d, set()).add(int(item[e]))
        for d, wanted in pairs.items():
            hits: dict[int, int] = {}
            for length in items.sketch:
                doc, a, b, _ = all_shingles[length]
                lo, hi = np.searchsorted(doc, [d, d + 1])
                text = texts[d]
                for s in {text[i:j] for i, j in zip(a[lo:hi].tolist(), b[lo:hi].tolist())}:
                    for k in items.of.get(s, ()):
                        hits[k] = hits.get(k, 0) + 1
            out += [(d, k, hits[k]) for k in sorted(wanted) if hits.get(k, 0) >= items.need[k]]
        return out


def _small(items: DataFrame, text_col: str) -> bool:
    r = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b")).first()
    return r["n"] <= BROADCAST_ITEMS and r["b"] <= BROADCAST_BYTES


def _broadcast(spark, items: DataFrame, id_col: str, text_col: str, threshold: float):
    rows = items.select(F.col(id_col).cast("long"), F.col(text_col)).orderBy(id_col, text_col).collect()  # within the bound that _small checks
    return spark.sparkContext.broadcast(index([(r[0], r[1]) for r in rows], threshold))


LEAKS = "doc_id long, item_id long, matched long, item_shingles long, containment double"


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", broadcast: bool | None = None) -> DataFrame:
    """(doc_id, item_id, matched, item_shingles, containment) of every leaked item of every row of ``docs``.

    Null and empty texts hold nothing; repeated rows, of either table, are found each by itself; null ids stay
    null. Empty tables give no rows. Other columns are not read. ``broadcast`` overrides the size check.
    """
    if not (_small(items, text_col) if broadcast is None else broadcast):
        return _joined(docs, items, threshold, id_col, text_col, item_col)
    shared = _broadcast(docs.sparkSession, items, item_col, text_col, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(shared.value)
        for b in batches:
            for start, end in groups(_sizes(b.column(1)), most=1_000_000):
                ids = b.column(0).slice(start, end - start).to_pylist()
                found = search.run([normal(t) for t in b.column(1).slice(start, end - start).to_pylist()])
                yield _leak_batch([(ids[d], shared.value.ids[k], m, shared.value.sizes[k]) for d, k, m in found])

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, LEAKS)


def _sizes(texts: pa.Array) -> np.ndarray:
    return np.array([len(x.as_buffer()) if x.is_valid else 0 for x in texts])


def _leak_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 4
    share = [m / n for _, _, m, n in rows]
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols], pa.array(share, pa.float64())], names=["doc_id", "item_id", "matched", "item_shingles", "containment"])


def _joined(docs: DataFrame, items: DataFrame, threshold: float, id_col: str, text_col: str, item_col: str) -> DataFrame:
    """The same for any number of items: sketch values and document shingles meet in a shuffled join."""
    own = saved(items.select(F.col(item_col).cast("long").alias("item_id"), F.monotonically_increasing_id().alias("item_uid"), F.col(text_col).alias("item_text")), "items")
    texts = saved(bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.col(text_col).alias("text")), "texts")

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for uid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                one = index([(uid, text)], threshold)
                if one.ids:  # the partition's largest size, taken at its upper end
                    words = normal(text)
                    length = min(SHINGLE_WORDS, words.count(b" ") + 1)
                    values = sorted(set(shingles([words], [length])[length][3].tolist()))
                    keep = int((1 - threshold) * ((1 << one.sizes[0].bit_length()) - 1) + 1e-9) + 1
                    rows += [(v - (1 << 63), length, uid) for v in values[:keep]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["h", "len", "item_uid"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, end in groups(_sizes(b.column(1)), most=1_000_000):
                uid = b.column(0).slice(start, end - start).to_numpy(zero_copy_only=False)
                for n, (doc, _, _, h) in shingles([normal(t) for t in b.column(1).slice(start, end - start).to_pylist()], list(range(1, SHINGLE_WORDS + 1))).items():
                    value = (h ^ np.uint64(1 << 63)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(np.full(len(h), n, np.int64)), pa.array(uid[doc])], names=["h", "len", "uid"])

    sketch = own.select("item_uid", "item_text").mapInArrow(sketches, "h long, len long, item_uid long")
    found = texts.select("uid", "text").mapInArrow(spread, "h long, len long, uid long")
    pairs = found.join(sketch, ["h", "len"]).select("uid", "item_uid").distinct()
    both = pairs.join(texts, "uid").join(own, "item_uid").select("doc_id", "text", "item_id", "item_text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, item_id, item_text in zip(*[b.column(k).to_pylist() for k in range(4)]):
                one = index([(item_id, item_text)], threshold)
                rows += [(doc_id, item_id, m, one.sizes[0]) for _, _, m in _Search(one).run([normal(text)])]
            yield _leak_batch(rows)

    return both.mapInArrow(verify, LEAKS)


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that any item leaks into.

    Null, empty and short texts hold no item and stay, repeated rows and null ids are told each by itself; items that are null
    or empty leak nowhere, and an empty table of either gives what there is. Other columns, of whatever name, are kept.
    """
    columns = docs.columns
    if not _small(items, "text"):
        (uid,) = free(docs, "__uid")
        own = saved(docs.withColumn(uid, F.monotonically_increasing_id()), "docs")
        bad = _joined(own, items, threshold, uid, "text", "item_id").select(F.col("doc_id").alias(uid)).distinct()
        return own.join(bad, uid, "left_anti").select(*[F.col(f"`{c}`") for c in columns])
    shared = _broadcast(docs.sparkSession, items, "item_id", "text", threshold)
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(shared.value)
        for b in batches:
            for start, end in groups(_sizes(b.column(at)), most=1_000_000):
                part = b.slice(start, end - start)
                keep = np.ones(part.num_rows, bool)
                keep[[d for d, _, _ in search.run([normal(t) for t in part.column(at).to_pylist()])]] = False
                yield part.filter(pa.array(keep))

    return bounded(docs).mapInArrow(run, docs.schema)
