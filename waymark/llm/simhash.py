"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a word of the perfect
binary Golay code of 23 bits. Decoding gives the index of the nearest codeword; a word at the covering
radius of 3 also gets the five codewords at distance 4. Two words that differ in at most two bits then
share an index. If two fingerprints differ in at most four bits, then

* one segment is equal and another differs in at most two bits: they share (equal segment, index), or
* every segment differs, in at most two bits each: they share (index, index, index).

So equal keys find every link, and each is verified on the full fingerprints. Distinct fingerprints alone
are compared; equal ones are one node. A key with very many fingerprints is compared in pairs of bounded
blocks, and each block yields a spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import partitions, saved
from .graph import components
from .names import free
from .tokens import bounded

SHINGLE_WORDS = 4
MOST_BITS = 4
SEED = 42
#: Bits of the segments, from the lowest.
SEGMENTS = (22, 21, 21)
#: Fingerprints of one key that a task compares at once; larger keys are cut into blocks of about half of it.
BLOCK = 4096

#: Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
_GENERATOR = 0b110001110101


def hashes(data: bytes, words_per_shingle: int) -> np.ndarray:
    """Hash of every shingle of a UTF-8 text, in order of the text; a shorter text is one shingle, a blank one has none."""
    import xxhash

    words = data.lower().split()  # of bytes: folds A-Z, cuts at space and \\x09-\\x0d
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    n = len(words)
    if n <= words_per_shingle:
        return np.array([hashed(joined, SEED)] if n else [], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)).tolist()
    starts = [0, *[e + 1 for e in ends[: n - words_per_shingle]]]
    return np.fromiter([hashed(joined[a:b], SEED) for a, b in zip(starts, ends[words_per_shingle - 1 :])], np.uint64, n - words_per_shingle + 1)


def vote(h: np.ndarray) -> int:
    """SimHash of shingles' hashes: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):
        part = h[k : k + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(data: bytes, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of a UTF-8 text."""
    return vote(hashes(data, words_per_shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of every whole text as a signed 64-bit number; null texts count as empty (0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_buffer().to_pybytes()) if x.is_valid else 0 for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parity of each 12-bit message; error pattern of each syndrome; what to add to the nearest index for
    each syndrome's other indices; and how many indices it has (1 or 6)."""
    messages = np.arange(4096)
    parity = messages << 11
    for bit in range(22, 10, -1):
        parity = np.where(parity >> bit & 1, parity ^ (_GENERATOR << (bit - 11)), parity)
    code = messages << 11 | parity
    single = 1 << np.arange(23)
    patterns = [0, *single.tolist()]
    patterns += [int(single[i] | single[j]) for i in range(23) for j in range(i)]
    patterns += [int(single[i] | single[j] | single[k]) for i in range(23) for j in range(i) for k in range(j)]
    pat = np.array(patterns)
    syndrome = (pat & 2047) ^ parity[pat >> 11]
    errors = np.zeros(2048, np.int64)
    errors[syndrome] = pat
    blocks = code[np.bitwise_count(code) == 7]
    others = np.zeros((2048, 6), np.int64)
    count = np.ones(2048, np.int64)
    for e, s in zip(pat.tolist(), syndrome.tolist()):
        if e.bit_count() == 3:
            others[s, 1:] = blocks[blocks & e == e] >> 11
            count[s] = 6
    return parity, errors, others, count


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices (n x 6) of 23-bit words, and how many of them count."""
    parity, errors, others, count = golay()
    syndrome = (words & 2047) ^ parity[words >> 11]
    nearest = (words ^ errors[syndrome]) >> 11
    return nearest[:, None] ^ others[syndrome], count[syndrome]


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of each fingerprint; a key's top bits tell its kind."""
    f = fps.view(np.uint64)
    seg, at = [], 0
    for width in SEGMENTS:
        seg.append(((f >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    decoded = [indices(s) for s in seg]
    rows, out = [], []
    slot = np.arange(6)
    for i in range(3):
        for j in range(3):
            if i != j:
                idx, n = decoded[j]
                r, c = np.nonzero(slot < n[:, None])
                rows.append(r)
                out.append((np.int64(1 + 3 * i + j) << 58) | seg[i][r] << 12 | idx[r, c])
    (a, na), (b, nb), (c, nc) = decoded
    r, s = np.nonzero(slot < na[:, None])
    r2, t = np.nonzero(slot < nb[r][:, None])
    r3, u = np.nonzero(slot < nc[r[r2]][:, None])
    row = r[r2[r3]]
    rows.append(row)
    out.append((np.int64(12) << 58) | a[row, s[r2[r3]]] << 24 | b[row, t[r3]] << 12 | c[row, u])
    return np.concatenate(rows), np.concatenate(out)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for k in range(0, len(fps), 2000):
            part = np.ascontiguousarray(fps[k : k + 2000])
            row, key = keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["key", "fp"])


def forest(fps: np.ndarray, most_bits: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs within ``most_bits`` connect, fewer than there are fingerprints."""
    left = np.unique(fps.view(np.uint64))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= most_bits
            if near.any():
                hit = left[near]
                a.append(np.full(len(hit), x, np.uint64))
                b.append(hit)
                todo.extend(hit)
                left = left[~near]
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str], most: int):
    """Rows sorted by ``names``, as blocks that never cut a run shorter than ``most`` rows."""
    held: list[np.ndarray] | None = None
    for b in batches:
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)]
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
        n = len(held[0])
        last = [held[k][-1] for k in range(len(names))]
        start = n
        same = np.ones(n, bool)
        for k, v in enumerate(last):
            same &= held[k] == v
        start = n - int(same[::-1].argmin()) if not same.all() else 0
        if start:
            yield [c[:start] for c in held]
            held = [c[start:] for c in held]
        while len(held[0]) >= most:
            yield [c[:most] for c in held]
            held = [c[most:] for c in held]
    if held is not None and len(held[0]):
        yield held


def _linker(n_keys: int, block: int, spill: bool, most_bits: int):
    """Links within runs of equal keys; with ``spill``, the rows of runs over ``block`` rows come back unlinked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

        open_key, open_rows = None, 0  # of a long run that goes on from block to block
        for cols in _runs(batches, [""] * n_keys, block + 1 if spill else 1 << 62):
            key, fp = cols[:n_keys], np.ascontiguousarray(cols[n_keys])
            new = np.ones(len(fp), bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
            starts = np.flatnonzero(new)
            size = np.diff(np.append(starts, len(fp)))
            if spill:
                first = (key[0][0],)
                long = size > block
                if open_rows and first == open_key:
                    long[0] = True
                open_key, open_rows = (key[0][-1],), int(long[-1])
                if long.any():
                    rows = np.repeat(long, size)
                    yield out(1, key[0][rows], fp[rows])
            else:
                long = np.zeros(len(size), bool)
            group = np.repeat(np.arange(len(size)), size)
            short = np.repeat((size <= 24) & ~long, size)
            g, f = group[short], fp[short]
            for lag in range(1, 24):
                if lag >= len(g):
                    break
                same = g[lag:] == g[:-lag]
                if not same.any():
                    break
                a, b = f[:-lag][same], f[lag:][same]
                ok = np.bitwise_count((a ^ b).view(np.uint64)) <= most_bits
                if ok.any():
                    yield out(0, a[ok], b[ok])
            for k in np.flatnonzero((size > 24) & ~long).tolist():
                a, b = forest(fp[starts[k] : starts[k] + size[k]], most_bits)
                if len(a):
                    yield out(0, a, b)

    return run


def links(fps: DataFrame, most_bits: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect exactly those within ``most_bits`` (at most 4) bits."""
    if not 0 <= most_bits <= MOST_BITS:
        raise ValueError("the keys find links of up to four bits")
    n = partitions(fps, 200)  # so many keys a fingerprint at most, on average
    keyed = fps.select("fp").where("fp IS NOT NULL").mapInArrow(_keyed, "key long, fp long")
    found = saved(
        keyed.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_linker(1, block, True, most_bits), "kind int, a long, b long").distinct(),
        "fp-links",
    )
    near = found.where("kind = 0").select("a", "b")
    wide = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    # keys of more than a block: every pair of half-blocks is one task's run
    sizes = wide.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(block // 2)).cast("int").alias("parts"))
    part = wide.join(sizes, "key").withColumn("p", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    pairs = part.select("key", "fp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"), "p").select(
        "key", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "fp"
    )
    spread = F.xxhash64("key", "i", "j").alias("key")
    far = (
        pairs.select(spread, "fp")
        .repartition(n, "key")
        .sortWithinPartitions("key", "fp")
        .mapInArrow(_linker(1, block, False, most_bits), "kind int, a long, b long")
        .select("a", "b")
    )
    return near.union(far)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for every row of ``docs``.

    Every row counts, repeated ones too. Null, empty and blank texts have fingerprint zero and link like any
    other. ``component_id`` is the smallest non-null id reachable over links, so a null id gets the id of its
    component, or null if that has none. An empty table gives no rows; other columns are not read.
    """
    fps = saved(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    roots = components(links(nodes, most_bits))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest doc_id.

    Near copies (:mod:`.nearcopies`) are found by :func:`links` on SimHashes of five-word shingles, and exactly beyond its
    radius; both are verified by a Jaccard similarity of 0.8 or more of the sets of shingles.

    Of different texts with that id the one of the smallest hash stays, and of its repeated rows one. Documents
    without an id can't be named by a group and stay. Null, empty and blank texts are copies of each other. An empty
    table gives no rows; other columns, of whatever name, are kept. Who stays is settled on ids and hashes alone;
    texts are sent once, to meet the outcome.
    """
    from .nearcopies import near_copies
    from .sift import split

    at = F.xxhash64(F.col("text").cast("binary"))
    named = near_copies(docs).where("doc_id IS NOT NULL")
    each = named.groupBy("root", "doc_id", "at").agg(F.count(F.lit(1)).alias("n"))
    first = each.groupBy("root").agg(F.min(F.struct("doc_id", "at")).alias("x"))
    stays = (F.col("doc_id") == F.col("x.doc_id")) & (F.col("at") == F.col("x.at"))
    place, keeps = free(docs, "__at", "__stays")
    told = each.join(first, "root").select("doc_id", F.col("at").alias(place), stays.alias(keeps), "n")
    # the rest of the documents stand alone and stay without a shuffle
    odd = saved(told.where(~F.col(keeps) | (F.col("n") > 1)).select("doc_id", place, keeps), "near-odd")
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), place)
    may, alone = split(docs.withColumn(place, at), key, odd, F.struct("doc_id", place))
    met = may.join(odd, ["doc_id", place], "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = alone.select(*columns).union(met.where(F.col(keeps).isNull()).select(*columns))
    if not odd.where(keeps).isEmpty():
        out = out.union(met.where(keeps).dropDuplicates(["doc_id", place]).select(*columns))
    return out
