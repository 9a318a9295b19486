"""Content-addressed store of token ids.

A rolling hash over the last ``WINDOW`` ids cuts each document's id stream where it meets a mask, so equal
passages give equal chunks wherever they stand. A chunk's address is the SHA-256 of its bytes; each distinct
chunk is stored once. A document's recipe lists its chunks' addresses and the root of the Merkle tree over
them. Recipes are written in ascending order of doc_id, each with its place, ``nth``, and the number of ids
before it. The manifest is the Merkle tree over the recipes: ``FAN`` neighbours make a node, up to one root.

Layout, all Parquet: ``parts/kind=chunk`` (key = address, payload = little-endian ids of the encoder's width),
``recipes`` (doc_id, uid, nth, start, n_tokens, width, payload = addresses, root; file k holds the k-th range)
and ``manifest`` (level, node, n, digest). Reading back verifies every chunk against its address, every recipe
against its root and length, and all recipes against the manifest, so a lost or changed file is an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, partitions, saved
from .order import starts
from .tokens import ENCODE_BYTES, ENCODE_ROWS, bounded, encoder, groups, trim

END_ID = 2
WINDOW = 16
#: Ids of a chunk: on average about MASK + MIN_IDS, never over MAX_IDS.
MASK, MIN_IDS, MAX_IDS = 511, 64, 4096
#: Addresses a task remembers, to send a frequent chunk once; the rest is settled after the shuffle.
SEEN = 200_000

#: Recipes, or nodes, under one node of the manifest.
FAN = 1024

_MULTIPLIER = 0x9E3779B97F4A7C15
_POLY = 0xEDB88320

SCHEMA = "kind string, key binary, payload binary, doc_id long, uid long, n_tokens long, width int, root binary"
RECIPES = "doc_id long, uid long, nth long, start long, n_tokens long, width int, payload binary, root binary"
MANIFEST = "level int, node long, n long, digest string"
NAMES = ["kind", "key", "payload", "doc_id", "uid", "n_tokens", "width", "root"]


def marks(ids: np.ndarray) -> np.ndarray:
    """Ends of the windows whose hash meets the mask. Streams may be put end to end: a window that reaches back into
    the one before ends within a stream's first ``WINDOW`` ids, and no chunk is cut before ``MIN_IDS``, which is more."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(_MULTIPLIER)
        h ^= h >> np.uint64(29)
        power, span = np.uint64(0xD1342543DE82EF95), 1
        while span < WINDOW:  # windows of twice the length from two of this length
            wide = h.copy()
            wide[span:] += power * h[:-span]
            h, power, span = wide, power * power, 2 * span
        return np.flatnonzero((h >> np.uint64(40)) & np.uint64(MASK) == 0) + 1


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    return chosen(marks(ids).tolist(), len(ids))


def chosen(found: list[int], n: int) -> list[int]:
    """Those of its marks, and of places between them, where a stream of ``n`` ids is cut."""
    out, last = [], 0
    for at in [*found, n]:
        while at - last > MAX_IDS:
            last += MAX_IDS
            out.append(last)
        if at - last >= MIN_IDS or at == n and at > last:
            out.append(at)
            last = at
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root over leaf digests; an odd node moves up as it is, and no leaves give the digest of nothing."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[k] + level[k + 1]).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write chunks and recipes to ``path``.

    Repeated rows and null ids get recipes of their own. An empty table writes an empty store.
    """

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        enc = encoder(tokenizer)
        width, end = enc.dtype.itemsize, np.array([end_id], enc.dtype).tobytes()
        seen: set[bytes] = set()
        for b in batches:
            texts = b.column(2)
            sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in texts])
            for i, j in groups(sizes, ENCODE_BYTES, ENCODE_ROWS):
                rows: list[tuple] = []
                encoded = [raw + end for raw in enc.encode(texts.slice(i, j - i))]
                ends = np.cumsum([len(raw) // width for raw in encoded])
                found = marks(np.frombuffer(b"".join(encoded), enc.dtype))
                own = np.split(found, np.searchsorted(found, ends, "right"))
                for doc_id, uid, raw, stop, at_marks in zip(b.column(0).slice(i, j - i).to_pylist(), b.column(1).slice(i, j - i).to_pylist(), encoded, ends.tolist(), own):
                    n = len(raw) // width
                    digests, last = [], 0
                    for at in chosen((at_marks - (stop - n)).tolist(), n):
                        payload = raw[last * width : at * width]
                        last = at
                        d = hashlib.sha256(payload).digest()
                        digests.append(d)
                        if d not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(d)
                            rows.append(("chunk", d, payload, None, None, None, width, None))
                    rows.append(("recipe", uid.to_bytes(8, "little"), b"".join(digests), doc_id, uid, n, width, merkle(digests)))
                cols = list(zip(*rows))
                types = [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=NAMES)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            keys = [x.as_py() for x in b.column(1)]
            keep = np.array([k != p for k, p in zip(keys, [last, *keys[:-1]])], bool)
            last = keys[-1] if keys else last
            yield b.filter(pa.array(keep))

    spark = docs.sparkSession
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.col(text_col).alias("text"))
    sent = rows.mapInArrow(chunk, SCHEMA).repartition(partitions(rows), "kind", "key").sortWithinPartitions("kind", "key")
    sent.mapInArrow(once, SCHEMA).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/parts")
    loose = _read(spark, path, "recipe").select("doc_id", "uid", "n_tokens", "width", "payload", "root")
    placed = starts(loose, ["doc_id", "uid"], "n_tokens")
    # ``start`` rises from row to row, so its ranges are those of doc_id
    ordered = placed.select(*[c.split()[0] for c in RECIPES.split(", ")]).repartitionByRange(partitions(loose), "start").sortWithinPartitions("start")
    ordered.write.option("compression", "zstd").parquet(f"{path}/recipes")
    for old in (placed, _At(spark, f"{path}/parts/kind=recipe")):
        discard(old)
    manifest(spark, path).write.option("compression", "zstd").parquet(f"{path}/manifest")


class _At:
    """Names a folder to :func:`discard`."""

    def __init__(self, spark: SparkSession, path: str):
        self.sparkSession, self._waymark_path = spark, path


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(SCHEMA.replace("kind string, ", "") + ", kind string").parquet(f"{path}/parts").where(F.col("kind") == kind)


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(level, node, n, digest) of the tree over a store's recipes; the last level has one node. No recipes give one node of none."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    leaf = F.sha2(F.concat_ws("|", text("doc_id"), "nth", "start", "n_tokens", F.hex("root")), 256)
    level, levels = 1, []
    below = _recipes(spark, path).select(F.col("nth").alias("place"), F.lit(1).cast("long").alias("n"), leaf.alias("digest"))
    while True:
        node = F.floor(F.col("place") / FAN).alias("node")
        grouped = below.groupBy(node).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("of"))  # FAN at most
        at = saved(grouped.select(F.lit(level).alias("level"), "node", "n", F.sha2(F.array_join("of.digest", ""), 256).alias("digest")), "manifest")
        levels.append(at)
        if at.count() <= 1:
            break
        level, below = level + 1, at.select(F.col("node").alias("place"), "n", "digest")
    out = levels[0]
    for more in levels[1:]:
        out = out.union(more)
    if out.isEmpty():
        out = spark.range(1).select(F.lit(1).alias("level"), F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("n"), F.sha2(F.lit(""), 256).alias("digest"))
    return out


def verify_recipes(spark: SparkSession, path: str) -> None:
    """Raises an error if the recipes aren't those that the manifest was made of."""
    known, found = spark.read.schema(MANIFEST).parquet(f"{path}/manifest"), manifest(spark, path)
    if known.isEmpty():
        raise ValueError("the manifest is lost")
    keys = ["level", "node", "n", "digest"]
    odd = known.select(*keys).exceptAll(found.select(*keys)).union(found.select(*keys).exceptAll(known.select(*keys)))
    worst = odd.orderBy("level", "node").first()
    if worst is not None:
        raise ValueError(f"recipes are lost or damaged: node {worst['node']} of level {worst['level']} of the manifest differs")


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials mod the CRC-32 polynomial, lowest power in the highest bit."""
    out = np.zeros_like(a)
    b = b.copy()
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), b >> np.uint32(1) ^ np.uint32(_POLY), b >> np.uint32(1))
    return out


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What CRCs add to that of a longer string, ``n_bytes`` after their own end."""
    power = np.full(1, 1 << 23, np.uint32)  # x^8
    out, left = crc.astype(np.uint32), n_bytes.astype(np.int64).copy()
    while left.any():
        odd = left & 1 == 1
        if odd.any():
            out[odd] = _times(out[odd], np.broadcast_to(power, odd.sum()).copy())
        power = _times(power, power)
        left >>= 1
    return out


def verified_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(key, n_ids, crc) of every stored chunk, the CRC-32 being that of its ids as unsigned 32-bit; a chunk
    whose bytes don't give its address is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, crc = [], []
            for key, payload, width in zip(b.column(0), b.column(1), b.column(2).to_pylist()):
                raw = payload.as_buffer().to_pybytes()
                if hashlib.sha256(raw).digest() != key.as_buffer().to_pybytes():
                    raise ValueError(f"chunk {key.as_py().hex()} is damaged")
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["key", "n_ids", "crc"])

    return _read(spark, path, "chunk").select("key", "payload", "width").mapInArrow(run, "key binary, n_ids long, crc long")


def _recipe_parts(spark: SparkSession, path: str) -> DataFrame:
    """(uid, pos, key): every recipe's chunks."""
    recipes = _recipes(spark, path).select("uid", "payload")
    n = (F.octet_length("payload") / 32).cast("int")
    at = recipes.select("uid", "payload", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    return at.select("uid", "pos", F.substring("payload", F.col("pos") * 32 + 1, F.lit(32)).alias("key"))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the store's files alone.

    The recipes are held against the manifest at once; every chunk against its address and every recipe against its
    Merkle root and length as rows are read. A difference is an error. ``start`` counts the ids of all documents
    before it in ascending doc_id order (nulls first, repeated ids as they were numbered).
    """
    verify_recipes(spark, path)
    # a list for each document, as long as the document
    of = _recipe_parts(spark, path).join(verified_chunks(spark, path), "key", "left")
    lists = of.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("n_ids", F.lit(-1)).alias("n_ids"), F.coalesce("crc", F.lit(0)).alias("crc")))).alias("parts"))
    recipes = _recipes(spark, path).select("uid", "doc_id", "start", "n_tokens", F.col("payload").alias("keys"), "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid, doc_id, start, n_tokens = (b.column(k) for k in range(4))
            for u, keys, root in zip(uid.to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist()):
                if merkle([keys[k : k + 32] for k in range(0, len(keys), 32)]) != root:
                    raise ValueError(f"recipe {u} is damaged")
            parts = b.column(6)
            sizes = np.diff(parts.offsets.to_numpy())
            flat = parts.flatten()
            n, crc = flat.field(1).to_numpy(zero_copy_only=False), flat.field(2).to_numpy(zero_copy_only=False)
            if (n < 0).any():
                raise ValueError("a recipe names a chunk that is not stored")
            owner = np.repeat(np.arange(b.num_rows), sizes)
            ends = np.cumsum(n)
            base = np.cumsum(sizes)
            after = ends[base - 1][owner] - ends if len(ends) else ends
            sums = np.bincount(owner, n, b.num_rows).astype(np.int64)
            if (sums != n_tokens.to_numpy()).any():
                raise ValueError("a document's chunks have another length than its recipe")
            moved = shifted(crc.astype(np.uint32), after * 4)
            whole = np.bitwise_xor.reduceat(moved, base - sizes) if len(moved) else moved
            yield pa.RecordBatch.from_arrays([doc_id, start, n_tokens, pa.array(whole.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    joined = recipes.join(lists, "uid").select("uid", "doc_id", "start", "n_tokens", "keys", "root", "parts")
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, uid, ids): each document's ids put together from its chunks."""
    chunks = _read(spark, path, "chunk").select("key", "payload", "width")
    of = _recipe_parts(spark, path).join(chunks, "key")
    lists = of.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("pos", "payload", "width"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                ids = [np.concatenate([np.frombuffer(p["payload"], f"<u{p['width']}").astype(np.int32) for p in parts]) for parts in b.column(2).slice(k, 64).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 64), b.column(1).slice(k, 64), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "uid", "ids"])

    return _recipes(spark, path).select("uid", "doc_id").join(lists, "uid").select("doc_id", "uid", "parts").mapInArrow(run, "doc_id long, uid long, ids array<int>")
