"""Ordinal quality classifier: cumulative-link regression on graded ratings.

A document's grade is 0 (toxic), 1 (poor) or 2 (good). One vector of weights over hashed text is shared by all
grades and ordered thresholds cut its score: P(grade >= k) = logistic(score - threshold_k). The sum of the two
tail probabilities is the expected grade; the last one, of being good, decides the selection.

Features are a document's distinct words and the beginnings of these words (a word's form goes by its stem in
any language), hashed, and a few classes of shape (repetition, symbols, words without a letter). The fit uses a
bounded sample of labelled documents; every whole document is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved
from .tokens import bounded

#: Labelled documents of the fit, the first by a hash of their id.
SAMPLE = 8000
BITS = 18
STEMS = (3, 4, 5, 6, 7)
#: A feature gets a weight if so many documents of the sample have it, and if the share of any grade among them
#: differs from its share of all by so many standard errors: far more than chance gives one of 2**BITS features.
LEAST_DOCS, LEAST_Z = 8, 4.5
GRADES = 3
CACHE_WORDS = 400_000

_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def word_features(token: str) -> list[int]:
    """Hashed features of a lower-cased token: its word and the word's beginnings."""
    word = token.strip(_STRIP)
    if not word:
        return []
    mask = (1 << BITS) - 1
    return [zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass")) & mask, *[zlib.crc32(b"s" + word[:n].encode("utf-8", "surrogatepass")) & mask for n in STEMS if len(word) > n]]


def shape_features(tokens: list[str], distinct: set[str]) -> list[int]:
    """Hashed classes of the share of repeated tokens, of tokens without a letter and of tokens that end in a run of symbols."""
    n = len(tokens)
    bare = sum(not t.strip(_STRIP) for t in tokens if len(t) < 4) / n
    noisy = sum(len(t) > 3 and t[-1] in _STRIP and t[-2] in _STRIP for t in tokens) / n
    repeated = min(9, int(10 * (1 - len(distinct) / n))) if n >= 20 else -1
    line = sum(a == b for a, b in zip(tokens, tokens[1:])) / n
    named = (f"repeated {repeated}", f"bare {min(4, int(bare * 20))}", f"noisy {min(4, int(noisy * 20))}", f"stutter {min(4, int(line * 20))}")
    return [zlib.crc32(s.encode()) & ((1 << BITS) - 1) for s in named]


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each score."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -40, 40)))


def fit(rows: list[np.ndarray], grades: np.ndarray, rounds: int = 150, l2: float = 2e-3, rate: float = 0.05) -> Model:
    """Cumulative-link regression by Adam on documents' feature lists (a feature may stand in a list more than once)."""
    size = 1 << BITS
    if not len(rows):
        return Model(np.zeros(size, np.float32), np.arange(1, GRADES) - GRADES / 2.0)
    docs = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feats = np.concatenate(rows).astype(np.int64)
    pair, count = np.unique(docs * size + feats, return_counts=True)
    docs, feats = pair // size, pair % size
    seen = np.bincount(feats, minlength=size)
    told = np.zeros(size, bool)
    for g in range(GRADES):
        p = (grades == g).mean()
        z = (np.bincount(feats, (grades[docs] == g).astype(float), size) - seen * p) / np.sqrt(np.maximum(seen, 1) * max(p * (1 - p), 1e-9))
        told |= np.abs(z) >= LEAST_Z
    kept = (told & (seen >= LEAST_DOCS))[feats]
    docs, feats, value = docs[kept], feats[kept], np.log1p(count[kept]).astype(np.float64)
    used, feats = np.unique(feats, return_inverse=True)
    n = len(rows)
    share = np.array([(grades >= k).mean() for k in range(1, GRADES)]).clip(0.01, 0.99)
    # thresholds: the first, and gaps that stay positive
    first = -np.log(share[0] / (1 - share[0]))
    gaps = np.log(np.maximum(0.1, np.diff(-np.log(share / (1 - share)))))
    theta = np.concatenate([[first], gaps, np.zeros(len(used))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k = GRADES - 1
    # every grade weighs the same
    per = np.bincount(grades, minlength=GRADES)
    weight = np.sqrt(n / (GRADES * np.maximum(per, 1)))[grades]
    weight /= weight.sum()
    for step in range(1, rounds + 1):
        w = theta[k:]
        cut = np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:k]))])
        s = np.bincount(docs, w[feats] * value, n)
        tail = 1 / (1 + np.exp(-np.clip(s[:, None] - cut, -40, 40)))
        full = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        p = np.maximum(full[np.arange(n), grades] - full[np.arange(n), grades + 1], 1e-9)
        slope = np.concatenate([np.zeros((n, 1)), tail * (1 - tail), np.zeros((n, 1))], axis=1)
        up, down = slope[np.arange(n), grades] / p, slope[np.arange(n), grades + 1] / p
        ds = -(up - down) * weight
        dcut = np.zeros(k)
        np.add.at(dcut, np.maximum(grades - 1, 0), np.where(grades > 0, up * weight, 0))
        np.add.at(dcut, np.minimum(grades, k - 1), np.where(grades < k, -down * weight, 0))
        grad = np.concatenate([[dcut.sum()], [dcut[j:].sum() * np.exp(theta[j]) for j in range(1, k)], np.bincount(feats, ds[docs] * value, len(used)) + l2 * w])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[used] = theta[k:]
    return Model(weights, np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:k]))]))


def features(text: str) -> np.ndarray:
    tokens = text.lower().split()
    distinct = set(tokens)
    out = [f for t in distinct for f in word_features(t)]
    return np.array(out + (shape_features(tokens, distinct) if tokens else []), np.int32)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on the first ``sample`` labelled documents by a hash of their id.

    ``labels`` has (doc_id, quality, toxic): toxic is grade 0, else quality 0 is grade 1 and quality 1 grade 2;
    the least of a document's labels counts. Rows with a null id, text or label are not learned from.
    """
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & F.col("quality").isNotNull())
    chosen = known.groupBy(F.col(id_col).alias("id")).agg(F.min(grade).alias("grade")).orderBy(F.xxhash64(F.lit("quality"), "id"), "id").limit(sample)
    rows = bounded(docs).where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = pa.array([features(t) for t in b.column(2).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["id", "grade", "features"])

    listed = saved(rows.select("id", "grade", "text").mapInArrow(run, "id long, grade int, features array<int>"), "quality-features")
    # the features that tell grades apart are chosen where the documents are, so that only theirs reach the driver
    of = [F.count_if(F.col("grade") == g).alias(f"n{g}") for g in range(GRADES)]
    total = listed.agg(F.count(F.lit(1)).alias("n"), *of).first()
    seen = listed.select("grade", F.explode(F.array_distinct("features")).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("seen"), *of)
    z = F.lit(0.0)
    for g in range(GRADES):
        share = total[f"n{g}"] / max(1, total["n"])
        z = F.greatest(z, F.abs(F.col(f"n{g}") - F.col("seen") * share) / F.sqrt(F.col("seen") * max(share * (1 - share), 1e-9)))
    told = seen.where((F.col("seen") >= LEAST_DOCS) & (z >= LEAST_Z - 1e-6)).select("f")
    own = listed.select("id", "grade", F.explode("features").alias("f")).join(F.broadcast(told), "f").groupBy("id", "grade").agg(F.sort_array(F.collect_list("f")).alias("fs"))
    got = listed.select("id", "grade").join(own, ["id", "grade"], "left").orderBy("id").collect()  # as many as sampled
    return fit([np.array(r["fs"] or [], np.int32) for r in got], np.array([r["grade"] for r in got], np.int64))


def score(docs: DataFrame, model: Model, keep_at: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, p_clean, p_good, keep) of every row of ``docs``.

    ``p_clean`` is P(grade >= 1) and ``p_good`` P(grade >= 2); ``keep`` is p_good >= ``keep_at``. Null, empty and
    blank texts score 0 in all and are not kept; repeated rows and null ids are scored each by itself; an empty
    table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.weights.astype(float)
        # log1p of counts is over a document's features, so words give theirs and the document sums them up
        cache: dict[str, list[int]] = {}
        for b in batches:
            for i in range(0, b.num_rows, 500):
                texts = b.column(1).slice(i, 500).to_pylist()
                total, blank = np.zeros(len(texts)), np.zeros(len(texts), bool)
                for k, t in enumerate(texts):
                    tokens = t.lower().split() if t else []
                    if not tokens:
                        blank[k] = True
                        continue
                    distinct = set(tokens)
                    out = shape_features(tokens, distinct)
                    for x in distinct:
                        f = cache.get(x)
                        if f is None:
                            if len(cache) >= CACHE_WORDS:
                                cache.clear()
                            f = cache[x] = [v for v in word_features(x) if w[v] != 0.0]
                        out += f
                    feats, n = np.unique(np.array(out, np.int64), return_counts=True)
                    total[k] = w[feats] @ np.log1p(n)
                tails = shared.value.tails(total)
                tails[blank] = 0.0
                cols = [pa.array(tails.sum(1)), pa.array(tails[:, 0]), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= keep_at)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 500), *cols], names=["doc_id", "expected_grade", "p_clean", "p_good", "keep"])

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, expected_grade double, p_clean double, p_good double, keep boolean")
