"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built from a bounded sample of labelled text. A text is parsed
greedily into the longest phrases that occur in that sample; the fewer phrases per symbol, the lower the
cross entropy of the text with that language. Samples need not be alike in length: a phrase costs the bits
that name its place in the sample (with ``ROOM`` places more, so that short samples don't come cheap), and a
symbol that a sample lacks costs a phrase of the longest sample and one bit. The language with the fewest bits wins.

Symbols are lower-case letters; every run of other characters is one blank. Texts are parsed in blocks of
``BLOCK`` symbols, all blocks of a batch in step, so a phrase also ends at a block's end, for each language
alike. The sample is the only bounded part: every whole text is parsed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import free
from .tokens import bounded, groups, let_go

#: Labelled documents of each language, and symbols of each, that make its sample; the bound of the fit.
SAMPLE_DOCS = 160
SAMPLE_SLICE = 600
SAMPLE_SYMBOLS = 32_768
#: Symbols of all languages' samples together: with more languages the longest samples get less.
SAMPLE_TOTAL = 1_000_000
BLOCK = 512
#: Cells of the table of frequent symbols' transitions (32 MB); those of rarer symbols are looked up in sorted keys.
DENSE_CELLS = 1 << 23
#: Bytes of texts that are parsed at once, in about 40 times as much memory.
AT_ONCE = 1_000_000
#: Places added to each sample's own when a phrase is priced.
ROOM = 64
UNKNOWN = "und"


@lru_cache(1)
def _folded() -> np.ndarray:
    """For each code point: 0 if it is no letter, else its lower-case letter's code point."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def symbols(text: str) -> np.ndarray:
    """Lower-case letters' code points, with 0 for each run of anything else between letters."""
    s = _folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = s != 0
    if not letter.any():
        return s[:0]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of blanks
    s = s[keep]
    return s[:-1] if s[-1] == 0 else s


@dataclass
class Automata:
    """Suffix automata of all languages, their transitions in one table for frequent symbols and a sorted list for the
    rest; 0 for none. Its size is bounded by the samples' symbols and ``DENSE_CELLS``."""

    langs: list[str]
    alphabet: np.ndarray  # code points, sorted
    code: np.ndarray  # of each of the alphabet: its number by frequency, and one more for a symbol of no sample
    table: np.ndarray  # states x the most frequent symbols
    keys: np.ndarray  # state * (alphabet + 1) + symbol of the other transitions, sorted
    targets: np.ndarray  # of these keys
    roots: np.ndarray  # languages x alphabet: where a phrase that begins with a symbol goes, or the root
    start: np.ndarray  # each language's root
    sizes: np.ndarray  # symbols of each language's sample

    def encode(self, s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.alphabet, s).clip(max=len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == s, self.code[at], len(self.alphabet))

    def follow(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where each state (languages x texts) goes by each text's symbol."""
        width = self.table.shape[1]
        rare = np.flatnonzero(c >= width)
        if not len(rare):
            return self.table.reshape(-1)[state * width + c]
        to = self.table.reshape(-1)[state * width + np.minimum(c, width - 1)]
        if len(self.keys):
            wanted = state[:, rare].astype(np.int64) * (len(self.alphabet) + 1) + c[rare]
            at = np.searchsorted(self.keys, wanted).clip(max=len(self.keys) - 1)
            to[:, rare] = np.where(self.keys[at] == wanted, self.targets[at], 0)
        else:
            to[:, rare] = 0
        return to

    def phrases(self, parts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (texts x languages)."""
        return self._parse(parts)[0]

    def bits(self, parts: list[np.ndarray]) -> np.ndarray:
        """Bits that each text costs (texts x languages)."""
        n, unseen = self._parse(parts)
        price = np.log2(self.sizes + ROOM)
        return (n - unseen) * price + unseen * (price.max(initial=0) + 1)

    def _parse(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text, and how many of them are one symbol that the sample lacks."""
        sizes = np.array([len(p) for p in parts])
        blocks = -(-sizes // BLOCK)
        out = np.zeros((len(parts), len(self.langs)), np.int64)
        unseen = np.zeros_like(out)
        if not blocks.sum():
            return out, unseen
        all_syms = self.encode(np.concatenate(parts))
        ends = np.cumsum(sizes)
        for k in range(len(self.langs)):
            before = np.append(0, np.cumsum((self.roots[k] == self.start[k])[all_syms]))
            unseen[:, k] = before[ends] - before[ends - sizes]
        owner = np.repeat(np.arange(len(parts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = (np.cumsum(sizes) - sizes)[owner] + nth * BLOCK
        length = np.minimum(BLOCK, sizes[owner] - nth * BLOCK)
        order = np.argsort(-length, kind="stable")
        begin, length, owner = begin[order], length[order], owner[order]
        active = np.searchsorted(-length, -np.arange(BLOCK), side="left")  # blocks longer than t
        n_lang = len(self.langs)
        state = np.repeat(self.start[:, None], len(begin), axis=1)
        count = np.zeros((n_lang, len(begin)), np.int32)
        for t in range(int(length[0])):
            m = int(active[t])
            c = all_syms[begin[:m] + t]
            now = self.follow(state[:, :m], c)
            new = now == 0
            count[:, :m] += new
            state[:, :m] = np.where(new, self.roots[:, c], now)
        np.add.at(out, owner, count.T)
        return out, unseen


def automaton(s: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    last = 0
    for c in s:
        cur = len(nxt)
        nxt.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if longest[p] + 1 == longest[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def build(samples: dict[str, str]) -> Automata:
    """One automaton for each language's sample, of its own length up to the bound that holds for all."""
    langs = sorted(samples)
    syms = {k: symbols(samples[k])[:SAMPLE_SYMBOLS] for k in langs}
    left = SAMPLE_TOTAL
    for done, k in enumerate(sorted(langs, key=lambda k: len(syms[k]))):  # what short samples leave goes to the longer ones
        syms[k] = syms[k][: left // (len(langs) - done)]
        left -= len(syms[k])
    langs = [k for k in langs if len(syms[k])]
    alphabet, often = np.unique(np.concatenate([np.zeros(1, np.uint32), *[syms[k] for k in langs]]), return_counts=True)
    code = np.empty(len(alphabet), np.int64)
    code[np.argsort(-often, kind="stable")] = np.arange(len(alphabet))
    width = len(alphabet) + 1  # the last: a symbol of no sample
    roots, start, at = [], [], 0
    states: list[np.ndarray] = []
    by: list[np.ndarray] = []
    to: list[np.ndarray] = []
    for k in langs:
        nxt = automaton(code[np.searchsorted(alphabet, syms[k])].tolist())
        first = np.full(width, at, np.int32)
        first[list(nxt[0].keys())] = np.array(list(nxt[0].values()), np.int32) + at
        nxt[0] = {}  # at the root a phrase begins
        states.append(np.repeat(np.arange(len(nxt)), [len(x) for x in nxt]) + at)
        by.append(np.fromiter((c for x in nxt for c in x), np.int64))
        to.append(np.fromiter((t for x in nxt for t in x.values()), np.int64) + at)
        roots.append(first)
        start.append(at)
        at += len(nxt)
    state, c, target = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (states, by, to))
    # state 0 is the first root, which no transition leads to, so 0 can stand for none
    dense = max(1, min(len(alphabet), DENSE_CELLS // max(1, at)))
    table = np.zeros((max(1, at), dense), np.int32)
    often = c < dense
    table[state[often], c[often]] = target[often]
    keys = state[~often] * width + c[~often]
    order = np.argsort(keys)
    sizes = np.array([len(syms[k]) for k in langs], np.int64)
    first = np.array(roots, np.int32).reshape(len(langs), width)
    return Automata(langs, alphabet, code, table, keys[order], target[~often][order].astype(np.int32), first, np.array(start, np.int64), sizes)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Automata:
    """Automata from labelled rows of the training part (crc32 of the id as text, mod 4, is not 2).

    Of each language ``SAMPLE_DOCS`` documents, the first by a hash of their id, give ``SAMPLE_SLICE``
    characters each from a place that the same hash chooses. Only text and label are learned from.
    """
    h = F.xxhash64(F.lit("langid"), F.col(id_col).cast("string"))
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 4 != 2))
    rows = rows.select(F.col(lang_col).alias("lang"), h.alias("h"), F.length(text_col).alias("n"), F.col(text_col).alias("text")).where("n > 0")
    cut = rows.select("lang", "h", F.substring("text", F.pmod("h", F.greatest(F.lit(1), F.col("n") - SAMPLE_SLICE)).cast("int") + 1, F.lit(SAMPLE_SLICE)).alias("text"))
    first = cut.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("rn") <= SAMPLE_DOCS)
    samples: dict[str, list[str]] = {}
    for r in first.orderBy("lang", "rn").collect():
        samples.setdefault(r["lang"], []).append(r["text"])
    return build({k: "\n".join(v) for k, v in samples.items()})


def classify(automata: Automata, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text; the score is the winner's lead over the next, as a share of the next's bits."""
    parts = [symbols(t) if t else np.zeros(0, np.uint32) for t in texts]
    n = automata.bits(parts)
    langs, scores = [], []
    for p, row in zip(parts, n):
        if not len(p) or not automata.langs:
            langs.append(UNKNOWN)
            scores.append(0.0)
            continue
        best = int(row.argmin())  # ties: the first in order of name
        rest = np.delete(row, best)
        langs.append(automata.langs[best])
        scores.append(float(1 - row[best] / rest.min()) if len(rest) else 1.0)
    return langs, scores


def _told(shared, names: list[str]):
    """Rows whose last column is the text -> rows with language and score instead; ``shared`` is a broadcast of automata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            texts = b.column(b.num_columns - 1)
            sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in texts])
            for start, end in groups(sizes, most=AT_ONCE, rows=2000):
                part = b.slice(start, end - start)
                langs, scores = classify(shared.value, part.column(part.num_columns - 1).to_pylist())
                cols = [part.column(k) for k in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)
        let_go()

    return run


def predict(docs: DataFrame, automata: Automata, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """``docs`` with a language and a score, in columns that are replaced if ``docs`` has such.

    Null and empty texts, and texts without a letter, get ``und`` and 0.0; equal costs go to the language
    first by name, with score 0.0. Without any labelled text every row gets ``und``. Repeated rows are told each
    by itself; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automata)  # bounded by SAMPLE_TOTAL symbols and DENSE_CELLS
    rest = [c for c in docs.columns if c not in (lang_as, score_as)]
    rows = bounded(docs).select(*[F.col(f"`{c}`") for c in rest], F.col(text_col).alias(free(docs, "__text")[0]))
    kept = [f for f in docs.schema.fields if f.name in rest]
    schema = T.StructType([*kept, T.StructField(lang_as, T.StringType()), T.StructField(score_as, T.DoubleType())])

    return rows.mapInArrow(_told(shared, [*rest, lang_as, score_as]), schema)


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without those whose language can't be told: null, empty and blank texts, and texts without a letter.

    All columns are kept as they are, also those with the names of :func:`predict`'s. Repeated rows and null ids
    are told each by itself; an empty table gives no rows; without any labelled text nothing is kept.
    """
    lang, score = free(docs, "__lang_pred", "__score")
    known = predict(docs, fit(docs), lang_as=lang, score_as=score).where(F.col(lang) != UNKNOWN)
    return known.select(*[F.col(f"`{c}`") for c in docs.columns])
