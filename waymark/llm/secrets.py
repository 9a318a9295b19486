"""Secret scan: sliding-window Shannon entropy over candidate strings.

Candidates are runs of key-like characters. A run's alphabet (hexadecimal, base-36 or base-64) sets the
threshold; the entropy of every window of ``WINDOW`` characters is kept by adding and removing one count a
step. Runs whose highest window passes are secrets unless an allow-list entry explains them. Three fixed
patterns (assignments, access ids, hexadecimal keys) are found besides, whatever their entropy.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import bounded, groups

KINDS = ("assign", "access", "hex")
WINDOW = 20
#: Least entropy, in bits a character, of a candidate's highest window, by its alphabet.
THRESHOLDS = {"hex": 3.0, "base36": 3.6, "base64": 3.9}
#: A word of one case, with a capital perhaps, or a few of them run together; a random key has no such parts.
_WORD = r"(?:[A-Z]?[a-z]{1,32}|[A-Z]{1,32})(?:[A-Z][a-z]{2,32})*\d{0,4}"
#: Shapes of ordinary strings: UUIDs, dates and times, dotted names and numbers, words joined by hyphens, dots, slashes or underscores.
ALLOW = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"\d{4}-\d\d-\d\d([T_ ]?\d\d.?\d\d.?\d\d[.\dZ+-]*)?",
    r"[+\d][\d./=_-]*",
    rf"[./_=+-]*(?:{_WORD}|\d{{1,4}})([./_=+-]+(?:{_WORD}|\d{{1,4}}))*[./_=+-]*",
    r"(.)\1*",
)

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_KEYLIKE = _table(_LETTERS + _DIGITS + b"+/_.=-")
_HEX = _table(_DIGITS + b"abcdef")


def _runs(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of runs of at least ``least``."""
    edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    a, b = edges[::2], edges[1::2]
    long = b - a >= least
    return list(zip(a[long].tolist(), b[long].tolist()))


def window_entropy(s: bytes, window: int = WINDOW) -> float:
    """Highest Shannon entropy of the windows of a string (of the whole, if it is shorter)."""
    n = min(window, len(s))
    if not n:
        return 0.0
    term = [0.0, *[c * math.log2(c) for c in range(1, n + 1)]]
    count: dict[int, int] = {}
    total = 0.0  # sum of c log c
    best = -1.0
    for k, c in enumerate(s):
        had = count.get(c, 0)
        count[c] = had + 1
        total += term[had + 1] - term[had]
        if k >= n - 1:
            best = max(best, math.log2(n) - total / n)
            old = s[k - n + 1]
            count[old] -= 1
            total += term[count[old]] - term[count[old] + 1]
    return best


class Scanner:
    def __init__(self, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS, allow: tuple[str, ...] = ALLOW):
        self.window, self.thresholds = window, thresholds
        self.allowed = [re.compile(p) for p in allow]

    def alphabet(self, s: str) -> str:
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
            return "hex"
        return "base36" if re.fullmatch(r"[0-9a-z]+|[0-9A-Z]+", s) else "base64"

    def secret(self, s: str) -> float | None:
        """The entropy of a string that is a secret; None for others."""
        if any(p.fullmatch(s) for p in self.allowed):
            return None
        e = window_entropy(s.encode(), self.window)
        return e if e >= self.thresholds[self.alphabet(s)] else None

    def scan(self, text: str) -> list[tuple[str, int, int, bool, float]]:
        """(kind, start, end, base, entropy) by start, then kind as listed; positions in characters."""
        data = text.encode("utf-8", "surrogatepass")
        b = np.frombuffer(data, np.uint8)
        out: list[tuple[str, int, int, bool]] = []
        low = data.lower()
        if any(h in low for h in _HINTS):
            out += [("assign", m.start(), m.end(), True) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        if b"AKIA" in data:
            out += [("access", m.start(), m.end(), True) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
        if len(data) == len(text):
            at = None
        else:  # characters before each byte
            at = np.append(0, np.cumsum((b & 0xC0) != 0x80, dtype=np.int64))
        chars = (lambda k: k) if at is None else (lambda k: int(at[k]))
        out += [("hex", chars(i), chars(j), True) for i, j in _runs(_HEX[b], 16)]
        found = [(k, i, j, base, window_entropy(text[i:j].encode("utf-8", "surrogatepass"), self.window)) for k, i, j, base in out]
        taken = _merged([(i, j) for _, i, j, _ in out])
        ends = [j for _, j in taken]
        for i, j in _runs(_KEYLIKE[b], self.window):
            run, begin, end = data[i:j].decode(), chars(i), chars(j)
            k, last = bisect_left(ends, begin + 1), begin
            while last < end:  # what the patterns leave of the run
                x, y = taken[k] if k < len(taken) else (end, end)
                x = min(max(x, last), end)
                if x - last >= self.window and (e := self.secret(run[last - begin : x - begin])) is not None:
                    found.append(("entropy", last, x, False, e))
                last, k = max(x, y), k + 1
        order = {k: n for n, k in enumerate((*KINDS, "entropy"))}
        return sorted(found, key=lambda x: (x[1], order[x[0]], x[2]))


def _merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, joined where they overlap."""
    out: list[tuple[int, int]] = []
    for i, j in sorted(pairs):
        if out and i < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], j))
        else:
            out.append((i, j))
    return out


SPAN = "struct<kind:string,start:long,end:long,base:boolean,entropy:double>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("entropy", pa.float64())]))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row of ``docs``, by start.

    The patterns' spans come first; what they leave of a run of key-like characters is judged by its entropy.
    Null and empty texts have none. Repeated rows and null ids are scanned each by itself; an empty table
    gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            for i in range(0, b.num_rows, 500):
                rows = [
                    [dict(zip(("kind", "start", "end", "base", "entropy"), s)) for s in scanner.scan(t)] if t else []
                    for t in b.column(1).slice(i, 500).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 500), pa.array(rows, _SPAN)], names=["doc_id", "spans"])

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, spans array<{SPAN}>")


MASK = "[SECRET]"


def redact(text: str, found: list[tuple]) -> str:
    """A text with its spans, joined where they overlap, replaced by ``MASK``."""
    out, at = [], 0
    for i, j in _merged([s[1:3] for s in found]):
        out += [text[at:i], MASK]
        at = j
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced, and ``n_chars`` (where there is one) counted anew for those.

    Null and empty texts stay as they are; repeated rows and null ids are scanned each by itself; an empty table gives
    no rows; other columns, of whatever name, are kept. Time is linear in a text's length.
    """
    columns = docs.columns
    at, count = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None
    kind = docs.schema["n_chars"].dataType if count is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            for start, end in groups(np.array([len(x.as_buffer()) if x.is_valid else 0 for x in b.column(at)])):
                part = b.slice(start, end - start)
                texts = part.column(at).to_pylist()
                new: dict[int, str] = {}
                for k, t in enumerate(texts):
                    if t and (found := scanner.scan(t)):
                        new[k] = redact(t, found)
                if new:
                    cols = list(part.columns)
                    cols[at] = pa.array([new.get(k, t) for k, t in enumerate(texts)], cols[at].type)
                    if count is not None:
                        cols[count] = pa.array([len(new[k]) if k in new else n for k, n in enumerate(cols[count].to_pylist())], cols[count].type)
                    part = pa.RecordBatch.from_arrays(cols, names=columns)
                yield part

    if kind is not None and kind.typeName() not in ("long", "integer"):
        count = None
    return bounded(docs).mapInArrow(run, docs.schema)
