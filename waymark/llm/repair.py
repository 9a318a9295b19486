"""Conversation structure repair by generalised LR parsing.

The roles of a sound conversation are ``(s?(ua)+)?``. An LR automaton is made of that grammar, and all repairs of a
conversation are parsed at once on a graph-structured stack: stacks share their tails, every row is kept, reroled or
deleted and turns are inserted on each of them, and stacks that become equal are merged into the one of the least
(cost, audit). The grammar is left-recursive, so there are never more than a handful of stacks.

Equal costs mean audits of which neither begins the other (a longer one has more insertions, and these cost), so the least
audit of a part stays least whatever follows. A conversation of many rows or bytes is therefore cut into segments that
are parsed from every stack they may be entered with, in any order and by any task; a pass along the segments picks the
cheapest way, holding one short comparison of the stacks' audits, not the audits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import partitions, saved
from .sift import split

#: Left and right sides of the role grammar; S is a conversation, P its pairs.
GRAMMAR = (("S", ""), ("S", "P"), ("S", "sP"), ("P", "ua"), ("P", "Pua"))
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows and bytes of a conversation that one task repairs by itself; larger ones go in segments of so many rows.
LONG_ROWS, LONG_BYTES, SEGMENT = 4096, 16 << 20, 2048
#: Bytes of repaired text that cross to the hashing task as one row, about.
CHUNK = 1 << 20
#: What counts as blank, and how a finished turn ends.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"

Stack = tuple  # (state, the stack below), down to (0, None)
START: Stack = (0, None)


@lru_cache(1)
def automaton() -> tuple[dict[tuple[int, str], int], list[list[tuple[str, int]]]]:
    """(goto of state and symbol, productions that end in each state) of the grammar's LR(0) automaton."""

    def closed(items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        todo = list(items)
        while todo:
            p, dot = todo.pop()
            for q, (left, _) in enumerate(GRAMMAR):
                if GRAMMAR[p][1][dot : dot + 1] == left and (q, 0) not in items:
                    items.add((q, 0))
                    todo.append((q, 0))
        return frozenset(items)

    states = [closed({(q, 0) for q, (left, _) in enumerate(GRAMMAR) if left == "S"})]
    goto: dict[tuple[int, str], int] = {}
    for at, state in enumerate(states):  # grows
        for symbol in sorted({GRAMMAR[p][1][dot] for p, dot in state if dot < len(GRAMMAR[p][1])}):
            to = closed({(p, dot + 1) for p, dot in state if GRAMMAR[p][1][dot : dot + 1] == symbol})
            if to not in states:
                states.append(to)
            goto[at, symbol] = states.index(to)
    return goto, [[(GRAMMAR[p][0], dot) for p, dot in sorted(state) if dot == len(GRAMMAR[p][1])] for state in states]


def shifted(stack: Stack, symbol: str) -> list[Stack]:
    """Every stack that a role makes of a stack: shifted and as far reduced as it goes."""
    goto, ends = automaton()
    if (stack[0], symbol) not in goto:
        return []
    out, todo = [], [(goto[stack[0], symbol], stack)]
    while todo:
        top = todo.pop()
        pairs = [size for left, size in ends[top[0]] if left != "S"]
        if not pairs:
            out.append(top)
        for size in pairs:
            below = top
            for _ in range(size):
                below = below[1]
            todo.append((goto[below[0], "P"], below))
    return out


@lru_cache(1)
def stacks() -> list[Stack]:
    """All stacks there are, from the empty one."""
    known = [START]
    for stack in known:  # grows
        known += [t for symbol in "sua" for t in shifted(stack, symbol) if t not in known]
    return known


@lru_cache(1)
def _moves() -> list[dict[str, list[int]]]:
    return [{symbol: [stacks().index(t) for t in shifted(stack, symbol)] for symbol in "sua"} for stack in stacks()]


@lru_cache(1)
def accepting() -> list[int]:
    return [k for k, stack in enumerate(stacks()) if any(left == "S" for left, _ in automaton()[1][stack[0]])]


def _closed(front: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str]]:
    """``front`` with everything that insertions reach."""
    todo = list(front)
    while todo:
        at = todo.pop()
        cost, audit = front[at]
        for role in "ua":
            for to in _moves()[at][role]:
                if to not in front or (cost + INSERT, audit + "I") < front[to]:
                    front[to] = (cost + INSERT, audit + "I")
                    todo.append(to)
    return front


def parse(tokens: str, start: int = 0) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) to each stack that the tokens lead to from one.

    A token is a row: its role's initial (x for no role of the grammar), upper-case if it is truncated, d if it has to go.
    """
    moves = _moves()
    front = _closed({start: (0, "")})
    for token in tokens:
        new: dict[int, tuple[int, str]] = {}
        own, extra = (token.lower(), TRUNCATED * token.isupper()) if token != "d" else ("", 0)
        for at, (cost, audit) in front.items():
            ways = [(at, cost + DELETE, "D")]
            if own:
                ways += [(to, cost + extra, "K") for to in moves[at].get(own, [])]
                ways += [(to, cost + REROLE + extra, "R") for role in "ua" if role != own for to in moves[at][role]]
            for to, price, edit in ways:
                now = (price, audit + edit)
                if to not in new or now < new[to]:
                    new[to] = now
        front = _closed(new)
    return front


def best(tokens: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation's repair."""
    ends = parse(tokens)
    return min(ends[k] for k in accepting() if k in ends)


@lru_cache(20_000)
def _best_of_few(tokens: str) -> tuple[int, str]:
    return best(tokens)


def turns(audit: str, rows: Iterator[tuple[str, bytes, int]], stack: int = 0) -> Iterator[tuple[bytes, bytes]]:
    """The repaired (role, text) of an audit over rows (token, line, bytes of its role), entered with a stack."""
    at = stack
    for edit in audit:
        token, line, role = next(rows) if edit != "I" else ("", b":", 0)
        if edit == "D":
            continue
        due = token.lower() if edit == "K" else next(r for r in "ua" if _moves()[at][r])
        yield line[:role] if edit == "K" else ROLES[due].encode(), line[role + 1 :]
        at = _moves()[at][due][0]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, m, role, text): the damaged rows, each standing for ``m`` equal ones; dropped rows have m = 0 and no role or text."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"))
    rows = rows.withColumn("act", F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20)
    act = F.col("act")
    text = F.when(act == 1, "").when(act == 2, F.translate("text", ENDS, "")).when(act > 0, F.col("text"))
    role = F.when(act == 4, "user").when(act > 0, F.col("role"))
    return rows.select("conv_id", "turn", F.when(act == 0, 0).when(act == 3, 2).otherwise(1).cast("long").alias("m"), role.alias("role"), text.alias("text"))


def _prepared(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, m, role, text) with what the repair needs: (.., token, line, role_bytes, name).

    ``name`` tells role and text; of a blank row also the turn, as blank rows need no earlier ones to go by."""
    line = F.concat("role", F.lit(":"), "text")
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    own = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    token = F.when(F.col("m") == 0, "").when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(*ENDS), own).otherwise(F.upper(own))
    rows = rows.select("conv_id", "turn", F.col("m").alias("n"), own.alias("own"), token.alias("token"), line.cast("binary").alias("line"), F.octet_length("role").alias("role_bytes"))
    at = F.when(F.col("token") == "b", F.coalesce(F.col("turn").cast("string"), F.lit(" "))).otherwise("")
    return rows.withColumn("name", F.md5(F.concat(F.concat_ws(":", F.col("role_bytes").cast("string"), at, F.lit("")).cast("binary"), "line")))


ROW = "conv_id long, turn long, own string, token string, later boolean, n long, role_bytes int, line binary"
NAMES = [c.split()[0] for c in ROW.split(", ")]


def _folded(rows: DataFrame) -> DataFrame:
    """One row for equal ones of a turn, and whether an earlier turn has the same role and text (``later``).

    Texts that occur once in their conversation, nearly all, don't take part in a shuffle here."""
    key = F.struct("conv_id", "name")
    again = rows.where("n > 0").groupBy("conv_id", "name").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    again = saved(again.select(F.col("conv_id").alias("conv"), F.col("name").alias("named"), F.col("first.turn").alias("first")), "repeated")
    may, alone = split(rows.where("n > 0"), key, again, F.struct(F.col("conv").alias("conv_id"), F.col("named").alias("name")))
    one = may.groupBy("conv_id", "turn", "name").agg(*[F.first(c).alias(c) for c in ("own", "token", "line", "role_bytes")], F.sum("n").alias("n"))
    met = one.join(again, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("name") == F.col("named")), "left")
    later = F.col("named").isNotNull() & F.col("turn").isNotNull() & (F.col("first").isNull() | (F.col("turn") > F.col("first")))
    dropped = rows.where("n = 0").select("conv_id", F.lit(None).cast("long").alias("turn"), "own", "token", "line", "role_bytes", "n").distinct()
    return (
        met.withColumn("later", later).select(*NAMES).union(alone.withColumn("later", F.lit(False)).select(*NAMES)).union(dropped.withColumn("later", F.lit(False)).select(*NAMES))
    )


class Tally:
    """Counts of a conversation, or of a segment of one, over its rows in order."""

    FIELDS = ("turns", "blank", "duplicate", "truncated", "illegal")

    def __init__(self) -> None:
        self.low = self.high = self.first = self.last = None  # turns
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.own = self.end = ""  # initials of the first and last row

    def add(self, turn: int | None, own: str, token: str, later: bool, n: int, more: bool = False) -> str:
        """Count a row and give its tokens; ``more`` copies of the row before are all duplicates, but of a blank row."""
        if not n:
            return ""
        if turn is not None and turn != self.last:
            self.turns += 1
            self.low, self.first = (turn, turn) if self.low is None else (self.low, self.first)
            self.high = self.last = turn
        self.illegal += n - 1 + (self.end != "" and self.end + own not in ("su", "ua", "au"))
        self.own, self.end = self.own or own, own
        if token == "b":
            self.blank += n
            return "d" * n
        if later or more:
            self.duplicate += n
            return "d" * n
        self.duplicate += n - 1
        self.truncated += token.isupper()
        return token + "d" * (n - 1)

    def follow(self, row: dict) -> None:
        """Add the tally of the segment that comes next, as a dictionary."""
        joint = self.last is not None and row["first"] == self.last
        for f in self.FIELDS:
            setattr(self, f, getattr(self, f) + row[f])
        self.turns -= joint
        if row["own"]:
            self.illegal += self.end != "" and self.end + row["own"] not in ("su", "ua", "au")
            self.end = row["end"]
        if row["first"] is not None:
            self.low = row["first"] if self.low is None else self.low
            self.high = self.last = row["last"]

    def gaps(self) -> int:
        return self.high - self.low + 1 - self.turns if self.turns else 0


OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
OUT_NAMES = [c.split()[0] for c in OUT.split(", ")]


OUT_TYPES = [pa.int64()] * 7 + [pa.string()] * 2
TURNS = "conv_id long, part int, seg int, nth int, role binary, text binary"
TURN_NAMES = [c.split()[0] for c in TURNS.split(", ")]
TURN_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _sent(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _short(texts: bool):
    """Rows in order of conversation and place -> its repair, or with ``texts`` its repaired turns. The sort has put a
    conversation's rows together."""

    def finished(conv: int | None, rows: list[tuple]) -> list[tuple]:
        tally = Tally()
        each: list[tuple[str, bytes, int]] = []
        for turn, own, token, later, n, role, line in rows:
            each += [(t, line, role) for t in tally.add(turn, own, token, later, n)]
        tokens = "".join(t for t, _, _ in each)
        cost, audit = _best_of_few(tokens) if len(tokens) <= 32 else best(tokens)
        told = turns(audit, iter(each))
        if texts:
            return [(conv, 0, 0, nth, role, text) for nth, (role, text) in enumerate(told)]
        digest = hashlib.sha256(b"\n".join(role + b":" + text for role, text in told)).hexdigest()
        return [(conv, tally.gaps(), tally.blank, tally.duplicate, tally.truncated, tally.illegal, cost, audit, digest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (TURN_TYPES, TURN_NAMES) if texts else (OUT_TYPES, OUT_NAMES)
        held: list[tuple] = []
        conv: int | None = None
        for b in batches:
            out = []
            for row in zip(*(b.column(k).to_pylist() for k in range(b.num_columns))):
                if held and row[0] != conv:
                    out += finished(conv, held)
                    held = []
                conv = row[0]
                held.append(row[1:])
            if out:
                yield _sent(out, *shape)
        if held and (out := finished(conv, held)):
            yield _sent(out, *shape)

    return run


def _cut(segment: int):
    """Sorted rows -> the same with ``more`` (copies of the row before, without its text), ``part``, ``seg`` and ``pos``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, size, pos, conv = TaskContext.get().partitionId(), -1, 0, 0, None
        for b in batches:
            rows = []
            for row in zip(*(b.column(k).to_pylist() for k in range(b.num_columns))):
                left = row[5]
                while True:
                    n = min(left, 1 if left == row[5] else segment)  # the first copy stands alone
                    if seg < 0 or row[0] != conv or size + n > segment:
                        seg, size, conv = seg + 1, 0, row[0]
                    more = left != row[5]
                    rows.append((*row[:5], n, row[6], None if more else row[7], more, part, seg, pos))
                    pos, size, left = pos + 1, size + n, left - n
                    if left <= 0:
                        break
            if rows:
                cols = [pa.array(c, f.type) for c, f in zip(zip(*rows), b.schema)]
                tail = [pa.array(c, t) for c, t in zip(list(zip(*rows))[len(cols) :], (pa.bool_(), pa.int32(), pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*cols, *tail], names=[*NAMES, "more", "part", "seg", "pos"])

    return run


TABLE = "conv_id long, part int, seg int, turns long, blank long, duplicate long, truncated long, illegal long, first long, last long, own string, end string, ways array<struct<start:int,end:int,cost:long,audit:string>>"


def _tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A segment's rows, as an array -> its tally and the repairs from every stack to every stack."""
    for b in batches:
        out = []
        for conv, part, seg, items in zip(*(b.column(k).to_pylist() for k in range(4))):
            tally = Tally()
            tokens = "".join(tally.add(x["turn"], x["own"], x["token"], x["later"], x["n"], x["more"]) for x in items)
            ways = [{"start": s, "end": e, "cost": cost, "audit": audit} for s in range(len(stacks())) for e, (cost, audit) in parse(tokens, s).items()]
            out.append((conv, part, seg, *(getattr(tally, f) for f in Tally.FIELDS), tally.first, tally.last, tally.own, tally.end, ways))
        way = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        types = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 7, pa.string(), pa.string(), way]
        names = [c.split()[0] for c in TABLE.split(", ")]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


class Fold:
    """The cheapest way along segments to each stack. Of the audits so far it keeps their order, which of them differ only in
    the insertions they end in, and how many those are: all that later comparisons need."""

    def __init__(self) -> None:
        self.at = {0: (0, 0, 0, 0)}  # stack: (cost, rank, core, insertions at the end)

    def follow(self, ways: list[dict]) -> tuple[list[int], list[str]]:
        """Take the next segment; for each stack where it is entered from (-1: it isn't reached) and the audit there."""

        def order(x: tuple, y: tuple) -> int:
            (_, rank, core, k), a = x
            (_, other, its, j), b = y
            p, q = ("I" * k + a, "I" * j + b) if core == its else (rank, other)
            return (p > q) - (p < q)

        new: dict[int, tuple] = {}
        for w in ways:
            if w["start"] in self.at:
                old = self.at[w["start"]]
                cost, way = old[0] + w["cost"], (old, w["audit"])
                best = new.get(w["end"])
                if best is None or cost < best[0] or cost == best[0] and order(way, best[1]) < 0:
                    new[w["end"]] = (cost, way, w["start"])
        by = sorted(new, key=cmp_to_key(lambda x, y: order(new[x][1], new[y][1])))
        cores: dict[tuple[int, str], int] = {}
        self.at = {}
        for rank, to in enumerate(by):
            cost, ((_, _, core, k), audit), _ = new[to]
            whole = "I" * k + audit
            bare = whole.rstrip("I")
            self.at[to] = (cost, rank, cores.setdefault((core, bare), len(cores)), len(whole) - len(bare))
        every = range(len(stacks()))
        return [new[k][2] if k in new else -1 for k in every], [new[k][1][1] if k in new else "" for k in every]

    def end(self) -> tuple[int, int]:
        """(stack, cost) of the whole conversation's repair."""
        cost, _, at = min((self.at[k][0], self.at[k][1], k) for k in accepting() if k in self.at)
        return at, cost


ALONG = "conv_id long, part int, seg int, back array<int>, audits array<string>, closing int, cost long, gaps long, blank long, duplicate long, truncated long, illegal long"


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order -> each one's entries and audits; the last of a conversation has its totals and closing stack."""
    names = [c.split()[0] for c in ALONG.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32(), *[pa.int64()] * 6]
    fold, tally, held = Fold(), Tally(), None

    def closed(row: tuple) -> tuple:
        at, cost = fold.end()
        return (*row, at, cost, tally.gaps(), tally.blank, tally.duplicate, tally.truncated, tally.illegal)

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for b in batches:
        for row in b.to_pylist():
            if held is not None:
                over = held[0] != row["conv_id"]
                yield sent([closed(held) if over else (*held, *[None] * 7)])
                if over:
                    fold, tally = Fold(), Tally()
            tally.follow(row)
            held = (row["conv_id"], row["part"], row["seg"], *fold.follow(row["ways"]))
    if held is not None:
        yield sent([closed(held)])


def _back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments from the last to the first -> the stack each is entered with and its piece of the audit."""
    at = -1
    for b in batches:
        out = []
        for row in b.to_pylist():
            at = at if row["closing"] is None else row["closing"]
            out.append((row["conv_id"], row["part"], row["seg"], row["back"][at], row["audits"][at]))
            at = row["back"][at]
        if out:
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv_id", "part", "seg", "stack", "piece"])


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a segment in order, with its piece -> its repaired turns, in batches of bounded size."""

    def told(key: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        stack, piece = rows[0][3:5]
        each = ((t, line or b"", role) for later, n, more, _, _, token, role, line in rows for t in _tokens(token, later or more, n))
        out, size = [], 0
        for nth, (role, text) in enumerate(turns(piece, each, stack)):
            out.append((*key, nth, role, text))
            size += len(text)
            if size >= CHUNK:
                yield _sent(out, TURN_TYPES, TURN_NAMES)
                out, size = [], 0
        if out:
            yield _sent(out, TURN_TYPES, TURN_NAMES)

    held: list[tuple] = []
    key: tuple | None = None
    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in range(b.num_columns))):
            if held and row[:3] != key:
                yield from told(key, held)
                held = []
            key = row[:3]
            held.append(row[3:])
    if held:
        yield from told(key, held)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of segments in order -> (conv_id, part, seg, nth, bytes): many lines as one row; each line begins with a line feed."""
    names, types = ["conv_id", "part", "seg", "nth", "bytes"], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    key, buffer = None, bytearray()
    for b in batches:
        for *own, nth, role, text in zip(*(b.column(k).to_pylist() for k in range(b.num_columns))):
            if buffer and (own != key[:3] or len(buffer) >= CHUNK):
                yield _sent([(*key, bytes(buffer))], types, names)
                buffer = bytearray()
            key = [*own, nth]
            buffer += b"\n" + role + b":" + text
    if buffer:
        yield _sent([(*key, bytes(buffer))], types, names)


def _tokens(token: str, gone: bool, n: int) -> str:
    return "" if not n else "d" * n if gone or token == "b" else token + "d" * (n - 1)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order -> each conversation's SHA-256; one chunk is held at a time."""

    def sent(conv: int | None, digest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    conv, digest = None, None
    for b in batches:
        for own, data in zip(b.column(0).to_pylist(), b.column(1)):
            if digest is not None and own != conv:
                yield sent(conv, digest)
                digest = None
            text = data.as_buffer()
            if digest is None:
                conv, digest, text = own, hashlib.sha256(), text[1:]
            digest.update(text)
    if digest is not None:
        yield sent(conv, digest)


def _segments(rows: DataFrame, segment: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(closings, pieces, turns) of conversations of any length, by segments."""
    n = partitions(rows, 2)
    ranged = rows.repartitionByRange(n, "conv_id", "turn", F.substring("line", 1, 64)).sortWithinPartitions(*ORDER)
    placed = saved(ranged.mapInArrow(_cut(segment), f"{ROW}, more boolean, part int, seg int, pos long"), "placed-rows")
    item = F.struct("pos", "turn", "own", "token", "later", "n", "more")
    tables = placed.groupBy("conv_id", "part", "seg").agg(F.sort_array(F.collect_list(item)).alias("items")).mapInArrow(_tabled, TABLE)
    along = saved(tables.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "seg").mapInArrow(_along, ALONG), "segments")
    behind = along.select("conv_id", "part", "seg", "back", "audits", "closing").repartition(n, "conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seg"))
    pieces = saved(behind.mapInArrow(_back, "conv_id long, part int, seg int, stack int, piece string"), "audit-pieces")
    told = placed.join(pieces.select("part", "seg", "stack", "piece"), ["part", "seg"]).select("conv_id", "part", "seg", "later", "n", "more", "stack", "piece", "token", "role_bytes", "line", "pos")
    told = told.repartition(n, "part", "seg").sortWithinPartitions("part", "seg", "pos").drop("pos")
    return along.where("closing IS NOT NULL"), pieces, told.mapInArrow(_written, TURNS)


def _long(rows: DataFrame, segment: int) -> DataFrame:
    closings, pieces, told = _segments(rows, segment)
    chunks = told.mapInArrow(_chunked, "conv_id long, part int, seg int, nth int, bytes binary")
    chunks = chunks.repartition(partitions(rows, 2), "conv_id").sortWithinPartitions("conv_id", "part", "seg", "nth")
    digests = chunks.select("conv_id", "bytes").mapInArrow(_hashed, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "hashed")
    audits = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "seg", "piece"))).alias("p")).select(F.col("conv_id").alias("audited"), F.array_join("p.piece", "").alias("audit"))
    ends = closings.join(audits, F.col("conv_id").eqNullSafe(F.col("audited")))
    out = ends.join(digests, F.col("conv_id").eqNullSafe(F.col("hashed")), "left")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))).select(*OUT_NAMES)


ORDER = ("conv_id", "turn", "line", "role_bytes")


def _dealt(rows: DataFrame, long_rows: int, long_bytes: int, texts: bool) -> tuple[DataFrame, DataFrame | None]:
    """The work of :func:`_short` on the conversations that a task may hold, and the rows of the others, if there are any."""
    ready = _prepared(rows)
    sizes = ready.groupBy("conv_id").agg(F.sum("n").alias("rows"), F.sum(F.octet_length("line")).alias("bytes"))
    large = saved(sizes.where((F.col("rows") > long_rows) | (F.col("bytes") > long_bytes)).select(F.col("conv_id").alias("large")), "long-conversations")
    folded, of = _folded(ready), F.col("conv_id").eqNullSafe(F.col("large"))
    short = folded.join(large, of, "left_anti").repartition(partitions(rows, 2), "conv_id").sortWithinPartitions(*ORDER)
    done = short.mapInArrow(_short(texts), TURNS if texts else OUT)
    return done, None if large.isEmpty() else folded.join(large, of, "left_semi")


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of ``rows``.

    ``rows`` (conv_id, turn, m, role, text) are taken in order of turn (nulls first), then of ``role:text`` and of the role's
    length, as bytes; each stands for ``m`` equal ones, and m = 0 only names its conversation. A null conv_id is a
    conversation. A role that is empty, or begins with none of s, u, a, fits nowhere: it is reroled or deleted. Conversations
    without rows have zeros, an empty audit and the hash of the empty string. An empty table gives no rows; other
    columns are not read. A conversation's audit is one value, so it has less than 2**31 rows.
    """
    short, rest = _dealt(rows, long_rows, long_bytes, False)
    return short if rest is None else short.union(_long(rest, segment))


def repaired(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, part, seg, nth, role, text): the turns of the repaired conversations, in order of part, seg and nth.

    Rows are taken as by :func:`repair`; conversations of which nothing is left give no rows."""
    short, rest = _dealt(rows, long_rows, long_bytes, True)
    out = short if rest is None else short.union(_segments(rest, segment)[2])
    return out.withColumn("role", F.col("role").cast("string")).withColumn("text", F.col("text").cast("string"))
