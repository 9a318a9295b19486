import hashlib
import heapq
import random
import zlib

import pytest

from waymark.llm import queries, repair

from ..conftest import SMALL

WHITE = " \t\n\x0b\x0c\r"
#: Roles of the repaired conversation so far -> roles that may follow: nothing, s, u after s or a pair, a.
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        role, text, act = role if role is not None else " ", text if text is not None else " ", zlib.crc32(key.encode()) % 20
        text = "" if act == 1 else "".join(c for c in text if c not in ".!?") if act == 2 else text
        out += [(conv, turn, "user" if act == 4 else role, text)] * {0: 0, 3: 2}.get(act, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Least (cost, audit) by search over (rows taken, last role kept), and the repaired lines of the audit."""
    todo = [(0, "", 0, "", ())]
    done = set()
    while todo:
        cost, audit, k, last, told = heapq.heappop(todo)
        if (k, last) in done:
            continue
        done.add((k, last))
        if k == len(rows) and last in ("", "a"):
            return cost, audit, told
        for r in NEXT[last]:
            if r != "s":
                name = {"u": "user", "a": "assistant"}[r]
                heapq.heappush(todo, (cost + 3, audit + "I", k, r, (*told, name + ":")))
        if k < len(rows):
            _, _, role, text = rows[k]
            heapq.heappush(todo, (cost + 4, audit + "D", k + 1, last, told))
            if found[k] not in ("blank", "duplicate"):
                extra = 3 * (found[k] == "truncated")
                for r in NEXT[last]:
                    if role[:1] == r:
                        heapq.heappush(todo, (cost + extra, audit + "K", k + 1, r, (*told, f"{role}:{text}")))
                    elif r != "s":
                        name = {"u": "user", "a": "assistant"}[r]
                        heapq.heappush(todo, (cost + extra + 3, audit + "R", k + 1, r, (*told, f"{name}:{text}")))
    raise AssertionError


def brute(rows):
    out = {}
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, f"{r[2]}:{r[3]}".encode(), len(r[2].encode())))
        found = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit, told = cheapest(own, found)
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest(),
        )
    return out


def told(df):
    rows = [tuple(r) for r in df.select(*repair.OUT_NAMES).collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int").repartition(4)


def some(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "What?", "hm", "", " \t", "Ends. Not", "é?", "A", "ok. \n", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "User", None]
    rows = []
    for conv in range(convs):
        for t in range(rng.randrange(most)):
            turn = rng.choice([t, t, t, t, rng.randrange(most), None])
            rows.append((conv if conv % 7 else None, turn, rng.choice(roles), f"{rng.choice(texts[:3])} {rng.randrange(40)}." if rng.random() < 0.5 else rng.choice(texts)))
    return rows


def test_automaton_is_small_and_accepts_whole_conversations():
    assert len(repair.stacks()) == 8 and [len(repair.shifted(repair.START, c)) for c in "sua"] == [1, 1, 0]
    assert repair.best("suaua") == (0, "KKKKK") and repair.best("") == (0, "") and repair.best("s") == (4, "D") and repair.best("au")[0] == 6
    assert repair.best("a") == (3, "IK") and repair.best("U") == (4, "D") and repair.best("ddd") == (12, "DDD")


@pytest.mark.parametrize("seed", range(3))
def test_equals_search(spark, seed):
    rows = some(seed, 60, 12)
    assert told(repair.repair(repair.damaged(frame(spark, rows)))) == brute(rows)


@pytest.mark.parametrize("segment", [1, 3, 50])
def test_long_conversations_by_segments_equal_search(spark, segment):
    """One conversation holds a third of all rows, one many equal rows, one is all dropped or blank."""
    rows = some(11, 20, 12) + [r for r in some(12, 2, 2000) if r[0] is not None][:150]
    rows += [(500, 3, "user", "Again.")] * 40 + [(501, t, "user", "Again.") for t in range(60)] + [(502, 1, "assistant", " ")] * 30
    df = repair.damaged(frame(spark, rows))
    want = brute(rows)
    assert told(repair.repair(df, long_rows=20, segment=segment)) == want
    assert told(repair.repair(df, long_rows=10_000, long_bytes=300, segment=segment)) == want
    for long_rows in (20, 10_000):
        turns = sorted(repair.repaired(df, long_rows=long_rows, segment=segment).collect(), key=lambda r: r[1:4])
        for conv in want:
            text = "\n".join(f"{r['role']}:{r['text']}" for r in turns if r["conv_id"] == conv)
            assert hashlib.sha256(text.encode()).hexdigest() == want[conv][-1]


def test_query_equals_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(queries.op11_repair(spark, SMALL)) == brute(rows)


def test_edges(spark):
    long = "word " * 200_000 + "."
    rows = [(1, None, None, None), (1, None, "user", long), (None, None, "system", "S."), (None, 5, "assistant", "A."), (3, 0, "", "x."), (4, -5, "user", "a:b."), (4, 9, "user:a", "b.")]
    assert told(repair.repair(repair.damaged(frame(spark, rows)))) == brute(rows)
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = told(repair.repair(repair.damaged(frame(spark, [(dropped, 0, "user", "Hi.")]))))
    assert got == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert told(repair.repair(repair.damaged(frame(spark, rows).limit(0)))) == {}
