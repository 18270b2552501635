"""Operator 13: the run-length programme against trying all edits, the whole query against a plain loop over conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from heapq import heappop, heappush

import pytest

from loomdown.llm import turn_repair as T

SCHEMA = "conv_id long, turn long, role string, text string, conv string, m int, audit string"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """(cost, audit, [(role, text)]) by a search in order of (cost, audit) over all edit strings; rows: (role, text, must go, truncated)."""
    heap, best = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, out = heappop(heap)
        letters = "".join(r[:1] for r, _ in out)
        if i == len(rows) and GRAMMAR.match(letters):
            return cost, audit, list(out)
        key = (i, letters[-1:], bool(out))
        if key in best:
            continue
        best.add(key)
        step = []
        if i < len(rows):
            role, text, gone, cut = rows[i]
            step.append((3, "D", i + 1, out))
            if not gone:
                step += [(cut, "K", i + 1, out + ((role, text),))]
                step += [(2 + cut, "R", i + 1, out + ((r, text),)) for r in ("user", "assistant")]
        step += [(2, "I", i, out + ((r, ""),)) for r in ("user", "assistant")]
        for c, letter, j, o in step:
            s = "".join(r[:1] for r, _ in o)
            if re.match(r"(s|s?(ua)*u?)\Z", s) and all(r for r, _ in o):
                heappush(heap, (cost + c, audit + letter, j, o))


def expected(table):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in table:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        rows = convs[conv]
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        rows += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, todo, count = set(), [], [0, 0, 0]
        for _, role, text in rows:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            blank, dup, cut = not body, (role, text) in seen, bool(body) and body[-1] not in ".!?"
            seen.add((role, text))
            count[0] += blank
            count[1] += dup and not blank
            count[2] += cut and not blank and not dup
            todo.append((role, text, blank or dup, int(cut and not blank and not dup)))
        turns = sorted({r[0] for r in rows if r[0] is not None})
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, kept = cheapest(todo)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (turns[-1] - turns[0] + 1 - len(turns) if turns else 0, *count, illegal, cost, audit, sha)
    return out


def test_solve_against_search():
    rnd = random.Random(5)
    for _ in range(400):
        s = "".join(rnd.choice(T.SYMBOLS) * rnd.choice([1, 1, 2, 5]) for _ in range(rnd.randint(0, 6)))
        runs = [(m.group()[0], len(m.group())) for m in re.finditer(r"(.)\1*", s)]
        role = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
        cost, audit, _ = cheapest([(role.get(c.lower(), "x"), "t", c == "X", int(c.isupper() and c != "X")) for c in s])
        assert T.solve(runs) == (cost, audit), s


def test_long_runs_equal_single_rows(monkeypatch):
    runs = [("s", 3), ("u", 5000), ("a", 4999), ("X", 70), ("U", 9000), ("a", 1)]
    got = T.solve(runs)
    monkeypatch.setattr(T, "BLOCK", 7)
    assert T.solve(runs) == got
    v = T.END
    for c, n in reversed(runs):
        for _ in range(n):
            v = T._apply(T.power(c, 0), v)
    assert got[0] == v[0] and len(got[1].replace("I", "")) == sum(n for _, n in runs)


def table():
    rnd = random.Random(11)
    texts = ["Hi.", "Why?", "Because", "No!", "", "  \n", "Hi.", "a. ", "x" * 20000 + ".", None, "éü ", "same", "same"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User", "unknown"]
    out = []
    for conv in [None, *range(90)]:
        if conv is not None and rnd.random() < 0.4:
            plain = [("system" if rnd.random() < 0.2 else "user", "assistant")[i % 2] for i in range(rnd.randint(0, 7))]
            out += [(conv, i, r, f"t{i}.", "c", 1, "z") for i, r in enumerate(plain)]
        for _ in range(rnd.randint(1, 9)):
            out.append((conv, rnd.choice([None, -3, 0, 1, 2, 3, 4, 7, 20]), rnd.choice(roles), rnd.choice(texts), "c", 1, "z"))
    out += [out[0]] * 3 + [(500, t, "user", "again.", "c", 1, "z") for t in range(40)]
    return out


@pytest.mark.parametrize("pieces", [3, 65536])
def test_against_plain_loop(spark, monkeypatch, pieces):
    monkeypatch.setattr(T, "PIECE_RUNS", pieces)
    from loomdown.llm.queries import turn_repair_rows

    rows = table()
    want = expected(rows)
    got = turn_repair_rows(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id
    assert any("I" in w[6] for w in want.values()) and any("R" in w[6] for w in want.values())


def test_empty_and_dropped(spark):
    from loomdown.llm.queries import turn_repair_rows

    assert turn_repair_rows(spark.createDataFrame([], SCHEMA)).count() == 0
    turn = next(t for t in range(100) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    got = turn_repair_rows(spark.createDataFrame([(1, turn, "user", "x", "", 0, "")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_long_conversation_is_many_pieces(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"text {i}.", "", 0, "") for i in range(4000)] + [(2, 0, "user", "a.", "", 0, "")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        p = T._pieces(T._symbols(T.undamaged(spark.createDataFrame(rows, SCHEMA)))).where("conv = 1").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({r.part for r in p}) > 4 and max(r.n for r in p) < 2000
