"""Operator 13, conversation structure repair by run-length dynamic programming.

A conversation's rows become a string of symbols (role initial and fault). Equal neighbours are one run. The cheapest repair is a
min-plus product of one 4 x 4 transition a row over the states of the role grammar ``(s?(ua)+)?`` (nothing yet, after s, after u,
after a); a run of n rows advances by the cached binary powers of its symbol's transition. The backward pass keeps the costs to
go at block borders only; the forward pass recomputes a block's costs and unrolls the choices, taking the least letter
among the cheapest, into the audit.

How Spark spreads it
* Symbols and texts go separate ways. The symbol rows hold a digest of the text, never the text; equal rows are one counted row
  (a partial aggregate), so a row repeated by a third of the table is one row a task.
* "Seen earlier" is the least turn per (conversation, role, digest), a partial aggregate, joined back by key (a hot key splits).
* A range partitioning by (conversation, turn, role, digest) orders the symbol rows and cuts a conversation of any length into
  pieces over many tasks; each task turns its rows into runs, counts and border values. A conversation's pieces meet in one
  task as runs, which take no more room than the audit string the result asks for.
* The texts are shuffled once, by conversation, each conversation's audit ahead of its rows, and are streamed through the
  audit row by row: no task holds a conversation's texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
INF = 1 << 60
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: states: 0 nothing yet, 1 after s, 2 after u, 3 after a; the state after a u, an a or an s, where the grammar allows one
AFTER = {"u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "s": {0: 1}}
#: costs to go after the last row: states 1 and 2 still need inserted turns
END = (0, 2 * INSERT, INSERT, 0)
#: a symbol: X must go (blank or duplicate); else the role initial, upper case if the text is truncated (o, O: an initial outside the grammar)
SYMBOLS = "XsSuUaAoO"
BLOCK = 4096
PIECE_RUNS = 65536


def _options(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of a row's edits in ASCII order; inserts are not among them."""
    out = [("D", DELETE, state)]
    if symbol != "X":
        more = TRUNCATED if symbol.isupper() else 0
        kept = AFTER.get(symbol.lower(), {}).get(state)
        if kept is not None:
            out.append(("K", more, kept))
        turned = AFTER["u"].get(state, AFTER["a"].get(state))
        out.append(("R", REROLE + more, turned))
    return out


def _inserted(state: int) -> int:
    return AFTER["u"].get(state, AFTER["a"].get(state))


def _product(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def _apply(m: tuple, v: tuple) -> tuple:
    return tuple(min(r[0] + v[0], r[1] + v[1], r[2] + v[2], r[3] + v[3]) for r in m)


@lru_cache(maxsize=None)
def power(symbol: str, bit: int) -> tuple:
    """The min-plus transition of 2^bit rows of one symbol, inserts before each row included."""
    if bit:
        half = power(symbol, bit - 1)
        return _product(half, half)
    m = [[INF] * 4 for _ in range(4)]
    for p in range(4):
        state, paid = p, 0
        for _ in range(3):  # no insert, one, two: more come back to a state already met
            for _, cost, q in _options(symbol, state):
                m[p][q] = min(m[p][q], paid + cost)
            state, paid = _inserted(state), paid + INSERT
    return tuple(map(tuple, m))


def advance(symbol: str, n: int, togo: tuple) -> tuple:
    """Costs to go before a run of n rows, from those after it."""
    bit = 0
    while n:
        if n & 1:
            togo = _apply(power(symbol, bit), togo)
        n >>= 1
        bit += 1
    return togo


def solve(runs: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of a string given as runs, the ASCII-least audit among equally cheap ones."""
    blocks: list[list[tuple[str, int]]] = []
    room = 0
    for symbol, n in runs:
        while n:
            if not room:
                blocks.append([])
                room = BLOCK
            k = min(n, room)
            blocks[-1].append((symbol, k))
            n, room = n - k, room - k
    ends = [END]
    for block in reversed(blocks):
        v = ends[-1]
        for symbol, n in reversed(block):
            v = advance(symbol, n, v)
        ends.append(v)
    cost = ends[-1][0]
    state, audit = 0, []
    for block, end in zip(blocks, reversed(ends[:-1])):
        row = [symbol for symbol, n in block for _ in range(n)]
        after = [end]
        for symbol in reversed(row):
            after.append(_apply(power(symbol, 0), after[-1]))
        left = after.pop()[state]
        for symbol in row:
            togo = after.pop()
            while True:
                fits = {letter: q for letter, c, q in _options(symbol, state) if c + togo[q] == left}
                insert = _inserted(state)
                if "D" not in fits and min(c + togo[q] for _, c, q in _reach(symbol, insert)) + INSERT == left:
                    audit.append("I")
                    state, left = insert, left - INSERT
                    continue
                letter = min(fits)
                audit.append(letter)
                state = fits[letter]
                left = togo[state]
                break
    while state in (1, 2):
        audit.append("I")
        state = _inserted(state)
    return cost, "".join(audit)


def _reach(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """A row's edits from ``state``, also after further inserts."""
    out = _options(symbol, state)
    nxt = _inserted(state)
    return out + [(x, c + INSERT, q) for x, c, q in _options(symbol, nxt)]


def damaged(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, m): the contract's damage by crc32 of ``conv:turn`` modulo 20. m is how often the row stands in the
    damaged table: 0 (dropped; role and text empty), 1 or 2. Null roles and texts are one space, as are null parts of the key."""
    space = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), space)
    k = F.crc32(F.encode(F.concat(part(conv_col), F.lit(":"), part(turn_col)), "UTF-8")) % 20
    rows = table.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), part(role_col).alias("role"), part(text_col).alias("text"), k.alias("k"))
    text = F.when(F.col("k").isin(0, 1), "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 0, "").when(F.col("k") == 4, "user").otherwise(F.col("role"))
    m = F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).cast("long")
    return rows.select("conv", F.when(F.col("k") != 0, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"), m.alias("m"))


def undamaged(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A table's rows in the form ``repair`` takes, as they are (null roles and texts are one space)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return table.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"),
                        F.lit(1).cast("long").alias("m"))


def _digest() -> Column:
    return F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))


def _symbols(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, tk, m, blank, cut, dup): counted symbol rows. Of m equal rows the first has the flags, the others are duplicates."""
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    light = rows.select("conv", "turn", "role", _digest().alias("tk"), "m", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    kinds = light.groupBy("conv", "turn", "role", "tk").agg(F.sum("m").alias("m"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    # only what stands at several turns can be seen earlier; a conversation's blank rows are no duplicates of each other
    several = kinds.where((F.col("m") > 0) & ~F.col("blank")).groupBy("conv", "role", "tk").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")
    several = several.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("tk").alias("d"), "first")
    j = kinds.join(several, kinds["conv"].eqNullSafe(F.col("c")) & (kinds["role"] == F.col("r")) & (kinds["tk"] == F.col("d")), "left")
    dup = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    return j.select("conv", "turn", "role", "tk", "m", "blank", "cut", F.coalesce(dup, F.lit(False)).alias("dup"))


_PIECE = "part int, piece int, runs string, lens array<long>, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, lo long, hi long, turns long"
LEGAL = {"su", "ua", "au"}


class _Piece:
    """The runs and counts of some neighbouring rows of one conversation."""

    def __init__(self, conv):
        self.conv = conv
        self.runs, self.lens = [], []
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.lo = self.hi = None

    def run(self, symbol: str, n: int) -> None:
        if self.runs and self.runs[-1] == symbol:
            self.lens[-1] += n
        elif n:
            self.runs.append(symbol)
            self.lens.append(n)

    def add(self, turn, role: str, m: int, blank: bool, cut: bool, dup: bool) -> None:
        if not m:
            return
        initial = role[:1]
        if turn is not None and turn != self.hi:
            self.turns, self.hi = self.turns + 1, turn
            self.lo = turn if self.lo is None else self.lo
        self.illegal += (self.n > 0 and self.last + initial not in LEGAL) + (m - 1)  # no letter may follow itself
        self.first = initial if self.first is None else self.first
        self.last = initial
        self.n += m
        if blank:
            self.blank += m
            self.run("X", m)
            return
        self.duplicate += m - 1 + dup
        if dup:
            self.run("X", m)
            return
        self.truncated += cut
        symbol = initial if initial and initial in "sua" else "o"
        self.run(symbol.upper() if cut else symbol, 1)
        self.run("X", m - 1)

    def join(self, r: dict) -> None:
        """Adds the piece that follows."""
        for symbol, n in zip(r["runs"], r["lens"]):
            self.run(symbol, n)
        self.illegal += r["illegal"] + (self.n > 0 and r["n"] > 0 and self.last + r["first"] not in LEGAL)
        self.turns += r["turns"] - (r["lo"] is not None and r["lo"] == self.hi)
        for c in ("n", "blank", "duplicate", "truncated"):
            setattr(self, c, getattr(self, c) + r[c])
        if r["n"]:
            self.last = r["last"]
        if r["lo"] is not None:
            self.lo, self.hi = r["lo"] if self.lo is None else self.lo, r["hi"]


def _changes(col: pa.Array) -> Iterator[tuple[object, int, int]]:
    """(value, from, to) of a column's runs of equal neighbours."""
    values = col.to_pylist()
    at = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[at]:
            yield values[at], at, i
            at = i


def _pieces(symbols: DataFrame) -> DataFrame:
    kind = symbols.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, now, number, out = TaskContext.get().partitionId(), None, 0, []

        def flush() -> pa.RecordBatch:
            cols = [pa.array([p.conv for p, _ in out], type=conv_type), pa.array([part] * len(out), pa.int32()), pa.array([k for _, k in out], pa.int32()),
                    pa.array(["".join(p.runs) for p, _ in out], pa.string()), pa.array([p.lens for p, _ in out], pa.list_(pa.int64()))]
            cols += [pa.array([getattr(p, c) for p, _ in out], t) for c, t in (
                ("n", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()),
                ("last", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("turns", pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["conv", *[c.split()[0] for c in _PIECE.split(", ")]])

        conv_type = None
        for b in batches:
            conv_type = b.column(0).type
            data = [b.column(i).to_pylist() for i in (1, 2, 4, 5, 6, 7)]
            for conv, lo, hi in _changes(b.column(0)):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append((now, number))
                    now, number = _Piece(conv), 0
                for row in zip(*[c[lo:hi] for c in data]):
                    now.add(*row)
                    if len(now.runs) >= PIECE_RUNS:
                        out.append((now, number))
                        now, number = _Piece(conv), number + 1
            if len(out) > 256:
                yield flush()
        if now is not None:
            out.append((now, number))
            yield flush()

    ordered = symbols.repartitionByRange("conv", "turn", "role", "tk").sortWithinPartitions("conv", "turn", "role", "tk")
    return ordered.mapInArrow(run, f"conv {kind.simpleString()}, {_PIECE}")


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repairs(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit), one row a conversation of ``rows`` (conv, turn, role, text, m)."""
    pieces = _pieces(_symbols(rows))
    kind = rows.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def close(p: _Piece) -> None:
            cost, audit = solve(list(zip(p.runs, p.lens)))
            gaps = p.hi - p.lo + 1 - p.turns if p.lo is not None else 0
            out.append((p.conv, gaps, p.blank, p.duplicate, p.truncated, p.illegal, cost, audit))

        def flush() -> pa.RecordBatch:
            types = [conv_type, *[pa.int64()] * 6, pa.string()]
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv", *[c.split()[0] for c in _SUMMARY.split(", ")]])
            out.clear()
            return got

        conv_type = None
        for b in batches:
            conv_type = b.column(0).type
            for r in b.to_pylist():
                if now is None or now.conv != r["conv"]:
                    if now is not None:
                        close(now)
                    now = _Piece(r["conv"])
                now.join(r)
            if len(out) > 256:
                yield flush()
        if now is not None:
            close(now)
            yield flush()

    dealt = pieces.repartition("conv").sortWithinPartitions("conv", "part", "piece")
    return dealt.mapInArrow(run, f"conv {kind.simpleString()}, {_SUMMARY}")


def repaired_turns(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """(conv, line, edit, role, text) of the repaired conversations, by conversation and then in order within each task's rows. line 0 heads
    every conversation (no edit, role or text); the others are kept (K), reroled (R) and inserted (I) turns."""
    kind = rows.schema["conv"].dataType.simpleString()
    none = F.lit(None)
    heads = summary.select("conv", F.lit(0).alias("o"), none.cast("long").alias("turn"), F.lit("").alias("role"), none.cast("binary").alias("tk"),
                           F.col("audit").alias("text"), F.lit(1).cast("long").alias("m"))
    body = rows.where("m > 0").select("conv", F.lit(1).alias("o"), "turn", "role", _digest().alias("tk"), "text", "m")
    both = heads.unionByName(body).repartition("conv").sortWithinPartitions("conv", "o", "turn", "role", "tk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, line, out = None, "", 0, 0, 0, []

        def put(edit: str | None, role: str | None, text: str | None) -> None:
            nonlocal line
            out.append((conv, line, edit, role, text))
            line += 1

        def inserts() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = _inserted(state)
                put("I", "user" if state == 2 else "assistant", "")
                at += 1

        def flush() -> pa.RecordBatch:
            types = [conv_type, pa.int64(), pa.string(), pa.string(), pa.string()]
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv", "line", "edit", "role", "text"])
            out.clear()
            return got

        for b in batches:
            conv_type = b.column(0).type
            for c, o, role, text, m in zip(*[b.column(i).to_pylist() for i in (0, 1, 3, 5, 6)]):
                if o == 0:
                    inserts()
                    conv, audit, at, state, line = c, text, 0, 0, 0
                    put(None, None, None)
                    continue
                for _ in range(m):
                    inserts()
                    edit = audit[at]
                    at += 1
                    if edit == "K":
                        state = AFTER[role[0]][state]
                        put("K", role, text)
                    elif edit == "R":
                        state = _inserted(state)
                        put("R", "user" if state == 2 else "assistant", text)
                if len(out) >= 1024:
                    yield flush()
        inserts()
        if out:
            yield flush()

    return both.mapInArrow(run, f"conv {kind}, line long, edit string, role string, text string")


def conversation_hashes(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) from ``repaired_turns``, in the same tasks: SHA-256 of ``role:text`` lines joined by newlines, streamed."""
    import hashlib

    kind = turns.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, out = None, None, []
        for b in batches:
            for c, line, role, text in zip(*[b.column(i).to_pylist() for i in (0, 1, 3, 4)]):
                if line == 0:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256()
                else:
                    digest.update(("\n" if line > 1 else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            conv_type = b.column(0).type
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], conv_type), pa.array([h for _, h in out], pa.string())], names=["conv", "repaired_sha256"])
            out.clear()
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], conv_type), pa.array([digest.hexdigest()], pa.string())], names=["conv", "repaired_sha256"])

    return turns.mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, repaired turns) of ``rows`` (conv, turn, role, text, m), as ``damaged`` or ``undamaged`` make them.

    A conversation's rows stand by turn (nulls first), rows of one turn by role and then by the text's SHA-256, equal rows side by
    side. Every conversation has a summary row, also one without rows and the one of null ids. An empty table gives no rows; other
    columns never reach this function. Roles count by their first letter, in lower case; any other (also none) cannot be kept. One
    conversation's repaired texts are streamed by one task, since a digest or a dialogue is read in order; its audit is one string, so a
    conversation is bounded by 2^31 - 1 edits. Long texts are never held more than one row at a time.
    """
    from loomdown.llm.common import written

    summary = written(repairs(rows))
    return summary, repaired_turns(rows, summary)
