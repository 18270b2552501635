"""End, depth and parent of every token of a page, and the innermost message container around it.

The rule: an open tag lies inside all elements still open; a close tag ends the nearest open element of its name and every
element opened inside that one, or nothing if there is none; what is open at the page's end ends there.

A page's tokens travel as one string of events (``+tag`` open, ``-tag`` close, ``.`` anything else), so a task sees a
few bytes a token. Pages up to SPLIT bytes are walked whole. The events of longer ones are cut into pieces that different tasks
walk, in three steps:

1. Each piece is reduced to what it cannot settle alone: opens whose close lies behind, closes whose open lies before, and
   opens a pending close may or may not end. An open and its close with no pending close between them settle in any context.
2. The reduced pieces of a page are merged as a tree, FAN neighbours at a time, with the same reduction: it does not matter where
   the cuts lie. The page's first piece has nothing before it, so it settles all its closes, and the last merge settles
   the rest. What was settled in a merge are the elements that cross pieces.
3. Each piece gets the elements that are open where it starts, and the ends of its own that lie in later pieces, and is walked.

A merge holds FAN reduced pieces: for well-formed pages the depth of the open elements, for pages of nothing but stray tags the tags
themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdown.functions import constants as K

SPLIT = 8 << 20
PIECE = 1 << 16
FAN = 64
ROUNDS = 3  # 64^3 pieces of 65,536 tokens: more tokens than one string can hold
OPEN, CLOSE, LEAF = "+", "-", "."

Event = tuple[int, str]  # position, sign and tag
BOXES = frozenset(K.CONTAINER_TAGS)


def walk(events: list[str], base: int = 0, stack: list[tuple[str, int]] | None = None) -> tuple[list[int], list[int], list[int], list[int]]:
    """(end, depth, parent, box) of each event, given the elements open before the first (tag, position), outermost first. box is the
    innermost element of BOXES around it: an ancestor-descendant join made by the same pass, as the stack holds a token's ancestors.
    The end of an element left open is -1, the parent or box of a token that has none -1."""
    up: list[tuple[str, int, int]] = []
    names: dict[str, int] = {}
    for t, q in stack or []:
        up.append((t, q, q if t in BOXES else up[-1][2] if up else -1))
        names[t] = names.get(t, 0) + 1
    n = len(events)
    end, depth, parent, box = [0] * n, [0] * n, [0] * n, [0] * n
    for i, e in enumerate(events):
        p = base + i
        sign = e[0]
        if sign == CLOSE and names.get(e[1:]):
            tag = e[1:]
            while True:
                t, q, _ = up.pop()
                names[t] -= 1
                if t == tag:
                    if q >= base:
                        end[q - base] = p + 1
                    break
                if q >= base:
                    end[q - base] = p
        depth[i] = len(up)
        parent[i], box[i] = up[-1][1:] if up else (-1, -1)
        if sign == OPEN:
            tag = e[1:]
            end[i] = -1
            up.append((tag, p, p if tag in BOXES else box[i]))
            names[tag] = names.get(tag, 0) + 1
        else:
            end[i] = p + 1
    return end, depth, parent, box


def reduce_events(events: Iterator[Event], rooted: bool) -> tuple[list[Event], list[tuple[int, int, int, str]]]:
    """(events left, elements settled as (position, end, close's position, tag)). ``rooted``: nothing lies before these events."""
    left: list[Event] = []
    floor = 0  # events before this place are a pending close or lie before one
    names: dict[str, int] = {}  # opens from floor on
    done = []
    for p, e in events:
        if e[0] == OPEN:
            left.append((p, e))
            names[e[1:]] = names.get(e[1:], 0) + 1
            continue
        tag = e[1:]
        if names.get(tag):
            while True:
                q, o = left.pop()
                t = o[1:]
                names[t] -= 1
                done.append((q, p + 1 if t == tag else p, p, t))
                if t == tag:
                    break
        elif not rooted:
            left.append((p, e))
            floor = len(left)
            names = {}
    return left, done


def events_of(kinds: str = "kinds", tags: str = "tags") -> Column:
    """A page's events as one string, from its arrays of kinds and tags."""
    return F.expr(f"""array_join(transform({kinds}, (k, i) -> case k when 'open' then concat('{OPEN}', {tags}[i])
        when 'close' then concat('{CLOSE}', {tags}[i]) else '{LEAF}' end), ' ')""")


NEST = "array<struct<e:int,d:int,par:int,box:int>>"


class _Rows:
    """Collects the walks of several pages or pieces into one Arrow column."""

    def __init__(self):
        self.offsets, self.columns = [0], ([], [], [], [])

    def add(self, *walked: list[int]) -> None:
        for c, w in zip(self.columns, walked):
            c += w
        self.offsets.append(len(self.columns[0]))

    def column(self) -> pa.Array:
        end, depth, parent, box = (np.array(c, dtype=np.int32) for c in self.columns)
        rows = [pa.array(end), pa.array(depth), pa.array(parent, mask=parent < 0), pa.array(box, mask=box < 0)]
        return pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), pa.StructArray.from_arrays(rows, names=["e", "d", "par", "box"]))


def nest_whole(events: Column) -> Column:
    """N3/N4 of a page whose events are one string: one (end, depth, parent, box) a token."""

    @F.arrow_udf(NEST)
    def run(col: pa.Array) -> pa.Array:
        out = _Rows()
        for s in col.to_pylist():
            ev = s.split(" ") if s else []
            end, *rest = walk(ev)
            out.add([len(ev) if e < 0 else e for e in end], *rest)
        return out.column()

    return run(events)


_DONE = "array<struct<p:int,e:int,c:int,t:string>>"


def _reduce(piece: Column, pos: Column, ev: Column) -> Column:
    """``reduce_events`` of a row's events: struct (pos, ev, done)."""

    @F.arrow_udf(f"pos array<int>, ev string, done {_DONE}")
    def run(piece: pa.Array, pos: pa.Array, ev: pa.Array) -> pa.Array:
        out = []
        for k, p, e in zip(piece.to_pylist(), pos.to_pylist(), ev.to_pylist()):
            left, done = reduce_events(zip(p, e.split(" ")) if p else iter(()), k == 0)
            out.append({"pos": [q for q, _ in left], "ev": " ".join(x for _, x in left), "done": [dict(zip("pect", d)) for d in done]})
        done = pa.list_(pa.struct([("p", pa.int32()), ("e", pa.int32()), ("c", pa.int32()), ("t", pa.string())]))
        return pa.array(out, pa.struct([("pos", pa.list_(pa.int32())), ("ev", pa.string()), ("done", done)]))

    return run(piece, pos, ev)


def nest_long(tokens: DataFrame, piece: int = PIECE, fan: int = FAN, rounds: int = ROUNDS) -> DataFrame:
    """(page_id, toks, kinds, tags, first, nest) of pages (page_id, toks, kinds, tags), one row a piece whose first token is ``first``;
    the pieces of a page are spread over tasks."""
    n = F.size("toks").cast("int")
    cut = tokens.withColumn("n_tok", n).withColumn("piece", F.explode(F.expr(f"sequence(0, cast(greatest(n_tok - 1, 0) div {piece} as int))")))
    first = (F.col("piece") * piece).cast("int")
    part = [F.slice(c, first + 1, piece).alias(c) for c in ("toks", "kinds", "tags")]
    cut = cut.select("page_id", "piece", "n_tok", first.alias("first"), *part).repartition("page_id", "piece")
    cut = cut.withColumn("ev", events_of())
    no_leaf = F.expr(f"filter(transform(split(ev, ' '), (e, i) -> named_struct('p', cast(first + i as int), 'e', e)), x -> x.e != '{LEAF}' and x.e != '')")
    up = cut.withColumn("x", no_leaf).select("page_id", "piece", "n_tok", F.col("x.p").alias("pos"), F.array_join(F.col("x.e"), " ").alias("ev"))
    # what a piece settles by itself nobody else needs
    up = up.withColumn("r", _reduce(F.col("piece"), F.col("pos"), F.col("ev"))).select(
        "page_id", "piece", "n_tok", "r.pos", "r.ev", F.lit(None).cast(_DONE).alias("done")).where(F.size("pos") > 0)
    for _ in range(rounds):
        parts = F.array_sort(F.collect_list(F.struct("piece", "pos", "ev")))
        up = up.groupBy("page_id", (F.col("piece") / fan).cast("int").alias("group")).agg(
            F.first("n_tok").alias("n_tok"), parts.alias("parts"), F.flatten(F.collect_list("done")).alias("before"))
        full = F.filter("parts", lambda x: F.size(x["pos"]) > 0)
        up = up.withColumn("r", _reduce(F.col("group"), F.flatten(F.transform(full, lambda x: x["pos"])), F.array_join(F.transform(full, lambda x: x["ev"]), " ")))
        up = up.select("page_id", F.col("group").alias("piece"), "n_tok", "r.pos", "r.ev", F.concat("before", "r.done").alias("done"))
    # elements that cross pieces: settled in a merge, or open to the page's end
    still = F.expr("transform(arrays_zip(pos, split(ev, ' ')), x -> named_struct('p', x.pos, 'e', n_tok, 'c', n_tok, 't', substr(x.`1`, 2)))")
    crossing = up.select("page_id", "n_tok", F.explode(F.concat("done", F.when(F.size("pos") > 0, still).otherwise(F.expr("slice(done, 1, 0)")))).alias("x")).select("page_id", "n_tok", "x.*")
    last = F.expr(f"cast(least(c div {piece}, greatest(n_tok - 1, 0) div {piece}) as int)")
    home = F.expr(f"cast(p div {piece} as int)")
    over = crossing.where(last > home).select("page_id", F.explode(F.sequence(home + 1, last)).alias("piece"), F.struct("p", "t").alias("open"), F.lit(None).cast("struct<p:int,e:int>").alias("own"))
    own = crossing.select("page_id", home.alias("piece"), F.lit(None).cast("struct<p:int,t:string>").alias("open"), F.struct("p", "e").alias("own"))
    context = over.unionByName(own).groupBy("page_id", "piece").agg(F.array_sort(F.collect_list("open")).alias("opens"), F.collect_list("own").alias("owns"))
    j = cut.join(context, ["page_id", "piece"], "left")

    @F.arrow_udf(NEST)
    def place(first: pa.Array, ev: pa.Array, opens: pa.Array, owns: pa.Array) -> pa.Array:
        out = _Rows()
        for base, s, stack, late in zip(first.to_pylist(), ev.to_pylist(), opens.to_pylist(), owns.to_pylist()):
            end, *rest = walk(s.split(" ") if s else [], base, [(x["t"], x["p"]) for x in stack or []])
            for x in late or []:
                end[x["p"] - base] = x["e"]
            out.add(end, *rest)
        return out.column()

    return j.select("page_id", "toks", "kinds", "tags", "first", place("first", "ev", "opens", "owns").alias("nest"))
