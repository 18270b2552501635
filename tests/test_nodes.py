"""N1-N7 on literal edge rows: losslessness, stack nesting, nesting against a plain walk, attributes."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdown.operators import chrome as C
from loomdown.operators import nesting as G
from loomdown.operators import nodes as N

EDGE = [
    (1, "<div><p>a</div></p>tail"),                       # crossing tags, stray close
    (2, "<DIV CLASS=Foo>up</div>"),                        # upper case, bare attribute
    (3, "<p class='x' class=\"y\" data-v=1>t</p>"),        # duplicate attribute: last wins
    (4, '<a title="x>y" href="/q">link</a>'),             # '>' inside a quoted attribute
    (5, "<!-- open comment <b>bold</b>"),                  # unterminated comment
    (6, "<script>var t=\"</p>\";</script><p>x"),           # raw text with a fake close tag
    (7, ""),                                               # empty page
    (8, "text only &amp; &#65;"),                          # no body
    (9, "<main><p>x<b>y<br>z</main><p>t</p>"),             # unclosed inside a closed parent
]


def test_tokens_lossless(spark):
    df = spark.createDataFrame(EDGE, "page_id long, html string")
    t = N.tokenize(df).select("page_id", F.array_join("toks", "").alias("back"))
    back = {r.page_id: r.back for r in t.collect()}
    assert all(back[k] == html for k, html in EDGE)


def test_nesting_and_attrs(spark, opts):
    df = spark.createDataFrame(EDGE, "page_id long, html string")
    n = N.build_nodes(df, opts).where("ord = 0")
    rows = {(r.page_id, r.pos): r for r in n.collect()}
    # crossing: </div> pops p (end = close), stray </p> ignored
    assert rows[(1, 0)].end == 4 and rows[(1, 1)].end == 3 and rows[(1, 4)].kind == "close"
    assert rows[(2, 0)].tag == "div" and rows[(2, 0)].cls == "Foo"
    assert rows[(3, 0)].amap["class"] == "y" and rows[(3, 0)].amap["data-v"] == "1"
    assert rows[(4, 0)].amap["href"] == "/q"
    assert rows[(6, 0)].kind == "raw" and rows[(6, 1)].tag == "p"
    assert rows[(8, 0)].text == "text only & A"
    # unclosed p and b end where </main> pops them
    assert rows[(9, 1)].end == 7 and rows[(9, 3)].end == 7 and rows[(9, 0)].end == 8


def _walk(events):
    """Plain stack walk: (pos, end, depth, parent) of every element and leaf."""
    up, out = [], []
    for i, (k, t) in enumerate(events):
        if k == 1:
            up.append((t, i, len(up), up[-1][1] if up else None))
            continue
        at = max((j for j, s in enumerate(up) if s[0] == t), default=None) if k == 2 else None
        if at is not None:
            out += [(s[1], i + 1 if s[0] == t else i, s[2], s[3]) for s in up[at:]]
            del up[at:]
        out.append((i, i + 1, len(up), up[-1][1] if up else None))
    return sorted((*out, *((s[1], len(events), s[2], s[3]) for s in up)))


def _events(rng, size):
    return [(k := rng.choice((0, 1, 1, 2, 2)), rng.choice(("a", "b", "c", "div")) if k else None) for _ in range(size)]


def _strings(events):
    return [f"{'.+-'[k]}{t or ''}" for k, t in events]


def test_walk_equals_stack_walk():
    rng = random.Random(5)
    for size in (0, 1, 2, 3, 50, 700, 20_000):
        ev = _events(rng, size)
        end, depth, parent, box = G.walk(_strings(ev))
        got = [(i, size if e < 0 else e, d, None if p < 0 else p) for i, (e, d, p) in enumerate(zip(end, depth, parent))]
        assert got == _walk(ev)
        if size < 1000:
            inner = [max((p for p, e in enumerate(end) if ev[p] == (1, "div") and p < i and (e < 0 or e > i)), default=-1) for i in range(size)]
            assert [b for b, k in zip(box, ev) if k[0] == 0] == [b for b, k in zip(inner, ev) if k[0] == 0]


@given(st.lists(st.tuples(st.sampled_from((0, 1, 1, 2, 2)), st.sampled_from("abc")), max_size=40), st.lists(st.integers(0, 40), max_size=6), st.integers(2, 3))
@settings(max_examples=400, deadline=None)
def test_merge_is_the_walk_for_every_cut(events, cuts, fan):
    ev = [(k, t if k else None) for k, t in events]
    items = list(enumerate(_strings(ev)))
    at = sorted({0, len(items), *(c for c in cuts if c < len(items))})
    level = [([x for x in items[a:b] if x[1] != "."], []) for a, b in zip(at, at[1:])] or [([], [])]
    level = [G.reduce_events(iter(x), i == 0) for i, (x, _) in enumerate(level)]
    while len(level) > 1:
        groups = [level[i:i + fan] for i in range(0, len(level), fan)]
        merged = [G.reduce_events((x for part, _ in g for x in part), i == 0) for i, g in enumerate(groups)]
        level = [(left, [d for _, done in g for d in done] + done) for g, (left, done) in zip(groups, merged)]
    left, done = level[0]
    ends = {p: e for p, e, _, _ in done} | {p: len(ev) for p, e in left}
    assert ends == {r[0]: r[1] for r in _walk(ev) if ev[r[0]][0] == 1}
    assert all(e[0] == "+" for _, e in left)


def test_long_pages_in_pieces(spark):
    rng = random.Random(8)
    pages = [_events(rng, n) for n in (0, 1, 7, 8, 9, 60, 333)] + [[(1, "a")] * 70 + [(2, "b")] * 9 + [(2, "a")] * 65]
    kind = {0: "text", 1: "open", 2: "close"}
    rows = [(i, [str(p) for p in range(len(ev))], [kind[k] for k, _ in ev], [t for _, t in ev]) for i, ev in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id int, toks array<string>, kinds array<string>, tags array<string>")
    for piece, fan, rounds in ((8, 4, 3), (64, 64, 1), (1000, 64, 3)):
        got = {i: [] for i in range(len(pages))}
        for r in G.nest_long(df, piece, fan, rounds).collect():
            assert r.toks == [str(r.first + k) for k in range(len(r.nest))]
            got[r.page_id] += [(r.first + k, x.e, x.d, x.par) for k, x in enumerate(r.nest)]
        for i, ev in enumerate(pages):
            assert sorted(got[i]) == _walk(ev), (piece, i)


def test_long_and_short_pages_have_equal_nodes(spark, opts):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").unionByName(
        spark.createDataFrame([(-k, "u", h) for k, h in EDGE], "page_id long, url string, html string"))
    cols = ["page_id", "pos", "ord", "end", "depth", "parent", "box", "kind", "tag", "text"]
    short, long = (N.build_nodes(df, opts, split=s).select(*cols) for s in (1 << 30, 40))
    assert short.exceptAll(long).isEmpty() and long.exceptAll(short).isEmpty()


def test_page_plan_has_one_page_exchange(spark, opts):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = N.build_nodes(df, opts)._jdf.queryExecution().executedPlan().toString()
    steps = [re.sub(r"^[ :+-]*(\*\(\d+\) )?", "", line) for line in plan.split("\n")]
    top = steps[: next(i for i, x in enumerate(steps) if x.startswith("ArrowEvalPython"))]
    assert [x[:28] for x in top if x.startswith("Exchange")] == ["Exchange hashpartitioning(pa"] and "BatchEvalPython" not in plan


def test_driver_pages_lossless(spark):
    p = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    t = N.tokenize(p).join(p, "page_id").where(F.array_join("toks", "") != F.col("html"))
    assert t.count() == 0


def _stage_by_stage(cands, stages, limit):
    """The guarded stages literally: each reads what the earlier ones left."""
    text = {}  # position -> live characters, one piece per candidate start
    for pos, end, _, total in cands:
        text[pos] = total - sum(t for p, e, _, t in cands if pos < p < end and not any(pos < q < p < f for q, f, _, _ in cands))
    gone = []
    for stage in range(stages):
        live = {p: t for p, t in text.items() if not any(a <= p < b for a, b in gone)}
        for pos, end, bits, _ in sorted(cands):
            if bits >> stage & 1 and not any(a <= pos < b for a, b in gone) and sum(t for p, t in live.items() if pos <= p < end) <= limit:
                gone.append((pos, end))
    return sorted(gone)


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 15), st.integers(0, 9)), min_size=1, max_size=25), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_guard_sweep_is_stage_by_stage(shape, stages):
    # a random forest: ``up`` elements close before the next one opens
    open_, ends, at = [], {}, []
    for i, (up, bits, own) in enumerate(shape):
        for _ in range(min(up, len(open_))):
            ends[open_.pop()] = 2 * i
        open_.append(i)
        at.append((2 * i, bits, own))
    ends |= {i: 2 * len(shape) for i in open_}
    own = [x[2] for x in at]
    cands = [(p, ends[i], bits, sum(own[j] for j in range(i, len(at)) if 2 * j < ends[i])) for i, (p, bits, _) in enumerate(at)]
    assert sorted(C.guard_sweep(cands, stages, 7)) == _stage_by_stage(cands, stages, 7)


def test_many_guard_candidates(spark, opts):
    """10,000 candidates on one page, some over the limit: the sweep's cost follows their number."""
    parts = [f'<div class="sidebar" role="navigation">{"x" * (6000 if k % 500 == 0 else 5)}</div>' for k in range(10_000)]
    html = f"<body><main>{''.join(parts)}<p>end</p></main></body>"
    n = C.clean_page(N.build_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"), opts), opts)
    live = n.where("in_region and kind = 'text'").groupBy(F.length("text").alias("n")).count().collect()
    assert {r.n: r["count"] for r in live} == {6000: 20, 3: 1}
