"""Operators 4, 5, 10: brute force on small tables with nulls, empties, ties, repeats, clashing names, hot groups."""

import hashlib
import random
from collections import defaultdict

import pytest
import xxhash

from loomdown.llm.components import components
from loomdown.llm.exact_dedup import exact_dedup
from loomdown.llm.line_dedup import line_dedup
from loomdown.llm.simhash import fingerprint_of, keep_one, links, simhash_components

SCHEMA = "doc_id long, text string, lang string, source string, id string, t string, n long"


def rows(texts, sources=None):
    return [(i, t, None, (sources or {}).get(i, f"s{i % 12}"), "x", "y", 7) for i, t in enumerate(texts)]


def test_exact_dedup(spark):
    data = rows(["a", None, "", "a", "b", "a ", "é" * 50000]) + [(3, "a", None, None, "x", "y", 1), (None, "b", None, None, "x", "y", 1)]
    got = sorted(map(tuple, exact_dedup(spark.createDataFrame(data, SCHEMA)).collect()), key=str)
    groups = defaultdict(list)
    for r in data:
        groups[r[1] or ""].append(r[0])
    want = sorted(((r[0], max((i for i in groups[r[1] or ""] if i is not None), default=None), len(groups[r[1] or ""]),
                    r[0] == max((i for i in groups[r[1] or ""] if i is not None), default=None),
                    hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in data), key=str)
    assert got == want
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_fp(text):
    w = [x for x in (text or "").encode().lower().split()]
    sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    ids = list(range(len(fps)))
    root = ids[:]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids[:i]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in ids]


def texts(rnd, n):
    base = [" ".join(rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 90))) for _ in range(n // 3)]
    out = base + [None, "", " \t", "one", "one two", "ONE two"]
    while len(out) < n:
        w = rnd.choice(base).split()
        if w:
            w[rnd.randrange(len(w))] = rnd.choice(["zz", "a", "B"])
        out.append(" ".join(w))
    return out


def test_simhash_brute_force(spark):
    data = texts(random.Random(5), 240)
    fps = [brute_fp(t) for t in data]
    assert [fingerprint_of((t or "").encode().lower().split()) for t in data] == fps
    root = brute_components(fps)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash_components(spark.createDataFrame(rows(data), SCHEMA)).collect()}
    assert got == {i: (fps[i], root[i]) for i in range(len(data))}
    kept = keep_one(spark.createDataFrame(rows(data), SCHEMA))
    assert kept.columns == spark.createDataFrame([], SCHEMA).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_keep_one_of_repeated_and_null_ids(spark):
    rnd = random.Random(8)
    far = [" ".join(rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(60)) for _ in range(8)]
    a, b = far[:2]
    data = [(5, a), (5, b), (7, b.upper()), (5, a), (9, a), (None, a), (None, b)]  # one id in two groups
    data += [(None, t) for t in far[2:]] + [(None, far[2]), (11, far[3]), (None, None), (None, ""), (12, None), (12, "")]
    df = spark.createDataFrame([(i, t, None, "s", "x", "y", 7) for i, t in data], SCHEMA)
    root = brute_components([brute_fp(t) for _, t in data])
    best = {}
    for (i, _), r in zip(data, root):
        best[r] = min(best.get(r, (True, 0)), (i is None, i or 0))
    got = keep_one(df).collect()
    group = {t: r for (_, t), r in zip(data, root)}
    assert sorted(group[r.text] for r in got) == sorted(best)  # one row of every group, no more
    assert all((r.doc_id is None, r.doc_id or 0) == best[group[r.text]] for r in got)


@pytest.mark.parametrize("crowded", [2, 10**6])
def test_crowded_cells_keep_components(spark, crowded):
    rnd = random.Random(3)
    center = rnd.getrandbits(64)
    fps = {center ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 4]))) for _ in range(300)} | {rnd.getrandbits(64) for _ in range(50)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.root for r in components(links(df, crowded)).collect()}
    root = brute_components([f % (1 << 64) for f in fps])
    assert {f: got.get(f, f) for f in fps} == {f: fps[root[i]] for i, f in enumerate(fps)}


def test_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901)], "u long, v long")
    got = {r.node: r.root for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(301)}, 900: 900, 901: 900}
    assert components(e.limit(0)).count() == 0


def test_line_dedup(spark):
    wide, near, few = "wide line", "near line", "few line"
    data = [f"{wide}\r\nown {i}\n\n {near if i < 10 else few if i < 9 + 9 + 10 else ''}" for i in range(60)] + [None, "", wide]
    src = {i: f"s{i % 30}" for i in range(60)}
    src[62] = None
    df = spark.createDataFrame(rows(data, src) + [(62, wide, None, "s1", "x", "y", 7)], SCHEMA)
    sites = defaultdict(set)
    for r in df.collect():
        for ln in (r.text or "").split("\n") if r.text is not None else []:
            if ln.strip(" \t\r") and r.source is not None:
                sites[ln.strip(" \t\r")].add(r.source)
    bad = {k for k, v in sites.items() if len(v) >= 10}
    assert wide in bad and near in bad
    got = line_dedup(df)
    assert got.columns[:7] == df.columns
    for r in got.collect():
        t = data[r.doc_id]
        assert r.text == (None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\r") not in bad))
        assert r.n == 7
    assert got.count() == 64
    assert line_dedup(df.limit(0)).count() == 0
