"""Operator 12 against numpy on all rows at once."""

import math
import random

import numpy as np
import pytest

from loomdown.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, key string, dim int, n string"


def brute(vectors, weight):
    """{row: (n, deviation, whitened up to 4, explained)} by dense linear algebra over the distinct vectors."""
    xs = {i: tuple(math.floor(256 * c) for c in v) for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    kinds = {}
    for x in xs.values():
        kinds[x] = kinds.get(x, 0) + 1
    w = np.array([1 if weight == "one" else k for k in kinds.values()])
    a = np.array(list(kinds), dtype=float)
    n = int(w.sum())
    s = [sum(int(k) * x[i] for x, k in zip(kinds, w)) for i in range(a.shape[1])]
    c = a - np.array([t / n for t in s])
    v = (c * w[:, None]).T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    return {i: (n, sum((n * x[k] - s[k]) ** 2 for k in range(len(s))), ((np.array(x) - np.array([t / n for t in s])) @ q[:, :4]) / np.sqrt(e[:4]), e[:4] / np.trace(v))
            for i, x in xs.items()}


@pytest.mark.parametrize("weight", ["one", "copies"])
def test_against_dense_algebra(spark, weight):
    rnd = random.Random(3)
    base = [[rnd.gauss(0, 1 + i) for i in range(6)] for _ in range(60)]
    vectors = base + [base[0]] * 40 + [None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [math.nan] + [0.0] * 5, [math.inf] * 6, [-0.0] * 6, [0.0] * 6, [1e-9] * 6]
    rows = [(i, v, "k", 1, "n") for i, v in enumerate(vectors)]
    got = {}
    for r in W.whitened_embeddings(spark.createDataFrame(rows, SCHEMA).repartition(3), weight=weight).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    want = brute(vectors, weight)
    assert set(got) == set(want)
    sign = np.ones(4)
    for i in want:
        n, dev, out, share = want[i]
        mine = [got[i][k] for k in (1, 2, 3, 4)]
        if i == 1:
            sign = np.sign(out) * np.sign([m.whitened for m in mine])
    for i in want:
        n, dev, out, share = want[i]
        mine = [got[i][k] for k in (1, 2, 3, 4)]
        assert {(m.n, m.deviation) for m in mine} == {(n, dev)}
        assert np.allclose([m.whitened for m in mine], out * sign, rtol=1e-9, atol=1e-9)
        assert np.allclose([m.explained for m in mine], share, rtol=1e-9)
        assert all(m.identity_error < 1e-9 for m in mine)


def test_edge_rows(spark):
    out = lambda rows: W.whitened_embeddings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert out([]) == []
    assert out([(1, None, None, None, None), (None, [], None, None, None)]) == []
    assert out([(i, [1.0, 2.0], "", 0, "") for i in range(5)]) == []  # one distinct vector: no variance
    two = out([(None, [1.0, 0.0], "", 0, ""), (7, [0.0, 0.0], "", 0, ""), (7, [0.0, 0.0], "", 0, ""), (8, [1.0], "", 0, "")])
    assert sorted((r.vec_id is None, r.component, r.n, round(abs(r.whitened), 9), r.deviation) for r in two) == [(False, 1, 2, 1.0, 65536)] * 2 + [(True, 1, 2, 1.0, 65536)]


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(x), 1.0], "", 0, "") for i, x in enumerate([0, 2 ** 20, 2 ** 24, 5])]
    got = {r.vec_id: r.deviation for r in W.whitened_embeddings(spark.createDataFrame(rows, SCHEMA)).collect()}
    xs = [256 * x for x in (0, 2 ** 20, 2 ** 24, 5)]
    assert got == {i: (4 * x - sum(xs)) ** 2 if (4 * x - sum(xs)) ** 2 < 2 ** 63 else None for i, x in enumerate(xs)}


def test_keys_are_exact():
    x = np.array([[0, 127, -128], [0, 128, 0], [1 << 20, 0, 1], [1 << 40, -(1 << 62), 0]])
    import pyarrow as pa

    keys = W.pack(x)
    assert [k[0] for k in keys] == [1, 2, 4, 8] and (W.unpack(pa.array(keys, pa.binary())) == x).all()
