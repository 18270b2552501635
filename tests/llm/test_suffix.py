"""Operator 3 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from loomdown.llm import suffix_dedup as S


def brute(texts, n):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + n] for r in raws for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - n + 1):
            if seen[r[i:i + n]] > 1:
                gone[i:i + n] = b"\x01" * n
        runs = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(r, gone) if not g)).hexdigest()))
    return out


def corpus(seed, docs=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(2, 9)))
    para = lambda k: " ".join(word() for _ in range(k))
    shared = [para(rnd.randint(5, 120)) for _ in range(6)]
    out = [None, "", "short", "a" * 700, "a" * 650 + "b", "ab" * 400, shared[0] * 5]
    for _ in range(docs):
        out.append(" ".join(rnd.choice([para(rnd.randint(1, 80)), rnd.choice(shared), rnd.choice(shared)[3:rnd.randint(50, 400)]]) for _ in range(rnd.randint(1, 5))))
    return out + rnd.sample(out[7:], 6)


def test_repeated_windows():
    rnd = random.Random(4)
    base = bytes(rnd.choice(b"abcd") for _ in range(900))
    strings = [base[:300], base[50:420], b"x" + base[100:350], bytes(rnd.choice(b"ab") for _ in range(500)), base[:300][::-1], b"q" * 260]
    seen = Counter(s[i:i + 200] for s in strings for i in range(len(s) - 199))
    want = [[i for i in range(len(s) - 199) if seen[s[i:i + 200]] > 1] for s in strings]
    for shard_bytes in (1, 700, 1 << 20):
        assert [x.tolist() for x in S.repeated_windows(strings, 200, shard_bytes)] == want


def test_merge_orders_windows_only(monkeypatch):
    rnd = random.Random(6)
    base = bytes(rnd.choice(b"abcd") for _ in range(284))
    strings = [base, base[:283] + b"x", base[1:] + b"y"]
    shards = [S.ShardBwt(strings[:2], 0), S.ShardBwt(strings[2:], 568)]
    sorted_keys, argsort = [], np.argsort
    monkeypatch.setattr(S.np, "argsort", lambda key: sorted_keys.append(len(key)) or argsort(key))
    hits = S.merge_repeats(shards, 200)
    assert sorted(hits.tolist()) == [*range(85), *range(284, 368), *range(568, 652)]
    assert len(sorted_keys) == 25 and max(sorted_keys) <= sum(len(s) - 199 for s in strings)


def test_long_texts_are_cut_alike(monkeypatch):
    data = np.frombuffer(bytes(random.Random(1).choice(b"abc") for _ in range(5000)), dtype=np.uint8)
    monkeypatch.setattr(S, "_BLOCK", 512)
    got = set()
    for i, j, lo, hi in S._blocks(np.array([100, 5000]), 200):
        _, s0, n, _ = S.territories(data[lo:hi], np.clip(np.array([100, 5000])[i:j] - lo, 0, hi - lo))
        got |= {int(a) + lo + k for a, c in zip(s0, n) for k in range(int(c))}
    assert got == set(range(100, 4801))


@pytest.mark.parametrize("hot", [1, 1000])
def test_against_brute_force(spark, hot):
    texts = corpus(7)
    rows = [(i, t, "c", 1) for i, t in enumerate(texts)] + [(8, texts[8], "c", 1), (None, texts[9], "c", 1)]
    want = Counter(zip([r[0] for r in rows], brute([r[1] for r in rows], 200)))
    df = spark.createDataFrame(rows, "doc_id long, text string, tk string, h int").repartition(3)
    got = S.remove_repeats(df, hot=hot, bucket_bytes=20000).collect()
    assert Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())) for r in got) == want
    assert sum(r.n_removed for r in got) > 0


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
