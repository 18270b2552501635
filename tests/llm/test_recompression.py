"""Operator 11 against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from loomdown.llm import recompression as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, h long, tk string, pos int, m int"


def brute(rows, width):
    """Counter of (id, n_words, n_removed, kept digest); rows of one id by the library's hash order are given in order."""
    seen, out = set(), []
    for i, text in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - width + 1):
            w = tuple(words[k: k + width])
            if w in seen:
                gone[k: k + width] = [True] * width
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def corpus(seed, docs=80):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 3)))
    words = lambda n: [word() for _ in range(n)]
    shared = [words(rnd.randint(15, 90)) for _ in range(8)]
    sep = lambda: rnd.choice([" ", " ", "\n", "\t ", "  ", "\x0b"])
    out = [None, "", " \n", "one", "a " * 300, "a b " * 200, "a b c\n" * 70, " ".join(shared[0] * 4), "x y z" * 30, "w" * 3000]
    for _ in range(docs):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            s = rnd.choice(shared)
            a = rnd.randint(0, len(s) - 1)
            parts += rnd.choice([words(rnd.randint(1, 60)), s, s[a: a + rnd.randint(10, 60)]])
        out.append("".join(w + sep() for w in parts))
    return out + rnd.sample(out[10:], 8)


def anchors_of(words, width=20):
    data = " ".join(words).encode()
    w = R.Words(np.frombuffer(data, dtype=np.uint8), np.array([len(data)]))
    return w, R.anchors(w.names(), w.text, width)


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(2)
    core = [rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(60)]
    found = {}
    for _ in range(30):
        words = [rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 40))] + core + [rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 40))]
        w, (starts, anchor, place) = anchors_of(words)
        assert starts.tolist() == list(range(len(words) - 19))
        for s, a, p in zip(starts.tolist(), anchor.tolist(), place.tolist()):
            key = tuple(words[s: s + 20])
            assert found.setdefault(key, (a, (p >> 3) - s)) == (a, (p >> 3) - s)


def test_words_and_names():
    texts = ["ab  cd\n", "", "x", "cd ab", " \t", "é e cd"]
    raw = [t.encode() for t in texts]
    w = R.Words(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([len(r) for r in raw]))
    got = [bytes(w.line[a:b]).decode() for a, b in zip(w.start, w.stop)]
    assert got == [x for t in texts for x in WORD.findall(t)]
    assert w.text.tolist() == [0, 0, 2, 3, 3, 5, 5]
    names = dict(zip(got, w.names().tolist()))
    assert len(set(names.values())) == len(names) == len(set(got)) and all(names[g] == n for g, n in zip(got, w.names().tolist()))


def test_giant_words_and_slices(monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 64)
    monkeypatch.setattr(R, "SLICE", 50)
    rnd = random.Random(1)
    words = [rnd.choice("abc") * rnd.choice([1, 2, 200]) for _ in range(400)]
    data = " ".join(words).encode()
    w = R.Words(np.frombuffer(data, dtype=np.uint8), np.array([len(data)]))
    names = {}
    assert all(names.setdefault(x, n) == n for x, n in zip(words, w.names().tolist())) and len(set(names.values())) == len(names)
    covered = sorted(int(f) + k for _, first, count, _, _ in R.stretches(w) for f, c in zip(first, count) for k in range(c))
    assert covered == list(range(381))


@pytest.mark.parametrize("width,rounds", [(20, 4), (20, 2), (7, 3)])
def test_against_brute_force(spark, width, rounds):
    rows = list(enumerate(corpus(7)))
    df = spark.createDataFrame([(i, t, 1, "k", 2, 3) for i, t in rows], SCHEMA).repartition(4)
    got = R.remove_repeats(df, width=width, rounds=rounds).collect()
    have = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got)
    assert have == brute(rows, width)
    assert sum(r.n_removed for r in got) > 0


def test_repeated_and_null_ids(spark):
    texts = corpus(9, 20)
    long = next(t for t in texts[20:] if len(WORD.findall(t)) > 40)
    rows = [(None, long)] * 3 + [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 400
    df = spark.createDataFrame([(i, t, 1, "k", 2, 3) for i, t in rows], SCHEMA)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    got = R.remove_repeats(df).collect()
    have = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got)
    assert have == brute([rows[k] for k in order], 20)


def test_empty_table(spark):
    assert R.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
