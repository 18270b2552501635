"""Operator 7 against the tiktoken library, random strings, long pre-tokens, and the decoding round trip."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from loomdown.llm.bpe import Encoder, chunks, decode_documents, encode_documents, roundtrip

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    return Encoder(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def lib(enc):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})


def test_random_strings(enc, lib):
    rnd = random.Random(1)
    for _ in range(4000):
        s = "".join(rnd.choice(" \n\t\r'sat1²é\x1c\x85 　ß%三ll") for _ in range(rnd.randint(0, 16)))
        assert "".join(chunks(s)) == s
        assert enc.encode(s) == lib.encode_ordinary(s), repr(s)
        assert enc.decode(enc.encode(s)) == s.encode()


def test_long_pre_tokens(enc, lib):
    rnd = random.Random(2)
    for s in ["a" * 30000, " " * 5000 + "x", "".join(rnd.choice("abcdefgh") for _ in range(20000)), "<|endoftext|>"]:
        assert enc.encode(s) == lib.encode_ordinary(s)


def test_tables(spark, lib):
    data = [(1, "Hello  world's é", "c"), (2, None, "c"), (3, "", "c"), (1, "Hello  world's é", "c"), (None, " x", "c")]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string")
    got = sorted(map(tuple, roundtrip(df, RANKS, P.PATTERN).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _ in data:
        ids = lib.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want, key=str)
    e = encode_documents(df, RANKS, P.PATTERN)
    back = decode_documents(e, RANKS, P.PATTERN).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((t or "").encode() for _, t, _ in data)
    assert roundtrip(df.limit(0), RANKS, P.PATTERN).count() == 0
