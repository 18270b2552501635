"""The pipeline's stages against brute-force versions on rows with nulls, repeats, empty and long texts and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
BOILER = "Subscribe to our weekly letter for more stories like this one"
CLASH = "n_lines long, N_Removed_Lines string, id long, fp long, row string, digest string, score double, n long, root long, item string, shard int"
TAIL = (999, "mine", -1, -2, "r", "d", 0.5, 7, 8, "i", 3)


def brute_lines(rows, min_sites=10):
    sites = {}
    for _, text, _, source, _, *_ in rows:
        for line in (text or "").split("\n"):
            if source is not None:
                sites.setdefault(line.strip(" \t\r"), set()).add(source)
    gone = {k for k, v in sites.items() if k and len(v) >= min_sites}  # blank lines stay
    out = []
    for i, text, lang, source, n, *rest in rows:
        lines = None if text is None else text.split("\n")
        kept = None if lines is None else [x for x in lines if x.strip(" \t\r") not in gone]
        out.append((i, None if text is None else "\n".join(kept), lang, source, n if lines == kept else len("\n".join(kept)), *rest))
    return out


def brute_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_one_of_each(rows):
    """Components of fingerprints within two bits -> the row that stays: smallest id (nulls last), then smallest text digest."""
    fps = [brute_fingerprint(r[1]) for r in rows]
    names = sorted(set(fps))
    root = {f: f for f in names}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    best = {}
    for r, f in zip(rows, fps):
        key = (r[0] is None, r[0] or 0, b"" if r[1] is None else hashlib.sha256(r[1].encode()).digest())
        if find(f) not in best or key < best[find(f)][0]:
            best[find(f)] = (key, r)
    return [r for _, r in best.values()]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(6)
    given = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()
    words = sorted({w for r in given for w in (r.text or "").split()})
    out = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in given]
    out += [(1000 + i, f"{' '.join(rnd.choices(words, k=12))}\n  {BOILER}\t\n{' '.join(rnd.choices(words, k=9))}", "en", f"s{i % 13}", 5) for i in range(26)]
    out += [(2000 + i, f"only nine sites\n{' '.join(rnd.choices(words, k=8))}", None, f"s{i}", None) for i in range(9)]
    copy = out[3][1]
    out += [(3000, copy, "en", "a", 1), (3001, copy.upper(), "en", None, 2), (None, copy, None, None, None), (None, None, None, None, None),
            (None, None, None, None, None), (3002, "", "en", "b", 0), (3003, " \n\t ", "en", "b", 4), (3002, "", "en", "b", 0),
            (3004, " ".join(rnd.choices(words, k=150_000)), "en", "long", 9), (3004, "another text of this id", "en", "c", 23)]
    return [(*r, *TAIL) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    kind = spark.read.parquet(f"{SF}/documents.parquet").schema
    base = ", ".join(f"{c} {kind[c].dataType.simpleString()}" for c in ("doc_id", "text", "lang", "source", "n_chars"))
    return spark.createDataFrame(rows, f"{base}, {CLASH}").repartition(5).cache()


def same(df, rows):
    assert Counter(tuple(r) for r in df.collect()) == Counter(rows)


def test_line_stage(spark, docs, rows):
    want = brute_lines(rows)
    changed = {b[0] for a, b in zip(want, rows) if a != b}
    assert {1000 + i for i in range(26)} <= changed and not changed & {2000 + i for i in range(9)}
    got = C.stage_line_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    same(got, want)


def test_simhash_stage(spark, docs, rows):
    want = brute_one_of_each(rows)
    assert len(want) < len(rows) - 5
    same(C.stage_simhash(spark, docs, SF), want)


def test_toxicity_stage(spark, docs, rows):
    """A separate sum of the fitted weights decides; the rows that stay are whole."""
    from loomdown.llm import toxicity
    from loomdown.llm.common import held_out

    whole = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(whole.where(~held_out()), spark.read.parquet(f"{SF}/labels.parquet").where(~held_out()))

    def p(text):
        seen = {w: x for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if (x := model.word(w))}
        return 1 / (1 + math.exp(-(model.bias + sum(seen.values()))))

    kept = C.stage_toxicity(spark, whole, SF).collect()
    want = [r for r in whole.collect() if p(r.text) < toxicity.THRESHOLD]
    assert sorted(kept) == sorted(want) and 0 < len(want) < whole.count()
    same(toxicity.drop_toxic(docs, model), [r for r in rows if p(r[1]) < toxicity.THRESHOLD])


def test_decontam_stage(spark, docs, rows):
    """Documents with a planted item go; a document that holds no item's answer words stays."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(5).collect()
    planted = [(5000 + i, f"before it {r.text} after it", "en", "x", 1, *TAIL) for i, r in enumerate(items)]
    df = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    got = C.stage_decontam(spark, df, SF)
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert got.columns == docs.columns and not set(range(5000, 5005)) & set(ids)
    assert {1000 + i for i in range(26)} <= set(ids) and ids.count(None) == sum(r[0] is None for r in rows)


def test_bpe_stage(spark, docs, rows):
    import public_tokenizers as P
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    same(C.stage_bpe(spark, docs, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), want)


def test_empty_table(spark, docs):
    none = docs.where(F.lit(False))
    for name, stage in C.STAGES:
        out = stage(spark, none, SF)
        assert out.isEmpty(), name
        assert name == "bpe" or out.columns == none.columns
