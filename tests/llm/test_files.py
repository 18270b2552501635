"""Operators 2 and 6: exact round trips through the written files; the pipeline's stages."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P

from loomdown.llm import packing as K
from loomdown.llm import warc as W
from loomdown.llm.common import shared_dir

RANKS = P.path("byte_bpe_50k.tiktoken")


def test_best_fit_decreasing():
    rnd = random.Random(1)
    lengths = [rnd.randint(1, 64) for _ in range(400)]
    free, at = [], []
    for i in sorted(range(400), key=lambda i: -lengths[i]):  # brute force: a row of least sufficient space
        fits = [f for f in free if f >= lengths[i]]
        if fits:
            free.remove(min(fits))
            at.append(min(fits) - lengths[i])
        else:
            at.append(64 - lengths[i])
        free.append(at[-1])
    got = K.best_fit_decreasing(lengths, 64)
    used = {}
    for n, (row, off) in zip(lengths, got):
        assert not set(range(off, off + n)) & used.setdefault(row, set()) and off + n <= 64
        used[row] |= set(range(off, off + n))
    assert sorted(64 - len(u) for u in used.values()) == sorted(free)


def test_packing_is_lossless(spark):
    rnd = random.Random(2)
    texts = [None, "", "one", "x" * 20000, *[" ".join(rnd.choice(["alpha", "beta", "gamma's", "é"]) for _ in range(rnd.randint(1, 90))) for _ in range(60)]]
    rows = [(i, t, 3) for i, t in enumerate(texts)] + [(5, texts[5], 3), (None, "null id", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    folder = shared_dir(spark)
    pieces = K.pack_documents(df, folder, RANKS, P.PATTERN, seq_len=64, shard_bytes=8000)
    tokens, kind = K._tokenizer(RANKS, P.PATTERN)
    got = {}
    for r in pieces.collect():
        if r.piece is None:
            assert r.n_tokens == 0
            continue
        a = K.read_shard(folder, r.shard)
        part = a["ids"][r.row, r.row_offset:r.row_offset + r.length]
        cu = a["cu_seqlens"][a["row_index"][r.row]:a["row_index"][r.row + 1]]
        assert r.row_offset in cu and r.row_offset + r.length in cu
        pos = K.position_ids(cu, 64)
        assert pos[r.row_offset:r.row_offset + r.length].tolist() == list(range(r.length))
        got.setdefault((r.doc_id, r.shard), {}).setdefault(r.piece, []).append(part)
    for i, t, _ in rows:
        want = np.frombuffer(tokens(t or ""), dtype=kind)
        mine = [v for (d, _), v in got.items() if d == i]
        assert (not len(want) and not mine) or all(np.array_equal(np.concatenate([p[k][0] for k in sorted(p)]), want) for p in mine)
    back = K.unpack_documents(pieces, folder).collect()
    assert back and all(r.segment_ok for r in back)
    assert K.pack_documents(df.limit(0), shared_dir(spark), RANKS, P.PATTERN).count() == 0


def brute_records(rows):
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    top = {}
    for p, _, h in rows:
        if p is not None:
            top[h or ""] = max(top.get(h or "", p), p)
    out, done = [], set()
    for p, _, h in rows:
        t = h or ""
        first = p is not None and p == top[t] and t not in done
        if first:
            done.add(t)
        revisit = p is not None and not first
        out.append((p, len(t.encode()), digest(t), "revisit" if revisit else "response", top[t] if revisit else None))
    return sorted(out, key=str)


def test_warc_round_trip(spark):
    rnd = random.Random(3)
    rows = [(i * 7, f"http://a.b/{i} x\n", rnd.choice([None, "", "same", "é" * rnd.randint(1, 3000), f"<p>{i}</p>"])) for i in range(120)]
    rows += [(14, "u", "same"), (14, "u", "same"), (833, None, "same"), (833, None, "same"), (None, "n", "same"), (10**15, "far", "z" * 300000)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, id string, shard int").repartition(4)
    first = None
    for _ in range(2):  # the same files in every run
        folder = shared_dir(spark)
        m = W.write_warc(df, folder, shard_bytes=20000, roll_bytes=4000)
        back = W.read_warc(folder, m, with_payload=True).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str) == brute_records(rows)
        files = sorted((r.name, r.records, r["bytes"]) for r in m.collect())
        assert len(files) > 3 and files == (first or files)
        first = files
    html = {(p, len((h or "").encode())): (h or "").encode() for p, _, h in rows}
    assert all(bytes(r.payload) == html[r.page_id, r.payload_bytes] for r in back if r.record_type == "response")
    folder = shared_dir(spark)
    assert W.read_warc(folder, W.write_warc(df.limit(0), folder)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "simhash", "decontam", "bpe"]
    assert C.STAGES[0][1](spark, docs, sf).schema == docs.schema
    assert C.STAGES[1][1](spark, docs, sf).columns == docs.columns
    out = C.run(spark, sf)
    n = out.count()
    assert 0 < n < docs.count() and out.select("doc_id").distinct().count() == n


def test_warc_heavy_ids_and_jobs(spark):
    """Heavy ids and null ids spread over several archives, the same in every run; the number of jobs does not follow the shards."""
    rnd = random.Random(4)
    rows = [(50, f"u{i}", f"heavy {i} " * 40) for i in range(300)] + [(50, "same", "again")] * 4 + [(None, f"n{i}", "nil " * 90) for i in range(200)]
    rows += [(i, f"http://x/{i}", rnd.choice(["again", f"page {i} " * rnd.randint(1, 60)])) for i in range(0, 900, 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    sc, jobs, files = spark.sparkContext, [], []
    for n, (shard, slices) in enumerate([(10**9, 10), (40000, 10**6), (4000, 10), (4000, 77)]):
        sc.setJobGroup(f"warc-{n}", "")
        folder = shared_dir(spark)
        m = W.write_warc(df, folder, shard_bytes=shard, roll_bytes=10**9, slice_ids=slices)
        files.append(sorted((r.name, r.records, r["bytes"], str(r.first_id), str(r.last_id)) for r in m.collect()))
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"warc-{n}")))
        back = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.read_warc(folder, m).collect()]
        assert sorted(back, key=str) == brute_records(rows)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert files[2] == files[3] and len(files[0]) == 1 and len(files[2]) > 5 * len(files[1]) > 5
    assert sum(i == j == "50" for _, _, _, i, j in files[2]) > 10 and sum(i == j == "None" for _, _, _, i, j in files[2]) > 10
    assert abs(jobs[2] - jobs[1]) <= 4, jobs


def test_shards_are_tasks(spark):
    ids = spark.range(4000).selectExpr("id", "10L as b")
    plan = W.shard_plan(ids, 1000, 300)
    assert plan.count == 40 and plan.ends.tolist() == list(range(99, 3999, 100)) and not plan.more
    assert W.shard_plan(ids.limit(0), 1000).count == 1
    lone = W.shard_plan(spark.sql("select cast(null as long) as id, 5000L as b"), 1000)
    assert lone.count == 5
