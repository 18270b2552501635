"""Rows whose number Spark guesses too low (exploded, or repeated in files) are never broadcast, however small their files."""

import re

import pytest
from loomdown.llm import decontam, simhash
from pyspark.sql import functions as F


@pytest.fixture
def plans(spark, monkeypatch):
    """The final plans of all tables collected or written, in order."""
    seen = []
    kind = type(spark.range(1))
    collect, written = kind.collect, simhash.written

    def kept(df):
        rows = collect(df)
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return rows

    def kept_written(df):
        kept(df)
        return written(df)

    monkeypatch.setattr(kind, "collect", kept)
    monkeypatch.setattr(simhash, "written", kept_written)
    return seen


def joins(plans):
    return [x for p in plans for x in re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash|BroadcastNestedLoop)Join", p.split("== Initial Plan ==")[0])]


def test_cells_and_flips(spark, plans):
    far = 0xFF << 40
    fps = [*range(100), far, far + 1, 0x7F << 20]  # a crowded neighbourhood, a pair, one alone
    got = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), crowded=4).collect()
    assert joins(plans) == ["SortMergeJoin", "SortMergeJoin"] and not any("Broadcast" in p for p in plans)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for r in got:
        assert 1 <= (r.u ^ r.v).bit_count() <= 2
        root[max(find(r.u), find(r.v))] = min(find(r.u), find(r.v))
    assert {f: find(f) for f in fps} == {**dict.fromkeys(range(100), 0), far: far, far + 1: far, 0x7F << 20: 0x7F << 20}


def test_repeated_documents(spark, plans):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same short text").alias("text"))
    got = simhash.simhash_components(docs).collect()
    assert len(got) == 3000 and len({r.fp for r in got}) == 1
    assert re.search(r"SortMergeJoin \[fp#", plans[-1].split("== Initial Plan ==")[0])


def test_pairs_of_test_items(spark, plans):
    items = spark.createDataFrame([(i, f"what is the name of river {i} here? it is called number {i} there.") for i in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so what is the name of river 7 here? it is called number 7 there. yes"), (2, "nothing of it")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contamination(docs, items, items_per_index=15).collect()] == [(1, 7)]
    assert set(joins(plans)) == {"SortMergeJoin"}
