"""Operator 4, SimHash near-dedup by segment-popcount embedding.

1. 64-bit fingerprints of word shingles (Arrow batches, numpy inside the task).
2. Embedding: a fingerprint becomes the vector of bit counts of its 16 four-bit segments. The Manhattan distance of two
   vectors never exceeds the Hamming distance of the fingerprints.
3. Grid range-join: every distinct fingerprint enters its own grid cell and the cells one step away along each axis
   (radius 1). Two vectors at Manhattan distance <= 2 share a cell, others never do, so the join is an equi-join on
   cells with 33 rows per fingerprint, linear in the input. For larger radii more steps are taken from each end.
4. Pairs of a cell are verified exactly by the popcount of the xor. A crowded cell is not expanded into pairs: its
   fingerprints are keyed by themselves with every single bit flipped, where equal keys prove a distance <= 2, and
   linked to the key's smallest member. That keeps the same connected components with 65 rows per fingerprint.
5. Connected components over distinct fingerprints, then the smallest document id of each component.

``keep_one`` leaves exactly one row of each component, told apart by the component's root and not by its smallest id, so
repeated and null ids join nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdown.llm.common import written
from loomdown.llm.components import components

SEGMENTS = 16
SHINGLE = 3
MAX_BITS = 2
CROWDED = 64
_BLOCK = 1 << 17


def fingerprint_of(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Bit b is set if it is set in over half of the shingles' XXH64 (seed 42); no words give 0."""
    import xxhash

    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    h64 = xxhash.xxh64_intdigest
    for lo in range(0, n, _BLOCK):  # a very long text is hashed block by block
        part = words[lo: min(lo + _BLOCK, n) + shingle - 1]
        m = max(1, len(part) - shingle + 1)
        joined = b" ".join(part)
        at = np.cumsum(np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1)
        starts = [0, *at[: m - 1].tolist()]
        ends = (at[min(shingle, len(part)) - 1:] - 1).tolist()
        h = np.array([h64(joined[a:b], 42) for a, b in zip(starts, ends)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _digest(text: Column) -> Column:
    """SHA-256 of the text's bytes; that of a null text is empty."""
    return F.coalesce(F.unhex(F.sha2(text.cast("string").cast("binary"), 256)), F.lit(b""))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, digest: bool = False) -> DataFrame:
    """(id, fp long[, digest]): the fingerprint of each whole text as a signed 64-bit value; null text has no words."""
    more = [_digest(F.col(text_col)).alias("digest")] if digest else []
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint_of((t.as_py() or "").encode("utf-8", "surrogatepass").lower().split(), shingle)
                               for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], names=["id", "fp", *names])

    names = src.columns[2:]
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, fp long{', digest binary' if digest else ''}")


def _cell(fp: Column) -> Column:
    """The fingerprint's own grid cell: its vector packed with 4 bits an axis."""
    width = 64 // SEGMENTS
    own = F.lit(0).cast("long")
    for i in range(SEGMENTS):
        count = F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1))).cast("long")
        own = own.bitwiseOR(F.shiftleft(count + 1, 4 * i))  # +1 keeps a step down from borrowing
    return own


#: What leads from a cell to itself and to its neighbours one step away.
_STEPS = [0, *[sign * (1 << 4 * i) for i in range(SEGMENTS) for sign in (1, -1)]]


def links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(u, v) links with Hamming distance 1..2 between distinct fingerprints, enough to connect all that lie so near."""
    steps = F.array(*[F.lit(s).cast("long") for s in _STEPS])
    reg = fps.select("fp", _cell(F.col("fp")).alias("own")).select("fp", "own", F.explode(steps).alias("step"))
    reg = reg.select("fp", (F.col("own") + F.col("step")).alias("cell"))
    sizes = reg.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    # Spark sizes exploded rows as if they were not exploded and would broadcast them
    shared = written(reg.join(sizes.hint("merge"), "cell"))
    small = shared.where(F.col("n") <= crowded).groupBy("cell").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    pairs = small.select(F.explode("fps").alias("u"), "fps").select("u", F.explode(F.filter("fps", lambda x: x > F.col("u"))).alias("v"))
    near = pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)])
    busy = shared.where(F.col("n") > crowded).select("fp").distinct().select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("key"))
    low = busy.groupBy("key").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where(F.col("n") > 1)
    star = busy.join(low.hint("merge"), "key").where(F.col("fp") != F.col("v")).select(F.col("fp").alias("u"), "v")
    return near.unionByName(star).distinct()


def _roots(rows: DataFrame, lows: DataFrame) -> DataFrame:
    """(fp, low, root): ``lows`` (fp, low), one row per fingerprint of ``rows``, with the root of its component."""
    comp = components(links(rows.select("fp").distinct()))
    return written(lows.join(comp, lows.fp == comp.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: id, fp (signed long), component_id (smallest id of the linked documents).

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows are reported once each. A null id
    belongs to its component but is never its smallest id unless all are null. An empty table gives no rows. Other
    columns are ignored.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle))
    roots = _roots(rows, rows.groupBy("fp").agg(F.min("id").alias("low")))
    lows = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = roots.join(lows, "root").select("fp", "component_id")
    # repeated rows take next to no room in files, so rows may be many more than their files let Spark think
    return rows.join(by_fp.hint("merge"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The input's rows without near duplicates: of each component exactly one row stays.

    It is a row with the component's smallest id (nulls last), among those of different texts that of the smallest text
    digest, of equal rows any one. Rows repeating an id, or without an id, in different components are different documents.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle, digest=True))
    row = F.struct(F.col("id").isNull().alias("late"), "id", "digest", "n")
    equal = rows.groupBy("fp", "id", "digest").agg(F.count("*").alias("n"))
    roots = _roots(rows, equal.groupBy("fp").agg(F.min(row).alias("low")))
    stay = written(roots.groupBy("root").agg(F.min("low").alias("low")).select("low.id", "low.digest", "low.n"))

    def kept(which: DataFrame) -> DataFrame:  # id and digest determine the fingerprint and so the component
        cond = docs[id_col].eqNullSafe(which["id"]) & (_digest(docs[text_col]) == which["digest"])
        return docs.join(which, cond, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])

    if stay.where(F.col("n") > 1).isEmpty():
        return kept(stay)
    return kept(stay.where(F.col("n") == 1)).unionByName(kept(stay.where(F.col("n") > 1)).dropDuplicates([id_col, text_col]))
