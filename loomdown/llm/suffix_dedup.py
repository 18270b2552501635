"""Operator 3, suffix-array dedup: bytes covered by a ``length``-byte string that occurs more than once are removed.

No task can hold the suffixes of the whole corpus, so they are dealt by content first. Every window of ``length`` bytes is
led by its anchor, the 32-byte gram of least hash inside it; windows of equal content have equal anchors. The
consecutive windows of one anchor occurrence form a territory (about 85 windows).

* Anchors met once cannot lie in a repeat; counting them is a partial aggregation.
* Equal territories repeat in all their windows; equality is a 64-bit territory hash besides the 64-bit anchor hash.
* Different territories of one anchor share some windows or none. Only these reach the merge. Of each distinct one a
  single representative goes to its anchor's bucket. A bucket's strings form shards, each a table over 8-byte symbols
  (suffixes ordered by their first symbol only, and the symbol before each suffix; no full Burrows-Wheeler table). The
  tables are merged by iterative interleave refinement: each round orders the live suffixes by the preceding symbol and
  their block, an argsort of packed keys, which orders them by one more symbol, and the block borders that appear in round h are the places whose common prefix is h-1 symbols. Blocks of one suffix are
  settled and leave. After length/8 rounds the blocks left are the repeated intervals of common prefix >= length. No
  round compares whole suffixes.
* An anchor with more than ``HOT`` distinct territories (a passage's edge amid thousands of contexts) would fill one task;
  its windows are instead counted by 128-bit window hashes, one row per window, an aggregation that spreads.

All rows carry the document's id and a hash of its text, so tables that repeat an id stay right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdown.llm.common import written
from loomdown.llm.lang_id import _buffers

LENGTH = 200
GRAM = 32
SYMBOL = 8
HOT = 8192  # so many representatives of one anchor fill a bucket by themselves
BUCKET_BYTES = 2 << 20
SHARD_BYTES = 1 << 20
_BLOCK = 1 << 18  # bytes hashed at once: their arrays of 8-byte numbers stay in a core's cache
_POS = np.uint64((1 << 24) - 1)


def _random_table() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_TABLE = _random_table()
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each position, by doubling."""
    h, size, mul = _TABLE[data], 1, _BASE
    while size < GRAM:
        h = h[:-size] * np.uint64(mul) + h[size:]
        mul = mul * mul % (1 << 64)
        size *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def territories(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first window start in ``data``, windows, anchor hash) for texts lying end to end in a block < 16 MB."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, dtype=np.uint64)
    h = gram_hashes(data)
    m = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    width, size = length - GRAM + 1, 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if width > size:
        m = np.minimum(m[: len(m) - (width - size)], m[width - size:])
    anchor = (m & _POS).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    valid = np.zeros(len(anchor), dtype=bool)
    for s, e in zip(starts.tolist(), ends.tolist()):
        if e - s >= length:
            valid[s: e - length + 1] = True
    at = np.nonzero(valid)[0]
    if not len(at):
        return none, none, none, np.zeros(0, dtype=np.uint64)
    a = anchor[at]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.nonzero(new)[0]
    count = np.diff(np.concatenate([first, [len(at)]]))
    s0 = at[first]
    return np.searchsorted(ends, s0, side="right"), s0, count, h[a[first]]


def _blocks(ends: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last text + 1, from byte, to byte): whole texts together, or a slice of one long text overlapping the next."""
    i, start = 0, 0
    while i < len(ends):
        j = i
        while j + 1 < len(ends) and ends[j + 1] - start <= _BLOCK:
            j += 1
        if ends[j] - start <= 2 * _BLOCK:
            yield i, j + 1, start, int(ends[j])
        else:
            for lo in range(start, int(ends[j]) - length + 1, _BLOCK):
                yield i, j + 1, lo, min(lo + _BLOCK + length - 1, int(ends[j]))
        start = int(ends[j])
        i = j + 1


def anchor_rows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(h, t, id, tk, pos): every territory; pos packs the first window's byte offset and the number of windows."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            data, ends = _buffers(b.column(2))
            starts = np.concatenate([[0], ends[:-1]])
            view = memoryview(data)
            for i, j, lo, hi in _blocks(ends, length):
                part = data[lo:hi]
                doc, s0, count, h = territories(part, np.clip(ends[i:j] - lo, 0, len(part)), length)
                if not len(doc):
                    continue
                a = s0 + lo
                t = np.fromiter((digest(view[x:y]) for x, y in zip(a.tolist(), (a + count + length - 1).tolist())), dtype=np.uint64, count=len(a))
                pos = (a - starts[i + doc]) << 8 | count
                at = pa.array(i + doc)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t.view(np.int64)), b.column(0).take(at), b.column(1).take(at), pa.array(pos)],
                                                 names=["h", "t", "id", "tk", "pos"])

    return docs.mapInArrow(run, f"h long, t long, id {docs.schema['id'].dataType.simpleString()}, tk long, pos long")


def _borders(key: np.ndarray) -> np.ndarray:
    """Where a new block of equal keys begins."""
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    return new


def _shared(border: np.ndarray) -> np.ndarray:
    """Which places lie in a block of two or more suffixes."""
    alone = border.copy()
    alone[:-1] &= border[1:]
    return ~alone


class ShardBwt:
    """A shard's table over 8-byte symbols: its suffixes ordered by first symbol, and the symbol before each (-1: none).

    Symbols are numbers into the shard's own sorted alphabet."""

    def __init__(self, strings: list[bytes], first: int):
        data = np.frombuffer(b"".join(strings), dtype=np.uint8)
        n = np.array([len(s) for s in strings])
        offset = np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n)
        padded = np.concatenate([data, np.zeros(SYMBOL, dtype=np.uint8)])
        sym = np.zeros(len(data), dtype=np.uint64)
        for k in range(SYMBOL):
            sym = sym << np.uint64(8) | padded[k: k + len(data)]
        at = np.nonzero(np.repeat(n, n) - offset >= SYMBOL)[0]
        at = at[np.argsort(sym[at])]
        new = _borders(sym[at])
        self.suffix = (at + first).astype(np.int32)  # numbered through all shards of the bucket
        self.offset = offset[at]  # bytes before the suffix in its string
        self.alphabet = sym[at[new]]
        self.symbol = np.cumsum(new) - 1
        number = np.empty(len(data), dtype=np.int64)
        number[at] = self.symbol
        self.before = np.where(offset[at] >= SYMBOL, number[np.maximum(at - SYMBOL, 0)], -1)


def merge_repeats(shards: list[ShardBwt], length: int = LENGTH) -> np.ndarray:
    """Suffix numbers whose first ``length`` bytes start another suffix too, by interleave refinement of the shards' tables."""
    alphabet = np.sort(np.concatenate([s.alphabet for s in shards]))
    alphabet = alphabet[_borders(alphabet)]
    before = np.full(max((int(s.suffix.max(initial=-1)) for s in shards), default=-1) + 1, -1, dtype=np.int32)
    suffix, symbol = [], []
    for s in shards:
        joint = np.append(np.searchsorted(alphabet, s.alphabet), -1).astype(np.int32)  # the shard's numbers in the joint alphabet; -1 stays
        # the rounds lead from a window's last symbol to its start: a suffix with fewer bytes before it ends no window of its string
        last = s.offset >= length - SYMBOL
        suffix.append(s.suffix[last])
        symbol.append(joint[s.symbol[last]])
        before[s.suffix] = joint[s.before]
    suffix, symbol = np.concatenate(suffix), np.concatenate(symbol)
    z = np.argsort(symbol)  # round 1: the shards' sorted tables interleaved by first symbol
    suffix, border = suffix[z], _borders(symbol[z])
    for _ in range(length // SYMBOL - 1):
        live = _shared(border)  # a block of one suffix is settled
        block, suffix = np.cumsum(border)[live], suffix[live]
        c = before[suffix]
        go = c >= 0
        key = c[go].astype(np.int64) << 32 | block[go]  # dealt by the preceding symbol, the interleave's order kept
        z = np.argsort(key)
        suffix, border = suffix[go][z] - SYMBOL, _borders(key[z])
    return suffix[_shared(border)]


def repeated_windows(strings: list[bytes], length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each string the sorted window starts whose ``length`` bytes also start elsewhere in the strings."""
    shards, held, size, first = [], [], 0, 0
    for s in [*strings, None]:
        if held and (s is None or size + len(s) > shard_bytes):
            shards.append(ShardBwt(held, first))
            first += size
            held, size = [], 0
        if s is not None:
            held.append(s)
            size += len(s)
    hits = np.sort(merge_repeats(shards, length)) if shards else np.zeros(0, dtype=np.int64)
    ends = np.cumsum([len(s) for s in strings])
    starts = np.concatenate([[0], ends[:-1]]) if len(strings) else ends
    lo, hi = np.searchsorted(hits, starts), np.searchsorted(hits, ends)
    return [hits[a:b] - s for a, b, s in zip(lo, hi, starts)]


def _runs(at: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of consecutive numbers."""
    if not len(at):
        return []
    cut = np.nonzero(np.diff(at) > 1)[0]
    return list(zip(at[np.r_[0, cut + 1]].tolist(), at[np.r_[cut, len(at) - 1]].tolist()))


def _spans(docs: DataFrame, length: int, hot: int, bucket_bytes: int) -> DataFrame:
    """(id, tk, lo, hi): byte ranges to remove; they overlap."""
    import xxhash

    id_type = docs.schema["id"].dataType.simpleString()
    rows = anchor_rows(docs, length)
    groups = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1")).where(F.col("n") > 1)
    # written first: then both sides of the join are plain exchanges, and AQE splits an anchor that holds many rows
    groups = written(groups.select("h", (F.col("t0") == F.col("t1")).alias("same")))
    met = written(rows.join(groups, "h"))
    mixed = met.where(~F.col("same")).drop("same")
    kinds = written(mixed.groupBy("h", "t").agg(F.count("*").alias("k"), F.min(F.struct("id", "tk", "pos")).alias("r")))
    width = kinds.groupBy("h").agg(F.count("*").alias("kinds"))
    equal = mixed.join(kinds.where(F.col("k") > 1).select("h", "t"), ["h", "t"], "left_semi")
    whole = met.where("same").select("id", "tk", "pos").unionByName(equal.select("id", "tk", "pos"))
    whole = whole.select("id", "tk", F.shiftright("pos", 8).alias("lo"), (F.shiftright("pos", 8) + F.col("pos").bitwiseAND(F.lit(255)) + (length - 1)).alias("hi"))

    reps = kinds.join(width, "h").select("h", "t", "k", (F.col("kinds") > hot).alias("hot"), "r.id", "r.tk", "r.pos")
    of_doc = reps.groupBy("id", "tk").agg(F.collect_list(F.struct("h", "t", "k", "hot", "pos")).alias("reps"))
    j = docs.join(of_doc.select(F.col("id").alias("rid"), F.col("tk").alias("rtk"), "reps"), docs["id"].eqNullSafe(F.col("rid")) & (F.col("tk") == F.col("rtk")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, ends = _buffers(b.column(2))
            raw = memoryview(data)
            rep = dict(zip(("h", "t", "k", "hot", "pos"), b.column(3).flatten().flatten()))
            row = np.repeat(np.arange(b.num_rows), b.column(3).value_lengths().to_numpy(zero_copy_only=False))
            pos = rep["pos"].to_numpy()
            lo = np.concatenate([[0], ends[:-1]])[row] + (pos >> 8)
            hi = lo + (pos & 255) + (length - 1)
            # a batch's strings leave in pieces of bounded size
            piece = np.cumsum(hi - lo) // _BLOCK
            cuts = [0, *(np.nonzero(np.diff(piece))[0] + 1).tolist(), len(lo)] if len(lo) else [0]
            for a, z in zip(cuts, cuts[1:]):
                at = pa.array(row[a:z])
                of = {c: rep[c].slice(a, z - a) for c in ("h", "k", "hot", "pos")}
                s = pa.array([bytes(raw[x:y]) for x, y in zip(lo[a:z].tolist(), hi[a:z].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([of["h"], of["k"], of["hot"], b.column(0).take(at), b.column(1).take(at), of["pos"], s],
                                                 names=["h", "k", "hot", "id", "tk", "pos", "s"])

    strings = written(j.select("id", "tk", "text", "reps").mapInArrow(cut, f"h long, k long, hot boolean, id {id_type}, tk long, pos long, s binary"))
    size = strings.where(~F.col("hot")).agg(F.sum(F.octet_length("s"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    cold = strings.where(~F.col("hot")).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)).cast("int"))
    cold = cold.select("bucket", "k", "id", "tk", "pos", "s").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    span = f"id {id_type}, tk long, lo long, hi long"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a bucket's (k, pos, s), its ids and text keys as Arrow arrays beside
        held, ids, tks, now = [], [], [], None

        def finish() -> pa.RecordBatch:
            got = repeated_windows([s for _, _, s in held], length)
            at, lo, hi = [], [], []
            for i, ((k, pos, _), starts) in enumerate(zip(held, got)):
                if k == 1:  # the others are known to repeat
                    for a, z in _runs(starts):
                        at.append(i)
                        lo.append((pos >> 8) + a)
                        hi.append((pos >> 8) + z + length)
            pick = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids).take(pick), pa.concat_arrays(tks).take(pick), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["id", "tk", "lo", "hi"])

        for b in batches:
            which = b.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.nonzero(np.diff(which))[0] + 1).tolist(), len(which)] if len(which) else [0]
            for a, z in zip(cuts, cuts[1:]):
                if now is not None and which[a] != now:
                    yield finish()
                    held, ids, tks = [], [], []
                now = which[a]
                part = b.slice(a, z - a)
                held += zip(part.column(1).to_pylist(), part.column(4).to_pylist(), part.column(5).to_pylist())
                ids.append(part.column(2))
                tks.append(part.column(3))
        if held:
            yield finish()

    merged = cold.mapInArrow(merge, span)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            for i in range(b.num_rows):
                s, pos = b.column(4)[i].as_py(), b.column(3)[i].as_py()
                n = len(s) - length + 1
                d = np.frombuffer(b"".join([digest(s[x: x + length]) for x in range(n)]), dtype="<i8").reshape(-1, 2)
                at = pa.array([i] * n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), b.column(0).take(at), b.column(1).take(at), b.column(2).take(at),
                                                  pa.array((pos >> 8) + np.arange(n))], names=["w1", "w2", "k", "id", "tk", "lo"])

    seen = strings.where("hot").select("k", "id", "tk", "pos", "s").mapInArrow(windows, f"w1 long, w2 long, k long, id {id_type}, tk long, lo long")
    twice = seen.groupBy("w1", "w2").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    dense = seen.where(F.col("k") == 1).join(twice, ["w1", "w2"], "left_semi").select("id", "tk", "lo", (F.col("lo") + length).alias("hi"))
    return whole.unionByName(merged).unionByName(dense)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT,
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept (binary): the text without the bytes covered by a string of
    ``length`` bytes (a multiple of 8, at least 40, at most 224) that starts anywhere else, too.

    Null text is the empty text; texts shorter than ``length`` keep all bytes. Two rows repeating an id and text repeat each
    other. Ids may be null; an empty table gives no rows; other columns are ignored. Kept bytes need not be valid UTF-8.
    """
    if length % SYMBOL or not 40 <= length <= 224:
        raise ValueError("length must be a multiple of 8 from 40 to 224")
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("tk"), t.alias("text"))
    spans = _spans(src.where(F.octet_length("text") >= length), length, hot, bucket_bytes)
    of_doc = spans.groupBy("id", "tk").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    of_doc = of_doc.select(F.col("id").alias("sid"), F.col("tk").alias("stk"), "spans")
    j = src.join(of_doc, src["id"].eqNullSafe(F.col("sid")) & (F.col("tk") == F.col("stk")), "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, runs, kept = [], [], [], []
            for t, s in zip(b.column(1), b.column(2)):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                out, at, k = [], 0, 0
                if s.is_valid:
                    lo = s.values.field(0).to_numpy()
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], np.maximum.accumulate(s.values.field(1).to_numpy()[order])
                    first = np.nonzero(np.r_[True, lo[1:] > hi[:-1]])[0]
                    last = np.r_[first[1:] - 1, len(lo) - 1]
                    for a, z in zip(lo[first].tolist(), hi[last].tolist()):
                        out.append(raw[at:a])
                        at, k = z, k + 1
                out.append(raw[at:])
                rest = b"".join(out)
                n.append(len(raw))
                gone.append(len(raw) - len(rest))
                runs.append(k)
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.large_binary()).cast(pa.binary())],
                                             names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = j.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)
