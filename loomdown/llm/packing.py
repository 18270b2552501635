"""Operator 2, token-id output: best-fit-decreasing packing into fixed-length training rows.

Documents are dealt to shards by a hash of their id, tokenised, and cut without loss into pieces of at most ``seq_len``
tokens. Inside a shard the pieces go, longest first, to the row with the smallest sufficient space, found in a segment
tree over the capacities 0..seq_len. A shard is written as three arrays: the packed id matrix (uint16 when the
vocabulary allows, else uint32; unused cells hold ``pad_id``), the cumulative segment lengths of each row with an index of where
each row's lengths start, and the offsets at which positions restart. Shards hold about ``shard_bytes`` of text, so a
task's memory is bounded by that or by the longest document.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdown.llm.bpe import ChunkTable, load_ranks
from loomdown.llm.common import shared_dir, written
from loomdown.llm.files import TemporaryFile, commit, open_fs

SEQ_LEN = 2048
SHARD_BYTES = 12 << 20


class BestFit:
    """Rows with free space, by capacity: a segment tree over 0..size whose nodes say whether any row below has space."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.any = bytearray(2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        i = self.base + free
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(free space, row) of a fullest row with at least ``need`` free, the latest put there; None if there is none."""
        i = self.base + need
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):  # up to the first subtree on the right that has one
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:  # down to its leftmost
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        free = i - self.base
        rows = self.rows[free]
        row = rows.pop()
        if not rows:
            while i:
                self.any[i] = 0 if i >= self.base else self.any[2 * i] | self.any[2 * i + 1]
                if self.any[i]:
                    break
                i >>= 1
        return free, row


def best_fit_decreasing(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(row, offset) of each piece (1..size tokens); pieces are placed longest first, ties in input order."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    at: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    tree, n = BestFit(size), 0
    for i in order:
        need = lengths[i]
        got = tree.take(need)
        if got is None:
            got, n = (size, n), n + 1
        free, row = got
        at[i] = (row, size - free)
        if free > need:
            tree.put(free - need, row)
    return at


@lru_cache(maxsize=2)
def _tokenizer(rank_file: str, pattern: str):
    """Text -> bytes of little-endian ids, remembering the chunks met (bounded); the id type's name."""
    import tiktoken

    ranks = load_ranks(rank_file)
    kind = "<u2" if max(ranks.values()) < 65535 else "<u4"
    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    one = lambda c: np.array(enc.encode_ordinary(c), dtype=kind).tobytes()
    seen = ChunkTable(one, 500_000)

    def tokens(text: str) -> bytes:
        return b"".join(seen.values(text))

    return tokens, kind


def pack_shard(docs: list[np.ndarray], seq_len: int, pad_id: int, kind: str) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces (document, piece, row, offset, length), id matrix, cumulative lengths, where each row's start, position resets."""
    pieces = [(d, k, lo, min(seq_len, len(t) - lo)) for d, t in enumerate(docs) for k, lo in enumerate(range(0, len(t), seq_len))]
    at = best_fit_decreasing([p[3] for p in pieces], seq_len)
    n = 1 + max((r for r, _ in at), default=-1)
    ids = np.full((n, seq_len), pad_id, dtype=kind)
    segments: list[list[int]] = [[] for _ in range(n)]
    for (d, _, lo, length), (row, off) in zip(pieces, at):
        ids[row, off:off + length] = docs[d][lo:lo + length]
        segments[row].append(off + length)
    for s in segments:
        s.sort()
    cu = np.array([x for s in segments for x in [0, *s]], dtype="<i4")
    index = np.cumsum([0, *[len(s) + 1 for s in segments]]).astype("<i8")
    resets = np.array([x for s in segments for x in [0, *s[:-1]]], dtype="<i4")
    return [(d, k, row, off, length) for (d, k, _, length), (row, off) in zip(pieces, at)], ids, cu, index, resets


def position_ids(cu: np.ndarray, seq_len: int) -> np.ndarray:
    """A row's position ids from its cumulative lengths: they restart with every segment; padding counts from zero too."""
    pos = np.arange(seq_len)
    starts = np.zeros(seq_len, dtype=int)
    starts[[x for x in cu if x < seq_len]] = [x for x in cu if x < seq_len]
    return pos - np.maximum.accumulate(starts)


PARTS = ("ids", "cu_seqlens", "row_index", "position_resets")


def _npy(a: np.ndarray) -> bytes:
    f = io.BytesIO()
    np.save(f, a)
    return f.getvalue()


def pack_documents(docs: DataFrame, folder: str, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                   seq_len: int = SEQ_LEN, pad_id: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes ``shard-N.<part>.npy`` files below ``folder`` and returns a row per piece:
    id, shard, n_tokens (of the document), piece, row, row_offset, length; a document without tokens is one row with piece null.

    Null text counts as empty. Rows repeating an id are packed once each. ``pad_id`` defaults to the largest value of the
    id type. Files get their final names only after every task has reported, so repeated attempts leave no mix. An
    empty table writes no file.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    total = src.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    # repeated ids spread by their text; equal rows are spread by nothing else and packed side by side
    dealt = src.withColumn("shard", F.pmod(F.xxhash64("id", F.octet_length("t"), F.substring("t", 1, 64)), F.lit(shards)).cast("int"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "id", F.octet_length("t"), "t")
    id_field = src.select("id").limit(0).toArrow().schema.field("id").type
    fields = [("id", id_field), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("piece", pa.int32()), ("row", pa.int32()), ("row_offset", pa.int32()),
              ("length", pa.int32()), ("temp", pa.list_(pa.string()))]
    schema = f"id {src.schema['id'].dataType.simpleString()}, shard int, n_tokens long, piece int, row int, row_offset int, length int, temp array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, kind = _tokenizer(rank_file, pattern)
        pad = np.iinfo(np.dtype(kind)).max if pad_id is None else pad_id
        ids: list = []
        held: list[np.ndarray] = []

        def finish(shard: int) -> pa.RecordBatch:
            pieces, *arrays = pack_shard(held, seq_len, pad, kind)
            temps = []
            for part, a in zip(PARTS, arrays):
                f = TemporaryFile(folder, f"shard-{shard:06d}.{part}.npy")
                f.write(_npy(a))
                f.close()
                temps.append(f.temp)
            rows = [(ids[d], shard, len(held[d]), k, row, off, n, None) for d, k, row, off, n in pieces]
            rows += [(ids[d], shard, 0, None, None, None, None, None) for d in range(len(held)) if not len(held[d])]
            rows[0] = (*rows[0][:7], temps)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

        now = None
        for b in batches:
            for i, (t, shard) in enumerate(zip(b.column(1), b.column(2).to_pylist())):
                if now is not None and shard != now:
                    yield finish(now)
                    ids.clear()
                    held.clear()
                now = shard
                ids.append(b.column(0)[i].as_py())
                held.append(np.frombuffer(tokens(t.as_py()), dtype=kind))
        if now is not None:
            yield finish(now)

    out = written(dealt.mapInArrow(run, schema))

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for temp in b.column(0).to_pylist():
                commit(folder, temp, temp.removeprefix("_temporary/").rpartition(".")[0])
            yield b

    files = out.where(F.col("temp").isNotNull()).select(F.explode("temp").alias("temp"))
    files.mapInArrow(publish, "temp string").write.mode("overwrite").parquet(f"{folder}/_manifest")
    return out.drop("temp").withColumnRenamed("id", id_col)


def read_shard(folder: str, shard: int) -> dict[str, np.ndarray]:
    f, root = open_fs(folder)
    out = {}
    for part in PARTS:
        with f.open_input_stream(f"{root}/shard-{shard:06d}.{part}.npy", compression=None) as s:
            out[part] = np.load(io.BytesIO(s.read()))
    return out


def unpack_documents(pieces: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, shard, piece, row, row_offset, sha256 of the piece's ids as little-endian bytes, segment_ok) read back from the written shards."""
    src = pieces.where(F.col("piece").isNotNull()).select(F.col(id_col).alias("id"), "shard", "piece", "row", "row_offset", "length")
    n = max(1, pieces.select("shard").distinct().count())
    dealt = src.repartition(n, "shard").sortWithinPartitions("shard", "row", "row_offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        now, a = None, {}
        for b in batches:
            sha, ok = [], []
            for shard, row, off, length in zip(*(b.column(i).to_pylist() for i in (1, 3, 4, 5))):
                if shard != now:
                    now, a = shard, read_shard(folder, shard)
                sha.append(hashlib.sha256(a["ids"][row, off:off + length].tobytes()).hexdigest())
                cu = a["cu_seqlens"][a["row_index"][row]: a["row_index"][row + 1]]
                k = int(np.searchsorted(cu, off))
                ok.append(k + 1 < len(cu) and int(cu[k]) == off and int(cu[k + 1]) == off + length)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), b.column(4), pa.array(sha, pa.string()), pa.array(ok, pa.bool_())],
                                             names=["id", "shard", "piece", "row", "row_offset", "sha256", "segment_ok"])

    out = dealt.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, shard int, piece int, row int, row_offset int, sha256 string, segment_ok boolean")
    return out.withColumnRenamed("id", id_col)


def pack(docs: DataFrame, rank_file: str, pattern: str, **options) -> tuple[DataFrame, str]:
    folder = shared_dir(docs.sparkSession)
    return pack_documents(docs, folder, rank_file, pattern, **options), folder
