"""Operator 7, byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The merge loop keeps one bucket of positions per merge rank and a bitmap of non-empty ranks in two levels: find-first-set
on the top level names the block, find-first-set in the block names the rank. Positions point into a linked list of
parts; an entry whose part was merged meanwhile is stale and skipped when it comes up. Every step costs O(log) whatever
the length, so a pre-token of a million bytes is no special case.

Spark reads whole texts, Arrow batches carry them to the tasks. A task remembers the ids of the space-delimited chunks it
has met in a table of bounded size: a space followed by a non-space always starts a pre-token, so chunks cut there are
tokenised independently.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LEAF = 8  # 256 ranks a block
_INNER_SPACE = re.compile(r" \s| $")
_CUT = re.compile(r"(?= \S)")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def bpe(piece: bytes, ranks: dict[bytes, int], lengths: list[int]) -> list[int]:
    """Token ids of one pre-token; ``lengths`` holds each rank's number of bytes."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    get = ranks.get
    nxt = list(range(1, n + 1))  # a part starts at i and ends at nxt[i]; 0 marks a part that was merged away
    prv = list(range(-1, n - 1))
    buckets: dict[int, list[int]] = {}
    leaves: dict[int, int] = {}
    top = 0
    for i in range(n - 1):
        r = get(piece[i:i + 2])
        if r is not None:
            if r in buckets:
                buckets[r].append(i)
            else:
                buckets[r] = [i]
                k = r >> _LEAF
                leaves[k] = leaves.get(k, 0) | 1 << (r & 255)
                top |= 1 << k
    while top:
        k = (top & -top).bit_length() - 1
        leaf = leaves[k]
        low = leaf & -leaf
        rank = k << _LEAF | low.bit_length() - 1
        b = buckets[rank]
        i = heappop(b)  # leftmost of the lowest rank
        if not b:
            del buckets[rank]
            leaves[k] = leaf = leaf ^ low
            if not leaf:
                top ^= 1 << k
        mid = nxt[i]
        if not mid or mid >= n:
            continue  # stale: merged away, or the last part
        end = nxt[mid]
        if end - i != lengths[rank]:
            continue  # stale: one of the two parts has grown
        nxt[i], nxt[mid] = end, 0
        if end < n:
            prv[end] = i
        for j, stop in ((i, nxt[end] if end < n else 0), (prv[i], end)):
            if j >= 0 and stop:
                r = get(piece[j:stop])
                if r is not None:
                    if r in buckets:
                        heappush(buckets[r], j)
                    else:
                        buckets[r] = [j]
                        k = r >> _LEAF
                        leaves[k] = leaves.get(k, 0) | 1 << (r & 255)
                        top |= 1 << k
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:nxt[i]]])
        i = nxt[i]
    return out


class Bounded(dict):
    """A table of computed values in two generations of at most ``limit`` each: when the young one is full it becomes the old
    one, whose values return when they are asked for. Frequent keys stay, rare ones leave, memory is bounded."""

    def __init__(self, make: Callable, limit: int):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        v = self.old.get(key)
        if v is None:
            v = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = v
        return v


def chunks(text: str) -> list[str]:
    """The text cut before every space that a non-space follows; joined they are the text again."""
    if _INNER_SPACE.search(text):
        return _CUT.split(text)
    parts = text.split(" ")
    return [parts[0], *[" " + p for p in parts[1:]]]


class InnerSpace(Exception):
    """A space that no non-space follows: the text is not cut at every space."""


LONGEST = 256  # characters of a chunk that is remembered


class ChunkTable:
    """The values of a text's chunks. Nearly all chunks are a space and what lies up to the next one; they are remembered without
    that space, as ``str.split`` gives them, so a text costs one split and a look-up a chunk. Texts with other spaces or with long
    chunks are cut by ``chunks``."""

    def __init__(self, make: Callable, limit: int):
        self.make, self.whole, self.tail = make, Bounded(make, limit), Bounded(self._tail, limit)

    def _tail(self, part: str):
        if not part or part[0].isspace():
            raise InnerSpace
        return self.make(" " + part)

    def short(self, text: str) -> list | None:
        """The chunks' values if the text is cut at every space into chunks of at most LONGEST characters, else None."""
        head, *rest = text.split(" ")
        if len(text) > LONGEST and (len(head) > LONGEST or max(map(len, rest), default=0) >= LONGEST):
            return None
        try:
            out = list(map(self.tail.__getitem__, rest))
        except InnerSpace:
            return None
        return [self.whole[head], *out] if head else out

    def values(self, text: str) -> list:
        out = self.short(text)
        return [self.whole[c] if len(c) <= LONGEST else self.make(c) for c in chunks(text) if c] if out is None else out


class Encoder:
    """Encodes and decodes texts by a rank file and a pre-token pattern."""

    def __init__(self, rank_file: str, pattern: str, limit: int = 400_000):
        import regex

        self.ranks = load_ranks(rank_file)
        self.vocab = {v: k for k, v in self.ranks.items()}
        self.lengths = [len(self.vocab.get(i, b"")) for i in range(max(self.vocab) + 1)]
        self.find = regex.compile(pattern).findall
        self.by_text = {str(k): v for k, v in self.vocab.items()}
        self.pieces = Bounded(lambda p: " ".join(map(str, bpe(p.encode("utf-8"), self.ranks, self.lengths))), limit)
        self.seen = Bounded(self._chunk, limit)

    def _chunk(self, chunk: str) -> str:
        pieces = self.pieces
        if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()) and len(chunk) <= 64:
            return pieces[chunk]  # letters only: one pre-token
        # long pre-tokens are not remembered, so the table's memory is bounded
        return " ".join([pieces[p] if len(p) <= 64 else pieces.make(p) for p in self.find(chunk)])

    def ids_text(self, text: str) -> str:
        """The decimal ids of a text joined by one space."""
        seen = self.seen
        return " ".join([seen[c] if len(c) <= 256 else self._chunk(c) for c in chunks(text) if c]) if text else ""

    def encode(self, text: str) -> list[int]:
        s = self.ids_text(text)
        return list(map(int, s.split(" "))) if s else []

    def decode_text(self, ids: str) -> bytes:
        return b"".join(map(self.by_text.__getitem__, ids.split(" "))) if ids else b""

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(rank_file: str, pattern: str) -> Encoder:
    """One encoder a Python worker: its table of known chunks serves all tasks that the worker runs."""
    return Encoder(rank_file, pattern)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row; null text is empty and has no ids."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.encode(t.as_py() or "") for t in b.column(1)], pa.list_(pa.int32()))], names=["id", "ids"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary): the bytes that the ids stand for; null ids are an empty list."""
    src = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(x.as_py() or []) for x in b.column(1)], pa.binary())], names=["id", "bytes"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, bytes binary").withColumnRenamed("id", id_col)


def roundtrip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256; ids and bytes stay inside the task.

    Null text counts as the empty text: no tokens, digests of nothing. Repeated rows are reported once each; ids may
    be null; an empty table gives no rows; other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file, pattern)
        sha = hashlib.sha256
        for b in batches:
            n, ids_sha, dec_sha = [], [], []
            for t in b.column(1):
                ids = enc.ids_text(t.as_py() or "")
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(sha(ids.encode()).hexdigest())
                dec_sha.append(sha(enc.decode_text(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(dec_sha, pa.string())],
                                             names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
