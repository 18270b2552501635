"""Operator 11, substring dedup by recompression: words covered by a ``width``-word window that starts earlier, too, are removed.

Recompression turns a text into ever longer symbols. First runs of one word are named, then, round by round, pairs: every symbol
falls on one of two sides by its name, and a left symbol followed by a right one becomes a new symbol. A name is a function of what it
stands for, so all tasks name equal runs and pairs alike without asking each other, and equal substrings get equal symbols
but for their edges. Each symbol carries the range of words its shape depends on; a symbol whose range lies inside a
window is an interior symbol of that window, and of each other window with these words, wherever it stands.

The Spark rounds
1. Every window takes its anchor: the longest interior symbol of the highest round that has any (ties by name, then the leftmost).
   Neighbouring windows with one anchor are a stretch. Spark counts each anchor over all documents (a partial aggregate); a
   window whose anchor stands nowhere else is unique, so stretches of unshared anchors leave here, most of a corpus.
2. Shared anchors reveal candidates; the words decide. Stretches that agree in all words (a SHA-256 cut to 128 bits) are one
   class; all but its first (smallest doc_id, then start) are removed in whole. Copies of a document end here.
3. Of each class only the first goes on, and only if its anchor has other classes: there the ends of repeats lie. Their windows are
   compared one by one, and all but the first of equal windows are removed.
Counts are partial aggregates and joins plain equi-joins that AQE splits, so a passage in a third of all documents fills no task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdown.llm.common import release, written
from loomdown.llm.lang_id import _buffers

WIDTH = 20
ROUNDS = 4
#: a block's bytes, and the words of one slice of a long text
BLOCK = 1 << 19
SLICE = 1 << 17
_FAR = np.int64(1) << 60
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LETTER = np.random.default_rng(20241111).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit name from a 64-bit definition (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of texts lying end to end: for each its text's number, and where it starts and ends in ``line``, the texts with one space
    after each word."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        solid = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)  # a text begins here
        edge[0] = True
        edge[ends] = True
        start = solid.copy()
        start[1:] &= ~solid[:-1] | edge[1:-1]
        first = np.nonzero(start)[0]
        self.text = np.searchsorted(ends, first, side="right")
        after = np.zeros(len(data), dtype=bool)  # the one space kept after a word
        after[1:] = ~solid[1:] & solid[:-1] & ~edge[1:-1]
        keep = solid | after
        at = np.cumsum(keep)
        self.line = data[keep]
        self.line[after[keep]] = 0x20
        self.start = at[first] - 1
        # a word ends before the next one's start, less the space between them where there is one
        tail = np.append(self.start[1:], len(self.line))
        self.stop = tail - (self.line[np.maximum(tail - 1, 0)] == 0x20) if len(first) else tail[:0]

    def __len__(self) -> int:
        return len(self.start)

    def names(self) -> np.ndarray:
        """Level 0: the words' names, polynomials over their bytes."""
        out = np.zeros(len(self), dtype=np.uint64)
        i = 0
        while i < len(self):
            base = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.stop, base + BLOCK, side="right")))
            s, e = self.start[i:j] - base, self.stop[i:j] - base
            if e[-1] > 2 * BLOCK:  # one giant word
                raw = hashlib.blake2b(self.line[base: base + int(e[-1])].tobytes(), digest_size=8).digest()
                out[i] = np.frombuffer(raw, dtype=np.uint64)[0]
            else:
                n = int(e[-1])
                c = np.zeros(n + 1, dtype=np.uint64)
                np.cumsum(_LETTER[self.line[base: base + n]] * _UP[:n], out=c[1:])
                out[i:j] = (c[e] - c[s]) * _DOWN[s] + (e - s).astype(np.uint64) * np.uint64(_BASE)
            i = j
        return mix(out)


_UP, _DOWN = _powers(_BASE, 2 * BLOCK + 1), _powers(_BACK, 2 * BLOCK + 1)


class Symbols:
    """A text's symbols at one round: name, words [first, stop), and the words [lo, hi) on which the symbol's shape depends."""

    def __init__(self, name, first, stop, lo, hi, text):
        self.name, self.first, self.stop, self.lo, self.hi, self.text = name, first, stop, lo, hi, text

    def __len__(self) -> int:
        return len(self.name)


def runs(s: Symbols) -> Symbols:
    """Names the runs of equal symbols: a run ends where its neighbours differ, so its shape depends on them."""
    n = len(s)
    new = np.ones(n, dtype=bool)
    new[1:] = (s.name[1:] != s.name[:-1]) | (s.text[1:] != s.text[:-1])
    at = np.nonzero(new)[0]
    count = np.diff(np.append(at, n))
    end = at + count - 1
    name = np.where(count > 1, mix(s.name[at] * np.uint64(0xD6E8FEB86659FD93) + count.astype(np.uint64)), s.name[at])
    before, behind = np.append(-1, s.lo[:-1]), np.append(s.hi[1:], _FAR)
    return Symbols(name, s.first[at], s.stop[end], before[at], behind[end], s.text[at])


def pairs(s: Symbols, round_: int) -> Symbols:
    """Names the pairs of a left symbol and the right symbol after it. A lone left symbol's shape depends on the next one (it is no
    right one), a lone right symbol's on the one before."""
    left = mix(s.name + np.uint64(0xA0761D6478BD642F * (round_ + 1) % (1 << 64))) >> np.uint64(63) == 1
    pair = np.zeros(len(s), dtype=bool)
    pair[:-1] = left[:-1] & ~left[1:] & (s.text[:-1] == s.text[1:])
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = ~pair[:-1]
    lo = np.where(left, s.lo, np.append(-1, s.lo[:-1]))
    hi = np.where(left, np.append(s.hi[1:], _FAR), s.hi)
    name, stop = s.name.copy(), s.stop.copy()
    at = np.nonzero(pair)[0]
    name[at] = mix(mix(s.name[at] + np.uint64(round_ + 1)) * np.uint64(0xE7037ED1A0B428DB) + s.name[at + 1])
    stop[at] = s.stop[at + 1]
    return Symbols(name[keep], s.first[keep], stop[keep], lo[keep], hi[keep], s.text[keep])


def levels(names: np.ndarray, text: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    """The symbols after each round, the last round first: pairs, ..., pairs, runs, words."""
    at = np.arange(len(names), dtype=np.int64)
    out = [Symbols(names, at, at + 1, at, at + 1, text)]
    out.append(runs(out[-1]))
    for r in range(rounds):
        out.append(pairs(out[-1], r))
    return out[::-1]


def anchors(names: np.ndarray, text: np.ndarray, width: int = WIDTH, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, anchor name, anchor place) of all windows of ``width`` words that lie in one text; place tells symbols apart."""
    n = len(names) - width + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none
    todo = np.nonzero(text[:n] == text[width - 1:])[0]
    starts, anchor, place = todo, np.zeros(len(todo), dtype=np.uint64), np.zeros(len(todo), dtype=np.int64)
    left = np.arange(len(todo))
    for level, s in enumerate(levels(names, text, rounds)):
        if not len(left):
            break
        w = starts[left]
        a, z = np.searchsorted(s.lo, w, side="left"), np.searchsorted(s.hi, w + width, side="right")
        size = np.minimum(s.stop - s.first, 63).astype(np.uint64)
        # the longest first, then by name
        order = (np.uint64(63) - size) << np.uint64(58) | mix(s.name ^ np.uint64(_BASE)) >> np.uint64(6)
        some = a < z
        best, pick = np.full(int(some.sum()), ~np.uint64(0)), a[some]
        a, z, into = a[some], z[some], left[some]
        k = 0
        live = np.arange(len(a))
        while len(live):
            at = a[live] + k
            o = order[at]
            better = o < best[live]
            best[live[better]], pick[live[better]] = o[better], at[better]
            k += 1
            live = live[a[live] + k < z[live]]
        anchor[into] = mix(s.name[pick] + np.uint64(level))
        place[into] = s.first[pick] << 3 | min(level, 7)
        left = left[~some]
    return starts, anchor, place


def _digests(line: memoryview, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Two longs of each slice's SHA-256."""
    sha = hashlib.sha256
    raw = b"".join([sha(line[a:b]).digest()[:16] for a, b in zip(lo.tolist(), hi.tolist())])
    return np.frombuffer(raw, dtype="<i8").reshape(-1, 2)


def _texts(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, ends): whole texts, together at most BLOCK bytes, or one longer text."""
    i, start = 0, 0
    while i < len(ends):
        j = i + 1
        while j < len(ends) and ends[j] - start <= BLOCK:
            j += 1
        yield i, data[start: ends[j - 1]], ends[i:j] - start
        i, start = j, int(ends[j - 1])


def stretches(words: Words, width: int = WIDTH, rounds: int = ROUNDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, first window's word in the block, windows, anchor, digest) of neighbouring windows with one anchor; long texts in
    overlapping slices."""
    names, line = words.names(), memoryview(words.line)
    for lo in range(0, max(len(words) - width + 1, 0), SLICE):
        hi = min(lo + SLICE + width - 1, len(words))
        w, h, place = anchors(names[lo:hi], words.text[lo:hi], width, rounds)
        if not len(w):
            continue
        new = np.ones(len(w), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (w[1:] != w[:-1] + 1)
        at = np.nonzero(new)[0]
        count = np.diff(np.append(at, len(w)))
        first = w[at] + lo
        yield words.text[first], first, count, h[at], _digests(line, words.start[first], words.stop[first + count + width - 2])


def _stretch_rows(docs: DataFrame, width: int, rounds: int) -> DataFrame:
    """(h, t1, t2, id, tk, pos): anchor, digest of the stretch's words, document, its first word << 8 | its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data, ends in _texts(*_buffers(b.column(2))):
                words = Words(data, ends)
                origin = np.searchsorted(words.text, np.arange(len(ends)))
                for text, first, count, h, t in stretches(words, width, rounds):
                    at = pa.array(i + text)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(t[:, 0]), pa.array(t[:, 1]), b.column(0).take(at), b.column(1).take(at), pa.array((first - origin[text]) << 8 | count)],
                        names=["h", "t1", "t2", "id", "tk", "pos"])

    return docs.mapInArrow(run, f"h long, t1 long, t2 long, id {docs.schema['id'].dataType.simpleString()}, tk long, pos long")


def _window_rows(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(w1, w2, id, tk, lo): the windows of the given stretches, named by the digest of their words."""
    of_doc = reps.groupBy("id", "tk").agg(F.collect_list("pos").alias("at"))
    of_doc = of_doc.select(F.col("id").alias("rid"), F.col("tk").alias("rtk"), "at")
    j = docs.join(of_doc, docs["id"].eqNullSafe(F.col("rid")) & (docs["tk"] == F.col("rtk"))).select("id", "tk", "text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, ends = _buffers(b.column(2))
            begin = 0
            for i, end in enumerate(ends.tolist()):
                words = Words(data[begin:end], np.array([end - begin]))
                begin = end
                pos = b.column(3)[i].values.to_numpy()
                at = np.concatenate([np.arange(p >> 8, (p >> 8) + (p & 255)) for p in pos.tolist()])
                d = _digests(memoryview(words.line), words.start[at], words.stop[at + width - 1])
                one = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), b.column(0).take(one), b.column(1).take(one), pa.array(at)],
                                                 names=["w1", "w2", "id", "tk", "lo"])

    return j.mapInArrow(run, f"w1 long, w2 long, id {docs.schema['id'].dataType.simpleString()}, tk long, lo long")


def _classes(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Each class of equal rows: their number n and the id, tk and place of the first as ``f``."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("id", "tk", place)).alias("f"))


def _later(rows: DataFrame, classes: DataFrame, keys: list[str], place: str) -> DataFrame:
    """The rows that are not the first of their class."""
    many = classes.where("n > 1").select(*keys, "f")
    return rows.join(many, keys).where(~F.struct("id", "tk", place).eqNullSafe(F.col("f"))).drop("f")


def repeated_spans(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """(id, tk, lo, hi): ranges of words to remove, overlapping, of docs (id, tk, text) with distinct (id, tk)."""
    rows = written(_stretch_rows(docs, width, rounds))
    shared = written(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    met = written(rows.join(shared, "h"))
    release(rows, shared)
    keys = ["h", "t1", "t2"]
    classes = written(_classes(met, keys, "pos"))
    start = F.shiftright("pos", 8)
    whole = written(_later(met, classes, keys, "pos").select(
        "id", "tk", start.alias("lo"), (start + F.col("pos").bitwiseAND(F.lit(255)) + (width - 1)).alias("hi")))
    release(met)
    mixed = classes.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h")
    seen = written(_window_rows(docs, classes.join(mixed, "h").select("f.id", "f.tk", "f.pos"), width))
    release(classes)
    windows = written(_classes(seen, ["w1", "w2"], "lo"))
    again = written(_later(seen, windows, ["w1", "w2"], "lo").select("id", "tk", "lo", (F.col("lo") + width).alias("hi")))
    release(seen, windows)
    return whole.unionByName(again)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept (the words left, joined by one space).

    Words are runs of anything but ASCII white space, compared byte by byte. Null and empty texts have no words. Documents are ordered by id
    (null first); rows that repeat an id by a hash of their text. Of rows equal in id and text one is the first, and each other one
    is removed in whole (if it has ``width`` words). A long text is one row of the table, parsed in slices. An empty table
    gives no rows; other input columns are ignored, whatever their names. ``width`` must be 2 to 255.
    """
    if not 2 <= width <= 255:
        raise ValueError("width must be 2 to 255")
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    # a text key only where an id repeats; elsewhere the id says it all
    repeated = written(src.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("id").alias("rid"), F.lit(True).alias("rep")))
    keyed = src.join(repeated, src["id"].eqNullSafe(F.col("rid")), "left").select("id", F.when(F.col("rep"), F.xxhash64("text")).otherwise(0).alias("tk"), "text", "rep")
    several = keyed.where("rep").groupBy("id", "tk").agg(F.first("text").alias("text"), F.count("*").alias("m"))
    once = keyed.where("rep is null").select("id", "tk", "text", F.lit(1).cast("long").alias("m")).unionByName(several)
    spans = repeated_spans(once.select("id", "tk", "text"), width, rounds).distinct()
    of_doc = spans.groupBy("id", "tk").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    of_doc = of_doc.select(F.col("id").alias("sid"), F.col("tk").alias("stk"), "spans")
    all_ = once.join(of_doc, once["id"].eqNullSafe(F.col("sid")) & (once["tk"] == F.col("stk")), "left").select("id", "text", "spans", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, ends = _buffers(b.column(1))
            begin, n, gone, kept = 0, [], [], []
            for end, s in zip(ends.tolist(), b.column(2)):
                words = Words(data[begin:end], np.array([end - begin]))
                begin = end
                out = np.zeros(len(words) + 1, dtype=np.int64)
                if s.is_valid:
                    np.add.at(out, s.values.field(0).to_numpy(), 1)
                    np.add.at(out, s.values.field(1).to_numpy(), -1)
                stay = np.cumsum(out[:-1]) == 0
                n.append(len(words))
                gone.append(len(words) - int(stay.sum()))
                if gone[-1]:
                    line = memoryview(words.line)
                    kept.append(b" ".join([line[x:y] for x, y in zip(words.start[stay].tolist(), words.stop[stay].tolist())]))
                else:
                    kept.append(words.line[: words.stop[-1]].tobytes() if len(words) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string()), b.column(3)],
                                             names=["id", "n_words", "n_removed", "kept", "m"])

    out = all_.mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept string, m long")
    again = (F.col("i") > 1) & (F.col("n_words") >= width)
    out = out.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return out.select(F.col("id").alias(id_col), "n_words", F.when(again, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
                      F.when(again, "").otherwise(F.col("kept")).alias("kept"))
