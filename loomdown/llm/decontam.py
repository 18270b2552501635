"""Operator 8, benchmark decontamination: BM25 inverted index of test items searched with block-max WAND.

The index holds the items' word pairs (two consecutive words) as terms. Impacts are BM25 term scores divided by the item's score against itself,
so one threshold means the same share of every item. Postings lie in blocks with their largest impact. Every passage of
every training text is a query: windows twice as long as the longest item, each overlapping the next by half, so an
item copied anywhere lies whole in some window. A sum of upper bounds (vectorised) discards most windows, WAND with
block maxima retrieves all items above the threshold for the rest, and a hit counts only if five-word shingles of the
item's question and of its answer both overlap the window by ``MIN_OVERLAP``.

The index is built per block of items of bounded size and broadcast; each block is one pass over the texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdown.llm.bpe import Bounded

ITEMS_PER_INDEX = 20_000
BYTES_PER_INDEX = 32 << 20
THRESHOLD = 0.5
MIN_OVERLAP = 0.8
SHINGLE = 5
K1, B = 1.2, 0.75
BLOCK = 32
_KEEP = re.compile(r"[\W_]+")
_ANSWER = re.compile(r"(?<=[.?!])\s+|\n+")


def norm(token: str) -> str:
    return _KEEP.sub("", token)


def words(text: str) -> list[str]:
    """Lower-cased white-space runs without punctuation; runs of punctuation only are no words."""
    return [w for t in text.lower().split() if (w := norm(t))]


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of the question and of the answer: the answer is the last sentence that has words; an item of one
    sentence is split in the middle."""
    parts = [w for s in _ANSWER.split(text) if (w := words(s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    w = parts[0] if parts else []
    return w[:(len(w) + 1) // 2], w[(len(w) + 1) // 2:]


class Index:
    """Inverted index of one block of items: (item_id, text) rows and the corpus statistics of the whole benchmark."""

    def __init__(self, items: list[tuple[object, str]], df: dict[str, int], n_items: int, mean_len: float):
        self.ids, self.qa = [], []
        self.vocab: dict[str, int] = {}
        lists: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.longest = 1
        for item_id, text in items:
            q, a = question_answer(text)
            w = q + a
            if not w:
                continue
            t = [self.vocab.setdefault(x, len(self.vocab)) for x in w]
            k = len(self.ids)
            self.ids.append(item_id)
            self.qa.append((t[:len(q)], t[len(q):]))
            self.longest = max(self.longest, len(t))
            pairs = Counter(zip(t, t[1:]))
            name = dict(zip(t, w))
            raw = {}
            for (x, y), tf in pairs.items():
                n = df.get(f"{name[x]} {name[y]}", 1)
                idf = math.log(1 + (n_items - n + 0.5) / (n + 0.5))
                raw[x, y] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean_len))
            total = sum(raw.values()) or 1.0
            for p, s in raw.items():
                lists.setdefault(p, []).append((k, s / total))
        width = max(1, len(self.vocab))
        keys = sorted((x * width + y, (x, y)) for x, y in lists)
        self.width = width
        self.codes = np.array([c for c, _ in keys], dtype=np.int64)
        self.items = [np.array([k for k, _ in lists[p]]) for _, p in keys]
        self.impacts = [np.array([s for _, s in lists[p]]) for _, p in keys]
        self.block_max = [np.maximum.reduceat(s, np.arange(0, len(s), BLOCK)) for s in self.impacts]
        self.upper = np.array([s.max() for s in self.impacts] or [0.0])

    def terms(self, ids: np.ndarray) -> np.ndarray:
        """Term number of each word pair starting at a position (-1: not in the index)."""
        out = np.full(len(ids), -1, dtype=np.int64)
        if len(ids) > 1 and len(self.codes):
            at = np.nonzero((ids[:-1] >= 0) & (ids[1:] >= 0))[0]
            code = ids[at] * self.width + ids[at + 1]
            j = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            out[at] = np.where(self.codes[j] == code, j, -1)
        return out

    def search(self, query: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (item, score) with score >= threshold of a set of terms, by block-max WAND."""
        lists = [[0, t] for t in query]
        found = []
        while True:
            live = sorted((int(self.items[t][p]), i) for i, (p, t) in enumerate(lists) if p < len(self.items[t]))
            acc, pivot = 0.0, None
            for rank, (item, i) in enumerate(live):
                acc += self.upper[lists[i][1]]
                if acc >= threshold - 1e-9:
                    pivot = rank
                    break
            if pivot is None:
                return found
            item = live[pivot][0]
            upto = [i for it, i in live if it <= item]
            cap = 0.0  # block maxima at the pivot item
            for i in upto:
                p, t = lists[i]
                p = lists[i][0] = p + int(np.searchsorted(self.items[t][p:], item))
                if p < len(self.items[t]):
                    cap += self.block_max[t][p // BLOCK]
            if cap >= threshold - 1e-9:
                total = 0.0
                for i in upto:
                    p, t = lists[i]
                    if p < len(self.items[t]) and self.items[t][p] == item:
                        total += float(self.impacts[t][p])
                if total >= threshold - 1e-9:
                    found.append((item, total))
                go = item + 1
            else:  # no item below the next block border, or the next list's item, can reach the threshold
                ends = [int(self.items[t][min((p // BLOCK + 1) * BLOCK, len(self.items[t])) - 1]) + 1 for p, t in (lists[i] for i in upto) if p < len(self.items[t])]
                rest = [it for it, _ in live if it > item]
                go = max(item + 1, min([*ends, *rest[:1]], default=item + 1))
            for i in upto:
                p, t = lists[i]
                lists[i][0] = p + int(np.searchsorted(self.items[t][p:], go))


def overlap(part: list[int], window: list[int]) -> float:
    """Share of the part's word shingles that the window holds (a shorter part is one shingle; an empty one is held)."""
    n = min(SHINGLE, len(part))
    if not n:
        return 1.0
    want = {tuple(part[i:i + n]) for i in range(len(part) - n + 1)}
    have = {tuple(window[i:i + n]) for i in range(len(window) - n + 1)}
    return len(want & have) / len(want)


def scan(ids: np.ndarray, index: Index, threshold: float, min_overlap: float) -> dict[int, tuple[float, float, float]]:
    """item -> (score, question overlap, answer overlap) of the best verified window of one text's word numbers."""
    best: dict[int, tuple[float, float, float]] = {}
    terms = index.terms(ids)
    hits = np.nonzero(terms >= 0)[0]
    if not len(hits):
        return best
    step = index.longest
    sums = np.concatenate([[0.0], np.cumsum(index.upper[terms[hits]])])
    starts = np.arange(0, len(ids), step)
    lo, hi = np.searchsorted(hits, starts), np.searchsorted(hits, starts + 2 * step - 1)
    for k in np.nonzero(sums[hi] - sums[lo] >= threshold - 1e-9)[0]:
        query = np.unique(terms[hits[lo[k]:hi[k]]]).tolist()
        window = None
        for item, s in index.search(query, threshold):
            if window is None:
                window = ids[starts[k]: starts[k] + 2 * step].tolist()
            q, a = (overlap(p, window) for p in index.qa[item])
            if q >= min_overlap and a >= min_overlap and (s, q, a) > best.get(item, (0.0, 0.0, 0.0)):
                best[item] = (s, q, a)
    return best


def _pairs(text: str) -> list[str]:
    w = words(text)
    return sorted({f"{x} {y}" for x, y in zip(w, w[1:])})


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", threshold: float = THRESHOLD, min_overlap: float = MIN_OVERLAP,
                  items_per_index: int = ITEMS_PER_INDEX) -> DataFrame:
    """(id, item_id, score, question_overlap, answer_overlap): a row per training row and test item it contains.

    Null and empty texts hold nothing; items without at least two words are not searched for. Repeated rows are reported once
    each; an item repeated under several ids is reported under each. Other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    base = items.select(F.col(item_col).alias("item"))
    id_type, item_type = src.schema["id"].dataType.simpleString(), base.schema["item"].dataType.simpleString()
    arrow = base.limit(0).toArrow().schema.field("item").type
    schema = f"id {id_type}, item {item_type}, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for sent in _indexes(items, item_col, item_text_col, items_per_index):
        out = out.unionByName(_pass(src, sent, threshold, min_overlap, schema, arrow))
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def _indexes(items: DataFrame, item_col: str, text_col: str, items_per_index: int) -> Iterator:
    """Broadcast indexes of blocks of items, each bounded by ``items_per_index`` (about) and BYTES_PER_INDEX."""
    base = items.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("t"))
    n, size, mean_len = base.agg(F.count("*"), F.sum(F.octet_length("t")), F.avg(F.size(F.split("t", r"\s+")))).first()
    blocks = max(math.ceil(n / items_per_index), math.ceil((size or 0) / BYTES_PER_INDEX))
    pairs_of = F.udf(_pairs, "array<string>")
    base = base.withColumn("block", F.pmod(F.xxhash64("item", "t"), F.lit(max(1, blocks))))
    pairs = base.select("block", F.explode(pairs_of("t")).alias("pair"))
    counts = pairs.groupBy("pair").agg(F.count("*").alias("df"))
    for k in range(blocks):
        rows = [(r.item, r.t) for r in base.where(F.col("block") == k).orderBy("item", "t").collect()]
        own = pairs.where(F.col("block") == k).select("pair").distinct()
        # Spark sizes the exploded pairs by the items' files and would broadcast them; both sides lie by pair already
        df = {r.pair: r.df for r in counts.join(own.hint("merge"), "pair", "left_semi").collect()}
        yield items.sparkSession.sparkContext.broadcast(Index(rows, df, n, mean_len))


def _scanner(index: Index, threshold: float, min_overlap: float):
    """Text -> verified items with score and overlaps; remembers the word numbers of raw tokens."""
    number = Bounded(lambda tok: index.vocab.get(w, -1) if (w := norm(tok)) else -2, 500_000)

    def found(text: str | None) -> list[tuple]:
        toks = (text or "").lower().split()
        ids = np.fromiter(map(number.__getitem__, toks), dtype=np.int64, count=len(toks))
        ids = ids[ids > -2]  # punctuation between words is skipped
        return [(index.ids[item], *v) for item, v in sorted(scan(ids, index, threshold, min_overlap).items())]

    return found


def _pass(src: DataFrame, sent, threshold: float, min_overlap: float, schema: str, arrow: pa.DataType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _scanner(sent.value, threshold, min_overlap)
        for b in batches:
            out = [(i, *x) for i, t in enumerate(b.column(1)) for x in found(t.as_py())]
            at = pa.array([r[0] for r in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), pa.array([r[1] for r in out], arrow), *[pa.array([r[j] for r in out], pa.float64()) for j in (2, 3, 4)]],
                names=["id", "item", "score", "question_overlap", "answer_overlap"])

    return src.mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                      threshold: float = THRESHOLD, min_overlap: float = MIN_OVERLAP, items_per_index: int = ITEMS_PER_INDEX) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no test item (one pass per index, no join)."""
    at = docs.columns.index(text_col)
    for sent in _indexes(items, item_col, item_text_col, items_per_index):
        docs = _without(docs, sent, at, threshold, min_overlap)
    return docs


def _without(docs: DataFrame, sent, at: int, threshold: float, min_overlap: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _scanner(sent.value, threshold, min_overlap)
        for b in batches:
            yield b.filter(pa.array([not found(t.as_py()) for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
