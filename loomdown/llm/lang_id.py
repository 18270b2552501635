"""Operator 1, language identification by error-correcting output codes.

Each learned language gets a binary codeword. For every bit a binary classifier over hashed byte n-grams (log-odds of
the languages whose bit is 1 against the others, scaled by logistic calibration) predicts the bit. Decoding sums the
logistic loss of the margins against each codeword, every bit weighted by its accuracy in training, takes the codeword
of least loss and flags texts whose runner-up is nearly as good.

Languages are those of all labelled rows. Fitting uses about ``MAX_TRAIN_ROWS`` of the rows (a hash sample; whole texts), but of each
language at least about ``MIN_LANGUAGE_ROWS``, or all its rows if they are fewer: one half gives the n-gram counts, which
Spark sums by language, the other half the calibration. The model has a fixed size and goes to the tasks as a broadcast.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdown.llm.common import written

MAX_TRAIN_ROWS = 8000
MIN_LANGUAGE_ROWS = 40
MAX_LANGUAGES = 512
DIMS = 1 << 16  # per n-gram order: two bytes directly, three bytes hashed
AMBIGUOUS = 0.1
UNDETERMINED = "und"
_BLOCK = 1 << 21


def _classes() -> np.ndarray:
    """Bytes as the n-grams see them: A-Z lower-cased, other ASCII that is no letter becomes a space."""
    t = np.full(256, 32, dtype=np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128 or "a" <= c <= "z":
            t[b] = b
        elif "A" <= c <= "Z":
            t[b] = b + 32
    return t


_CLASS = _classes()


def ngram_indices(data: np.ndarray, ends: np.ndarray | tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """For each position the index of its 2-gram, and that of its 3-gram (the last positions see spaces, as do those before ``ends``)."""
    c = _CLASS[np.concatenate([data, np.array([32, 32], dtype=np.uint8)])].astype(np.uint32)
    second, third = c[1:-1].copy(), c[2:].copy()
    stop = np.asarray(ends, dtype=np.int64)
    stop = stop[(stop > 0) & (stop <= len(data))]
    second[stop - 1] = third[stop - 1] = third[stop[stop > 1] - 2] = 32
    two = c[:-2] << np.uint32(8) | second
    three = ((two << np.uint32(8) | third) * np.uint32(2654435761)) >> np.uint32(16)
    return two, three + np.uint32(DIMS)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +-1, one row each: all splits for few classes, else the random code of largest distance found."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 6:
        cols = [(1, *c) for c in itertools.product((1, -1), repeat=n - 1)]
        return np.array([c for c in cols if min(c) < 0], dtype=np.int8).T
    bits = int(np.ceil(10 * np.log2(n)))
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(40):
        m = rng.choice(np.array([1, -1], dtype=np.int8), size=(n, bits))
        if (abs(m.sum(axis=0)) == n).any():
            continue
        dist = (bits - m.astype(np.int32) @ m.T.astype(np.int32)) // 2
        d = int(dist[~np.eye(n, dtype=bool)].min())
        if d > far:
            best, far = m, d
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # n-gram x bits: log-odds
    scale: np.ndarray
    bias: np.ndarray
    accuracy: np.ndarray  # weight of a bit in decoding


def text_margins(data: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean log-odds per n-gram and bit of the texts lying end to end in ``data``; blocks bound the memory.

    A text's n-grams never see the next text, and those at a block's end see the text's bytes in the next block.
    """
    out = np.zeros((len(ends), weights.shape[1]), dtype=np.float64)
    starts = np.concatenate([[0], ends[:-1]])
    i = 0
    while i < len(ends):
        j = i
        while j + 1 < len(ends) and ends[j + 1] - starts[i] <= _BLOCK:
            j += 1
        for lo in range(int(starts[i]), max(int(ends[j]), int(starts[i]) + 1), _BLOCK):
            n = min(_BLOCK, int(ends[j]) - lo)
            if n <= 0:
                continue
            two, three = ngram_indices(data[lo: min(lo + n + 2, int(ends[j]))], ends[i:j + 1] - lo)
            s = weights[two[:n]] + weights[three[:n]]
            at = np.clip(starts[i:j + 1] - lo, 0, n)
            stop = np.clip(ends[i:j + 1] - lo, 0, n)
            full = np.nonzero(stop > at)[0]
            if len(full):
                cuts = at[full].astype(np.int64)
                out[i + full] += np.add.reduceat(s, cuts, axis=0)
        i = j + 1
    return out / np.maximum(ends - starts, 1)[:, None]


def _buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow text column and the end offset of each row (nulls are empty)."""
    col = col.cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset: col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0]: offs[-1]], offs[1:] - offs[0]


def _count_ngrams(sample: DataFrame) -> DataFrame:
    """(lang, gram, n) over the counting half, summed by Spark; at most languages x 2 x DIMS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            data, ends = _buffers(b.column(1))
            start = 0
            for lang, end in zip(b.column(0).to_pylist(), ends):
                two, three = ngram_indices(data[start:end])
                s = sums.setdefault(lang, np.zeros(2 * DIMS, dtype=np.int64))
                s += np.bincount(two, minlength=2 * DIMS) + np.bincount(three, minlength=2 * DIMS)
                start = end
        for lang, s in sums.items():
            g = np.nonzero(s)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int32)), pa.array(s[g])], names=["lang", "gram", "n"])

    return sample.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _margins(sample: DataFrame, weights) -> DataFrame:
    bits = weights.value.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = text_margins(*_buffers(b.column(1)), weights.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), bits).cast(pa.list_(pa.float64()))], names=["lang", "m"])

    return sample.mapInArrow(run, "lang string, m array<double>")


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and bias of a logistic model of y (+-1) on the margin x, by Newton steps with a small ridge."""
    sd = float(x.std()) or 1.0
    z, a, b = x / sd, 1.0, 0.0
    t = (y > 0).astype(float)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - t) * z).sum() + 0.1 * a, (p - t).sum() + 0.1 * b])
        w = p * (1 - p)
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
    return max(a, 0.0) / sd, b


def _sample(rows: DataFrame, sizes: dict[str, int], max_rows: int) -> DataFrame:
    """About ``max_rows`` rows by a hash of the id, and about MIN_LANGUAGE_ROWS of each language with fewer among them; all when there are fewer."""
    base = max_rows / sum(sizes.values())
    if base >= 1:
        return rows
    rare = [(lang, MIN_LANGUAGE_ROWS / n) for lang, n in sizes.items() if n * base < MIN_LANGUAGE_ROWS]

    def part(*cols) -> Column:  # a fraction of 40 bits
        h = F.xxhash64(F.lit("sample"), *cols)
        return F.pmod(h, F.lit(1 << 20)) / (1 << 20) + F.pmod(F.shiftright(h, 20), F.lit(1 << 20)) / (1 << 40)

    if not rare:
        return rows.where(part("id") < base)
    shares = F.broadcast(rows.sparkSession.createDataFrame(rare, "rare string, share double"))
    j = rows.join(shares, rows.lang == shares.rare, "left")
    # few distinct ids must not take or leave a rare language as a whole
    return j.where(F.when(F.col("share").isNull(), part("id") < base).otherwise(part("id", "t") < F.col("share"))).select("lang", "t", "id")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_TRAIN_ROWS) -> Model | None:
    """A model of the languages of ``docs``; rows without text or language are left out. None if there are none."""
    spark = docs.sparkSession
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t"), F.col(id_col).alias("id"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    languages = sorted(sizes)
    if not languages:
        return None
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sample = written(_sample(rows, sizes, max_rows).select("lang", "t", (F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2)) == 0).alias("counted")))
    code = codewords(len(languages))
    grams = _count_ngrams(sample.where("counted").select("lang", "t")).toPandas()
    counts = np.zeros((len(languages), 2 * DIMS))
    np.add.at(counts, (np.searchsorted(languages, grams["lang"].to_numpy(dtype=str)) if len(grams) else np.zeros(0, int), grams["gram"].to_numpy(dtype=int)), grams["n"].to_numpy(dtype=float))
    share = np.empty_like(counts)  # each language weighs the same, whatever its share of the rows
    for half in (slice(0, DIMS), slice(DIMS, 2 * DIMS)):
        part = counts[:, half]
        share[:, half] = (part + 0.5) / (part.sum(axis=1, keepdims=True) + 0.5 * DIMS)
    weights = np.empty((2 * DIMS, code.shape[1]), dtype=np.float32)
    for b in range(code.shape[1]):
        one, zero = share[code[:, b] > 0], share[code[:, b] < 0]
        weights[:, b] = np.log(one.mean(axis=0)) - np.log(zero.mean(axis=0)) if len(zero) else 1.0
    sent = spark.sparkContext.broadcast(weights)
    held = _margins(sample.where(~F.col("counted")).select("lang", "t"), sent).toPandas()
    scale, bias, acc = np.ones(code.shape[1]), np.zeros(code.shape[1]), np.ones(code.shape[1])
    if len(held):
        m = np.stack(held["m"].to_numpy())
        y = code[np.searchsorted(languages, held["lang"].to_numpy(dtype=str))]
        for b in range(code.shape[1]):
            scale[b], bias[b] = _calibrate(m[:, b], y[:, b])
            acc[b] = max(0.01, (((scale[b] * m[:, b] + bias[b]) > 0) == (y[:, b] > 0)).mean())
    return Model(languages, code, weights, scale, bias, acc / acc.sum())


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the codeword of least weighted logistic loss, its share of the softmax, and the gap to the runner-up."""
    z = np.clip(margins * model.scale + model.bias, -30, 30)
    loss = np.stack([(np.logaddexp(0, -z * c) * model.accuracy).sum(axis=1) for c in model.code], axis=1) * model.code.shape[1]
    order = np.sort(loss, axis=1)
    p = np.exp(-(loss - order[:, :1]))
    score = 1 / p.sum(axis=1)
    gap = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
    return loss.argmin(axis=1), score, gap


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", ambiguous: float = AMBIGUOUS) -> DataFrame:
    """One row per input row: id, lang_pred, score (0 to 1), ambiguous.

    Null text and text without a letter are ``und`` with score 0, as is everything when no language was learned.
    Repeated rows are reported once each; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    t = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("id"), F.when(t.rlike(r"\p{L}"), t).alias("t"))
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*(m.languages if m else []), UNDETERMINED], dtype=object)
        for b in batches:
            known = ~np.asarray(b.column(1).is_null()) & (m is not None)
            pick, score, gap = np.full(b.num_rows, len(names) - 1), np.zeros(b.num_rows), np.zeros(b.num_rows)
            if known.any():
                got = decode(m, text_margins(*_buffers(b.column(1)), m.weights))
                pick, score, gap = (np.where(known, x, y) for x, y in zip(got, (pick, score, gap)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[pick].tolist(), pa.string()), pa.array(score), pa.array(known & (gap < ambiguous))],
                                             names=["id", "lang_pred", "score", "ambiguous"])

    out = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("id", id_col)
