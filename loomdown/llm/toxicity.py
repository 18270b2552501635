"""Operator 9, toxicity: a counterfactual-regularised linear classifier.

Features are distinct words and word beginnings (inflected and derived forms share them). Spark counts them by label, the
ones most associated with a label form a bounded feature set. The classifier is a logistic model whose objective adds
``fairness`` times the squared change of the score when the identity terms of a labelled text's sentences are swapped
for other terms of their group, so mentioning a group does not move the score by itself. Neutral sentences naming each
term are added as counterfactual anchors. Scoring is one table lookup per distinct word.

Fitting uses at most ``MAX_TRAIN_ROWS`` labelled rows (a hash sample; whole texts).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdown.llm.bpe import Bounded
from loomdown.llm.common import bounded_sample, written

MAX_TRAIN_ROWS = 12000
MAX_FEATURES = 4096
MIN_ROWS = 3
MIN_Z = 3.5
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
#: Terms of a group stand for each other in counterfactual sentences.
IDENTITY_GROUPS = (
    ("women", "men", "transgender", "nonbinary"),
    ("woman", "man"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly"),
)
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]?\s*")
_WORD = r"[^\s\p{P}\p{S}\p{N}]+"


def _words(text: Column) -> Column:
    """Distinct lower-cased runs of letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"), 1))


def features(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


def _features(word: Column) -> Column:
    return F.array_compact(F.array(word, *[F.when(F.length(word) > n, F.concat(F.substring(word, 1, n), F.lit("*"))) for n in PREFIXES]))


def swap_terms(text: str, groups=IDENTITY_GROUPS) -> str:
    """The text with each identity term of its sentences replaced by the next one of its group."""
    nxt = {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}
    out = []
    for sentence in _SENTENCE.findall(text):
        out.append(re.sub(r"[^\W\d_]+", lambda m: nxt.get(m[0].lower(), m[0]), sentence))
    return "".join(out)


@dataclass
class Model:
    bias: float = -2.0
    weights: dict[str, float] = field(default_factory=dict)

    def word(self, w: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(w))


def _sparse(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, feature numbers) of all entries."""
    n = np.array([len(r) for r in rows], dtype=int)
    return np.repeat(np.arange(len(rows)), n), np.array([x for r in rows for x in r], dtype=int)


def train(rows: list[list[int]], swapped: list[list[int] | None], labels: np.ndarray, n_features: int, fairness: float = 5.0,
          ridge: float = 0.001, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias minimising mean log-loss + ridge + fairness x mean squared logit change under the swap (Adam)."""
    r, c = _sparse(rows)
    # the swap's difference vectors: +1 for what the text has, -1 for what its counterfactual has
    pairs = [(i, s) for i, s in enumerate(swapped) if s is not None]
    dr, dc = _sparse([[*rows[i], *s] for i, s in pairs])
    sign = np.concatenate([np.r_[np.ones(len(rows[i])), -np.ones(len(s))] for i, s in pairs]) if pairs else np.zeros(0)
    w, b = np.zeros(n_features), -1.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    # both labels weigh the same in total, however rare one of them is
    weigh = np.where(labels > 0, 0.5 / max(1.0, labels.sum()), 0.5 / max(1.0, len(labels) - labels.sum()))
    for k in range(1, steps + 1):
        z = np.bincount(r, w[c], minlength=len(rows)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weigh
        g = np.bincount(c, e[r], minlength=n_features) + ridge * w / 2
        if pairs:
            d = np.bincount(dr, sign * w[dc], minlength=len(pairs))
            g += 2 * fairness / len(pairs) * np.bincount(dc, sign * d[dr], minlength=n_features)
        full = np.r_[g, e.sum()]
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        step = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_rows: int = MAX_TRAIN_ROWS, fairness: float = 5.0) -> Model:
    """A model from the labelled rows among ``docs``. Rows without text, id or label are left out; an id with both labels
    counts as toxic. Without positive or negative rows every text scores low."""
    lab = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    d = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    sample = written(bounded_sample(lab.join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi"), "id", max_rows).join(d, "id").select("toxic", "t"))
    n1, n0 = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not n1 or not n0:
        return Model()
    p1, p0 = F.col("k1") / n1, F.col("k0") / n0
    p = (F.col("k1") + F.col("k0")) / (n1 + n0)
    z = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    words = sample.select("toxic", F.explode(_words(F.col("t"))).alias("w"))
    counts = words.select("toxic", F.explode(_features(F.col("w"))).alias("f")).groupBy("f").agg(
        F.sum("toxic").alias("k1"), F.sum(1 - F.col("toxic")).alias("k0"))
    best = counts.where(F.col("k1") + F.col("k0") >= MIN_ROWS).select("f", z.alias("z")).where(F.abs("z") >= MIN_Z)
    chosen = [r.f for r in best.orderBy(F.abs("z").desc(), "f").limit(MAX_FEATURES).collect()]
    terms = {t for g in IDENTITY_GROUPS for t in g}
    names = sorted({*chosen, *terms, *(f for t in terms for f in features(t) if f in set(chosen))})
    number = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bounded(lambda w: [number[f] for f in features(w) if f in number], 200_000)
        find = re.compile(r"[^\W\d_]+").findall

        def of(text: str) -> list[int]:
            return [i for w in set(find(text.lower())) for i in known[w]]

        for b in batches:
            ts = b.column(1).to_pylist()
            x = [of(t) for t in ts]
            y = [of(swap_terms(t)) if any(w in terms for w in set(find(t.lower()))) else None for t in ts]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, kind), pa.array(y, kind)], names=["toxic", "x", "y"])

    got = sample.mapInArrow(run, "toxic int, x array<int>, y array<int>").toPandas()
    rows, swapped = [list(x) for x in got["x"]], [None if y is None else list(y) for y in got["y"]]
    truth = got["toxic"].to_numpy(dtype=float)
    for g in IDENTITY_GROUPS:  # neutral anchors: naming a term or its neighbour must score alike
        for i, t in enumerate(g):
            rows.append([number[f] for f in features(t) if f in number])
            swapped.append([number[f] for f in features(g[(i + 1) % len(g)]) if f in number])
            truth = np.r_[truth, 0.0]
    w, b = train(rows, swapped, truth, len(names), fairness)
    return Model(b, {f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-4})


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, score (0 to 1, higher: likelier toxic), predicted (1 from the threshold up).

    Null and empty texts have no words and score by the bias alone. Repeated rows are reported once each; an empty table
    gives no rows; other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p_of = _scorer(sent.value)
        for b in batches:
            p = p_of(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    out = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose whole text scores below the threshold (one pass, no join)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p_of = _scorer(sent.value)
        for b in batches:
            yield b.filter(pa.array(p_of(b.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def _scorer(m: Model):
    """Arrow text column -> scores; a table remembers what raw tokens weigh (most weigh nothing)."""
    clean = re.compile(r"[^\W\d_]+").findall
    known = Bounded(lambda tok: [(w, x) for w in clean(tok) if (x := m.word(w))], 300_000)

    def scores(texts: pa.Array) -> np.ndarray:
        logits = np.empty(len(texts))
        for i, t in enumerate(texts):
            hits = {}
            for tok in set((t.as_py() or "").lower().split()):
                if got := known[tok]:
                    hits.update(got)
            logits[i] = m.bias + sum(hits.values())
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))

    return scores
