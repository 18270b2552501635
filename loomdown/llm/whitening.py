"""Operator 12, embedding whitening by weighted multiplicity covariance.

Equal vectors are one row of the fit: every vector becomes a tuple of longs (``floor(scale * entry)``), packed into one
binary key of the least integer width that holds it, so equal keys are equal vectors, compared byte by byte. Grouping by the key
combines copies in each task before the shuffle. Each distinct vector has its number of copies (or one) as its weight.

* Sums: exact integers, one row of partial sums a task and dimension.
* Covariance: one centred product ``(W^1/2 Xc)^T (W^1/2 Xc)`` a batch, summed within a task; Spark adds the tasks' matrices.
  Only numbers bounded by the vector's length (d sums, d x d covariances) reach the driver, where their eigenvectors are taken.
* Each distinct vector is projected once and the result joined back to its copies by key; both sides of that join are plain
  exchanges, so a vector that holds a third of all rows is split by AQE.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdown.llm.common import written

SCALE = 256.0
COMPONENTS = 4
#: a component whose share of the variance is not above this is numerically absent
LEAST_SHARE = 1e-12
_BATCH = 8192


def pack(x: np.ndarray) -> list[bytes]:
    """One key a row of a long matrix: a byte with the integer width (1, 2, 4 or 8), then the row's integers, little-endian."""
    if not x.shape[1]:
        return [b"\x01"] * len(x)
    lo, hi = x.min(axis=1), x.max(axis=1)
    width = np.full(len(x), 8)
    for w, top in ((4, 1 << 31), (2, 1 << 15), (1, 1 << 7)):
        width[(lo >= -top) & (hi < top)] = w
    out: list[bytes] = [b""] * len(x)
    for w in (1, 2, 4, 8):
        at = np.nonzero(width == w)[0]
        raw, step, head = x[at].astype(f"<i{w}").tobytes(), w * x.shape[1], bytes([w])
        for k, i in enumerate(at.tolist()):
            out[i] = head + raw[k * step: (k + 1) * step]
    return out


def unpack(keys: pa.Array) -> np.ndarray:
    """The long matrix of keys that all have one length of vector."""
    rows = [np.frombuffer(k, dtype=f"<i{k[0]}", offset=1) for k in keys.to_pylist()]
    return np.array(rows, dtype=np.int64).reshape(len(rows), -1)


def quantise(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(id, dim, key) of every row whose vector is not null and has only finite entries; entries are floor(scale * entry) as longs
    (those beyond a long take its end)."""
    kind = table.schema[id_col].dataType.simpleString()
    src = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            flat = v.flatten()
            n = np.diff(v.offsets.to_numpy())
            c = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry becomes NaN
            good = np.bincount(np.repeat(np.arange(len(n)), n), weights=~np.isfinite(c), minlength=len(n)) == 0
            start = np.cumsum(n) - n
            top = np.floor(scale * np.where(np.isfinite(c), c, 0.0))
            x = np.where(top >= 2.0 ** 63, np.iinfo(np.int64).max, np.clip(top, -2.0 ** 63, np.nextafter(2.0 ** 63, 0)).astype(np.int64))
            keys: list[bytes | None] = [None] * len(n)
            for d in np.unique(n[good]).tolist():
                at = np.nonzero(good & (n == d))[0]
                for i, k in zip(at.tolist(), pack(x[start[at][:, None] + np.arange(d)])):
                    keys[i] = k
            pick = pa.array(np.nonzero(good)[0])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pick), pa.array(n[good].astype(np.int32)), pa.array([k for k in keys if k is not None], pa.binary())],
                                             names=["id", "dim", "key"])

    return src.mapInArrow(run, f"id {kind}, dim int, key binary")


def distinct_vectors(quantised: DataFrame) -> DataFrame:
    """(dim, key, copies): each vector once, with its number of rows."""
    return quantised.groupBy("dim", "key").agg(F.count("*").alias("copies"))


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: n is the sum of the weights, sums the exact weighted sums, one column of ``vectors`` a component."""

    dim: int
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def components(self, most: int) -> int:
        """How many components, at most ``most``, have variance."""
        return int((self.values[:most] > LEAST_SHARE * self.trace).sum()) if self.trace > 0 else 0


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for i in range(0, b.num_rows, _BATCH):
            part = b.slice(i, _BATCH)
            yield part, unpack(part.column(0))


def fit(distinct: DataFrame, weight: str = "one") -> Whitening | None:
    """The transform of the distinct vectors, each weighing ``one`` or its ``copies``; None for an empty table.

    Vectors of one length can be fitted together: the length most distinct vectors have (of equally many the greater) is
    fitted, and the others get no components."""
    w = {"one": F.lit(1).cast("long"), "copies": F.col("copies")}[weight]
    top = distinct.groupBy("dim").agg(F.sum(w).cast("long").alias("n"), F.count("*").alias("kinds")).orderBy(F.desc("kinds"), F.desc("dim")).first()
    if top is None:
        return None
    d, n = top["dim"], top["n"]
    rows = distinct.where(F.col("dim") == d).select("key", w.alias("w"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for b, x in _slices(batches):
            k = b.column(1).to_numpy()
            small = x.size == 0 or max(abs(int(x.min())), abs(int(x.max()))) * int(k.sum()) < 1 << 62
            s = (x * k[:, None]).sum(axis=0) if small else (x.astype(object) * k[:, None].astype(object)).sum(axis=0)
            total = [a + int(c) for a, c in zip(total, s)]
        from decimal import Decimal

        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "s"])

    got = rows.mapInArrow(add, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()
    sums = [0] * d
    for r in got:
        sums[r["i"]] = int(r["s"])
    mean = np.array([s / n for s in sums])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((d, d))
        for b, x in _slices(batches):
            c = (x - mean) * np.sqrt(b.column(1).to_numpy().astype(np.float64))[:, None]
            g += c.T @ c
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(g[i, j])], names=["i", "j", "v"])

    cov = np.zeros((d, d))
    for r in rows.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["v"] / n
    values, vectors = np.linalg.eigh(cov) if d else (np.zeros(0), np.zeros((0, 0)))
    return Whitening(d, n, tuple(sums), np.maximum(values[::-1], 0.0), vectors[:, ::-1], float(np.trace(cov)))


def whiten(distinct: DataFrame, model: Whitening, most: int = COMPONENTS) -> DataFrame:
    """(key, copies, deviation, whitened): each distinct vector once. deviation is the exact sum over dimensions of (n*x - S)^2 (null where
    a long cannot hold it), whitened one value a component with variance, at most ``most``."""
    k = model.components(most)
    n, sums, mean = model.n, model.sums, model.mean
    proj = model.vectors[:, :k] / np.sqrt(model.values[:k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _slices(batches):
            most_x = max((abs(int(x.min())), abs(int(x.max())))) if x.size else 0
            bound = most_x * n + max((abs(s) for s in sums), default=0)
            if bound * bound * max(model.dim, 1) < 1 << 63:
                dev = ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
            else:
                dev = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
                dev = [v if v < 1 << 63 else None for v in dev]
            out = (x - mean) @ proj
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dev, pa.int64()), lists], names=["key", "copies", "deviation", "whitened"])

    rows = distinct.where(F.col("dim") == model.dim).select("key", "copies")
    return rows.mapInArrow(run, "key binary, copies long, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, components: int, weight: str = "one") -> float | None:
    """Largest absolute entry of (weighted covariance of ``whitened`` minus the identity); None without components."""
    if not components:
        return None
    w = {"one": F.lit(1.0), "copies": F.col("copies").cast("double")}[weight]
    c = [F.col("whitened")[i] for i in range(components)]
    m = whitened.agg(F.sum(w).alias("n"), *[F.sum(w * x).alias(f"s{i}") for i, x in enumerate(c)]).first()
    mean = [m[f"s{i}"] / m["n"] for i in range(components)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    p = whitened.agg(*[F.sum(w * (c[i] - F.lit(mean[i])) * (c[j] - F.lit(mean[j]))).alias(f"p{i}_{j}") for i, j in pairs]).first()
    return max(abs(p[f"p{i}_{j}"] / m["n"] - (i == j)) for i, j in pairs)


def whitened_embeddings(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", weight: str = "one", most: int = COMPONENTS,
                        scale: float = SCALE) -> DataFrame:
    """One row per usable input row and component: id, component (from 1 by falling eigenvalue), n, deviation, whitened, explained
    (the eigenvalue's share of the trace), identity_error (one value, of the fit).

    Rows whose vector is null or holds a null or non-finite entry are left out. Vectors of another length than the fitted one
    (see ``fit``), empty vectors and components without variance (all vectors equal, fewer dimensions) give no rows. Repeated ids,
    null ids and equal vectors each keep their rows; equal vectors have equal results. Vectors may have any length; the covariance (d x d) is held
    by each task and the driver. An empty table gives no rows; other input columns are ignored, whatever their names.
    """
    kind = table.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = quantise(table, id_col, vector_col, scale)
    distinct = written(distinct_vectors(rows))
    model = fit(distinct, weight)
    k = model.components(most) if model else 0
    if not k:
        return table.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    once = written(whiten(distinct, model, most))
    error = identity_error(once, k, weight)
    j = rows.join(once.drop("copies"), "key")
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values[:k]])
    out = j.select("id", "deviation", F.posexplode("whitened").alias("c", "whitened"))
    return out.select(F.col("id").alias(id_col), (F.col("c") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                      share[F.col("c")].alias("explained"), F.lit(error).alias("identity_error"))
