"""Whitening of embeddings by an incremental eigendecomposition.

Every partition keeps the spectrum of its scatter matrix and applies one centred rank-one update a vector: the new
eigenvalues are the roots of a secular equation between the old ones, entries without weight and equal eigenvalues are
deflated first (Bunch, Nielsen, Sorensen 1978), and the eigenvectors are built from weights recomputed from the roots, so
that they stay orthogonal (Gu, Eisenstat 1994). Equal vectors of a batch make one weighted update. Spectra are combined,
eight at a time, by successive rank-one updates with the eigenpairs of the smaller one and with the difference of the means. A
last pass refines the result (Rayleigh-Ritz): the covariance projected on the basis, accumulated over all vectors from
exactly centred integers, is diagonalised, and the basis turned accordingly. What moves is one spectrum a partition, of
the size of the dimension squared; no row but the output leaves its partition.

Entries become whole numbers, ``floor(scale * c) + shift``, so sums are exact.

Defined results: rows whose vector is NULL, empty, holds NULL, NaN or infinite entries, or has another length than most
vectors have (ties: the shorter), are dropped; NULL and repeated vec_ids are kept, repeated rows weigh as often as they
occur; with equal eigenvalues any basis of their space is taken, the same for all rows; components without variance are
left out (one vector alone gives no row); ``deviation`` is NULL where the exact sum exceeds 64 bits; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import materialize, own_tables

SCALE, SHIFT = 1024, 100_000
FAN_IN = 8
_EPS = np.finfo(float).eps
_SPECTRUM = "part long, n long, sums array<long>, mean array<double>, values array<double>, vectors array<double>"


def _roots(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``d_i - root_j`` as a matrix [j, i] for the roots of ``1 + sum w_i / (d_i - x)``, ``d`` rising and ``w`` positive.

    Each root is sought from the nearer of its two poles, by rational interpolation of both sides, kept in a bracket."""
    k = len(d)
    gap = np.append(np.diff(d), w.sum())
    middle = d + gap / 2
    f = 1 + (w / (d - middle[:, None])).sum(1)
    left = f >= 0
    left[-1] = True
    near = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    delta = d - d[near][:, None]
    lo, hi = np.where(left, 0.0, -gap / 2), np.where(left, gap / 2, 0.0)
    hi[-1] = gap[-1] * (1 + 4 * _EPS)
    first = np.tri(k, dtype=bool)
    own, other = -np.where(left, 0.0, gap), np.where(left, gap, 0.0)  # the two poles, from the origin
    x = (lo + hi) / 2
    for _ in range(100):
        away = delta - x[:, None]
        part = w / away
        slope = part / away
        value = 1 + part.sum(1)
        noise = _EPS * k * (1 + np.abs(part).sum(1))
        lo, hi = np.where(value < 0, x, lo), np.where(value >= 0, x, hi)
        done = (np.abs(value) <= noise) | (hi - lo <= 2 * _EPS * np.maximum(np.abs(lo), np.abs(hi)))
        if done.all():
            break
        low = np.where(first, slope, 0.0).sum(1)
        high = slope.sum(1) - low
        a1, a2 = own - x, other - x
        a = (a1 + a2) * value - a1 * a2 * (low + high)
        b, c = a1 * a2 * value, value - a1 * low - a2 * high
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            there = x + step
        bad = ~np.isfinite(there) | (there <= lo) | (there >= hi)
        x = np.where(done, x, np.where(bad, (lo + hi) / 2, there))
    return delta - x[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) of ``vectors diag(values) vectors' + rho v v'``, ``rho`` not negative."""
    z = vectors.T @ v
    length = float(z @ z)
    if rho <= 0 or length == 0:
        return values, vectors
    most = 8 * _EPS * max(abs(values[-1]), abs(values[0]), rho * length)
    used = np.flatnonzero(rho * np.abs(z) * math.sqrt(length) > most)
    kept = []
    close = len(used) > 1 and (np.diff(values[used]) <= 1e-6 * max(abs(values[-1]), rho * length)).any()
    if close:
        values, vectors, last = values.copy(), vectors.copy(), None
        for j in used:
            if last is not None:
                r = math.hypot(z[last], z[j])
                c, s = z[j] / r, z[last] / r
                if abs((values[j] - values[last]) * c * s) <= most:  # turned so that the earlier one has no weight
                    z[j], z[last] = r, 0.0
                    a, b = vectors[:, last].copy(), vectors[:, j].copy()
                    vectors[:, last], vectors[:, j] = c * a - s * b, s * a + c * b
                    low = values[last]
                    values[last], values[j] = c * c * low + s * s * values[j], s * s * low + c * c * values[j]
                    last = j
                    continue
                kept.append(last)
            last = j
        used = np.array([*kept, last]) if last is not None else used
    if len(used) == 0:
        return values, vectors
    d = values[used]
    away = _roots(d, rho * z[used] ** 2)
    k = len(d)
    # The weights for which these are the exact roots.
    ratio = -away.copy()
    between = d[None, :] - d[:, None]  # [i, j] = d_j - d_i
    i, j = np.tril_indices(k, -1)
    ratio[j, i] /= between[i, j]
    i, j = np.triu_indices(k - 1) if k > 1 else (np.array([], int), np.array([], int))
    ratio[j, i] /= between[i, j + 1]
    weight = np.sqrt(np.abs(ratio.prod(0))) * np.where(z[used] < 0, -1.0, 1.0)
    turn = weight / away
    turn /= np.sqrt((turn * turn).sum(1))[:, None]
    values, vectors = values.copy(), vectors.copy()
    values[used], vectors[:, used] = d - np.diagonal(away), vectors[:, used] @ turn.T
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, exact sums, mean and eigenpairs of the scatter matrix of the vectors seen."""

    def __init__(self, dim: int):
        self.n, self.sums, self.mean = 0, np.zeros(dim, np.int64), np.zeros(dim)
        self.values, self.vectors = np.zeros(dim), np.eye(dim)

    @classmethod
    def of(cls, row) -> Spectrum:
        s = cls(len(row["sums"]))
        s.n, s.sums = int(row["n"]), np.array(row["sums"], np.int64)
        s.mean, s.values = np.array(row["mean"], float), np.array(row["values"], float)
        s.vectors = np.array(row["vectors"], float).reshape(len(s.mean), -1)
        return s

    def add(self, x: np.ndarray, times: int) -> None:
        delta = x - SHIFT - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, delta, self.n * times / (self.n + times))
        self.n += times
        self.sums += x * times
        self.mean = self.mean + delta * (times / self.n)

    def merge(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        n = self.n + other.n
        if n == 0:
            return
        delta = other.mean - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, delta, self.n * other.n / n)
        self.mean, self.sums, self.n = self.mean + delta * (other.n / n), self.sums + other.sums, n

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "sums": self.sums, "mean": self.mean, "values": self.values, "vectors": self.vectors.ravel()}


def _whole(column, dim: int) -> np.ndarray:
    """Vectors of a batch as whole numbers, one in each row."""
    return np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64).reshape(-1, dim) + SHIFT


def usable(embeddings: DataFrame, vec_col: str) -> tuple[DataFrame, int]:
    """Rows whose vector has finite entries alone and the commonest length, and that length."""
    fine = F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.filter(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & fine)
    top = rows.groupBy(F.size(vec_col).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = top["dim"] if top else 0
    return rows.filter(F.size(vec_col) == dim), dim


def _spectra(rows: DataFrame, dim: int) -> DataFrame:
    def run(batches):
        s, part = Spectrum(dim), 0
        for b in batches:
            x, times = np.unique(_whole(b.column(0), dim), axis=0, return_counts=True)
            for v, t in zip(x, times.tolist(), strict=True):
                s.add(v, t)
            part = b.column(1)[0].as_py() if len(b) else part
        if s.n:
            yield pa.RecordBatch.from_pylist([s.row(part)], schema=_arrow(_SPECTRUM))

    return rows.select(rows.columns[0], F.spark_partition_id().cast("long")).mapInArrow(run, _SPECTRUM)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in ddl.split(", "))])


def _combine(rows: DataFrame, join) -> dict | None:
    """The rows of all partitions, told apart by ``part``, made one, ``FAN_IN`` at a time; ``join`` takes their frame and a number."""
    rows = materialize(rows)
    parts = rows.agg(F.max("part")).first()[0]
    if parts is None:
        return None
    while parts > 0:
        parts //= FAN_IN
        rows = rows.groupBy(F.floor(F.col("part") / FAN_IN).alias("group")).applyInPandas(lambda key, x: join(x.sort_values("part"), int(key[0])), rows.schema)
    return rows.first().asDict()  # one row, of the size of the dimension squared


def _joined(x: pd.DataFrame, part: int) -> pd.DataFrame:
    total, *rest = sorted((Spectrum.of(x.iloc[i]) for i in range(len(x))), key=lambda s: -s.n)
    for s in rest:
        total.merge(s)
    return pd.DataFrame([total.row(part)])


def _summed(x: pd.DataFrame, part: int) -> pd.DataFrame:
    return pd.DataFrame([{"part": part, "sums": np.sum(np.stack(x["sums"].to_list()), axis=0)}])


def _total(rows: DataFrame, of, dim: int) -> np.ndarray:
    """The sum of ``of(whole numbers)``, an array, over all batches."""

    def run(batches):
        total, part = None, 0
        for b in batches:
            if len(b):
                one = of(_whole(b.column(0), dim)).ravel()
                total, part = one if total is None else total + one, b.column(1)[0].as_py()
        if total is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "sums": total}], schema=_arrow("part long, sums array<double>"))

    sums = rows.select(rows.columns[0], F.spark_partition_id().cast("long")).mapInArrow(run, "part long, sums array<double>")
    return np.array(_combine(sums, _summed)["sums"])


class Whitener:
    """``components`` (columns), their ``eigenvalues`` and share of the variance, fitted on exact ``sums`` of ``n`` vectors."""

    def __init__(self, n: int, sums: np.ndarray, components: np.ndarray, eigenvalues: np.ndarray, trace: float):
        self.n, self.sums, self.components, self.eigenvalues, self.trace = n, sums, components, eigenvalues, trace

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x * self.n - self.sums) / self.n

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)


def fit(rows: DataFrame, dim: int, components: int) -> Whitener | None:
    """The whitener of ``rows`` (their first column has the vectors, as ``usable`` gives them); None if there are none."""
    found = _combine(_spectra(rows, dim), _joined)
    if found is None:
        return None
    s = Spectrum.of(found)
    basis, _ = np.linalg.qr(s.vectors)  # orthogonal to the last bit, the same directions
    n, sums = s.n, s.sums

    def projected(x: np.ndarray) -> np.ndarray:
        p = (x * n - sums) / n @ basis
        return p.T @ p

    h = _total(rows, projected, dim).reshape(dim, dim) / n
    values, turn = np.linalg.eigh((h + h.T) / 2)
    order = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > dim * 1e-13 * np.trace(h)]
    vectors = basis @ turn[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), range(len(order))] < 0, -1.0, 1.0) if order else vectors
    return Whitener(n, sums, vectors, values[order], float(np.trace(h)))


@own_tables
def whiten(embeddings: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, component`` (from 1)``, n, deviation`` (exact sum of squares of ``n x - S``)``, whitened, explained`` (share of the
    variance) and ``identity_error`` (largest entry by which the covariance of all whitened values differs from the identity)."""
    out = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(dict(embeddings.dtypes)[id_col])
    rows, dim = usable(embeddings.select(F.col(vec_col).alias("v"), F.col(id_col).alias("id")), "v")
    w = fit(rows.select("v"), dim, components) if dim else None
    if w is None or not len(w.eigenvalues):
        return embeddings.sparkSession.createDataFrame([], out)
    k = len(w.eigenvalues)

    def moments(x: np.ndarray) -> np.ndarray:
        y = w(x)
        return np.append((y.T @ y).ravel(), y.sum(0))

    m = _total(rows.select("v"), moments, dim) / w.n
    error = float(np.abs(m[: k * k].reshape(k, k) - np.outer(m[k * k :], m[k * k :]) - np.eye(k)).max())
    share = w.eigenvalues / w.trace

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            x = _whole(b.column(0), dim)
            off = x * w.n - w.sums
            if float(np.abs(off).max()) ** 2 * dim < 2.0**62:
                deviation = pa.array((off * off).sum(1).repeat(k))
            else:
                exact = [sum(int(c) ** 2 for c in r) for r in off]
                deviation = pa.array([e if e < 1 << 63 else None for e in exact for _ in range(k)], pa.int64())
            number = np.arange(len(x)).repeat(k)
            same = [np.full(len(number), w.n, np.int64), w(x).ravel(), np.tile(share, len(x)), np.full(len(number), error)]
            ids, component = b.column(1).take(pa.array(number)), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))
            cols = [ids, pa.array(component), pa.array(same[0]), deviation, *map(pa.array, same[1:])]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, out)
