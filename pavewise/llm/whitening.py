"""Embedding whitening: streaming covariance in partition iterators, merged pairwise, then a symmetric QR eigen-solve.

Vectors are taken to whole numbers (256ths), so sums and counts are exact. The covariance is that of the different vectors:
each task updates count, mean and the matrix of centred products by one rank-one step a vector (Welford), the tasks' states
are merged in rounds of FAN by the parallel update formula, and the driver gets FAN states of dimension squared numbers at
most. Householder reflections and implicitly shifted QR steps give all eigenpairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavewise.llm.common import pick, prepare, stored

SCALE = 256
COMPONENTS = 4
FAN = 16


@dataclass
class Moments:
    """Count, exact sums, mean and sum of centred products of some vectors."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Moments:
        return cls(0, np.zeros(d, np.int64), np.zeros(d), np.zeros((d, d)))

    def add(self, rows: np.ndarray) -> None:
        """One rank-one update for each row."""
        step = np.empty_like(self.products)
        for x in rows:
            self.n += 1
            delta = x - self.mean
            self.mean += delta / self.n
            np.multiply(delta[:, None], x - self.mean, out=step)
            self.products += step

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        products = self.products + other.products + np.outer(gap, gap) * (self.n * other.n / n)
        return Moments(n, self.sums + other.sums, self.mean + gap * (other.n / n), products)

    def pack(self) -> bytes:
        return np.int64(self.n).tobytes() + self.sums.tobytes() + self.mean.tobytes() + self.products.tobytes()

    @classmethod
    def unpack(cls, raw: bytes, d: int) -> Moments:
        n, sums = int(np.frombuffer(raw, np.int64, 1)[0]), np.frombuffer(raw, np.int64, d, 8)
        rest = np.frombuffer(raw, np.float64, d + d * d, 8 + 8 * d)
        return cls(n, sums, rest[:d].copy(), rest[d:].reshape(d, d).copy())

    def covariance(self) -> np.ndarray:
        both = self.products / max(self.n, 1)
        return (both + both.T) / 2


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and their unit eigenvectors as columns, of a real symmetric matrix."""
    a, n = np.array(matrix, float), len(matrix)
    q, least = np.eye(n), np.finfo(float).eps * np.abs(a).max(initial=0) / max(n, 1)
    for k in range(n - 2):  # to three diagonals
        x = a[k + 1 :, k]
        alpha = -np.copysign(np.linalg.norm(x), x[0])
        if abs(alpha) <= least:  # rounding alone
            a[k + 1, k] = 0
            continue
        v = x.copy()
        v[0] -= alpha
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1, k] = alpha
        q[:, k + 1 :] -= np.outer(2 * (q[:, k + 1 :] @ v), v)
    d, e = np.diag(a).copy(), np.diag(a, -1).copy()
    eps, high = np.finfo(float).eps, n - 1
    while high > 0:
        e[:high][np.abs(e[:high]) <= eps * (np.abs(d[:high]) + np.abs(d[1 : high + 1]))] = 0
        if e[high - 1] == 0:
            high -= 1
            continue
        low = high - 1
        while low > 0 and e[low - 1] != 0:
            low -= 1
        half, off = (d[high - 1] - d[high]) / 2, e[high - 1]
        shift = d[high] - off * off / (half + np.copysign(np.hypot(half, off), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            first, second, between = d[k], d[k + 1], e[k]
            d[k] = c * c * first + 2 * c * s * between + s * s * second
            d[k + 1] = s * s * first - 2 * c * s * between + c * c * second
            e[k] = c * s * (second - first) + (c * c - s * s) * between
            if k < high - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[:, k], q[:, k + 1] = c * q[:, k] + s * q[:, k + 1], c * q[:, k + 1] - s * q[:, k]
    order = np.argsort(-d, kind="stable")
    return d[order], q[:, order]


def lattice(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * entry) of the rows whose vector has entries, none of them null or not finite."""
    v = F.col("v")
    rows = pick(df, vec_id=id_col, v=vector_col).select("vec_id", v.cast("array<double>").alias("v"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return rows.filter((F.size(v) > 0) & F.forall(v, finite)).select("vec_id", F.transform(v, lambda c: F.floor(c * scale)).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def moments(vectors: DataFrame, d: int, basis: np.ndarray | None = None, mean: np.ndarray | None = None) -> Moments:
    """Moments of the column x of vectors (d entries each), or of (x - mean) @ basis."""
    wide = d if basis is None else basis.shape[1]

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments.empty(wide)
        for batch in batches:
            rows = _matrix(batch.column(0), d)
            if basis is None:
                state.sums = state.sums + rows.sum(0)
            state.add(rows.astype(float) if basis is None else (rows - mean) @ basis)
        if state.n:
            yield pa.record_batch([pa.array([state.pack()], pa.binary())], ["state"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments.empty(wide)
        for batch in batches:
            for raw in batch.column(0):
                state = state.merge(Moments.unpack(raw.as_py(), wide))
        if state.n:
            yield pa.record_batch([pa.array([state.pack()], pa.binary())], ["state"])

    states, parts = vectors.select("x").mapInArrow(seen, "state binary"), vectors.rdd.getNumPartitions()
    while parts > FAN:
        parts = -(-parts // FAN)
        states = states.repartition(parts).mapInArrow(met, "state binary")
    found = [Moments.unpack(bytes(r["state"]), wide) for r in states.collect()]  # FAN at most
    return reduce(Moments.merge, sorted(found, key=lambda m: (m.n, m.mean.tolist())), Moments.empty(wide))


def _deviations(rows: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Sums over dimensions of (n * x - S) ** 2, exact; OverflowError if one does not fit a long."""
    most = float(max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0))))) * n + float(np.abs(sums).max(initial=0))
    if most * most * rows.shape[1] < 2.0**62:
        return ((rows * n - sums) ** 2).sum(1)
    exact = [sum((n * x - s) ** 2 for x, s in zip(row, sums.tolist(), strict=True)) for row in rows.tolist()]
    return np.array(exact, np.int64)


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row with a usable vector and component.

    Rows whose vector is null or empty, or has null or non-finite entries, are left out; so are vectors of another length than
    most have (ties: than the longer ones). Different vectors count once in mean and covariance, however often they occur;
    repeated rows come out as often as they came, a null vec_id stays. An empty table gives none. There are as many
    components as the vectors have dimensions, if that is less. Where a component has no variance (fewer different
    vectors than dimensions, constant entries) whitened is null, and identity_error covers the others. Very long vectors
    cost each task and the driver the square of their length. Extra columns, whatever their names, are not looked at.
    """
    prepare(df.sparkSession)
    usable = lattice(df, id_col, vector_col)
    kind = usable.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sizes = usable.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return usable.select("vec_id", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")[1:]]).filter("false")
    d = sizes["d"]
    rows = usable.filter(F.size("x") == d)
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    all_of = moments(fit, d)
    n, sums, mean = all_of.n, all_of.sums, all_of.sums / all_of.n
    values, vectors = symmetric_qr(all_of.covariance())
    trace, k = float(np.trace(all_of.covariance())), min(components, d)
    some = values[:k] > max(values[0], 0.0) * d * np.finfo(float).eps
    basis = vectors[:, :k] / np.sqrt(np.where(some, values[:k], 1.0))
    error = None
    if some.any():
        error = float(np.abs(moments(fit, d, basis[:, some], mean).covariance() - np.eye(int(some.sum()))).max())
    shares = [float(v) / trace if trace > 0 else None for v in values[:k]]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), d)
            count = len(x)
            w = (x - mean) @ basis
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(count), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                pa.array(np.full(count * k, n)),
                pa.array(np.repeat(_deviations(x, n, sums), k)),
                pa.array(w.ravel(), mask=np.tile(~some, count)),
                pa.array(shares * count, pa.float64()),
                pa.array([error] * (count * k), pa.float64()),
            ]
            yield pa.record_batch(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
