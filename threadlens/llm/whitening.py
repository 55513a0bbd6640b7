"""Whitening of embeddings: streaming covariance by Welford's updates, merged across partitions, and a symmetric QR eigen-solve.

Each entry c becomes the integer floor(``scale`` * c) + ``shift``. A partition's iterator holds a count, exact integer sums, a mean
and the centred second moments, and changes them by a rank-one update for every vector; the states of two partitions merge by the parallel
update formula, first in up to 256 tasks, then in 16, so the driver gets 16 states of d * (d + 1) / 2 numbers at most. There
the covariance is made tridiagonal by Householder reflections and diagonal by implicitly shifted QR steps.

Whitened values and deviations come from ``n * x - S``, which is exact in integers, so nothing is lost to the shift. How far
the whitened vectors are from unit covariance is measured on them by the same updates in a second pass; no pass shuffles a vector.

Defined cases: vectors that are null or hold null or non-finite entries are dropped, and so are those whose length isn't the commonest
one (of equally common lengths the longest stays); entries beyond 2**52 after scaling count as that number; a deviation beyond a long
is null; components whose variance is not above d * 2**-52 of the largest one have null whitened values, and no share in
``identity_error``; with no variance at all ``explained`` is null; with fewer dimensions than components there are as many as dimensions; null and
repeated ids and repeated vectors count as often as they come; an empty table gives an empty result; columns of any names are handed
on by ``whitened``, but those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.common import arrow_limits, tidy
from threadlens.llm.places import unused
from threadlens.session import table

LIMIT = 1 << 52


class Moments:
    """Count, exact integer sums, mean and centred second moments of vectors."""

    SCHEMA = "n long, sums array<string>, mean array<double>, moments binary"

    def __init__(self, d: int):
        self.n, self.sums, self.mean, self.m2, self._outer = 0, [0] * d, np.zeros(d), np.zeros((d, d)), np.empty((d, d))

    def add(self, vectors: np.ndarray) -> None:
        """One rank-one update a vector (Welford): M2 gains (n - 1) / n times the outer product of its distance to the mean."""
        if vectors.dtype == np.int64:
            for at in range(0, len(vectors), 1000):  # a thousand entries of 2**52 still fit a long
                self.sums = [a + b for a, b in zip(self.sums, vectors[at : at + 1000].sum(axis=0).tolist())]
        for x in vectors.astype(np.float64):
            self.n += 1
            away = x - self.mean
            self.mean += away / self.n
            np.multiply.outer(away, away * ((self.n - 1) / self.n), out=self._outer)
            self.m2 += self._outer

    def merge(self, other: Moments) -> Moments:
        """The parallel update: both second moments, and the distance of the means."""
        n = self.n + other.n
        if other.n:
            away = other.mean - self.mean
            self.m2 += other.m2 + np.outer(away, away) * (self.n * other.n / n)
            self.mean += away * (other.n / n)
            self.sums, self.n = [a + b for a, b in zip(self.sums, other.sums)], n
        return self

    def covariance(self) -> np.ndarray:
        """Divisor n; exactly symmetric."""
        return (self.m2 + self.m2.T) / (2 * self.n)

    def row(self) -> pa.RecordBatch:
        upper = self.m2[np.triu_indices(len(self.mean))].tobytes()
        arrays = [pa.array([self.n]), pa.array([[str(s) for s in self.sums]], pa.list_(pa.string())), pa.array([self.mean.tolist()], pa.list_(pa.float64())), pa.array([upper], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["n", "sums", "mean", "moments"])

    @staticmethod
    def of(d: int, n: int, sums: list[str], mean: list[float], moments: bytes) -> Moments:
        out = Moments(d)
        out.n, out.sums, out.mean = n, [int(s) for s in sums], np.array(mean)
        out.m2[np.triu_indices(d)] = np.frombuffer(moments)
        out.m2 = out.m2 + np.triu(out.m2, 1).T
        return out


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column whose lists all have d entries."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def moments(vectors: DataFrame, d: int, partitions: int, read: Callable[[pa.Array], np.ndarray], fan_in: tuple[int, ...] = (256, 16)) -> Moments:
    """Moments of the only column of ``vectors`` (an array a row, turned into a matrix by ``read``), merged level by level."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments(d)
        for batch in batches:
            state.add(read(batch.column(0)))
        if state.n:
            yield state.row()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments(d)
        for batch in batches:
            for row in batch.to_pylist():
                state.merge(Moments.of(d, **row))
        if state.n:
            yield state.row()

    states = vectors.mapInArrow(tidy(fit), Moments.SCHEMA)
    for tasks in fan_in:
        if partitions > tasks:
            states = states.repartition(tasks).mapInArrow(tidy(merge), Moments.SCHEMA)
    out = Moments(d)
    for row in states.collect():
        out.merge(Moments.of(d, *row))
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and q with a = q t q', by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if norm == 0 or not v[1:].any():
            continue
        v[0] += np.copysign(norm, v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (p @ v) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = a[k, k + 1] = a[k + 1, k] - 2 * v[0] * (v @ a[k + 1 :, k])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix: implicit QR steps with Wilkinson's shift."""
    n = len(a)
    size = np.abs(a).max(initial=0.0)
    if n == 0 or size == 0:
        return np.zeros(n), np.eye(n)
    d, e, q = tridiagonal(a / size)
    q, hi, left, eps = np.ascontiguousarray(q.T), n - 1, sweeps * n, np.finfo(float).eps  # rows are the vectors
    while hi > 0:
        small = np.abs(e[:hi]) <= eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0.0
        if e[hi - 1] == 0:
            hi -= 1
            continue
        if (left := left - 1) < 0:
            raise ArithmeticError("the QR steps don't converge")
        zeros = np.flatnonzero(e[:hi] == 0)
        lo = int(zeros[-1]) + 1 if len(zeros) else 0
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):  # chase the bulge down
            r = np.hypot(x, z)
            c, s = (1.0, 0.0) if r == 0 else (x / r, z / r)
            if k > lo:
                e[k - 1] = r
            a1, b1, a2 = d[k], e[k], d[k + 1]
            d[k] = c * c * a1 + 2 * c * s * b1 + s * s * a2
            d[k + 1] = s * s * a1 - 2 * c * s * b1 + c * c * a2
            e[k] = c * s * (a2 - a1) + (c * c - s * s) * b1
            x = e[k]
            if k < hi - 1:
                z = s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    return d[order] * size, q[order].T


@dataclass
class Whitening:
    """A fitted model: counts, exact sums, falling variances of the components and their unit directions (columns)."""

    n: int
    sums: list[int]
    variances: np.ndarray
    directions: np.ndarray
    total: float
    scale: float
    shift: int
    partitions: int
    identity_error: float | None = None

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def explained(self) -> list[float | None]:
        return [float(v / self.total) if self.total > 0 else None for v in self.variances]

    def integers(self, column: pa.Array) -> np.ndarray:
        return integers(matrix(column, self.dimension), self.scale, self.shift)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """x - S / n by way of the exact n * x - S, and the sum of the latter's squares."""
        if self.n * (int(np.abs(x).max(initial=0)) + LIMIT // self.n) < 1 << 62 and max(map(abs, self.sums)) < 1 << 62:
            far = self.n * x - np.array(self.sums, np.int64)
            sizes = (far.astype(np.float64) ** 2).sum(axis=1)
            squares = [s if f < 2.0**62 else None for s, f in zip((far * far).sum(axis=1).tolist(), sizes)]
            away = far / self.n
        else:
            far, squares = [[self.n * a - s for a, s in zip(r, self.sums)] for r in x.tolist()], [None] * len(x)
            away = np.array([[float(a) / self.n for a in r] for r in far]).reshape(x.shape)
        for i in [i for i, s in enumerate(squares) if s is None]:
            exact = sum((self.n * a - s) ** 2 for a, s in zip(x[i].tolist(), self.sums))
            squares[i] = exact if exact < 1 << 63 else None
        return away, squares

    def usable(self) -> np.ndarray:
        top = self.variances.max(initial=0.0)
        return (self.variances > self.dimension * 2.0**-52 * top) & (self.variances > 0)

    def project(self, away: np.ndarray) -> np.ndarray:
        """Whitened values; zero in components without variance."""
        fits = self.usable()
        return away @ (self.directions * np.where(fits, 1 / np.sqrt(np.where(fits, self.variances, 1.0)), 0.0))


def integers(vectors: np.ndarray, scale: float, shift: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * vectors.astype(np.float64)), -LIMIT, LIMIT).astype(np.int64) + shift


def whole(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector and all its entries are there and finite."""
    sound = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return df.where(F.col(vector).isNotNull() & sound)


def fitted(df: DataFrame, vector: str, components: int = 8, scale: float = 1024.0, shift: int = 100_000) -> Whitening | None:
    """The whitening of all vectors of ``df``; None where there are none."""
    arrow_limits(df.sparkSession)
    sound = whole(df.select(F.col(vector).cast("array<double>").alias("v")), "v")
    # a count a length, and how many partitions there are: both bounded by the counts' partial sums
    lengths = sound.select(F.size("v").alias("d"), F.spark_partition_id().alias("p")).groupBy("d").agg(F.count("*").alias("n"), F.max("p").alias("p"))
    common = lengths.agg(F.max(F.struct("n", "d")).alias("best"), (F.max("p") + 1).alias("p")).first()
    if common["best"] is None:
        return None
    d, partitions = common["best"]["d"], common["p"]
    if d == 0:
        return Whitening(common["best"]["n"], [], np.zeros(0), np.zeros((0, 0)), 0.0, scale, shift, partitions)
    own = sound.where(F.size("v") == d)
    m = moments(own, d, partitions, lambda column: integers(matrix(column, d), scale, shift))
    cov = m.covariance()
    values, vectors = eigen(cov)
    model = Whitening(m.n, m.sums, values[:components], vectors[:, :components], float(np.trace(cov)), scale, shift, partitions)
    fits = model.usable()
    if fits.any():
        check = moments(own, len(fits), partitions, lambda column: model.project(model.centred(model.integers(column))[0]))
        model.identity_error = float(np.abs(check.covariance() - np.eye(len(fits)))[np.ix_(fits, fits)].max())
    return model


def whitened(df: DataFrame, model: Whitening, vector: str, out: tuple[str, str] = ("whitened", "deviation")) -> DataFrame:
    """``df``'s rows that the model is for, with the whitened values (array) and the deviation in the columns ``out``."""
    names = [c for c in df.columns if c.lower() not in out]
    (own,) = unused(names, "vector")
    arrow_limits(df.sparkSession)
    blank = (~model.usable()).nonzero()[0].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away, squares = model.centred(model.integers(batch.column(len(names))))
            values = model.project(away).tolist()
            for row in values if blank else []:
                for i in blank:
                    row[i] = None
            made = [pa.array(values, pa.list_(pa.float64())), pa.array(squares, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], names=[*names, *out])

    schema = df.select(*names).select("*", F.lit(None).cast("array<double>").alias(out[0]), F.lit(None).cast("long").alias(out[1])).schema
    given = df.select(*names, F.col(vector).cast("array<double>").alias(own))
    return whole(given, own).where(F.size(own) == model.dimension).mapInArrow(tidy(run), schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight whitened components of every embedding."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fitted(vectors, "embedding")
    if model is None or not model.dimension:
        kinds = {"vec_id": "long", "component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
        return vectors.where("false").select(*[(F.col(c) if c == "vec_id" else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
    shares = F.array(*[F.lit(x).cast("double") for x in model.explained()])
    rows = whitened(vectors.select("vec_id", "embedding"), model, "embedding").select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value"))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.col("value").alias("whitened"),
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
