"""Whitening of vectors by matrix-free block subspace iteration.

The entries become whole numbers, so that the number of vectors and the sums of their dimensions are exact. The
covariance V is never formed: a Spark pass takes a block Q of orthonormal columns, centres every row by whole numbers
and adds up the products of the centred rows with what they give on Q, which is V Q, as small as Q is. On the driver a
Rayleigh-Ritz step turns Q into the best approximations that its span holds, and QR of V Q gives the next block. The
passes end when the residual of each of the k components, the norm of V q - e q, is below ``tolerance`` times the largest
eigenvalue, which certifies them all.

A block has twice as many columns as components are asked for, and at most as many as there are dimensions. Where
residuals fall so slowly that more than ``patience`` passes would be left, as they do on flat spectra, the block doubles;
a block of all dimensions needs one pass. Nothing but blocks and sums of the size dimensions times columns reaches the
driver; each task hands on one partial sum, and Spark adds them up by dimension.

Defined cases. Rows whose vector is null, empty, or holds null or non-finite entries, or entries beyond 2^40, take no
part; nor do those of another length than most rows that are left have (of equally frequent lengths, the longest).
Repeated rows count as often as they occur; a null id stays null. Components with an eigenvalue of zero, to 1e-12 of the
largest, can't be scaled to one and are left out: with fewer dimensions or distinct vectors there are fewer components,
and with one vector, with equal ones, or with an empty table there are no rows. A deviation beyond 64 bits is null. Only
the id and the vector are read, so that other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop, written

SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 40)


def whole_numbers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and ``x``, the entries as whole numbers, of the vectors that take part; a table in the shared folder."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) <= LARGEST)
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(F.forall("v", fine))
    rows = written(rows.select("key", F.transform("v", lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("bigint")).alias("x")), "whole-vectors")
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    return rows.filter(F.size("x") == (length["d"] if length else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _added(rows: DataFrame, part, width: int) -> np.ndarray:
    """Sum over tasks of the matrix that ``part`` makes of each batch of rows; row i of it is Spark's group i."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                m = part(_matrix(b))
                total = m if total is None else total + m
        if total is not None:
            kind = pa.float64() if total.dtype == np.float64 else pa.int64()
            lists = pa.ListArray.from_arrays(np.arange(0, total.size + 1, width, dtype=np.int32), pa.array(total.ravel(), kind))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), lists], names=["i", "m"])

    whole = part(np.zeros((1, len(rows.head()["x"])), np.int64)).dtype != np.float64
    parts = rows.select("x").mapInArrow(work, f"i int, m array<{'bigint' if whole else 'double'}>")
    sums = parts.groupBy("i").agg(F.array(*[F.sum(F.col("m")[j]) for j in range(width)]).alias("m")).orderBy("i").collect()
    return np.array([r["m"] for r in sums])


@dataclass
class Whitening:
    """What whitens: number of vectors, exact sums of the dimensions, components as columns, eigenvalues, trace of V."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    passes: int = 0
    residual: float = 0.0

    def far(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: in Python's whole numbers where 64 bits don't hold them."""
        if float(np.abs(x).max(initial=0)) * self.n >= 2.0**62:
            x = x.astype(object)
        return x * self.n - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: whole numbers up to the division."""
        return self.far(x).astype(np.float64) / self.n

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)


def fit(rows: DataFrame, k: int = 32, block: int | None = None, tolerance: float = 1e-13, patience: int = 24, seed: int = 0) -> Whitening | None:
    """The leading k components of the rows of ``whole_numbers``; None if there are no rows."""
    first = rows.head()
    if first is None:
        return None
    d = len(first["x"])
    counted = _added(rows, lambda x: np.vstack([x.sum(axis=0), np.full(d, len(x))]), d)
    sums, n = counted[0], int(counted[1][0])
    model = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    model.trace = float(_added(rows, lambda x: (model.centred(x) ** 2).sum(axis=0)[None, :], d).sum() / n)
    if not model.trace > 0:
        return model
    k, width, random = min(k, d), min(d, block or 2 * k), np.random.default_rng(seed)
    q, last, stuck = np.linalg.qr(random.standard_normal((d, max(width, min(k, d)))))[0], np.inf, 0
    while True:
        centred = model.centred

        def product(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            c = centred(x)
            return c.T @ (c @ q)

        vq = _added(rows, product, q.shape[1]) / n
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = q @ turn, vq @ turn
        worst = float(np.linalg.norm(image[:, :k] - ritz[:, :k] * values[:k], axis=0).max() / values[0])
        model.passes, model.residual = model.passes + 1, worst
        full = q.shape[1] == d
        stuck = stuck + 1 if worst > last / 2 else 0
        if worst <= tolerance or (full and stuck >= 2):  # rounding is all that is left in a block of all dimensions
            break
        rate = np.log(max(worst, 1e-300) / last) if np.isfinite(last) else -np.inf
        slow = np.isfinite(last) and (rate >= 0 or np.log(tolerance / worst) / rate > patience)
        more = random.standard_normal((d, min(d - q.shape[1], q.shape[1]))) if slow else np.zeros((d, 0))
        last = np.inf if slow else worst
        q = np.linalg.qr(np.hstack([image, more]))[0]
    kept = values[:k] > 1e-12 * values[0]
    signs = np.sign(np.take_along_axis(ritz, np.abs(ritz).argmax(axis=0)[None, :], 0))
    model.components, model.values = (ritz * signs)[:, :k][:, kept], values[:k][kept]
    return model


def _deviations(model: Whitening, x: np.ndarray) -> pa.Array:
    far = model.far(x)
    if far.dtype != object and float((far.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) < 2.0**62:
        return pa.array((far * far).sum(axis=1), pa.int64())
    exact = [sum(int(v) * int(v) for v in row) for row in far]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, by one more pass."""
    k = len(model.values)

    def moments(x: np.ndarray) -> np.ndarray:
        z = model.apply(x)
        return np.vstack([z.T @ z, z.sum(axis=0)[None, :]])

    m = _added(rows, moments, k)
    mean = m[k] / model.n
    return float(np.abs(m[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """key, deviation and whitened, an array with a number a component, of rows of ``whole_numbers``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b)
                z = model.apply(x)
                lists = pa.ListArray.from_arrays(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("key"), _deviations(model, x), lists], names=["key", "deviation", "whitened"])

    return rows.mapInArrow(work, f"key {rows.schema['key'].dataType.simpleString()}, deviation bigint, whitened array<double>")


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 32, block: int | None = None) -> DataFrame:
    """key, component, n, deviation, whitened, explained and identity_error, a row a vector and component."""
    spark = vectors.sparkSession
    bounded_batches(spark, 4096)
    kind = vectors.schema[key].dataType.simpleString()
    rows = whole_numbers(vectors, key, vector)
    model = fit(rows, k, block)
    if model is None or not len(model.values):
        drop(rows)
        return spark.createDataFrame([], f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    error = identity_error(rows, model)
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    out = transform(rows, model).select("key", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
