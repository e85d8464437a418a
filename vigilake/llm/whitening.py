"""Whitening of embeddings: principal components by a randomised range finder and the Rayleigh-Ritz method.

Entries become integers, so sums and deviations are exact. Each pass goes over the centred vectors of the fit list, in tasks that add
up their own rows; sums of the tasks are added by Spark, cell by cell, and only matrices of (dimension x rank) cells reach the driver,
whatever the number of rows. A pass multiplies the covariance with a basis; from the basis and
the product the Rayleigh-Ritz method gives components and their residuals. If these fail after the last power pass, the basis
becomes the whole space and one more pass is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Components, further columns of the random basis, and passes with powers before the basis is the whole space.
COMPONENTS, OVERSAMPLE, POWERS = 16, 16, 4
#: Largest residual of a component against the largest eigenvalue.
RESIDUAL = 64 * np.finfo(float).eps


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums of each dimension, the components as columns with their eigenvalues, and what the passes told."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    rank: int
    residual: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, x: entries c as floor(64 c) + 1,000,000, of rows whose embedding is not null and has finite entries only.

    Vectors of another length than most have (the longer, if tied) can't be projected and take no part; nor do empty ones.
    """
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.where("e is not null and size(e) > 0 and not exists(e, c -> c is null or isnan(c) or abs(c) = double('inf'))")
    common = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("e") == (common[0] if common else 0)).selectExpr("vec_id", "transform(e, c -> floor(64 * c) + 1000000) as x")


def _matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _centre(n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers next to the means, and n times what is left."""
    whole = np.array([(2 * int(s) + n) // (2 * n) for s in sums], np.int64)
    return whole, np.array([int(s) - n * int(w) for s, w in zip(sums, whole)], np.int64)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    whole, left = _centre(n, sums)
    return (x - whole).astype(float) - left / n


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """The sum over dimensions of (n x - sums)²; exact, an error beyond 64 bits."""
    whole, left = _centre(n, sums)
    y = x - whole
    if n * float(np.abs(y).max(initial=0) + 1) * np.sqrt(x.shape[1]) < 2.0**31:
        return ((n * y - left) ** 2).sum(1)
    exact = ((y.astype(object) * n - left.astype(object)) ** 2).sum(1)
    if max(exact, default=0) >= 2**63:
        raise OverflowError("a deviation is beyond 64 bits")
    return exact.astype(np.int64)


def _totals(fit: DataFrame, width: int, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of the cells that add gives for a block of vectors."""
    schema = pa.schema([("cell", pa.int32()), ("value", pa.float64())])

    def run(batches):
        total = np.zeros(width)
        for x in _matrices(batches, 0):
            total += add(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], schema=schema)

    rows = fit.select("x").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(width)
    for cell, value in rows:
        out[cell] = value
    return out


def _sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64()), ("value", pa.int64())])

    def run(batches):
        n, total = 0, None
        for x in _matrices(batches, 0):
            n, total = n + len(x), x.sum(0) if total is None else total + x.sum(0)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.full(len(total), n)), pa.array(total)], schema=schema)

    rows = fit.select("x").mapInArrow(run, "cell int, n long, value long").groupBy("cell").agg(F.sum("n"), F.sum("value")).orderBy("cell").collect()
    return (rows[0][1], np.array([r[2] for r in rows], np.int64)) if rows else (0, np.zeros(0, np.int64))


def fit(rows: DataFrame, components: int = COMPONENTS, oversample: int = OVERSAMPLE, powers: int = POWERS, seed: int = 0) -> Whitening | None:
    """The whitening of the different vectors among rows(x); none without rows.

    Components by falling eigenvalue, their largest entry positive; those without variance (eigenvalue under the rounding of the trace) are left
    out. The driver and each task hold matrices of dimension x (components + oversample), or dimension x dimension where
    residuals ask for the whole space.
    """
    different = cut(rows.select("x").distinct(), "whiten-fit")
    n, sums = _sums(different)
    if not n:
        return None
    d = len(sums)
    trace = float(_totals(different, 1, lambda x: np.array([(_centred(x, n, sums) ** 2).sum()]))[0]) / n
    k = min(components, d)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, k + oversample))))[0]
    for step in range(powers + 2):
        rank = basis.shape[1]

        def product(x, basis=basis):
            c = _centred(x, n, sums)
            return (c.T @ (c @ basis)).ravel()

        image = _totals(different, d * rank, product).reshape(d, rank) / n
        inner = basis.T @ image
        values, inside = np.linalg.eigh((inner + inner.T) / 2)
        values, inside = values[::-1][:k], inside[:, ::-1][:, :k]
        found = basis @ inside
        residual = float(np.abs(image @ inside - found * values).max() / max(values[0], np.finfo(float).tiny))
        if residual <= RESIDUAL or rank == d:
            break
        basis = np.eye(d) if step == powers else np.linalg.qr(image)[0]
    alive = values > d * np.finfo(float).eps * trace
    found, values = found[:, alive], values[alive]
    if values.size:
        found = found * np.sign(found[np.abs(found).argmax(0), np.arange(found.shape[1])])
    scaled = found / np.sqrt(values)

    def square(x):
        white = _centred(x, n, sums) @ scaled
        return np.concatenate([(white.T @ white).ravel(), white.sum(0)])

    m = len(values)
    cells = _totals(different, m * m + m, square) / n
    covariance = cells[: m * m].reshape(m, m) - np.outer(cells[m * m :], cells[m * m :])
    return Whitening(n, sums, found, values, trace, float(np.abs(covariance - np.eye(m)).max(initial=0)), rank, residual)


def whiten(rows: DataFrame, fitted: Whitening | None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row of vectors and each component.

    Nothing without a fit, or where all vectors are the same. Rows that repeat stay as often as they come.
    """
    sql = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    id_type = rows.schema["vec_id"].dataType.simpleString()
    if fitted is None or not fitted.values.size:
        return rows.sparkSession.createDataFrame([], f"vec_id {id_type}, {sql}")
    scaled, m = fitted.components / np.sqrt(fitted.values), len(fitted.values)
    explained = fitted.values / fitted.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _matrices([batch], 1):
                rows = len(x)
                columns = [
                    batch.column(0).take(pa.array(np.repeat(np.arange(rows), m))),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * m, fitted.n)),
                    pa.array(np.repeat(_deviations(x, fitted.n, fitted.sums), m)),
                    pa.array((fitted.centred(x) @ scaled).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * m, fitted.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {id_type}, {sql}")
