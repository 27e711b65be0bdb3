"""Embedding whitening: leading components of the vectors' covariance, by FEAST contour integration."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import contour
from .shared import saved
from .sums import added

STEP, LARGE = 256, 1 << 62
HALF = np.int64(32)


def finite(vec: Column) -> Column:
    """Whether there is a vector without null or non-finite entries."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def whole(vec: Column, step: int = STEP) -> Column:
    """Entries as whole numbers of 1 / step, rounded down; those beyond a long become its ends."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * step))


def rows_of(column) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of whole numbers over rows in two parts, high and low 32 bits, so that none overflows."""
    low = (x & np.int64(0xFFFFFFFF)).sum(0)
    return (x >> HALF).sum(0) + (low >> HALF), low & np.int64(0xFFFFFFFF)


class Centre:
    """Differences of whole vectors from the mean sums / count: exact while they fit, in doubles beyond."""

    def __init__(self, count: int, sums: list[int]):
        self.count, self.sums = count, sums
        self.mean = np.array([float(Fraction(s, count)) for s in sums])

    def fits(self, x: np.ndarray, power: int = 1) -> bool:
        most = self.count * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, self.sums), default=0)
        return most**power * (len(self.sums) if power > 1 else 1) < LARGE

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """count * x - sums."""
        return self.count * x - np.array(self.sums, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) / self.count if self.fits(x) else x - self.mean

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (count * x - sums) squared; null where that is beyond a long."""
        if self.fits(x, 2):
            return (self.scaled(x) ** 2).sum(1).tolist()
        exact = (sum((self.count * c - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x.tolist())
        return [d if d < 1 << 63 else None for d in exact]


def second_moments(vectors: DataFrame, centre: Centre, basis: np.ndarray | None = None) -> np.ndarray:
    """Covariance of column x over all rows, centred before multiplying, divisor count; of their projections on basis, if given."""
    size = len(centre.sums) if basis is None else basis.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = centre.centred(rows_of(batch["x"]))
            x = x if basis is None else x @ basis
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.ravel()], pa.list_(pa.float64()))], ["part", "v"])

    return added(vectors.select("x").mapInArrow(add, "part long, v array<double>"), size * size).reshape(size, size) / centre.count


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4, step: int = STEP) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Vectors are rounded down to whole numbers of 1 / step. The fit list is each distinct one
    once, however often it occurs: n vectors x with sums S. A component is a unit eigenvector of
    their covariance, numbered from 1 by falling eigenvalue e; whitened is x - S/n projected on
    it, over sqrt(e); explained is e over the trace. deviation is the sum of (n * x - S) squared,
    exact, null beyond a long. identity_error is measured on the fit list: the largest entry of
    the covariance of whitened, less the identity.

    Rows without a vector or with null or non-finite entries are left out, and so are vectors
    of other lengths than the commonest (of equally common ones the longest). Repeated rows, equal and null ids each have
    their rows. There are as many components as eigenvalues beyond rounding, `components` at most:
    none, and so no row, where all vectors are equal or there is none. Other columns are ignored.

    Plan: one shuffle of the distinct whole vectors, saved; sums, then centred products, then the
    products of whitened, each added up per partition and then in two levels (arrays of dimensions
    squared, whatever the rows). The driver holds one such matrix. Rows get theirs in a narrow pass.
    """
    rows = vectors.where(finite(F.col(vec_col))).select(F.col(id_col).alias("id"), whole(F.col(vec_col), step).alias("x"))
    schema = f"id {dict(rows.dtypes)['id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    width = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if not width:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    width = width["n"]
    rows = rows.where(F.size("x") == width)
    distinct = saved(rows.select("x").distinct())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(len(batch), *halves(rows_of(batch["x"]))) for batch in batches]
        if parts:
            whole_sum = np.concatenate([[sum(p[0] for p in parts)], *(np.sum([p[k] for p in parts], axis=0) for k in (1, 2))])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([whole_sum], pa.list_(pa.int64()))], ["part", "v"])

    found = added(distinct.mapInArrow(sums, "part long, v array<long>"), 1 + 2 * width)
    centre = Centre(int(found[0]), [(int(a) << 32) + int(b) for a, b in zip(found[1 : width + 1], found[width + 1 :], strict=True)])
    covariance = second_moments(distinct, centre)
    values, axes = contour.largest(covariance, components)
    basis, shares = axes / np.sqrt(values), values / np.trace(covariance)
    error = float(np.abs(second_moments(distinct, centre, basis) - np.eye(len(values))).max()) if len(values) else 0.0
    k = len(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch["x"])
            size = len(x) * k
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays([
                batch["id"].take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(size, centre.count)), pa.array(centre.deviations(x), pa.int64()).take(each),
                pa.array((centre.centred(x) @ basis).ravel()), pa.array(np.tile(shares, len(x))), pa.array(np.full(size, error)),
            ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema).withColumnRenamed("id", id_col)
