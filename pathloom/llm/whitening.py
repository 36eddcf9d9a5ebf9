"""Whitening of vectors by their main components: a randomised range finder with power passes.

Components of the distinct integer vectors (a written table, read once a pass) start as a
random basis of a few more directions than asked for. Each pass multiplies the covariance
by the basis: every task centres its rows, then sums x (x'Q), so that no covariance of all
dimensions is needed. The Rayleigh-Ritz step, on a matrix of the basis' size, gives components
and the exact residuals |V u - e u|. If those of a few passes stay above what double
precision allows, the basis becomes that of all dimensions and one more pass is exact.

Tasks emit sums of the basis' size; Spark adds them by place, so that the driver gets one
matrix of dimensions by basis a pass, however many rows or tasks there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize

#: Integer components end here, so that none leaves a long.
_MOST = 2**62


@dataclass(frozen=True)
class Fit:
    """n distinct vectors of one length, their sums (exact), components as rows, eigenvalues, trace, and the basis' passes."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int
    expanded: bool


def _matrix(batch: pa.RecordBatch, dim: int, name: str = "x") -> np.ndarray:
    return batch.column(batch.schema.names.index(name)).flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(batch.num_rows, dim)


def _total(table: DataFrame, dim: int, size: int, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``add(matrix of rows)``, a flat array of ``size`` numbers, added up by Spark place by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = add(_matrix(batch.slice(at, step), dim))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total.astype(np.float64))], names=["place", "value"])

    step = max(1, 4_000_000 // (8 * dim))
    parts = map_batches(table.select("x"), run, "place int, value double")
    out = np.zeros(size)
    for place, value in parts.groupBy("place").agg(F.sum("value").alias("value")).collect():  # ``size`` rows
        out[place] = value
    return out


def _sums(table: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The rows and the exact sums of their components: high and low halves apart, as decimals."""
    parts = table.select(F.posexplode("x").alias("place", "value")).groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(20,0)")).alias("s"))
    rows = {r["place"]: (r["n"], int(r["s"])) for r in parts.collect()}  # one row a dimension
    return rows[0][0], [rows[i][1] for i in range(dim)]


def _mean(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole numbers and the rest below one, so that subtracting it loses nothing of large vectors."""
    whole = [s // n for s in sums]
    return np.array(whole, dtype=np.int64), np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])


def _centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    if np.abs(x).max(initial=0) < _MOST // 2 and np.abs(mean[0]).max(initial=0) < _MOST // 2:
        return (x - mean[0]).astype(np.float64) - mean[1]
    return (x.astype(np.float64) - mean[0]) - mean[1]


def fit(table: DataFrame, dim: int, *, components: int = 4, oversample: int = 12, passes: int = 6, tolerance: float = 1e-12, seed: int = 17) -> Fit:
    """Components of the rows of ``table`` (x: array of ``dim`` longs), each row counted once.

    Residuals at or under ``tolerance`` times the largest eigenvalue end the passes. Directions in
    which the rows do not vary (beyond rounding) are no components, so there may be fewer than asked for;
    one row, or equal rows, have none. Equal eigenvalues leave their components' directions
    open, as in any method.
    """
    n, sums = _sums(table, dim)
    mean = _mean(n, sums)
    width = min(dim, components + oversample)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, width)))[0]
    done, expanded = 0, width == dim
    if expanded:
        basis = np.eye(dim)
    while True:

        def add(x: np.ndarray, q: np.ndarray = basis) -> np.ndarray:
            c = _centred(x, mean)
            return np.concatenate([(c.T @ (c @ q)).ravel(), (c * c).sum(axis=0)])

        flat = _total(table, dim, dim * basis.shape[1] + dim, add) / n
        image, trace = flat[: -dim].reshape(dim, -1), math.fsum(flat[-dim:])
        done += 1
        small = basis.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        ritz, images = basis @ vectors, image @ vectors
        found = min(components, dim)
        residuals = np.sqrt(((images[:, :found] - ritz[:, :found] * values[:found]) ** 2).sum(axis=0))
        if expanded or not values[0] > 0 or (residuals <= tolerance * values[0]).all():
            break
        if done >= passes:
            basis, expanded = np.eye(dim), True
        else:
            basis = np.linalg.qr(images)[0]
    real = values[:found] > 1e-11 * max(values[0], 0.0)
    found = int(real.sum()) if values[0] > 0 else 0
    units = ritz[:, :found] / np.sqrt((ritz[:, :found] ** 2).sum(axis=0))
    return Fit(n, sums, units.T.copy(), values[:found].copy(), trace, done, expanded)


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over dimensions of (n*x - S)^2, exact; null if beyond a long."""
    most = n * int(np.abs(x).max(initial=0)) + max(abs(s) for s in sums)
    if most * most * x.shape[1] < 2**63:
        d = n * x - np.array(sums, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


def whiten(vectors: DataFrame, *, scale: int = 256, components: int = 4, **options: float) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row of ``vectors`` (vec_id, embedding) and component.

    Rows whose vector is null, empty or holds null or non-finite entries are left out. Entries become
    floor(scale * entry), held within +-2^62. Vectors of each length are whitened among
    themselves. The fit counts each distinct vector once; rows with null or repeated vec_id,
    and repeated rows, are rows of their own. A component in which the fit's vectors do not vary does
    not exist and gives no row, so that one distinct vector gives none, nor does an empty table.
    ``deviation`` is null where it is beyond a long. Other columns are ignored.
    """
    e = F.col("embedding")
    fine = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    held = lambda c: F.greatest(F.lit(float(-_MOST)), F.least(F.lit(float(_MOST)), F.floor(c.cast("double") * scale).cast("double")))
    whole = F.transform(e, lambda c: F.when(F.abs(c.cast("double") * scale) < 2.0**62, F.floor(c.cast("double") * scale)).otherwise(held(c).cast("long")))
    rows = vectors.select("vec_id", "embedding").filter(F.coalesce(fine, F.lit(False))).select("vec_id", whole.alias("x"))
    distinct = materialize(rows.groupBy("x").agg(F.lit(1).alias("_one")).select("x", F.size("x").alias("dim")), "whitening-fit")
    out = None
    for (dim,) in sorted(distinct.select("dim").distinct().collect()):  # lengths of vectors, a few
        found = fit(distinct.filter(F.col("dim") == dim), dim, components=components, **options)
        if len(found.eigenvalues):
            part = _project(rows.filter(F.size("x") == dim), dim, found, identity_error(distinct.filter(F.col("dim") == dim), dim, found))
            out = part if out is None else out.unionByName(part)
    schema = _schema(dict(vectors.dtypes)["vec_id"])
    return vectors.sparkSession.createDataFrame([], schema) if out is None else out


def _schema(kind: str) -> str:
    return f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _scores(x: np.ndarray, found: Fit, mean: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (_centred(x, mean) @ found.components.T) / np.sqrt(found.eigenvalues)


def identity_error(table: DataFrame, dim: int, found: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over the fit's rows."""
    k, mean = len(found.eigenvalues), _mean(found.n, found.sums)

    def add(x: np.ndarray) -> np.ndarray:
        y = _scores(x, found, mean)
        return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

    flat = _total(table, dim, k * k + k, add) / found.n
    middle = flat[-k:]
    return float(np.abs(flat[:-k].reshape(k, k) - np.outer(middle, middle) - np.eye(k)).max())


def _project(rows: DataFrame, dim: int, found: Fit, error: float) -> DataFrame:
    k, mean = len(found.eigenvalues), _mean(found.n, found.sums)
    explained = found.eigenvalues / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, m = _matrix(part, dim), part.num_rows
                repeated = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(repeated), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, found.n)),
                        pa.array(_deviation(x, found.n, found.sums), pa.int64()).take(repeated), pa.array(_scores(x, found, mean).ravel()),
                        pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return map_batches(rows.select("vec_id", "x"), run, _schema(dict(rows.dtypes)["vec_id"]))
