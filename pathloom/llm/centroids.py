"""Clustering of vectors around centroids, with the exponion search in place of full scans.

Every vector carries its cluster and two bounds: its distance to its centroid is at most
``upper``, to any other at least ``lower``. When centroids move, bounds follow by how far
they moved, and a vector whose upper bound stays strictly below its lower one, or below half the
way from its centroid to the next, cannot change. Others measure the distance to their
centroid and, if that does not settle it, scan only centroids inside a ball around their
centroid: of radius twice that distance plus the way to the next centroid, from lists of centroids
sorted by distance. A centroid as near as a vector's own is at most twice that distance from it, so
the ball, its rim included, holds all ties; the smaller number wins them.

Vectors and centroids are whole numbers and distances compared are exact integers; bounds are
rounded outwards. State is a written table a round; tasks emit a count and sums a cluster,
which Spark adds up, so that the driver sees centroids only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, release

#: Components are held within this, so that sums of squares of 64 differences fit in a long; rows of a step.
_MOST, _STEP = 2**27, 8192
_SLACK = 1e-9
_STATE = "vec_id long, x array<int>, cluster int, upper double, lower double, distance long, scanned long"


@dataclass(frozen=True)
class Centres:
    """Centroids as rows of whole numbers, and for each the others by distance: numbers, and distances rounded down."""

    at: np.ndarray
    order: np.ndarray
    far: np.ndarray

    @classmethod
    def of(cls, at: np.ndarray) -> Centres:
        between = np.sqrt(squares(at, at).astype(np.float64)) * (1 - _SLACK)
        np.fill_diagonal(between, -1.0)  # its own first
        order = np.argsort(between, axis=1, kind="stable")
        return cls(at, order, np.take_along_axis(between, order, axis=1))

    @property
    def next(self) -> np.ndarray:
        """A lower bound of the distance from each centroid to the nearest other."""
        return self.far[:, 1] if len(self.at) > 1 else np.full(len(self.at), np.inf)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all rows of ``b``."""
    most = int(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    if 4 * most * most * a.shape[1] < 2**53:  # products in double precision are exact then
        left, right = a.astype(np.float64), b.astype(np.float64)
        return ((left * left).sum(axis=1)[:, None] - 2 * (left @ right.T) + (right * right).sum(axis=1)[None, :]).astype(np.int64)
    left = a.astype(np.int64)
    return np.stack([((left - row) ** 2).sum(axis=1) for row in b.astype(np.int64)], axis=1)


def own_squares(x: np.ndarray, centres: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    d = x.astype(np.int64) - centres[cluster]
    return (d * d).sum(axis=1)


def assign(x: np.ndarray, centres: Centres, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
    """(cluster, upper, lower, exact squared distance, centroids scanned) of rows whose bounds hold for these centroids."""
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    scanned = np.zeros(len(x), dtype=np.int64)
    distance = own_squares(x, centres.at, cluster)
    nearest = centres.next[cluster]
    open_ = np.flatnonzero(~(upper < np.maximum(lower, nearest / 2)))
    upper[open_] = np.sqrt(distance[open_].astype(np.float64)) * (1 + _SLACK)
    open_ = open_[~(upper[open_] < np.maximum(lower[open_], nearest[open_] / 2))]
    radius = (2 * upper[open_] + nearest[open_]) * (1 + _SLACK)
    for a in np.unique(cluster[open_]).tolist():
        mine = open_[cluster[open_] == a]
        ball = np.searchsorted(centres.far[a], radius[cluster[open_] == a], side="right")
        rings = 1 << np.ceil(np.log2(np.maximum(ball, 1))).astype(np.int64)  # balls of like size together
        for ring in np.unique(rings).tolist():
            rows = mine[rings == ring]
            near = np.sort(centres.order[a, : min(ring, len(centres.at))])
            found = squares(x[rows], centres.at[near])
            best = found.argmin(axis=1)  # the first of equals, so the smallest number
            scanned[rows] = len(near)
            cluster[rows], distance[rows] = near[best], found[np.arange(len(rows)), best]
            found[np.arange(len(rows)), best] = np.iinfo(np.int64).max
            second = np.sqrt(found.min(axis=1).astype(np.float64)) if len(near) > 1 else np.full(len(rows), np.inf)
            if len(near) < len(centres.at):  # those outside the ball are this far at least
                second = np.minimum(second, centres.far[a, len(near)] - np.sqrt(own_squares(x[rows], centres.at, np.full(len(rows), a)).astype(np.float64)) * (1 + _SLACK))
            upper[rows] = np.sqrt(distance[rows].astype(np.float64)) * (1 + _SLACK)
            lower[rows] = np.maximum(second * (1 - _SLACK), 0.0)
    return cluster, upper, lower, distance, scanned


def _round(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """The state after centroids moved from ``old`` to ``new``."""
    centres = Centres.of(new)
    moved = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1)) * (1 + _SLACK)
    first, largest = int(moved.argmax()), np.sort(moved)
    others = np.full(len(new), largest[-1])
    others[first] = largest[-2] if len(new) > 1 else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                column = lambda name, p=part: p.column(p.schema.names.index(name))
                x = _rows(column("x"), new.shape[1])
                cluster = column("cluster").to_numpy()
                upper, lower = column("upper").to_numpy() + moved[cluster], column("lower").to_numpy() - others[cluster]
                cluster, upper, lower, distance, scanned = assign(x, centres, cluster, upper * (1 + _SLACK), lower - np.abs(lower) * _SLACK)
                arrays = [column("vec_id"), column("x"), *(pa.array(v) for v in (cluster.astype(np.int32), upper, lower, distance, scanned))]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _STATE.split(", ")])

    return map_batches(state, run, _STATE)


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _sums(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, list[list[int]]]:
    """Counts and exact sums of each cluster's vectors: added in each task, then by Spark; k * dim rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for batch in batches:
            cluster, x = batch.column(0).to_numpy(), _rows(batch.column(1), dim)
            count += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster).tolist():
                total[c] += x[cluster == c].sum(axis=0, dtype=np.int64)
        some = np.flatnonzero(count)
        if len(some):
            place = (some[:, None] * dim + np.arange(dim)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.repeat(count[some], dim)), pa.array(total[some].ravel())], names=["place", "n", "total"])

    parts = map_batches(state.select("cluster", "x"), run, "place long, n long, total long")
    counts, sums = np.zeros(k, dtype=np.int64), [[0] * dim for _ in range(k)]
    for place, n, total in parts.groupBy("place").agg(F.sum("n"), F.sum(F.col("total").cast("decimal(20,0)"))).collect():
        counts[place // dim], sums[place // dim][place % dim] = n, int(total)
    return counts, sums


def cluster(vectors: DataFrame, *, k: int = 16, dim: int = 64, scale: int = 64, rounds: int = 3, salt: str = "1") -> DataFrame:
    """(vec_id, cluster, distance, scanned, cluster_inertia, inertia, centroid_sha256) of every kept vector of ``vectors`` (vec_id, embedding).

    Kept are vectors of exactly ``dim`` components, none null or non-finite; a component c becomes
    floor(scale * c), held within +-2^27. Centroids start as the k kept vectors whose ids have the
    smallest digests of "<salt>:<vec_id>" (a null id has none; of rows with one id, the smaller vector
    comes first), fewer if there are fewer; each of ``rounds`` rounds assigns all vectors, ties to
    the smaller number, and moves every centroid that has vectors to the floor of their mean. A last
    assignment follows. ``scanned``: centroids that the last assignment compared. Repeated
    rows and ids, and null ids, count as rows of their own. No row with an id, or an empty table, gives no rows.
    Other columns are ignored.
    """
    e = F.col("embedding")
    fine = (F.size(e) == dim) & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(e, lambda c: F.greatest(F.lit(float(-_MOST)), F.least(F.lit(float(_MOST)), F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), c.cast("double") * scale))).cast("double"))).cast("int"))
    rows = vectors.select("vec_id", "embedding").filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    start = rows.filter("vec_id is not null").orderBy(digest, "x").limit(k).select("x").collect()  # k rows
    if not start:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, scanned long, cluster_inertia long, inertia long, centroid_sha256 string")
    centres = np.array([r["x"] for r in start], dtype=np.int64)
    none = {"cluster": F.lit(0), "upper": F.lit(float("inf")), "lower": F.lit(0.0), "distance": F.lit(0).cast("long"), "scanned": F.lit(0).cast("long")}
    state, before = materialize(rows.withColumns(none), "centroid-state"), centres
    for last in [False] * rounds + [True]:
        moved = materialize(_round(state, before, centres), "centroid-state")
        release(state)
        state, before = moved, centres
        if not last:
            counts, sums = _sums(state, len(centres), dim)
            centres = np.array([[s // int(n) for s in row] if n else old.tolist() for n, row, old in zip(counts, sums, centres, strict=True)], dtype=np.int64)
    parts = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    inertia = {r["cluster"]: int(r["s"]) for r in parts}
    digests = [sha256(",".join(map(str, row)).encode()).hexdigest() for row in centres.tolist()]
    fits = lambda v: v if v < 2**63 else None
    facts = [(c, fits(inertia.get(c, 0)), fits(sum(inertia.values())), d) for c, d in enumerate(digests)]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = state.select("vec_id", "cluster", "distance", "scanned").join(F.broadcast(facts), "cluster")  # k rows
    return found.select("vec_id", "cluster", "distance", "scanned", "cluster_inertia", "inertia", "centroid_sha256")
