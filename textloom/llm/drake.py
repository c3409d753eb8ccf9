"""k-means over whole numbers with adaptive bounds on distances (Drake).

Each vector keeps an upper bound of the distance to its own centroid, lower bounds to the several next ones, by name, and one
lower bound to all others. When centroids move, bounds move by as much. The new nearest is among those whose bounds the upper
one passes; only these are measured, and all centroids where even the bound of the rest is passed. Distances themselves are whole
numbers, so that ties are exact; bounds are floating-point with a margin."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, settle

#: Sums go by 31-bit parts, so that those of 2^32 vectors fit 64 bits whatever their size.
PART = 31
#: Below this, products and sums over a thousand components are exact in doubles.
LARGE = 2**20
#: Relative margin of bounds, far above rounding errors.
MARGIN = 1e-9


def kept(vectors: DataFrame, size: int) -> DataFrame:
    """(vec_id, embedding as doubles): vectors of ``size`` components, none null or non-finite."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where((F.size("embedding") == size) & F.coalesce(fine, F.lit(False)))


def whole(rows: list[list[float]] | np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit numbers where products and sums of their differences' squares are exact in doubles, else Python's."""
    with np.errstate(over="ignore"):
        x = np.floor(np.asarray(rows, np.float64) * scale)
    if not x.size or np.abs(x).max() < LARGE:
        return x.astype(np.int64)
    big = np.empty(x.shape, object)
    big[:] = [[int(f) if np.isfinite(f) else scale * int(y) for f, y in zip(*pair)] for pair in zip(x.tolist(), np.asarray(rows, np.float64).tolist())]
    return big


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each centroid: exact."""
    if v.dtype == object or c.dtype == object:
        v, c = v.astype(object), c.astype(object)
        return ((v[:, None, :] - c[None, :, :]) ** 2).sum(2)
    a, b = v.astype(np.float64), c.astype(np.float64)
    return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)


def _root(d: np.ndarray) -> np.ndarray:
    if d.dtype == object:  # whole numbers of any size; infinite bounds are never sure
        root = lambda x: math.sqrt(x) if x < 2**1000 else float(math.isqrt(x)) if x < 2**2040 else math.inf
        return np.array([root(int(x)) for x in d.ravel()], np.float64).reshape(d.shape)
    return np.sqrt(d.astype(np.float64))


class Bounds:
    """A batch's state: own centroid, upper bound, named next centroids in order with their lower bounds, the rest's bound."""

    def __init__(self, own, upper, near, lower, rest):
        self.own, self.upper, self.near, self.lower, self.rest = own, upper, near, lower, rest

    @classmethod
    def measured(cls, d: np.ndarray, named: int) -> Bounds:
        """From all distances."""
        order = np.argsort(d, axis=1, kind="stable")  # ties: the smaller number comes first
        root = _root(np.take_along_axis(d, order, 1))
        rest = root[:, named + 1] if d.shape[1] > named + 1 else np.full(len(d), np.inf)
        return cls(order[:, 0], root[:, 0], order[:, 1 : named + 1], root[:, 1 : named + 1], rest)

    def moved(self, by: np.ndarray) -> None:
        """Centroids have moved by these distances."""
        with np.errstate(invalid="ignore"):
            self._moved(by)

    def _moved(self, by: np.ndarray) -> None:
        self.upper = (self.upper + by[self.own]) * (1 + MARGIN)
        self.lower = np.maximum(self.lower - by[self.near], 0) * (1 - MARGIN)
        self.rest = np.maximum(self.rest - by.max(), 0) * (1 - MARGIN)

    def assign(self, v: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Find the nearest centroids again; how many distances were measured for each row."""
        asked = np.zeros(len(v), np.int64)
        if not len(v):
            return asked
        # the least bound from each place on: once the upper bound is below it, no later centroid can be nearest
        least = np.concatenate([self.lower, self.rest[:, None]], 1)
        least = np.minimum.accumulate(least[:, ::-1], axis=1)[:, ::-1]
        unsure = np.flatnonzero(~(self.upper < least[:, 0]))
        if not len(unsure):
            return asked
        own = _rowwise(v[unsure], c[self.own[unsure]])
        self.upper[unsure] = _root(own) * (1 + MARGIN)
        asked[unsure] = 1
        reach = (~(self.upper[unsure, None] < least[unsure])).sum(1)  # places to look at
        for n in np.unique(reach[reach > 0]):
            rows = unsure[reach == n]
            if n > self.near.shape[1]:
                new = Bounds.measured(distances(v[rows], c), self.near.shape[1])
                self.own[rows], self.upper[rows], self.near[rows], self.lower[rows], self.rest[rows] = new.own, new.upper, new.near, new.lower, new.rest
                asked[rows] += len(c)
                continue
            names = np.concatenate([self.own[rows, None], self.near[rows, :n]], 1)
            d = np.stack([_rowwise(v[rows], c[names[:, j]]) for j in range(n + 1)], 1)
            order = np.array([sorted(range(n + 1), key=lambda j, r=r: (d[r, j], names[r, j])) for r in range(len(rows))])
            names, d = np.take_along_axis(names, order, 1), np.take_along_axis(d, order, 1)
            self.own[rows], self.upper[rows] = names[:, 0], _root(d[:, 0])
            self.near[rows, :n], self.lower[rows, :n] = names[:, 1:], _root(d[:, 1:])
            asked[rows] += n
        return asked


def _rowwise(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row to the centroid beside it."""
    if v.dtype == object or c.dtype == object:
        v, c = v.astype(object), c.astype(object)
    return ((v - c) ** 2).sum(1)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(np.ascontiguousarray(values).reshape(-1), kind))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), width)


ROUND = "vec_id long, embedding array<double>, cluster int, upper double, near array<int>, lower array<double>, rest double, measured long"


def _assigned(rows: DataFrame, centroids: np.ndarray, moves: np.ndarray | None, size: int, scale: int, named: int) -> DataFrame:
    """Rows with their bounds after ``moves``; all distances are measured where there are none yet."""
    named = min(named, len(centroids) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = _matrix(b.column(1), size)
            v = whole(raw, scale)
            if moves is None:
                state, n = Bounds.measured(distances(v, centroids), named), np.full(len(v), len(centroids))
                before = np.zeros(len(v), np.int64)
            else:
                state = Bounds(np.array(b.column(2)).astype(np.int64), np.array(b.column(3)), _matrix(b.column(4), named).astype(np.int64), _matrix(b.column(5), named).copy(), np.array(b.column(6)))
                state.moved(moves)
                n, before = state.assign(v, centroids), np.asarray(b.column(7))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(state.own, pa.int32()), pa.array(state.upper), _lists(state.near, pa.int32()), _lists(state.lower, pa.float64()), pa.array(state.rest), pa.array(before + n, pa.int64())],
                names=["vec_id", "embedding", "cluster", "upper", "near", "lower", "rest", "measured"],
            )

    return rows.mapInArrow(run, ROUND)


def _sums(rows: DataFrame, k: int, size: int, scale: int) -> tuple[list[int], list[list[int]]]:
    """(vectors, componentwise sums) of each cluster: summed in the tasks, then by Spark; k * size rows and few parts come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, own = whole(_matrix(b.column(1), size), scale), np.asarray(b.column(0))
            out = []
            for j in np.unique(own):
                mine = v[own == j]
                # batches are small: sums of numbers below 2^21 fit
                for d, total in enumerate(mine.sum(0).tolist()):
                    part = 0
                    while True:
                        last = -(1 << PART) <= total < (1 << PART)  # it keeps the sign
                        out.append((int(j), d, part, total if last else total & ((1 << PART) - 1), len(mine) if d == part == 0 else 0))
                        if last:
                            break
                        total, part = total >> PART, part + 1
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["cluster", "d", "part", "total", "n"])

    made = rows.select("cluster", "embedding").mapInArrow(run, "cluster int, d int, part int, total long, n long")
    count, sums = [0] * k, [[0] * size for _ in range(k)]
    for r in made.groupBy("cluster", "d", "part").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        sums[r.cluster][r.d] += r.total << (PART * r.part)
        count[r.cluster] += r.n
    return count, sums


def _array(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(x) < LARGE for r in rows for x in r)
    return np.array(rows, np.int64 if small else object)


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1, named: int = 4) -> DataFrame:
    """vectors(vec_id, embedding) -> (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, measured).

    Components become floor(scale * x). Centroids start as the k vectors with the smallest sha256 of ``seed:vec_id``; each round assigns
    every vector to the nearest (ties: smaller number) and moves each centroid that has vectors to their floored mean; then vectors are
    assigned once more. ``distance`` is squared, inertias are its sums over the cluster and over all, ``measured`` the number of
    distances that were measured for the vector (the last one to its own centroid, which is always taken, left out).

    Vectors that are null, of another length, or hold null or non-finite components take no part. Repeated rows each count. Vectors
    with the same id start by their components' order; a null id is kept and starts last. Fewer than k vectors give fewer centroids,
    an empty table no rows. Components of any finite size are exact; a squared distance or a sum that doesn't fit 64 bits is null.
    Other columns are left aside."""
    spark = vectors.sparkSession
    rows = kept(vectors, size)
    hash_ = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.withColumn("h", hash_).orderBy(F.asc_nulls_last("h"), "embedding").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, measured long")
    centroids = _array([[int(x) for x in r] for r in whole([r.embedding for r in first], scale).tolist()])
    state, moves = rows, None
    for _ in range(rounds):
        table = settle(_assigned(state, centroids, moves, size, scale, named), "drake-round")
        count, sums = _sums(table, len(centroids), size, scale)
        new = _array([[s // n for s in own] if n else [int(x) for x in c] for n, own, c in zip(count, sums, centroids.tolist())])
        moves = _root(_rowwise(new, centroids)) * (1 + MARGIN)
        if state is not rows:
            discard(state)
        state, centroids = table, new
    final = settle(_measured(_assigned(state, centroids, moves, size, scale, named), centroids, size, scale), "drake-final")
    discard(state)
    by_cluster = {r.cluster: r.total for r in final.groupBy("cluster").agg(F.sum("d").alias("total")).collect()}
    missing = {r.cluster for r in final.where("d is null").select("cluster").distinct().collect()}
    total = None if missing or None in by_cluster.values() else int(sum(by_cluster.values()))
    fits = lambda x: int(x) if x is not None and x < 2**63 else None
    sha = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids.tolist()]
    figures = [(j, None if j in missing else fits(t), fits(total), sha[j]) for j, t in by_cluster.items()]
    named_ = spark.createDataFrame(figures, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(named_), "cluster").select("vec_id", "cluster", F.col("d").cast("long").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256", "measured")


def _measured(rows: DataFrame, centroids: np.ndarray, size: int, scale: int) -> DataFrame:
    """(vec_id, cluster, d, measured): the exact squared distance to the own centroid, null beyond 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.asarray(b.column(2))
            d = [x if x < 2**63 else None for x in map(int, _rowwise(whole(_matrix(b.column(1), size), scale), centroids[own]))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(d, pa.decimal128(38, 0)), b.column(3)], names=["vec_id", "cluster", "d", "measured"])

    return rows.select("vec_id", "embedding", "cluster", "measured").mapInArrow(run, "vec_id long, cluster int, d decimal(38,0), measured long")
