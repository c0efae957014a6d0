"""K-means over whole-number vectors with Drake's adaptive bounds.

Each vector keeps an upper bound on the distance to its own centroid, lower bounds on those to the several centroids that were
nearest next, in order, and one lower bound for all that remain. Centroids move, and bounds give way by as much. If the upper bound lies
below them all, the vector stays and nothing is computed; if it lies below the bound at some place of the list, only the centroids before that place are
measured; where no place certifies it, all are. Bounds are doubles with a margin above their rounding, distances are whole numbers, and ties are never certified.

A round is one pass over a written table with a row per vector. Sums of centroids change by the vectors that moved, and are added up in tasks, then by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import scratch
from tidemark.llm.vectors import matrix, packed, unpacked

#: Whole-number components are held within this, so that squared distances fit in 64 bits.
HOLD = 1 << 27
MARGIN, FAR = 1e-9, 1e300
ROWS = 4_096
_STATE = "vec_id long, x binary, cluster int, was int, used int, upper double, near binary, low binary, rest double"


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 * x), held within HOLD."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(256.0 * x), -HOLD, HOLD).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, centroids). Doubles do where all terms stay below 2^53, and are much faster."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * x.shape[1] * int(most) ** 2 < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], axis=1)


def in_order(d: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row by distance, ties by number."""
    by_id = np.argsort(ids, axis=1, kind="stable")
    d, ids = np.take_along_axis(d, by_id, 1), np.take_along_axis(ids, by_id, 1)
    by_d = np.argsort(d, axis=1, kind="stable")
    return np.take_along_axis(d, by_d, 1), np.take_along_axis(ids, by_d, 1)


@dataclass
class Bounds:
    """Of some vectors: own centroid, the upper bound on its distance, the centroids nearest next with their lower bounds, and the bound for the rest."""

    cluster: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    low: np.ndarray
    rest: np.ndarray

    @classmethod
    def measured(cls, x: np.ndarray, c: np.ndarray, kept: int) -> Bounds:
        """All centroids are measured; `kept` of them get a bound of their own."""
        d, ids = in_order(squared(x, c), np.broadcast_to(np.arange(len(c), dtype=np.int32), (len(x), len(c))))
        far = np.sqrt(d.astype(np.float64))
        return cls(ids[:, 0], far[:, 0], ids[:, 1 : kept + 1], far[:, 1 : kept + 1], far[:, kept + 1] if kept + 1 < len(c) else np.full(len(x), FAR))

    def moved(self, drift: np.ndarray, kept: int) -> None:
        """Give way to centroids that moved by drift, and leave the list `kept` places."""
        self.upper = self.upper + drift[self.cluster]
        self.low = self.low - drift[self.near]
        self.rest = np.minimum(self.rest - drift.max(), self.low[:, kept:].min(axis=1, initial=FAR))
        self.near, self.low = self.near[:, :kept], self.low[:, :kept]

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The first place of the list from which on no centroid can be nearer than, or as near as, the own one; one more than the last if there is none."""
        edges = np.concatenate([self.low[rows], self.rest[rows, None]], axis=1)
        edges = np.minimum.accumulate(edges[:, ::-1], axis=1)[:, ::-1]
        upper = self.upper[rows, None]
        sure = upper + MARGIN * (1 + upper + np.abs(edges)) < edges
        return np.where(sure.any(axis=1), sure.argmax(axis=1), edges.shape[1])

    def assign(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Find the nearest centroid of each vector; gives the place that certified it."""
        every = np.arange(len(x))
        used = self.place(every)
        open_ = every[used > 0]
        if len(open_):  # the own distance first: it often settles it
            self.upper[open_] = np.sqrt(((x[open_] - c[self.cluster[open_]]) ** 2).sum(1).astype(np.float64))
            used[open_] = self.place(open_)
        kept = self.low.shape[1]
        for n in np.unique(used[used > 0]):
            rows = every[used == n]
            if n > kept:
                new = Bounds.measured(x[rows], c, kept)
                self.cluster[rows], self.upper[rows], self.near[rows], self.low[rows], self.rest[rows] = new.cluster, new.upper, new.near, new.low, new.rest
                continue
            ids = np.concatenate([self.cluster[rows, None], self.near[rows, :n]], axis=1)
            d, ids = in_order(((x[rows, None, :] - c[ids]) ** 2).sum(2), ids)
            far = np.sqrt(d.astype(np.float64))
            self.cluster[rows], self.upper[rows], self.near[rows, :n], self.low[rows, :n] = ids[:, 0], far[:, 0], ids[:, 1:], far[:, 1:]
        return used


def _rows(ids: pa.Array, x: np.ndarray, b: Bounds, was: np.ndarray, used: np.ndarray) -> pa.RecordBatch:
    ints = lambda v: pa.array(np.asarray(v, np.int32))
    return pa.RecordBatch.from_arrays([ids, packed(x.astype("<i4")), ints(b.cluster), ints(was), ints(used), pa.array(b.upper), packed(b.near.astype("<i4")), packed(b.low.astype("<f8")), pa.array(b.rest)], [f.split()[0] for f in _STATE.split(", ")])


def _started(rows: DataFrame, c: np.ndarray, dim: int, kept: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = whole(matrix(part.column(1), dim))
                yield _rows(part.column(0), x, Bounds.measured(x, c, kept), np.full(len(x), -1), np.full(len(x), kept + 1))

    return rows.mapInArrow(run, _STATE)


def _stepped(state: DataFrame, c: np.ndarray, drift: np.ndarray, held: int, kept: int) -> DataFrame:
    """state after a move of the centroids to c. held: places of the lists as they are; kept: as they shall be."""
    dim = c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, was = unpacked(part.column("x"), dim, "<i4").astype(np.int64), part.column("cluster").to_numpy()
                b = Bounds(was.copy(), part.column("upper").to_numpy(), unpacked(part.column("near"), held, "<i4").copy(), unpacked(part.column("low"), held, "<f8").copy(), part.column("rest").to_numpy())
                b.moved(drift, kept)
                yield _rows(part.column("vec_id"), x, b, was, b.assign(x, c))

    return state.mapInArrow(run, _STATE)


def _changes(state: DataFrame, k: int, dim: int) -> tuple[list[list[int]], list[int]]:
    """What the vectors that moved change in each centroid's count and sums, and how many vectors each place certified. k + 1 rows of numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, places = np.zeros((k, dim + 1), np.int64), np.zeros(k + 2, np.int64)
        for batch in batches:
            places += np.bincount(batch.column("used").to_numpy(), minlength=k + 2)
            moved = batch.filter(batch.column("x").is_valid())
            if moved.num_rows:
                x = np.concatenate([np.ones((moved.num_rows, 1), np.int64), unpacked(moved.column("x"), dim, "<i4")], axis=1)
                now, was = moved.column("cluster").to_numpy(), moved.column("was").to_numpy()
                np.add.at(total, now, x)
                np.subtract.at(total, was[was >= 0], x[was >= 0])
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, k), pa.int32()), pa.array([places.tolist(), *total.tolist()], pa.list_(pa.int64()))], ["key", "v"])

    parts = state.select("cluster", "was", "used", F.when(F.col("cluster") != F.col("was"), F.col("x")).alias("x")).mapInArrow(run, "key int, v array<long>")
    summed = parts.select("key", F.posexplode("v").alias("pos", "n")).groupBy("key", "pos").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    places, total = [0] * (k + 2), [[0] * (dim + 1) for _ in range(k)]
    for r in summed.collect():
        (places if r["key"] < 0 else total[r["key"]])[r["pos"]] = int(r["n"])
    return total, places


def _fewer(places: list[int], kept: int, k: int) -> int:
    """Places to keep: the fewest, but k / 8, that certified 99 of 100 of those vectors that some place did."""
    served = places[: kept + 1]
    share, n = 0, 0
    for n, count in enumerate(served):  # noqa: B007
        share += count
        if share * 100 >= 99 * sum(served):
            break
    return min(kept, max(n, -(-k // 8)))


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: str = "2") -> DataFrame:
    """Per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid (final, array of long).

    Only vectors of exactly dim components, none null or not finite, take part, as whole numbers floor(256 * x). Centroids start as
    the k vectors with the least sha256 of `seed:vec_id`. In each round every vector goes to the nearest centroid, of equally near ones to the smaller number, and
    every centroid that has vectors becomes their mean, rounded down; then vectors are assigned once more.

    Edge cases: rows that share a vec_id are vectors of their own, and of equal hashes the least vector starts first; a null vec_id starts last. Fewer
    than k vectors make as many centroids. Equal vectors and starts that coincide leave centroids empty, which stay. Components beyond 2^27 (x beyond 524,288) count as 2^27, and inertias
    stop at 2^63 - 1. No vector at all gives an empty table. Other columns are not read.
    """
    v = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    good = (F.size("x") == dim) & ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("x")).where(F.col("x").isNotNull() & good)
    first = rows.select("x", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("sha")).orderBy(F.col("sha").asc_nulls_last(), "x").limit(k).collect()
    spark, k = vectors.sparkSession, len(first)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not k:
        return spark.createDataFrame([], schema)
    c = whole(np.array([r["x"] for r in first], np.float64).reshape(k, dim))
    kept = min(-(-k // 4), k - 1)
    state, path = scratch.stored(_started(rows, c, dim, kept), "bounds")
    sums = [[0] * (dim + 1) for _ in range(k)]
    for _ in range(rounds):
        change, places = _changes(state, k, dim)
        sums = [[a + b for a, b in zip(one, more, strict=True)] for one, more in zip(sums, change, strict=True)]
        new = np.array([[s // one[0] for s in one[1:]] if one[0] else old for one, old in zip(sums, c.tolist(), strict=True)], np.int64)
        drift = np.sqrt(((new - c) ** 2).sum(1).astype(np.float64)) * (1 + MARGIN)
        c, held, kept = new, kept, _fewer(places, kept, k)
        (state, new_path), old = scratch.stored(_stepped(state, c, drift, held, kept), "bounds"), path
        scratch.drop(spark, old)
        path = new_path

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            apart = ((unpacked(batch.column("x"), dim, "<i4").astype(np.int64) - c[cluster]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(apart)], ["vec_id", "cluster", "distance"])

    found, _ = scratch.stored(state.select("vec_id", "cluster", "x").mapInArrow(told, "vec_id long, cluster int, distance long"), "clusters")
    scratch.drop(spark, path)
    held_in = lambda d: F.least(d, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    total = found.groupBy(F.col("cluster").alias("_cluster")).agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_own"))
    whole_sum = total.agg(F.sum("_own").alias("_all"))
    centroids = spark.createDataFrame(list(enumerate(c.tolist())), "_c int, centroid array<long>")
    told_of = centroids.join(total, F.col("_c") == F.col("_cluster")).crossJoin(F.broadcast(whole_sum))  # k rows, beside one
    return found.join(F.broadcast(told_of), F.col("cluster") == F.col("_c")).select("vec_id", "cluster", "distance", held_in(F.col("_own")).alias("cluster_inertia"), held_in(F.col("_all")).alias("inertia"), "centroid")
