"""Exact top-k by inner product as a Voronoi kNN join.

An added component turns the largest inner product into the nearest neighbour: a vector x becomes
(x, sqrt(M^2 - |x|^2)), M the largest norm, and a query (q, 0). Vectors and queries go to the cell of their
nearest pivot; summaries of the cells bound how far a group of queries has to look; a vector is replicated to a group
only if the triangle inequality can't rule it out; groups are solved in blocks with exact integer scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import scratch
from tidemark.llm.arrow import small_batches
from tidemark.llm.vectors import is_query, matrix, packed, ranked, unpacked, valid

#: Queries and vectors that meet in one task at most, about: blocks are cut by hash.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 8192
#: The number of pivots is the root of that of vectors, within these bounds; the driver holds the distances between pivots.
LEAST_PIVOTS, MOST_PIVOTS = 64, 2048
_EXACT = float(1 << 53)
_LONG = float(1 << 62)


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, x): floor(scale * component) as longs, held within 2^62."""
    return valid(vectors).select("vec_id", F.transform("x", lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(_LONG)), F.lit(-_LONG)))).alias("x"))


def _lifted(x: np.ndarray, top: float, query: bool) -> np.ndarray:
    x = x.astype(np.float64)
    rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(top - (x**2).sum(axis=1), 0))
    return np.column_stack((x, rest))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0))


def _cells(rows: DataFrame, pivots: np.ndarray, dim: int, top: float, query: bool, kind: type) -> DataFrame:
    """(vec_id, vec, cell, far): packed whole numbers of a kind, the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = matrix(pa.concat_arrays([part.column(1)]), dim, np.int64)
                d = _distances(_lifted(x, top, query), pivots)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), packed(x.astype(kind)), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["vec_id", "vec", "cell", "far"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, vec binary, cell int, far double")


def _groups(counts: dict[int, int], between: np.ndarray) -> list[list[int]]:
    """Cells that hold queries, near ones together, until a group has a block of queries."""
    left, out = set(counts), []
    while left:
        own = [min(left)]
        left.remove(own[0])
        while left and sum(counts[c] for c in own) < QUERY_BLOCK:
            own.append(min(left, key=lambda c: (between[own[0], c], c)))
            left.remove(own[-1])
        out.append(own)
    return out


def _scores(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products: in doubles where all sums stay below 2^53, else in Python's integers, held within 64 bits."""
    if exact:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    made = q.astype(object) @ x.T.astype(object)
    return np.clip(made, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(qid: np.ndarray, vid: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query among parallel arrays."""
    order = np.lexsort((vid, -s.astype(np.float64) if s.dtype != np.int64 else ~s, qid))
    qid, vid, s = qid[order], vid[order], s[order]
    first = np.searchsorted(qid, qid, side="left")
    keep = np.arange(len(qid)) - first < k
    return qid[keep], vid[keep], s[keep]


def top_inner_products(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by `every`, the k largest inner products with all other vectors.

    Components are floor(scale * x); ties go to the smaller vec_id. Without `pivots` there are as many as the root of the number of vectors,
    64 to 2048, so that cells and their bounds get narrower as the table grows.

    Edge cases: vectors null or holding null or non-finite components take no part, nor does a row without vec_id. Rows that
    share a vec_id count once, as the largest vector. Shorter vectors count as padded with zeros. Components stay
    within 2^62 and scores within 64 bits. With fewer than k candidates all are returned; an empty table gives an empty table. Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows, _ = scratch.stored(quantised(vectors, scale), "quantised")
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    high = F.aggregate("x", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v.cast("double"))))
    n, dim, top, peak = rows.agg(F.count(F.lit(1)), F.max(F.size("x")), F.max(square), F.max(high)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, exact = max(dim, 1), dim * peak * peak < _EXACT
    kind = np.int16 if peak < 1 << 15 else np.int32 if peak < 1 << 31 else np.int64  # vectors travel in as few bytes as hold them
    pivots = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, int(n**0.5)))
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).toPandas()  # a fixed number of rows
    pivot = _lifted(np.array([np.pad(np.asarray(x, np.int64), (0, dim - len(x))) for x in some["x"]]).reshape(-1, dim), top, False)
    between = _distances(pivot, pivot)

    data, _ = scratch.stored(_cells(rows, pivot, dim, top, False, kind), "voronoi-data")
    asked, _ = scratch.stored(_cells(rows.where(is_query("vec_id", every)), pivot, dim, top, True, kind), "voronoi-queries")
    # Summaries: of each cell of data the k + 1 least distances to its pivot, of each cell of queries the number and the largest.
    near = data.select("cell", "far").withColumn("i", F.row_number().over(W.partitionBy("cell").orderBy("far"))).where(F.col("i") <= k + 1).toPandas()
    cells = {r["cell"]: (r["n"], r["far"]) for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    slack = 1e-6 * (1 + between.max() + float(top) ** 0.5)
    groups = _groups({c: v[0] for c, v in cells.items()}, between)
    low, up = np.full((len(groups), len(pivot)), np.inf), np.full((len(groups), len(pivot)), -np.inf)
    for g, own in enumerate(groups):
        for c in own:
            reach = cells[c][1]
            bounds = np.sort(near["far"].to_numpy() + between[c, near["cell"].to_numpy(int)] + reach)
            most = bounds[k] if len(bounds) > k else np.inf  # k + 1, as the query itself may be among them
            low[g] = np.minimum(low[g], between[c] - reach - most - slack)
            up[g] = np.maximum(up[g], between[c] + reach + most + slack)
    if dim * peak * peak >= 2.0**63:  # scores that are held within 64 bits tie where distances do not
        low[:], up[:] = -np.inf, np.inf
    group_of = np.zeros(len(pivot), np.int32)
    for g, own in enumerate(groups):
        group_of[own] = g
    held = [sum(cells[c][0] for c in own) for own in groups]
    q_blocks = np.array([max(1, -(-h // QUERY_BLOCK)) for h in held] or [1], np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many vectors each group may need."""
        left = np.zeros(len(groups), np.int64)
        for batch in batches:
            cell, far = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            left += [((far >= low[g][cell]) & (far <= up[g][cell])).sum() for g in range(len(groups))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(groups)), pa.int32()), pa.array(left)], ["g", "n"])

    # A group's queries go to as many blocks as its vectors fill, not to as many as the table would.
    left = {r["g"]: r["n"] for r in data.select("cell", "far").mapInArrow(counted, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()}  # a row for each group
    v_blocks = np.array([max(1, -(-left.get(g, 0) // VECTOR_BLOCK)) for g in range(len(groups))] or [1], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to each vector block of their query block (kind 0), vectors to each query block of the groups that may need them (kind 1)."""
        for batch in batches:
            vid, cell, far, ask = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4))
            mixed = (vid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            for g in range(len(groups)):
                mine = np.flatnonzero(ask & (group_of[cell] == g))
                wanted = np.flatnonzero(~ask & (far >= low[g][cell]) & (far <= up[g][cell]))
                for b in range(int(q_blocks[g])):
                    here = mine[mixed[mine].astype(np.int64) % q_blocks[g] == b]
                    for rows_, kind, slots in [(here, 0, range(int(v_blocks[g]))), (wanted, 1, [None])]:
                        for v in slots:
                            if len(rows_):
                                slot = np.full(len(rows_), v) if v is not None else mixed[rows_].astype(np.int64) % v_blocks[g]
                                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows_), g), pa.int32()), pa.array(np.full(len(rows_), b), pa.int32()), pa.array(slot, pa.int32()), pa.array(np.full(len(rows_), kind), pa.int32()), pa.array(vid[rows_]), batch.column(1).take(pa.array(rows_))], ["g", "b", "v", "kind", "vec_id", "vec"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, parts, best = None, [], [], None

        def done(best):
            qid, vid, s = best
            return pa.RecordBatch.from_arrays([pa.array(qid), pa.array(vid), pa.array(s)], ["query_id", "vec_id", "score"])

        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                if tuple(keys[a, :3]) != key:
                    if best is not None:
                        yield done(best)
                    key, ids, parts, best = tuple(keys[a, :3]), [], [], None
                part = batch.slice(a, z - a)
                vid, x = part.column(4).to_numpy(), unpacked(part.column(5), dim, kind)
                if keys[a, 3] == 0:
                    ids.append(vid)
                    parts.append(x)
                    continue
                if not ids:
                    continue
                qid, q = np.concatenate(ids), np.concatenate(parts)
                for at in range(0, len(vid), 2048):
                    v = vid[at : at + 2048]
                    s = _scores(q, x[at : at + 2048], exact)
                    other = qid[:, None] != v
                    if len(v) > k + 1:
                        bar = np.partition(s, len(v) - k - 1, axis=1)[:, len(v) - k - 1]  # own row may be above it
                        other &= s >= bar[:, None]
                    i, j = np.nonzero(other)
                    found = qid[i], v[j], s[i, j]
                    if best is not None:
                        found = tuple(np.concatenate(p) for p in zip(best, found, strict=True))
                    best = _best(*found, k)
        if best is not None:
            yield done(best)

    both = data.withColumn("ask", F.lit(False)).unionByName(asked.withColumn("ask", F.lit(True)))
    dealt = both.mapInArrow(deal, "g int, b int, v int, kind int, vec_id long, vec binary").repartition("g", "b", "v").sortWithinPartitions("g", "b", "v", "kind")
    return ranked(dealt.mapInArrow(solve, "query_id long, vec_id long, score long"), k)
