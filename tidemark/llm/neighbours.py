"""Approximate nearest neighbours by cosine: NN-descent builds a neighbour graph, greedy search walks it.

Equal vectors are one node. Nodes are numbered along a rough order of space; MERGE numbers make a bucket, which keeps its nodes'
vectors and lists, BLOCK numbers a block, in which the lists of a round are solved. What tasks tell each other are rows
(key, kind, origin, data) whose data hold many numbers or vectors at once, so that exchanges carry few rows however many lists a node is in.

A round of NN-descent joins each node's list (its neighbours and those it is a neighbour of) with the
vectors and holds new members of a list against all others: neighbours of neighbours meet. A block gets each vector it needs once. Rounds
go on until lists settle, walks until the beam does.
How wide the beam must be depends on the table: a sample of queries is answered by a full scan too, and the beam is
doubled until the walk finds enough of that. Where no walk does, or one would see as much as a scan, all queries are scanned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tidemark.llm import scratch
from tidemark.llm.arrow import small_batches
from tidemark.llm.vectors import is_query, matrix, packed, ranked, unpacked, valid

#: Nodes of a block at most, about.
BLOCK = 8192
#: Rows of the sorted runs that the first graph compares, sorted runs it starts from, and neighbours a run gives.
RUN, RUNS, RUN_BEST = 1024, 4, 20
#: Nodes of a bucket.
MERGE = 1024
#: Candidates that a task holds before it cuts them to the best of each node.
HELD = 750_000
#: Share of list entries that a round still replaces when the graph counts as settled.
MOVED = 0.03
#: What rounding two unit vectors to half precision can add to or take from their cosine, at most about.
ROUNDING = 2.0**-10
#: Queries answered exactly to learn the recall of a beam.
SAMPLE = 256
#: Queries that walk together, and vectors scored at a time.
WALKERS, SCORED = 128, 4096
#: Queries and vectors that meet in one task of the full scan, about.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 8192
#: Vectors that tell the order of space.
PIVOTS = 256
#: Bytes of a row at most, about, where a row may be cut.
ROW = 1 << 20
MESSAGE = "key long, kind int, origin long, data binary"
_NAMES = ["key", "kind", "origin", "data"]


class Kinds:
    """Layouts of the data of messages; numbers of nodes take four bytes where those are enough."""

    def __init__(self, n: int, dim: int):
        self.node = np.dtype("<u4" if n < 1 << 32 else "<i8")
        self.edge = np.dtype([("u", self.node), ("w", self.node), ("s", "<f4"), ("fresh", "u1")])
        self.link = np.dtype([("v", self.node), ("m", self.node), ("fresh", "u1")])
        self.bar = np.dtype([("u", self.node), ("s", "<f4")])
        self.vector = np.dtype([("m", self.node), ("bar", "<f4"), ("vec", "<f2", (dim,))])


def _messages(key: np.ndarray, data: np.ndarray, kind: int, origin: int = 0, whole: bool = False) -> Iterator[pa.RecordBatch]:
    """data dealt out to its keys: a row for each key, or several of about ROW bytes unless whole."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    key, data = key[order], data[order]
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    step = len(data) if whole else max(1, ROW // data.dtype.itemsize)
    keys, rows, size = [], [], 0
    for a, z in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
        for i in range(a, z, step):
            keys.append(int(key[a]))
            rows.append(data[i : min(i + step, z)].tobytes())
            size += len(rows[-1])
            if size > 8 * ROW:
                yield _batch(keys, kind, origin, rows)
                keys, rows, size = [], [], 0
    if keys:
        yield _batch(keys, kind, origin, rows)


def _batch(keys: list[int], kind: int, origin: int, rows: list[bytes]) -> pa.RecordBatch:
    n = len(keys)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([origin] * n, pa.int64()), pa.array(rows, pa.binary())], _NAMES)


def _one(key: int, data: np.ndarray, kind: int, origin: int = 0) -> Iterator[pa.RecordBatch]:
    yield _batch([int(key)], kind, origin, [data.tobytes()])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)


def _mapped(messages: DataFrame, each: Callable) -> DataFrame:
    """each(key, kind, origin, data) of every message, where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield from each(*row)

    return messages.mapInArrow(run, MESSAGE)


def _met(messages: DataFrame, solve: Callable) -> DataFrame:
    """solve(key, messages of the key by rising kind), after all messages of a key were brought together. They are read one by one; tasks without a message run no Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in groupby(_rows(batches), key=lambda r: r[0]):
            yield from solve(key, rows)

    return messages.repartition("key").sortWithinPartitions("key", "kind").groupBy("key").applyInArrow(run, MESSAGE)


def _top(u: np.ndarray, w: np.ndarray, s: np.ndarray, k: int, fresh: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The k best distinct w of each u, sorted by u; of two scores of a pair the one that is not fresh."""
    fresh = np.zeros(len(u), np.uint8) if fresh is None else fresh
    order = np.lexsort((fresh, w, u))
    u, w, s, fresh = u[order], w[order], s[order], fresh[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    u, w, s, fresh = u[new], w[new], s[new], fresh[new]
    order = np.lexsort((w, -s, u))
    u, w, s, fresh = u[order], w[order], s[order], fresh[order]
    keep = np.arange(len(u)) - np.searchsorted(u, u, side="left") < k
    return u[keep], w[keep], s[keep], fresh[keep]


def _edges_of(parts: tuple[np.ndarray, ...], edge: np.dtype) -> np.ndarray:
    out = np.empty(len(parts[0]), edge)
    for name, values in zip(("u", "w", "s", "fresh"), parts, strict=True):
        out[name] = values
    return out


def _best(edges: list[np.ndarray], k: int, edge: np.dtype) -> np.ndarray:
    all_ = np.concatenate(edges)
    return _edges_of(_top(all_["u"], all_["w"], all_["s"], k, all_["fresh"]), edge)


def numbered(units: DataFrame, n: int, dim: int) -> DataFrame:
    """(u, vec_id, vec, exact) of (vec_id, vec, exact): numbers from 0 without gaps, along cells of pivots and a direction within them."""
    some = units.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("vec").toPandas()["vec"]  # a fixed number of rows
    pivots, way = np.frombuffer(b"".join(some), np.float16).reshape(-1, dim).astype(np.float32), np.random.default_rng(0).normal(size=dim).astype(np.float32)
    pivots = pivots[np.argsort(pivots @ way)]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column(1), dim, np.float16).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((x @ pivots.T).argmax(axis=1), pa.int32()), pa.array((x @ way).astype(np.float64))], ["vec_id", "vec", "exact", "cell", "along"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([task] * batch.num_rows, pa.int32()), pa.array(np.arange(seen, seen + batch.num_rows))], ["vec_id", "vec", "exact", "task", "nth"])
            seen += batch.num_rows

    order = "cell", "along", F.xxhash64("vec_id")
    spread = units.mapInArrow(placed, "vec_id long, vec binary, exact binary, cell int, along double").repartitionByRange(min(4096, max(1, n // (4 * RUN))), *order)
    rows, path = scratch.stored(spread.sortWithinPartitions(*order).mapInArrow(counted, "vec_id long, vec binary, exact binary, task int, nth long"), "nn-ordered")
    sizes = {r["task"]: r["count"] for r in rows.groupBy("task").count().collect()}  # a row for each of 4096 tasks at most
    heads = np.zeros(max(sizes) + 1, np.int64)
    for task, size in sizes.items():
        heads[task] = size
    heads = np.cumsum(heads) - heads

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(heads[batch.column(3).to_numpy()] + batch.column(4).to_numpy()), *batch.columns[:3]], ["u", "vec_id", "vec", "exact"])

    nodes, _ = scratch.stored(rows.mapInArrow(number, "u long, vec_id long, vec binary, exact binary"), "nn-nodes")
    scratch.drop(units.sparkSession, path)
    return nodes


def _first_graph(rows: DataFrame, n: int, dim: int, k: int, seed: int, kinds: Kinds) -> DataFrame:
    """Edges, as messages to buckets: the best of each run of nodes (vec_id, vec) sorted along a random direction."""
    way = np.random.default_rng(seed).normal(size=dim).astype(np.float32)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column(1), dim, np.float16).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x @ way).astype(np.float64))], ["vec_id", "vec", "along"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(run: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids, x = run.column(0).to_numpy(), unpacked(run.column(1), dim, np.float16).astype(np.float32)
            if len(ids) > 1:
                s = x @ x.T
                np.fill_diagonal(s, -2)
                m = min(k, len(ids) - 1)
                j = np.argpartition(-s, m - 1, axis=1)[:, :m]
                edges = _edges_of((np.repeat(ids, m), ids[j].ravel(), np.take_along_axis(s, j, 1).ravel(), 1), kinds.edge)
                yield from _messages(edges["u"] // MERGE, edges, 1)

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= 2 * RUN:
                table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                yield from solve(table.slice(0, RUN))
                held = [table.slice(RUN)]
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    spread = rows.mapInArrow(project, "vec_id long, vec binary, along double")
    order = "along", F.xxhash64("vec_id")  # by hash after that, or all nodes at one place would share a task
    return spread.repartitionByRange(max(1, n // (4 * RUN)), *order).sortWithinPartitions(*order).mapInArrow(compare, MESSAGE)


def _merged(messages: DataFrame, k: int, kinds: Kinds) -> tuple[DataFrame, str]:
    """The stored graph: a message for each bucket with the k best edges of its nodes, its origin the number of fresh ones. Edges come as kind 0 (known) and 1 (fresh)."""

    def solve(bucket: int, rows: Iterator) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, _, _, data in rows:
            held.append(np.frombuffer(data, kinds.edge))
            size += len(held[-1])
            if size > HELD:
                held = [_best(held, k, kinds.edge)]
                size = len(held[0])
        best = _best(held, k, kinds.edge)
        yield from _one(bucket, best, 0, int(best["fresh"].sum()))

    return scratch.stored(_met(messages, solve), "nn-graph")


def _sampled(links: np.ndarray, most: int) -> np.ndarray:
    """Of each v a hashed choice of `most` links, fresh ones first."""
    mixed = (links["v"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (links["m"].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    links = links[np.lexsort((mixed, 1 - links["fresh"], links["v"]))]
    return links[np.arange(len(links)) - np.searchsorted(links["v"], links["v"], side="left") < most]


def _adjacency(graph: DataFrame, per: int, reverse: int, kinds: Kinds, then: Callable = _one) -> DataFrame:
    """What `then` makes of groups of `per` nodes and their links (v, m, fresh), sorted by v, to a node's neighbours and to `reverse` of those it is a neighbour of; by itself a message of kind 1."""

    def send(bucket: int, kind: int, origin: int, data: bytes) -> Iterator[pa.RecordBatch]:
        edges = np.frombuffer(data, kinds.edge)
        for kind, (v, m) in enumerate((("u", "w"), ("w", "u"))):
            links = np.empty(len(edges), kinds.link)
            links["v"], links["m"], links["fresh"] = edges[v], edges[m], edges["fresh"]
            links = _sampled(links, reverse) if kind else links
            yield from _messages(links["v"] // per, links, kind)

    def solve(group: int, rows: Iterator) -> Iterator[pa.RecordBatch]:
        ahead, back, size = [], [np.zeros(0, kinds.link)], 0
        for _, kind, _, data in rows:
            links = np.frombuffer(data, kinds.link)
            (back if kind else ahead).append(links)
            size += len(links) * kind
            if size > HELD:
                back = [_sampled(np.concatenate(back), reverse)]
                size = len(back[0])
        links = np.concatenate((*ahead, _sampled(np.concatenate(back), reverse)))
        links = links[np.lexsort((1 - links["fresh"], links["m"], links["v"]))]
        new = np.ones(len(links), bool)
        new[1:] = (links["v"][1:] != links["v"][:-1]) | (links["m"][1:] != links["m"][:-1])
        yield from then(group, links[new], 1)

    return _met(_mapped(graph, send), solve)


def _blocks(n: int) -> int:
    """Blocks of n nodes. No least number: it would hide on small tables that vectors sent grow with nodes x blocks."""
    return max(1, -(-n // BLOCK))


def _packs(nodes: DataFrame, dim: int) -> DataFrame:
    """Messages of kind 0 to buckets: their vectors, the origin being the first one's place in the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, data = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            cuts = np.flatnonzero(np.append(True, (u[1:] // MERGE != u[:-1] // MERGE) | (u[1:] != u[:-1] + 1)))
            for a, z in zip(cuts, np.append(cuts[1:], len(u)), strict=True):
                yield _batch([int(u[a] // MERGE)], 0, int(u[a] % MERGE), [b"".join(data[a:z])])

    return nodes.select("u", "vec").mapInArrow(run, MESSAGE)


def _fetched(messages: DataFrame, dim: int, kinds: Kinds, reply: int) -> DataFrame:
    """Vectors, sent back as messages of a kind to those who ask for them: kind 0 are packs, kind 1 bars of nodes, kind 2 asked numbers, the origin being who asks."""

    def solve(bucket: int, rows: Iterator) -> Iterator[pa.RecordBatch]:
        vecs, bars, asked = np.zeros((MERGE, dim), np.float16), np.full(MERGE, -2, np.float32), {}
        for _, kind, origin, data in rows:
            if kind == 0:
                x = np.frombuffer(data, np.float16).reshape(-1, dim)
                vecs[origin : origin + len(x)] = x
            elif kind == 1:
                got = np.frombuffer(data, kinds.bar)
                bars[got["u"] % MERGE] = got["s"]
            else:
                asked.setdefault(origin, []).append(np.frombuffer(data, kinds.node))
        for who, parts in asked.items():
            ids = np.unique(np.concatenate(parts))
            out, at = np.empty(len(ids), kinds.vector), ids % MERGE
            out["m"], out["bar"], out["vec"] = ids, bars[at], vecs[at]
            yield from _one(who, out, reply)

    return _met(messages, solve)


def _round(packs: DataFrame, graph: DataFrame, dim: int, k: int, reverse: int, each: int, kinds: Kinds) -> tuple[DataFrame, str]:
    """The graph after one round, and its path."""
    spark = graph.sparkSession

    def ask(block: int, links: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
        """Lists with anything fresh stay (kind 1), and their members are asked for (kind 2)."""
        begins = np.flatnonzero(np.append(True, links["v"][1:] != links["v"][:-1]))
        fresh = np.repeat(np.maximum.reduceat(links["fresh"], begins) > 0, np.diff(np.append(begins, len(links))))
        links = links[fresh]
        if len(links):
            yield from _one(block, links, kind)
            ids = np.unique(links["m"])
            yield from _messages(ids // MERGE, ids, 2, block)

    def bars(bucket: int, kind: int, origin: int, data: bytes) -> Iterator[pa.RecordBatch]:
        edges = np.frombuffer(data, kinds.edge)
        u = edges["u"]
        first = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        full = np.diff(np.append(first, len(u))) >= k
        out = np.empty(int(full.sum()), kinds.bar)
        out["u"], out["s"] = u[first][full], np.minimum.reduceat(edges["s"], first)[full]
        yield from _one(bucket, out, 1)

    def solve(block: int, rows: Iterator) -> Iterator[pa.RecordBatch]:
        held, found, size, index = [], [], 0, None
        for _, kind, _, data in rows:
            if kind == 0:
                held.append(np.frombuffer(data, kinds.vector))
                continue
            if index is None:
                index = np.concatenate(held)
                index, held = index[np.argsort(index["m"])], []
            for part in _joined(np.frombuffer(data, kinds.link), index, each, kinds.edge):
                found.append(part)
                size += len(part)
                if size > HELD:
                    found = [_best(found, k, kinds.edge)]
                    size = len(found[0])
        if found:
            best = _best(found, k, kinds.edge)
            yield from _messages(best["u"] // MERGE, best, 1)

    def known(bucket: int, kind: int, origin: int, data: bytes) -> Iterator[pa.RecordBatch]:
        edges = np.frombuffer(data, kinds.edge).copy()
        edges["fresh"] = 0
        yield from _one(bucket, edges, 0)

    asked, path = scratch.stored(_adjacency(graph, BLOCK, reverse, kinds, ask), "nn-asked")
    vectors = _fetched(packs.unionByName(_mapped(graph, bars)).unionByName(asked.where("kind = 2")), dim, kinds, 0)
    better = _met(vectors.unionByName(asked.where("kind = 1")), solve)
    made = _merged(_mapped(graph, known).unionByName(better), k, kinds)
    scratch.drop(spark, path)
    return made


def _joined(links: np.ndarray, index: np.ndarray, each: int, edge: np.dtype) -> Iterator[np.ndarray]:
    """Edges between members of the same list, one of which at least is fresh: the `each` best of every member, if they beat its bar."""
    begins = np.flatnonzero(np.append(True, links["v"][1:] != links["v"][:-1]))
    sizes = np.diff(np.append(begins, len(links)))
    links = links[np.lexsort((1 - links["fresh"], np.repeat(np.arange(len(sizes)), sizes)))]  # fresh ones first
    fresh = np.add.reduceat(links["fresh"], begins, dtype=np.int64)
    ids, bar = index["m"], index["bar"]
    at = np.searchsorted(ids, links["m"])
    order = np.argsort(fresh, kind="stable")  # lists with as many fresh members together
    for a in range(0, len(order), 64):
        some = order[a : a + 64]
        wide, first = int(sizes[some].max()), int(fresh[some].max())
        if wide < 2:
            continue
        real = np.arange(wide) < sizes[some, None]
        who = np.zeros((len(some), wide), np.int64)
        who[real] = at[np.concatenate([np.arange(begins[i], begins[i] + sizes[i]) for i in some])]
        own = index["vec"][who].astype(np.float32)
        s = own[:, :first] @ own.transpose(0, 2, 1)
        s[~(np.arange(first) < fresh[some, None])] = -2
        s[np.broadcast_to(~real[:, None, :], s.shape)] = -2
        s[:, np.arange(first), np.arange(first)] = -2
        m = min(each, wide - 1)
        j = np.argpartition(-s, m - 1, axis=2)[:, :, :m]
        yield _pairs(np.broadcast_to(who[:, :first, None], j.shape), np.take_along_axis(np.broadcast_to(who[:, None, :], s.shape), j, 2), np.take_along_axis(s, j, 2), ids, bar, edge)
        old = s[:, :, int(fresh[some].min()) :]  # members that are not fresh, against the fresh ones
        if old.shape[2]:
            m, mine = min(each, first), who[:, int(fresh[some].min()) :]
            j = np.argpartition(-old, m - 1, axis=1)[:, :m, :]
            yield _pairs(np.broadcast_to(mine[:, None, :], j.shape), np.take_along_axis(np.broadcast_to(who[:, :first, None], old.shape), j, 1), np.take_along_axis(old, j, 1), ids, bar, edge)


def _pairs(u: np.ndarray, w: np.ndarray, s: np.ndarray, ids: np.ndarray, bar: np.ndarray, edge: np.dtype) -> np.ndarray:
    better = s > np.maximum(bar[u], -1.5)
    return _edges_of((ids[u[better]], ids[w[better]], s[better], 1), edge)


def _moved(graph: DataFrame, kinds: Kinds) -> float:
    """Share of edges that the last round put in."""
    fresh, all_ = graph.agg(F.sum("origin"), F.sum(F.octet_length("data"))).first()
    return (fresh or 0) * kinds.edge.itemsize / (all_ or 1)


def build_graph(nodes: DataFrame, packs: DataFrame, n: int, dim: int, k: int, reverse: int, each: int, kinds: Kinds, rounds: int | None = None) -> DataFrame:
    """The graph after NN-descent over (u, vec): packed unit vectors in half precision.

    Lists only ever get better, so they settle, however many rounds that takes; `rounds` stops before.
    """
    rows, starts = nodes.select(F.col("u").alias("vec_id"), "vec"), None
    for seed in range(1, RUNS + 1):
        part = _first_graph(rows, n, dim, min(k, RUN_BEST), seed, kinds)
        starts = part if starts is None else starts.unionByName(part)
    graph, path = _merged(starts, k, kinds)
    share, done = 1.0, 0
    while share >= MOVED and done != rounds:
        new, new_path = _round(packs, graph, dim, k, reverse, each, kinds)
        share, done = _moved(new, kinds), done + 1
        scratch.drop(nodes.sparkSession, path)
        graph, path = new, new_path
    return graph


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot product over the product of norms, row by row: equal rows give equal scores wherever they stand."""
    norm = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    return (a * b).sum(axis=1) / np.where(norm > 0, norm, 1)


def _originals(column: pa.Array, dim: int, kind: type) -> np.ndarray:
    """Packed original vectors as doubles, scaled by powers of two, or squares might overflow. That leaves cosines as they are."""
    x = unpacked(column, dim, kind).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def _cosines(pairs: DataFrame, dim: int, kind: type) -> DataFrame:
    """(query_id, vec_id, score) of (query_id, vec_id, qvec, vec): dot product over the product of norms, in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_originals(batch.column(i), dim, kind) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_cosine(a, b))], ["query_id", "vec_id", "score"])

    return pairs.select("query_id", "vec_id", "qvec", "vec").mapInArrow(run, "query_id long, vec_id long, score double")


#: Kinds of a walk's messages: queries with their vectors, beams, nodes seen, nodes expanded, then what comes in, and requests for lists and vectors.
_QUERY, _BEAM, _SEEN, _DONE, _IN, _LISTS, _VECTORS = range(7)


def greedy_search(packs: DataFrame, lists: DataFrame, asked: DataFrame, dim: int, k: int, beam: int, expand: int, kinds: Kinds, hops: int | None = None) -> DataFrame:
    """(q, m): for each query of asked (u, vec), the nodes that are its k best after walking the adjacency lists from its own node, best nodes first, and those that rounding may hide among them.

    WALKERS queries walk together, so that a vector comes to them once, and each is scored for all of them. A hop expands the `expand`
    best nodes of each beam that nobody has expanded. A walk ends when all of all beams are expanded; `hops` stops before.
    """
    spark, groups = asked.sparkSession, max(1, -(-asked.count() // WALKERS))
    task = asked.select(F.pmod(F.xxhash64("u"), F.lit(groups)).alias("g"), "u", "vec")
    own = np.dtype([("q", kinds.node), ("m", kinds.node), ("s", "<f4")])
    types = {_QUERY: kinds.vector, _BEAM: own, _SEEN: kinds.node, _DONE: kinds.node}

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, u = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = np.empty(len(u), kinds.vector)
            out["m"], out["bar"], out["vec"] = u, 1, unpacked(batch.column(2), dim, np.float16)
            yield from _messages(g, out, _QUERY)
            beams = np.empty(len(u), own)
            beams["q"], beams["m"], beams["s"] = u, u, 1
            yield from _messages(g, beams, _BEAM)
            yield from _messages(g, u.astype(kinds.node), _SEEN)

    def opened(rows: Iterator) -> tuple[dict[int, np.ndarray], Iterator]:
        """The state of a group, and what comes in after it."""
        parts, rest = {kind: [np.zeros(0, dtype)] for kind, dtype in types.items()}, iter(())
        for row in rows:
            if row[1] == _IN:
                rest = chain([row], rows)
                break
            parts[row[1]].append(np.frombuffer(row[3], types[row[1]]))
        return {kind: np.concatenate(held) for kind, held in parts.items()}, rest

    def front(beams: np.ndarray, done: np.ndarray, most: int) -> np.ndarray:
        """Nodes to expand next: of each beam the best that nobody has expanded."""
        beams = beams[np.lexsort((beams["m"], -beams["s"], beams["q"]))]
        beams = beams[np.arange(len(beams)) - np.searchsorted(beams["q"], beams["q"], side="left") < beam]
        left = beams[~np.isin(beams["m"], done)]
        return np.unique(left["m"][np.arange(len(left)) - np.searchsorted(left["q"], left["q"], side="left") < most])

    def listed(bucket: int, rows: Iterator) -> Iterator[pa.RecordBatch]:
        """Members of the lists asked for, sent back to the groups."""
        links, wanted = np.zeros(0, kinds.link), {}
        for _, kind, origin, data in rows:
            if kind == 1:
                links = np.concatenate((links, np.frombuffer(data, kinds.link)))
            else:
                wanted.setdefault(origin, []).append(np.frombuffer(data, kinds.node))
        for group, parts in wanted.items():
            yield from _one(group, np.unique(links["m"][np.isin(links["v"], np.concatenate(parts))]), _IN)

    def choose(group: int, rows: Iterator) -> Iterator[pa.RecordBatch]:
        """The state with what is now expanded and seen, and requests for the vectors of nodes not seen yet."""
        state, rest = opened(rows)
        members = np.unique(np.concatenate([np.zeros(0, kinds.node), *(np.frombuffer(data, kinds.node) for _, _, _, data in rest)]))
        ids = members[~np.isin(members, state[_SEEN])]
        state[_DONE] = np.union1d(state[_DONE], front(state[_BEAM], state[_DONE], expand))
        state[_SEEN] = np.union1d(state[_SEEN], ids)
        for kind, data in state.items():
            yield from _one(group, data, kind)
        yield from _messages(ids // MERGE, ids, _VECTORS, group)

    def scored(group: int, rows: Iterator) -> Iterator[pa.RecordBatch]:
        """The state with the beams after new vectors were held against all queries of the group, and requests for the lists of nodes to expand next."""
        state, rest = opened(rows)
        queries, beams = state[_QUERY], [state[_BEAM]]
        q = queries["vec"].astype(np.float32)
        least = np.full(len(queries), -2.0, np.float32)
        for _, _, _, data in rest:
            vectors = np.frombuffer(data, kinds.vector)
            for at in range(0, len(vectors), SCORED):
                part = vectors[at : at + SCORED]
                s = q @ part["vec"].astype(np.float32).T
                i, j = np.nonzero(s >= least[:, None])
                fresh = np.empty(len(i), own)
                fresh["q"], fresh["m"], fresh["s"] = queries["m"][i], part["m"][j], s[i, j]
                beams.append(fresh)
                beams = [cut(np.concatenate(beams))]
                least = bars(beams[0], queries["m"])
        state[_BEAM] = beams[0]
        for kind, data in state.items():
            yield from _one(group, data, kind)
        ids = front(state[_BEAM], state[_DONE], expand)
        yield from _messages(ids // MERGE, ids, _LISTS, group)

    def cut(all_: np.ndarray) -> np.ndarray:
        """Of each query the best of the beam, and whatever rounding cannot tell from the k best."""
        all_ = all_[np.lexsort((all_["m"], -all_["s"], all_["q"]))]
        first = np.searchsorted(all_["q"], all_["q"], side="left")
        nth = np.arange(len(all_)) - first
        kth = np.minimum(first + k, np.searchsorted(all_["q"], all_["q"], side="right") - 1)  # the query's own node is one more
        return all_[(nth <= beam) | (all_["s"] >= all_["s"][kth] - 2 * ROUNDING)]

    def bars(beams: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """What a node must score to enter a query's beam."""
        first, end = np.searchsorted(beams["q"], ids, side="left"), np.searchsorted(beams["q"], ids, side="right")
        full = end - first > beam
        last = beams["s"][np.minimum(first + beam, len(beams) - 1)]
        return np.where(full, np.minimum(last, beams["s"][np.minimum(first + k, len(beams) - 1)] - 2 * ROUNDING), -2).astype(np.float32)

    def final(group: int, rows: Iterator) -> Iterator[pa.RecordBatch]:
        beams = opened(rows)[0][_BEAM]
        beams = beams[beams["q"] != beams["m"]]
        beams = beams[np.lexsort((beams["m"], -beams["s"], beams["q"]))]
        first = np.searchsorted(beams["q"], beams["q"], side="left")
        kth = np.minimum(first + k - 1, np.searchsorted(beams["q"], beams["q"], side="right") - 1)
        yield from _one(group, beams[beams["s"] >= beams["s"][kth] - 2 * ROUNDING], 0)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, data in _rows(batches):
            got = np.frombuffer(data, own)
            yield pa.RecordBatch.from_arrays([pa.array(got["q"].astype(np.int64)), pa.array(got["m"].astype(np.int64))], ["q", "m"])

    state, path = scratch.stored(_met(task.mapInArrow(begin, MESSAGE), scored), "nn-walk")
    done = 0
    while done != hops and not (wanted := state.where(f"kind = {_LISTS}")).isEmpty():
        members = _met(lists.unionByName(wanted), listed)
        chosen, chosen_path = scratch.stored(_met(state.where(f"kind < {_IN}").unionByName(members), choose), "nn-chosen")
        vectors = _fetched(packs.unionByName(chosen.where(f"kind = {_VECTORS}").withColumn("kind", F.lit(2))), dim, kinds, _IN)
        new, new_path = scratch.stored(_met(chosen.where(f"kind < {_IN}").unionByName(vectors), scored), "nn-walk")
        scratch.drop(spark, path, chosen_path)
        state, path, done = new, new_path, done + 1
    return _met(state.where(f"kind = {_BEAM}"), final).mapInArrow(pairs, "q long, m long")


def scan(both: DataFrame, ids: DataFrame, n: int, asked: int, dim: int, k: int, kind: type) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of the `asked` queries of ids (_q), each held against all n vectors (vec_id, exact), block by block."""
    q_blocks, v_blocks = max(1, -(-asked // QUERY_BLOCK)), max(1, -(-n // VECTOR_BLOCK))

    def block(blocks: int):
        return F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")

    def all_of(blocks: int):
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        qid, vid = left["id"].to_numpy(), right["id"].to_numpy()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(qid) and len(vid):
            q, x = _originals(left["x"], dim, kind), _originals(right["x"], dim, kind)
            q_unit, x_unit = (m / np.sqrt((m * m).sum(axis=1, keepdims=True)) for m in (q, x))
            for i in range(0, len(qid), 64):
                parts = []
                for j in range(0, len(vid), 2048):
                    s = q_unit[i : i + 64] @ x_unit[j : j + 2048].T
                    other = qid[i : i + 64, None] != vid[j : j + 2048]
                    s[~other] = -2
                    if s.shape[1] > k:
                        other &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] - 1e-12  # ties are told apart by _cosine
                    a, b = np.nonzero(other)
                    parts.append((qid[i + a], vid[j + b], _cosine(q[i + a], x[j + b])))
                found.append(_top(*(np.concatenate(p) for p in zip(*parts, strict=True)), k)[:3])
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(p) for p in zip(*found, strict=True)), strict=True)))

    queries = both.join(ids, F.col("vec_id") == F.col("_q")).select(block(q_blocks).alias("a"), all_of(v_blocks).alias("b"), "vec_id", "exact").toDF("a", "b", "id", "x")
    vectors = both.select(all_of(q_blocks).alias("a"), block(v_blocks).alias("b"), "vec_id", "exact").toDF("a", "b", "id", "x")
    return ranked(queries.groupBy("a", "b").cogroup(vectors.groupBy("a", "b")).applyInArrow(meet, "query_id long, vec_id long, score double"), k)


def _copies(both: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Of equal vectors the least vec_id is the node: (vec_id, node) of all others, and (node, vec_id) of the nodes themselves. None if no vectors are equal."""
    marks = both.select(F.md5("exact").alias("_h"), "vec_id")
    twice, _ = scratch.stored(marks.groupBy("_h").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h", "node"), "nn-equal")
    if twice.isEmpty():
        return None
    others, _ = scratch.stored(marks.join(twice, "_h").where("vec_id <> node").select("vec_id", "node"), "nn-copies")
    return others, twice.select("node", F.col("node").alias("vec_id"))


def nearest_neighbours(vectors: DataFrame, k: int = 5, every: int = 50, degree: int = 40, reverse: int = 40, each: int = 8, rounds: int | None = None, beam: int = 128, expand: int = 64, hops: int | None = None, recall: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by `every`, about the k nearest by cosine among all other vectors.

    Every row is in the graph, equal vectors as one node; scores are exact cosines of the original vectors in double precision; ties go to the smaller
    vec_id. The beam is doubled from `beam`, and expand with it, until the walk finds the share `recall` of the neighbours of a sample of
    queries; if doubling gains nothing, or a walk would meet as many vectors as there are, every query is held against every vector.

    Edge cases: vectors null, zero or holding null or non-finite components take no part, nor does a row without vec_id. Rows that
    share a vec_id count once, as the largest vector. Shorter vectors count as padded with zeros. With fewer than k candidates all are
    returned; an empty table gives an empty table. Other columns are not read.
    """
    spark, kind = vectors.sparkSession, np.float32 if vectors.schema["embedding"].dataType.elementType == FloatType() else np.float64
    small_batches(spark)
    stored, path = scratch.stored(valid(vectors).where(F.exists("x", lambda v: v != 0)), "nn-vectors")
    n, dim = stored.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = packed((matrix(batch.column(1), dim) + 0.0).astype(kind))  # a zero has one sign, so that equal vectors have equal bytes
            x = _originals(exact, dim, kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), packed((x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float16)), exact], ["vec_id", "vec", "exact"])

    both, _ = scratch.stored(stored.mapInArrow(unit, "vec_id long, vec binary, exact binary"), "nn-units")
    scratch.drop(spark, path)
    ids = both.where(is_query("vec_id", every)).select("vec_id")
    if (copies := _copies(both)) is None:
        return _among_nodes(both, ids.select(F.col("vec_id").alias("_q")), dim, k, degree, reverse, each, rounds, beam, expand, hops, recall, kind)
    others, firsts = copies
    of = ids.join(others, "vec_id", "left").select("vec_id", F.coalesce("node", "vec_id").alias("_q"))  # queries and their nodes
    nodes, _ = scratch.stored(both.join(others, "vec_id", "left_anti"), "nn-distinct")
    found, _ = scratch.stored(_among_nodes(nodes, of.select("_q").distinct(), dim, k, degree, reverse, each, rounds, beam, expand, hops, recall, kind), "nn-found")
    # A node stands for all rows that hold its vector, of which no more than the first k + 1 can be an answer.
    order = F.row_number().over(W.partitionBy("node").orderBy("vec_id"))
    members = others.select("node", "vec_id").unionByName(firsts).withColumn("_i", order).where(F.col("_i") <= k + 1).select("node", "vec_id")
    mine = nodes.join(firsts.join(of, F.col("node") == F.col("_q"), "left_semi").select(F.col("node").alias("_n")), F.col("vec_id") == F.col("_n"))
    same = _cosines(mine.select(F.col("vec_id").alias("query_id"), "vec_id", F.col("exact").alias("qvec"), F.col("exact").alias("vec")), dim, kind)
    spots = found.select("query_id", F.col("vec_id").alias("node"), "score").unionByName(same.select("query_id", F.col("vec_id").alias("node"), "score"))
    spots = spots.join(members, "node", "left").select(F.col("query_id").alias("_node"), F.coalesce("vec_id", "node").alias("vec_id"), "score")
    answers = of.select(F.col("vec_id").alias("query_id"), "_q").join(spots, F.col("_q") == F.col("_node")).where("query_id <> vec_id")
    return ranked(answers.select("query_id", "vec_id", "score"), k)


def _among_nodes(units: DataFrame, ids: DataFrame, dim: int, k: int, degree: int, reverse: int, each: int, rounds: int | None, beam: int, expand: int, hops: int | None, recall: float, kind: type) -> DataFrame:
    """nearest_neighbours() of the vectors of ids (_q) among the different ones (vec_id, vec, exact)."""
    n = units.count()
    kinds, nodes = Kinds(n, dim), numbered(units, n, dim)
    packs = _packs(nodes, dim)
    graph = build_graph(nodes, packs, n, dim, degree, reverse, each, kinds, rounds)
    lists, _ = scratch.stored(_adjacency(graph, MERGE, reverse, kinds), "nn-adjacency")

    def walked(ids: DataFrame, beam: int, expand: int) -> DataFrame:
        asked = nodes.join(ids, F.col("vec_id") == F.col("_q"))
        pairs = greedy_search(packs, lists, asked.select("u", "vec"), dim, k, beam, expand, kinds, hops)
        left = asked.select(F.col("u").alias("q"), F.col("vec_id").alias("query_id"), F.col("exact").alias("qvec"))
        right = nodes.select(F.col("u").alias("m"), "vec_id", F.col("exact").alias("vec"))
        return ranked(_cosines(pairs.join(left, "q").join(right, "m"), dim, kind), k)

    sample, _ = scratch.stored(ids.orderBy(F.xxhash64("_q"), "_q").limit(SAMPLE), "nn-sample")
    best, _ = scratch.stored(scan(nodes, sample, n, SAMPLE, dim, k, kind), "nn-scanned")
    least = best.groupBy(F.col("query_id").alias("_q")).agg(F.min("score").alias("least"))
    wanted, asked, before = best.count(), ids.count(), -1.0
    while True:
        found, _ = scratch.stored(walked(sample, beam, expand), "nn-walked")
        hit = found.join(least, F.col("query_id") == F.col("_q")).where("score >= least").count() / wanted if wanted else 1.0
        if hit >= recall:
            break
        if hit <= before or 2 * beam * (degree + reverse) >= n:
            return scan(nodes, ids, n, asked, dim, k, kind)
        beam, expand, before = 2 * beam, 2 * expand, hit
    return found if asked <= SAMPLE else found.unionByName(walked(ids.join(sample, "_q", "left_anti"), beam, expand))
