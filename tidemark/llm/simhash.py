"""SimHash near-dedup by the generalised pigeonhole principle.

The 64 bits are dealt into four parts, correlated bits together. Two fingerprints within `most` bits are
within threshold t_i of each other in some part i, if the t_i sum to most - 3 at least (t_i = -1 leaves a part out).
Dynamic programming picks the t_i by the number of candidate pairs, counted exactly from histograms of all
fingerprints. Each fingerprint is filed under its part values and probes their neighbourhoods; candidates are
verified on all 64 bits, and links make components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import scratch
from tidemark.llm.arrow import small_batches
from tidemark.llm.columns import quoted, spare
from tidemark.llm.components import components

BITS, PARTS = 64, 4
WIDE = BITS // PARTS
#: Rows of a block; a larger bucket is compared block by block, so that no task holds more than two.
BLOCK = 4096


def fingerprint(text: str | bytes | None, width: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the XXH64 of the word shingles; without words it is 0."""
    raw = text.encode("utf-8") if isinstance(text, str) else text or b""
    words = raw.lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(b" ".join(words), seed)]
    else:
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[: -width] + 1)).tolist()
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    n, counts = len(hashes), np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        bits = np.unpackbits(np.array(hashes[at : at + 65536], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit number, over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [fingerprint(t, width) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlations(fps: DataFrame) -> np.ndarray:
    """64 x 64 correlations of the bits over all distinct fingerprints; only 65 x 64 sums reach the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((BITS + 1, BITS), np.int64)
        for frame in frames:
            for at in range(0, len(frame), 65536):
                x = _bits(frame["fp"].to_numpy()[at : at + 65536]).astype(np.float32)
                both[:BITS] += (x.T @ x).astype(np.int64)
                both[BITS] += len(x)
        yield pd.DataFrame({"cell": np.arange(both.size), "n": both.ravel()})

    cells = fps.select("fp").mapInPandas(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros((BITS + 1) * BITS)
    both[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    both = both.reshape(BITS + 1, BITS)
    n = max(1.0, both[BITS, 0])
    mean = both[:BITS].diagonal() / n
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    return (both[:BITS] / n - np.outer(mean, mean)) / np.outer(sd, sd)


def group_bits(corr: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """Equal parts with correlated bits together: each part starts from the bit most tied to the rest and takes the closest ones."""
    tie, left, out = np.abs(corr) - np.eye(len(corr)), set(range(len(corr))), []
    for _ in range(parts):
        own = [max(left, key=lambda b: (tie[b, list(left)].sum(), -b))]
        left.remove(own[0])
        while len(own) < len(corr) // parts:
            own.append(max(left, key=lambda b: (tie[b, own].sum(), -b)))
            left.remove(own[-1])
        out.append(sorted(own))
    return out


def part_values(fps: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """(n, parts) values of the parts."""
    u = fps.view(np.uint64)
    out = np.zeros((len(fps), len(groups)), np.int64)
    for p, group in enumerate(groups):
        for i, bit in enumerate(group):
            out[:, p] |= ((u >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << i
    return out


def histograms(fps: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """(parts, 2^16) counts over all fingerprints: a table of fixed size, however many there are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = part_values(frame["fp"].to_numpy(), groups) + (np.arange(len(groups)) << WIDE)
            key, n = np.unique(values, return_counts=True)
            yield pd.DataFrame({"slot": key, "n": n})

    got = fps.select("fp").mapInPandas(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(groups) << WIDE)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(len(groups), -1)


def candidate_counts(hist: np.ndarray, most: int) -> np.ndarray:
    """(parts, most + 2): ordered pairs within t bits of each other in a part, for t = -1 .. most, by XOR convolution."""
    weight = np.array([bin(v).count("1") for v in range(hist.shape[1])])
    out = np.zeros((len(hist), most + 2))
    for p, row in enumerate(hist):
        h, step = row.copy(), 1
        while step < len(h):  # Walsh-Hadamard transform, its square, and back
            h = h.reshape(-1, 2, step)
            h = np.stack((h[:, 0] + h[:, 1], h[:, 0] - h[:, 1]), axis=1).ravel()
            step *= 2
        h, step = h * h, 1
        while step < len(h):
            h = h.reshape(-1, 2, step)
            h = np.stack((h[:, 0] + h[:, 1], h[:, 0] - h[:, 1]), axis=1).ravel()
            step *= 2
        out[p, 1:] = np.cumsum([h[weight == t].sum() / len(h) for t in range(most + 1)])
    return out


def allocate(counts: np.ndarray, most: int, n: float) -> list[int]:
    """Thresholds, one a part, from -1 up, that sum to most - parts + 1 and cost least: candidates plus n for each probe."""
    parts, balls = len(counts), [0]
    for t in range(most + 1):
        balls.append(balls[-1] + sum(1 for _ in combinations(range(WIDE), t)))
    need = most - parts + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for p in range(parts):
        new: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, most + 1):
                to, price = total + t, cost + counts[p, t + 1] + n * balls[t + 1]
                if to not in new or price < new[to][0]:
                    new[to] = (price, [*chosen, t])
        best = new
    return best[need][1]


#: Buckets of up to so many rows are compared all at once, shifted against themselves.
SMALL = 32


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= most


def _forest(fps: np.ndarray, most: int) -> np.ndarray:
    """A spanning forest of the links in a bucket: each fingerprint is held against those not reached yet only."""
    left, edges = np.unique(fps), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = _near(left, x, most)
            if near.any():
                found = left[near]
                edges.append(np.stack((np.full(len(found), x), found)))
                front += found.tolist()
                left = left[~near]
    return np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)


def _bucket_links(fp: np.ndarray, cuts: np.ndarray, most: int) -> np.ndarray:
    """(2, n) links in consecutive buckets that begin at cuts."""
    sizes = np.diff(np.append(cuts, len(fp)))
    bucket = np.repeat(np.arange(len(cuts)), sizes)
    small = sizes[bucket] <= SMALL
    own, home, out = fp[small], bucket[small], []
    for shift in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
        a, b = own[:-shift], own[shift:]
        hit = (home[:-shift] == home[shift:]) & (a != b)
        hit[hit] = _near(a[hit], b[hit], most)
        out.append(np.stack((a[hit], b[hit])))
    for at in np.flatnonzero(sizes > SMALL):
        out.append(_forest(fp[cuts[at] : cuts[at] + sizes[at]], most))
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)


def links(fps: DataFrame, most: int = 4) -> DataFrame:
    """(a, b): links among distinct fingerprints that connect exactly what all links within `most` bits connect.

    A bucket is the fingerprints filed under a part's value with the probes that reach it. A bucket of more than BLOCK
    rows is dealt into blocks, and every two blocks meet in a task of their own.
    """
    groups = group_bits(correlations(fps))
    hist = histograms(fps, groups)
    n = float(hist[0].sum())
    thresholds = allocate(candidate_counts(hist, most), most, n)
    masks = [[m for t in range(limit + 1) for m in (sum(1 << b for b in c) for c in combinations(range(WIDE), t))] if limit >= 0 else [] for limit in thresholds]
    # How many rows reach each bucket: a ball around a value gathers the counts of its neighbours.
    values = np.arange(1 << WIDE)
    loads = np.concatenate([sum((hist[p][values ^ m] for m in masks[p]), np.zeros(1 << WIDE)) for p in range(PARTS)])
    blocks = np.maximum(1, -(-loads // BLOCK)).astype(np.int32)

    def file(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fp = frame["fp"].to_numpy()
            for at in range(0, len(fp), 20_000):
                own = fp[at : at + 20_000]
                parts = part_values(own, groups)
                for p in range(PARTS):
                    for mask in masks[p]:
                        slot = (parts[:, p] ^ mask) | (p << WIDE)
                        if mask:  # of two values that differ, the one with the mask's top bit probes the other
                            keep = (parts[:, p] >> (mask.bit_length() - 1)) & 1 == 1
                            slot, some = slot[keep], own[keep]
                        else:
                            some = own
                        b = blocks[slot]
                        mine = (some.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % b
                        if (b == 1).all():
                            yield pd.DataFrame({"slot": slot, "x": 0, "y": 0, "fp": some})
                            continue
                        for other in range(int(b.max())):
                            there = other < b
                            lo, hi = np.minimum(mine, other)[there], np.maximum(mine, other)[there]
                            yield pd.DataFrame({"slot": slot[there], "x": lo, "y": hi, "fp": some[there]})

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def solve(frame: pd.DataFrame) -> pd.DataFrame:
            key = frame[["slot", "x", "y"]].to_numpy()
            cuts = np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1)
            return pd.DataFrame(dict(zip("ab", _bucket_links(frame["fp"].to_numpy(), cuts, most), strict=True)))

        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = frame.iloc[-1]
            same = (frame["slot"] == last["slot"]) & (frame["x"] == last["x"]) & (frame["y"] == last["y"])
            held, whole = frame[same], frame[~same]
            if len(whole):
                yield solve(whole)
        if held is not None and len(held):
            yield solve(held)

    filed = fps.select("fp").mapInPandas(file, "slot long, x int, y int, fp long")
    dealt = filed.repartition("slot", "x", "y").sortWithinPartitions("slot", "x", "y")
    return dealt.mapInPandas(verify, "a long, b long")


def _rooted(docs: DataFrame, most: int, width: int) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row; root is one fingerprint of the component."""
    rows, _ = scratch.stored(fingerprints(docs, width), "fingerprints")
    nodes, _ = scratch.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "nodes")
    edges = links(nodes, most)
    roots = components(edges)
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp, _ = scratch.stored(named.join(heads, "root").select(F.col("fp").alias("_fp"), "root", "component_id"), "fingerprint-components")  # a table of its own, so that the join can split a fingerprint that many rows share
    return rows.join(by_fp, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, most: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest doc_id whose fingerprint is reachable by links of at most `most` bits.

    Edge cases: null, empty or blank text has fingerprint 0, linked like any other. Equal fingerprints are one node,
    so copies never meet pairwise. Repeated doc_ids keep their rows. A row without doc_id takes part; a component of such
    rows only has a null component_id. An empty table gives an empty table.
    """
    return _rooted(docs, most, width).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, most: int = 4, width: int = 4) -> DataFrame:
    """docs with one row of each group: of its smallest doc_id.

    Edge cases: rows without doc_id always stay. Rows that share a doc_id are told apart by their fingerprints, so a text that is in no
    group with the others stays beside them; of rows that agree in both, the one with the least text stays, of equal texts the one whose
    other columns hash least, whatever the partitioning. Null, empty and blank texts are one group. An empty table gives an empty table.
    """

    def printed(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in text], np.uint64).view(np.int64))

    own_id, own_print, nth = spare(docs, "_id", "_print", "_nth")
    heads = _rooted(docs, most, width).where("doc_id = component_id")
    kept, _ = scratch.stored(heads.groupBy("root", "doc_id").agg(F.min("fp").alias(own_print)).select(F.col("doc_id").alias(own_id), own_print), "kept")
    # Fingerprints are only needed to tell rows apart that share an id: others go by it alone.
    shared = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias(own_id)).count().where("count > 1").select(own_id)
    shared, _ = scratch.stored(shared, "shared-ids")
    key = F.col("doc_id").cast("long")
    single = docs.join(shared, key == F.col(own_id), "left_anti").join(kept, key == F.col(own_id), "left_semi")
    out = single.unionByName(docs.where("doc_id is null"))
    if shared.isEmpty():
        return out
    several = docs.join(shared, key == F.col(own_id), "left_semi")
    marked = several.withColumn(own_print, F.pandas_udf(printed, "long")(F.col("text").cast("string"))).withColumn(own_id, key)
    several = marked.join(kept, [own_id, own_print], "left_semi")
    first = W.partitionBy(own_id, own_print).orderBy(F.col("text").cast("string").asc_nulls_first(), F.xxhash64(F.to_json(F.struct(*map(quoted, docs.columns)))))
    several = several.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1)
    return out.unionByName(several.drop(own_id, own_print, nth))
