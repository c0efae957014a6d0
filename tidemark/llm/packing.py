"""Best-fit packing of token sequences with large-item matching.

Lengths are whole numbers up to the capacity, so a histogram of lengths is all that packing needs: its size is
fixed, however many documents there are. Items above a third of the capacity go at most two to a bin and are matched
greedily; shorter ones take the tightest gap that holds them. The plan is a short list of runs "items i..j of
length s lie in bins b.. at offset o", and each item looks up its place by its rank among items of its length.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import scratch
from tidemark.llm.arrow import small_batches

END = 2
# Fixed value: the pre-tokenizing pattern that belongs to the byte_bpe_50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = {"<|endoftext|>": 50256}


def vocabulary(name: str = "byte_bpe_50k") -> tuple[str, str]:
    """Paths of the vocabulary for tokenizers and, as ranks, for tiktoken."""
    import public_tokenizers

    return str(public_tokenizers.path(f"{name}.json")), str(public_tokenizers.path(f"{name}.tiktoken"))


class Encoder:
    """The ids of the tokenizers file, by tiktoken's faster encoder over the same vocabulary.

    A text that this encoder cannot take (its pattern engine gives up on very long runs of blanks) goes through tokenizers.
    """

    def __init__(self, paths: tuple[str, str]):
        import tiktoken
        from tiktoken import registry

        self.paths, name = paths, f"tidemark:{paths[1]}"
        if name not in registry.ENCODINGS:  # a worker process builds it once
            with open(paths[1], "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            registry.ENCODINGS[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.fast, self.plain = registry.ENCODINGS[name], None

    def __call__(self, text: str) -> list[int]:
        try:
            return self.fast.encode(text, allowed_special="all")
        except BaseException as e:  # the engine's panics are no Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                raise
            if self.plain is None:
                from tokenizers import Tokenizer

                self.plain = Tokenizer.from_file(self.paths[0])
            return self.plain.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole capacities, before them what remains."""
    first = n % capacity
    return ([(0, first)] if first else []) + [(at, capacity) for at in range(first, n, capacity)]


def tokenized(docs: DataFrame, capacity: int = 1024, keep_ids: bool = False, paths: tuple[str, str] | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, the task that made it, its rank in that task by length, and its ids if asked for."""
    small_batches(docs.sparkSession)
    paths = paths or vocabulary()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = Encoder(paths), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part, rows = batch.slice(begin, 256), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), END], "<u4")
                    for i, (start, length) in enumerate(cut(len(ids), capacity)):
                        own = ids[start : start + length]
                        rows.append((doc, i, start, length, zlib.crc32(own.tobytes()), task, seen[length], *([own.astype(np.int32)] if keep_ids else [])))
                        seen[length] += 1
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids array<int>" * keep_ids)


@dataclass
class Plan:
    """Runs of (length, first rank, count, first bin, offset) and the number of bins."""

    capacity: int
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    bins: int = 0
    next_rank: dict[int, int] = field(default_factory=dict)

    def put(self, length: int, count: int, first_bin: int, offset: int) -> None:
        rank = self.next_rank.get(length, 0)
        self.runs.append((length, rank, count, first_bin, offset))
        self.next_rank[length] = rank + count


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Pack counts[length] items of each length."""
    out, left = Plan(capacity), {s: n for s, n in counts.items() if n}
    gaps: dict[int, list[list[int]]] = {}  # gap -> runs [first bin, count]

    def opened(count: int, gap: int) -> int:
        first = out.bins
        out.bins += count
        if gap:
            gaps.setdefault(gap, []).append([first, count])
        return first

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for a in large:
        while left[a]:
            fits = [b for b in large if b <= min(a, capacity - a) and left[b] > (b == a)]
            if not fits:
                first = opened(left[a], capacity - a)
                out.put(a, left[a], first, 0)
                left[a] = 0
                break
            b = fits[0]  # the largest
            k = left[a] // 2 if a == b else min(left[a], left[b])
            first = opened(k, capacity - a - b)
            out.put(a, k, first, 0)
            out.put(b, k, first, a)
            left[a] -= k
            left[b] -= k
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n and (tight := min((g for g in gaps if g >= s), default=0)):
            segments = gaps.pop(tight)
            while segments and n:
                first, count = segments.pop()
                k = min(n, count)
                out.put(s, k, first, capacity - tight)
                if tight > s:
                    gaps.setdefault(tight - s, []).append([first, k])
                if count > k:
                    segments.append([first + k, count - k])
                n -= k
            if segments:
                gaps.setdefault(tight, []).extend(segments)
        each = capacity // s
        for bins, per in ((n // each, each), (1, n % each)):
            if bins and per:
                first = opened(bins, capacity - per * s)
                for i in range(per):
                    out.put(s, bins, first, i * s)
    return out


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Pieces, as tokenized() gives them, plus sequence_id and offset. They must be a written table, as task and nth name rows of it."""
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    heads, path = scratch.stored(counts.withColumn("head", F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")), "pack-heads")
    made = plan({r["length"]: r["n"] for r in heads.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)  # a row for each length
    runs = np.array(sorted(made.runs), np.int64).reshape(-1, 5)
    key = (runs[:, 0] << 48) + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("nth").to_numpy() + batch.column("head").to_numpy()
            at = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            where, offset = runs[at, 3] + rank - runs[at, 1], runs[at, 4]
            names = [n for n in batch.schema.names if n not in ("head", "nth", "task")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(where), pa.array(offset)], [*names, "sequence_id", "offset"])

    rows = pieces.join(heads.select(F.col("task").alias("_task"), F.col("length").alias("_length"), "head"), (F.col("task") == F.col("_task")) & (F.col("length") == F.col("_length"))).drop("_task", "_length")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("head", "nth", "task"))
    return rows.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """Every document's tokens in sequences of at most `capacity`, a row per piece.

    A document is its ids and then id 2. Only longer ones are cut, into whole capacities; what remains comes first.

    Edge cases: a null or empty text is the one id 2. Rows with null or repeated doc_id are each packed. Very
    long texts make many pieces. An empty table gives an empty table. Other columns are not read.
    """
    pieces, _ = scratch.stored(tokenized(docs, capacity, keep_ids), "pieces")
    return pack(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the token ids of each sequence, from packed pieces with ids. A sequence holds `capacity` ids at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("_parts")).select("sequence_id", F.flatten(F.transform("_parts", lambda p: p["ids"])).alias("ids"), F.transform("_parts", lambda p: p["doc_id"]).alias("doc_ids"))
