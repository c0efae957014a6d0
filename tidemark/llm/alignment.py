"""Alignment of two tokenizers over the same texts.

The tokens of both sides that share bytes are the edges of a bipartite graph; its connected components, found by union-find, are the
smallest groups of tokens that cover the same bytes on both sides. Members of a component are linked, all with all. In how many documents
a pair of ids is linked is counted over the whole corpus; each document is then judged by these counts.

Documents are worked on in blocks of bounded size. A block has a dictionary of its pairs, and only dictionaries, not the pairs of each
document, are shuffled to be counted and to learn the counts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import scratch
from tidemark.llm.arrow import small_batches
from tidemark.llm.packing import Encoder, vocabulary

#: A block ends with the document that fills it to so many (document, pair) entries, or rows.
BLOCK_PAIRS, BLOCK_ROWS = 300_000, 4_096
#: Texts that are worked on at once: so many characters, or one text that has more.
CHUNK_CHARS = 1_000_000
#: A component of more links than this is expanded by its distinct ids, not by occurrence.
WIDE = 256


def pieces_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Plain(Encoder):
    """The encoder, with the strings of special tokens as ordinary text."""

    def __call__(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # the engine's panics are no Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                raise
            if self.plain is None:
                from tokenizers import Tokenizer

                self.plain = Tokenizer.from_file(self.paths[0])
                self.plain.encode_special_tokens = True
            return self.plain.encode(text, add_special_tokens=False).ids


class Pair:
    """Both tokenizers, with the bytes of each token. A encodes a space and the text, B, which adds that space itself, the text."""

    def __init__(self, paths: tuple[str, str], model: str):
        import sentencepiece

        self.a, self.b = Plain(paths), sentencepiece.SentencePieceProcessor(model_file=model)
        with open(paths[1], "rb") as f:
            ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
        self.bytes_a = [ranks.get(i, b"") for i in range(max(ranks) + 1)]
        pieces = self.b.id_to_piece(list(range(self.b.get_piece_size())))
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = np.array([len(t) for t in self.bytes_a]), np.array([len(t) for t in self.bytes_b])
        # Ids as text, with what may follow them in a listing of groups.
        self.said = [b"%d%c" % (i, sep) for n, seps in ((len(self.size_a), b",|"), (len(self.size_b), b",;")) for sep in seps for i in range(n)]

    def __call__(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """The ids of both sides; none where the text is null or empty or a side does not give back its bytes."""
        said = [t or "" for t in texts]
        out = []
        for text, b in zip(said, self.b.encode(said, num_threads=1), strict=True):
            raw = b" " + text.encode()
            a = self.a(" " + text) if text else []
            same = text and b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw
            out.append((a, b) if same else ([], []))
        return out


def united(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least member of each of n nodes' component under the edges (u, v): union-find, all edges at once.

    Roots hook onto the least root across an edge, and paths are then cut to their roots, until no edge joins two roots.
    """
    parent = np.arange(n)
    while True:
        pu, pv = parent[u], parent[v]
        apart = pu != pv
        if not apart.any():
            return parent
        u, v, pu, pv = u[apart], v[apart], pu[apart], pv[apart]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


@dataclass
class Groups:
    """Components of the tokens of some documents: the group of each token, numbered by place, and how many of either side each group has."""

    of_a: np.ndarray
    of_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray


def grouped(size_a: np.ndarray, size_b: np.ndarray) -> Groups:
    """Groups of two token sequences over the same bytes, given the tokens' sizes in bytes. Tokens overlap where one begins within the other."""
    if not len(size_a):
        none = np.zeros(0, np.int64)
        return Groups(none, none, none, none)
    mark = np.zeros(int(size_a.sum()), np.uint8)
    mark[np.cumsum(size_a) - size_a] = 1
    mark[np.cumsum(size_b) - size_b] |= 2
    begins = mark[np.flatnonzero(mark)]
    i, j = np.cumsum(begins & 1, dtype=np.int64) - 1, np.cumsum(begins >> 1, dtype=np.int64) - 1
    n = len(size_a)
    root = united(i, n + j, n + len(size_b))
    number = np.cumsum(root[:n] == np.arange(n)) - 1  # the least member is of side A, as each component has one
    of_a, of_b = number[root[:n]], number[root[n:]]
    return Groups(of_a, of_b, np.bincount(of_a), np.bincount(of_b, minlength=number[-1] + 1))


def linked(g: Groups, key_a: np.ndarray, id_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, times): the distinct pairs key_a + id_b of linked tokens, sorted, and how many links each has. key_a holds document and A id, scaled."""
    wide = g.n_a * g.n_b > WIDE
    small = np.flatnonzero(~wide[g.of_a])
    each = g.n_b[g.of_a[small]]
    first = (np.cumsum(g.n_b) - g.n_b)[g.of_a[small]]
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first, each)
    pair, times = np.unique(np.repeat(key_a[small], each) + id_b[at], return_counts=True)
    if not wide.any():
        return pair, times
    pairs, counts = [pair], [times]
    begin_a, begin_b = np.cumsum(g.n_a) - g.n_a, np.cumsum(g.n_b) - g.n_b
    for w in np.flatnonzero(wide):
        a, n = np.unique(key_a[begin_a[w] : begin_a[w] + g.n_a[w]], return_counts=True)
        b, m = np.unique(id_b[begin_b[w] : begin_b[w] + g.n_b[w]], return_counts=True)
        pairs.append((a[:, None] + b).ravel())
        counts.append((n[:, None] * m).ravel())
    pair, back = np.unique(np.concatenate(pairs), return_inverse=True)
    times = np.zeros(len(pair), np.int64)
    np.add.at(times, back, np.concatenate(counts))
    return pair, times


_DOC = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "groups": pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))}
_OWN = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups array<struct<a: array<int>, b: array<int>>>"
#: A row is a document (its pairs are places in the dictionary of its block, and how often it has each) or a block's dictionary.
_ROWS = f"block long, {_OWN}, pairs binary, times binary, a array<int>, b array<int>, n array<int>"


def tokenized(docs: DataFrame, keep_groups: bool = False, paths: tuple[str, str] | None = None, model: str | None = None) -> DataFrame:
    """Rows of _ROWS: each document's tokens grouped and linked, and the dictionary of each block."""
    small_batches(docs.sparkSession)
    paths, model = paths or vocabulary(), model or pieces_path()
    kinds = {"block": pa.int64(), **_DOC, "pairs": pa.binary(), "times": pa.binary(), "a": pa.list_(pa.int32()), "b": pa.list_(pa.int32()), "n": pa.list_(pa.int32())}

    def batch(block: int, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block if k == "block" else r.get(k) for r in rows], kind) for k, kind in kinds.items()], list(kinds))

    def worked(both: Pair, ids: list[int | None], texts: list[str | None]) -> tuple[list[dict], np.ndarray, np.ndarray]:
        """Documents, their pairs (document, a, b as one number, sorted) and how often they have each."""
        tokens = both(texts)
        count_a, count_b = (np.array([len(t[side]) for t in tokens]) for side in (0, 1))
        id_a, id_b = (np.fromiter(chain.from_iterable(t[side] for t in tokens), np.int64, count.sum()) for side, count in ((0, count_a), (1, count_b)))
        doc_a, wide_b = np.repeat(np.arange(len(tokens)), count_a), len(both.size_b)
        g = grouped(both.size_a[id_a], both.size_b[id_b])
        pair, times = linked(g, (doc_a * len(both.size_a) + id_a) * wide_b, id_b)
        of_doc = doc_a[np.cumsum(g.n_a) - g.n_a]  # of each group
        n_groups = np.bincount(of_doc, minlength=len(tokens))
        links = np.zeros(len(tokens), np.int64)
        np.add.at(links, of_doc, g.n_a * g.n_b)
        # A listing has each group's A ids, then its B ids.
        up_a, up_b = np.cumsum(g.n_a), np.cumsum(g.n_b)
        listing = np.empty(len(id_a) + len(id_b), np.int64)
        places_a, places_b = np.arange(len(id_a)), np.arange(len(id_b))
        size_a, size_b = len(both.size_a), len(both.size_b)
        listing[places_a + (up_b - g.n_b)[g.of_a]] = id_a + size_a * (places_a == (up_a - 1)[g.of_a])
        listing[places_b + up_a[g.of_b]] = 2 * size_a + id_b + size_b * (places_b == (up_b - 1)[g.of_b])
        rows, ends, group = [], np.cumsum(count_a + count_b), 0
        for d, doc in enumerate(ids):
            codes = listing[ends[d] - count_a[d] - count_b[d] : ends[d]].tolist()
            said = b"".join(map(both.said.__getitem__, codes))[:-1]
            row = {"doc_id": doc, "n_a": int(count_a[d]), "n_b": int(count_b[d]), "n_groups": int(n_groups[d]), "n_links": int(links[d]), "groups_sha256": hashlib.sha256(said).hexdigest() if said else ""}
            if keep_groups:
                row["groups"] = [dict(zip("ab", ([int(t) for t in side.split(b",")] for side in one.split(b"|")), strict=True)) for one in said.split(b";")] if said else []
            rows.append(row)
        return rows, pair, times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Pair(paths, model)
        every = len(both.size_a) * len(both.size_b)
        block, rows, pairs, times, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal block, rows, pairs, times, held
            known, place = np.unique(np.concatenate(pairs), return_inverse=True)
            n, at = np.bincount(place, minlength=len(known)), 0
            for row, own, often in zip(rows, pairs, times, strict=True):
                row["pairs"], row["times"] = place[at : at + len(own)].astype("<i4").tobytes(), often.astype("<i8").tobytes()
                at += len(own)
            for i in range(0, len(rows), 256):
                yield batch(block, rows[i : i + 256])
            if len(known):
                a, b = np.divmod(known, len(both.size_b))
                yield batch(block, [{"a": a.astype(np.int32), "b": b.astype(np.int32), "n": n.astype(np.int32)}])
            block, rows, pairs, times, held = block + 1, [], [], [], 0

        def chunk(ids: list[int | None], texts: list[str | None]) -> Iterator[pa.RecordBatch]:
            nonlocal held
            more, pair, often = worked(both, ids, texts)
            cuts = np.searchsorted(pair, np.arange(1, len(ids)) * every)
            for row, own, n in zip(more, np.split(pair % every, cuts), np.split(often, cuts), strict=True):
                rows.append(row)
                pairs.append(own)
                times.append(n)
                held += len(own)
                if held >= BLOCK_PAIRS or len(rows) >= BLOCK_ROWS:
                    yield from closed()

        for b in batches:
            ids, texts, chars = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(doc)
                texts.append(text)
                chars += len(text or "")
                if chars >= CHUNK_CHARS or len(ids) >= 1024:
                    yield from chunk(ids, texts)
                    ids, texts, chars = [], [], 0
            if ids:
                yield from chunk(ids, texts)
        if rows:
            yield from closed()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, _ROWS)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, n_docs, best): in how many documents each pair of ids is linked, and whether no pair of that A id is in more. rows: a written table of tokenized()."""
    spoken = rows.where("a is not null").select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("p.*")
    counts, _ = scratch.stored(spoken.groupBy("a", "b").agg(F.sum(F.col("n").cast("long")).alias("n_docs")), "pair-counts")
    most = counts.groupBy(F.col("a").alias("_a")).agg(F.max("n_docs").alias("_most"))
    return counts.join(most, F.col("a") == F.col("_a")).select("a", "b", "n_docs", (F.col("n_docs") == F.col("_most")).alias("best"))


def token_map(docs: DataFrame, **how) -> DataFrame:
    """(a, b, n_docs): for each id of A that is linked at all, the ids of B linked with it in most documents, ties included: a way from one vocabulary to the other.

    Edge cases: texts without tokens say nothing; no links give an empty table.
    """
    rows, _ = scratch.stored(tokenized(docs, **how), "aligned")
    return pair_counts(rows).where("best").drop("best")


def _judged(key: tuple, docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's documents with the sums of their links' counts. pairs: place, n_docs and best of the whole dictionary."""
    count, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, bool)
    place = pairs.column("pos").to_numpy()
    count[place], best[place] = pairs.column("n_docs").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
    n_best, count_sum = [], []
    for own, times in zip(docs.column("pairs").to_pylist(), docs.column("times").to_pylist(), strict=True):
        own, times = np.frombuffer(own, "<i4"), np.frombuffer(times, "<i8")
        n_best.append(int(times[best[own]].sum()))
        count_sum.append(int((times * count[own]).sum()))
    return pa.table([*(docs.column(n) for n in _DOC), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], [*_DOC, "n_best", "count_sum"])


def align(docs: DataFrame, keep_groups: bool = False, **how) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups (if asked for, else null), n_best and count_sum.

    A link is a pair of token occurrences, one of either side, in one group. n_best: links whose pair of ids is in the most documents
    of all pairs of that A id, ties included. count_sum: the sum over links of the number of documents that hold their pair.

    Edge cases: a text that is null, empty, or changed by either tokenizer (B's normaliser, say) has no tokens: zeros and an empty digest. Rows are
    documents, so rows that share a doc_id, or have none, each count and each come back. Very long texts are a block of their own. A
    group of many tokens is linked by distinct ids, so that it costs what its distinct pairs do. An empty table gives an empty table. Other columns are not read.
    """
    rows, _ = scratch.stored(tokenized(docs, keep_groups, **how), "aligned")
    counts, _ = scratch.stored(pair_counts(rows), "pair-best")
    places = rows.where("a is not null").select("block", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "p"))
    known = places.select("block", "pos", F.col("p.a").alias("_pa"), F.col("p.b").alias("_pb")).join(counts, (F.col("_pa") == F.col("a")) & (F.col("_pb") == F.col("b"))).select(F.col("block").alias("_block"), "pos", "n_docs", "best")
    held = rows.where("a is null").select("block", *_DOC, "pairs", "times")
    return held.groupBy("block").cogroup(known.groupBy("_block")).applyInArrow(_judged, f"{_OWN}, n_best long, count_sum long")
