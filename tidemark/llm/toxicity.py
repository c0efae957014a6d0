"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum of weights + sum over pairs of <v_i, v_j>): pairs such as an insult with a group
mention count beyond their single weights. Which hashed terms take part, and the machine itself, are fitted on
a bounded sample of labelled rows; scoring reads every text whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import scratch
from tidemark.llm.arrow import small_batches
from tidemark.llm.columns import extended, plain
from tidemark.llm.language import remainder

SLOTS = 1 << 18
_WORD = re.compile(r"\w+")


def slots(text: str) -> np.ndarray:
    """The distinct hashed terms of a whole text: lower-cased words and, apart from them, word beginnings of five letters."""
    words = set(_WORD.findall(text.lower()))
    crc = zlib.crc32
    found = {crc(w.encode("utf-8", "replace")) for w in words}
    found |= {crc(s.encode("utf-8", "replace"), 1) for s in {w[:5] for w in words if len(w) > 5}}
    return np.fromiter(found, np.int64, len(found)) % SLOTS


@dataclass
class Model:
    """place: slot -> term number or -1; bias, weights (terms) and factors (terms, k)."""

    place: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def terms(self, text: str) -> np.ndarray:
        """Numbers of the terms of a whole text that take part."""
        found = np.unique(self.place[slots(text)])
        return found[found >= 0]

    def parts(self, text: str) -> tuple[float, float]:
        """The sum of single weights and the sum over pairs."""
        terms = self.terms(text)
        v = self.factors[terms]
        return float(self.weights[terms].sum()), float(0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum()))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.parts(text)), -30, 30))))


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, text, toxic) of at most max_rows labelled documents, those of least doc_id hash, whose crc32(doc_id) mod 3 is not 1.

    A document labelled twice is toxic if any label says so. The labels are cut to max_rows before they are broadcast, so texts
    are not shuffled for them.
    """
    own = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = own.where(remainder(F.col("_id"), 3) != 1).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(own), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")


def _class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each class, and those that hold each slot, over all rows of (toxic, slots); one array of fixed size a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = np.zeros(2, np.int64), np.zeros((2, SLOTS), np.int64)
        for batch in batches:
            for packed, toxic in zip(batch.column("slots").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                c = int(toxic > 0)
                n[c] += 1
                held[c, np.frombuffer(packed, "<i4")] += 1
        all_ = np.concatenate((held.ravel(), n))
        at = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(all_[at], pa.int64())], ["slot", "n"])

    got = rows.select("slots", "toxic").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(2 * SLOTS + 2)
    flat[got["slot"].to_numpy(int)] = got["n"]
    return flat[-2:], flat[:-2].reshape(2, SLOTS)


def _g_squared(n: np.ndarray, held: np.ndarray) -> np.ndarray:
    """How far each column of held (documents with something, by class) is from being independent of the class."""
    total, out = n.sum(), np.zeros(held.shape[1:])
    for seen in (held, n.reshape(-1, *[1] * (held.ndim - 1)) - held):
        expected = np.multiply.outer(n, seen.sum(axis=0)) / max(total, 1)
        out += np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0).sum(axis=0)
    return 2 * out


def _paired(x: list[np.ndarray], y: np.ndarray, terms: int, gain: np.ndarray, least: float) -> np.ndarray:
    """Of terms numbered from 0, those of a pair that says more about the label than either of the two alone, by `least` at least."""
    both = np.zeros((2, terms, terms))
    for c in (0, 1):
        own = [a for a, label in zip(x, y, strict=True) if label == c]
        for at in range(0, len(own), 4096):
            block = np.zeros((len(own[at : at + 4096]), terms), np.float32)
            for row, a in zip(block, own[at : at + 4096], strict=True):
                row[a] = 1
            both[c] += block.T @ block
    more = _g_squared(np.array([np.sum(y == 0), np.sum(y == 1)], float), both) - np.maximum(gain[:, None], gain)
    np.fill_diagonal(more, -np.inf)
    return np.flatnonzero((more > least).any(axis=1))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 30_000, max_terms: int = 4096, min_gain: float = 12, pair_terms: int = 512, min_pair_gain: float = 120, k: int = 8, epochs: int = 60, seed: int = 0) -> Model:
    """Terms first, then weights and factors by AdaGrad, on a sample of at most max_rows labelled documents.

    Terms that take part are those whose G-squared against the label is above min_gain, the max_terms best at most, and, so that a pair
    whose words say nothing alone is not missed, the terms of pairs that beat both their words' G-squared by min_pair_gain; pairs are
    looked for among the pair_terms terms of most documents. All these bounds are the classifier's, whatever the corpus weighs.
    """

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [np.unique(slots(t)).astype("<i4").tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(found, pa.binary())], ["doc_id", "toxic", "slots"])

    rows, path = scratch.stored(labelled(docs, labels, max_rows).mapInArrow(tokenized, "doc_id long, toxic int, slots binary"), "toxic-sample")
    n, held = _class_counts(rows)
    gain, frequency = _g_squared(n, held), held.sum(axis=0)
    best = np.argsort(-gain, kind="stable")[:max_terms]
    best = best[gain[best] > min_gain]
    often = np.argsort(-frequency, kind="stable")[:pair_terms]
    often = often[frequency[often] > 0]
    candidates = np.concatenate((best, np.setdiff1d(often, best, assume_unique=True)))
    bias = float(np.log((n[1] + 0.5) / (n[0] + 0.5))) if n.sum() else -30.0
    place = np.full(SLOTS, -1, np.int32)
    place[candidates] = np.arange(len(candidates))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [place[np.frombuffer(s, "<i4")] for s in batch.column("slots").to_pylist()]
            found = [np.sort(x[x >= 0]).astype("<i4").tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())], ["doc_id", "toxic", "terms"])

    got = rows.mapInArrow(features, "doc_id long, toxic int, terms binary").toPandas().sort_values(["doc_id", "terms"], kind="stable")
    scratch.drop(docs.sparkSession, path)
    x, y = [np.frombuffer(b, "<i4") for b in got["terms"]], (got["toxic"].to_numpy() > 0).astype(float)
    mine = place[often]
    nth = np.full(len(candidates), -1)
    nth[mine] = np.arange(len(mine))
    paired = mine[_paired([nth[a][nth[a] >= 0] for a in x], y, len(mine), gain[often], min_pair_gain)]
    chosen = np.union1d(np.arange(len(best)), paired)
    number = np.full(len(candidates), -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    place[candidates] = number
    x = [number[a][number[a] >= 0] for a in x]
    if not len(chosen):
        return Model(place, bias, np.zeros(0), np.zeros((0, k)))
    return Model(place, *_adagrad(x, y, len(chosen), bias, k, epochs, seed))


def _adagrad(x: list[np.ndarray], y: np.ndarray, terms: int, bias: float, k: int, epochs: int, seed: int, rate: float = 0.2, decay: tuple[float, float] = (1e-6, 1e-3)) -> tuple[float, np.ndarray, np.ndarray]:
    """The first half of the epochs learns single weights alone, the second both, so that a pair counts for what its single terms leave. decay: of weights and of factors, which decay faster, but not so fast that pairs die out."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(terms), rng.normal(0, 0.02, (terms, k))
    gw, gv, gb = np.full(terms, 1e-4), np.full((terms, k), 1e-4), 1e-4
    sizes = np.array([len(a) for a in x])
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            lengths = sizes[rows]
            term, row = np.concatenate([x[i] for i in rows]), np.repeat(np.arange(len(rows)), lengths)
            vt = v[term]
            total = np.zeros((len(rows), k))
            np.add.at(total, row, vt)
            single, squares = np.bincount(row, w[term], len(rows)), np.bincount(row, (vt**2).sum(axis=1), len(rows))
            p = 1 / (1 + np.exp(-np.clip(bias + single + 0.5 * ((total**2).sum(axis=1) - squares), -30, 30)))
            err = (p - y[rows]) / len(rows)
            gb += err.sum() ** 2
            bias -= rate * err.sum() / np.sqrt(gb)
            used, inverse = np.unique(term, return_inverse=True)
            dw = np.bincount(inverse, err[row], len(used)) + decay[0] * w[used]
            dv = np.zeros((len(used), k))
            np.add.at(dv, inverse, err[row][:, None] * (total[row] - vt))
            dv += decay[1] * v[used]
            gw[used] += dw**2
            gv[used] += dv**2 * (2 * epoch >= epochs)
            w[used] -= rate * dw / np.sqrt(gw[used])
            if 2 * epoch >= epochs:
                v[used] -= rate * dv / np.sqrt(gv[used])
    return float(bias), w, v


def score_toxicity(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None, threshold: float = 0.7) -> DataFrame:
    """docs plus held_out, score and predicted, on whole texts.

    Edge cases: a null or empty text has no terms and gets the score of the bias alone. Without any label the bias is -30, so
    every score is about 1e-13. Labels that are null, or of unknown documents, are not learned from; rows without doc_id neither, nor are they
    held out. Repeated rows are each answered. An empty table gives an empty table. Input columns with a result's name are replaced.
    """
    small_batches(docs.sparkSession)
    docs, restored = plain(docs.drop("held_out", "score", "predicted"))
    model = model or fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = [model.score(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, "score"])

    rows = docs.withColumn("text", F.col("text").cast("string"))
    out = rows.mapInArrow(run, extended(rows.schema, "score double"))
    return restored(out.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))).withColumn("predicted", (F.col("score") >= threshold).cast("int")))
