"""Language identification with error-correcting output codes.

Every language has a codeword; one binary byte-trigram classifier a bit is learned from counts, and
loss-weighted decoding takes the language whose codeword loses least on the classifiers' margins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import small_batches
from tidemark.llm.columns import extended, plain

SLOTS = 1 << 16
#: Bytes that one numpy pass looks at; longer texts go through it in overlapping pieces.
PIECE = 4 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32  # digits, signs and spaces
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of doc_id as text, modulo `by`; null without doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def _slots(raw: bytes) -> np.ndarray:
    """Hashed trigrams of bytes; slot 0 is for white space only."""
    b = _FOLD[np.frombuffer(raw, np.uint8)].astype(np.uint32)
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) ^ 0x202020
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)


def _pieces(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Trigram slots and where each document's begin, for groups of documents of up to PIECE bytes; a longer document makes several."""
    group, at, size = [], [], 0
    for i, raw in enumerate(raws):
        padded = b"  " + raw + b"  "
        for begin in range(0, max(1, len(padded) - 2), PIECE):
            part = padded[begin : begin + PIECE + 2]
            if size + len(part) > PIECE and group:
                yield _slots(b"".join(group)), np.array(at)
                group, at, size = [], [], 0
            group.append(part if len(part) <= PIECE else part + b"  ")
            at.append((i, size))
            size += len(group[-1])
    if group:
        yield _slots(b"".join(group) + b"  "), np.array(at)


def count_trigrams(texts: DataFrame) -> DataFrame:
    """(lang, slot, n) over all rows of (lang, text), counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                langs, raws = part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()
                for lang in set(langs):
                    own = total.setdefault(lang, np.zeros(SLOTS, np.int64))
                    for slots, _ in _pieces([r for r, x in zip(raws, langs, strict=True) if x == lang]):
                        own += np.bincount(slots, minlength=SLOTS)
        for lang, n in total.items():
            slots = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(n[slots], pa.int64())], ["lang", "slot", "n"])

    return texts.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +1 and -1: the exhaustive code up to five languages, beyond that the random code of widest least distance."""
    if n <= 5:
        bits = [[1 if i == 0 or (word >> (i - 1)) & 1 else -1 for word in range(2 ** (n - 1) - 1)] for i in range(n)]
        return np.array(bits, np.int8).reshape(n, -1)
    best, least = None, -1
    size = int(np.ceil(10 * np.log2(n)))
    for seed in range(50):
        code = np.where(np.random.default_rng(seed).random((n, size)) < 0.5, -1, 1).astype(np.int8)
        apart = (size - code.astype(int) @ code.T) // 2 + size * np.eye(n, dtype=int)
        split = (abs(code.sum(axis=0)) < n).all()
        if split and apart.min() > least:
            best, least = code, apart.min()
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score and ambiguity for (n, bits) margins."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None, :, :]).sum(axis=2)
        order = np.sort(loss, axis=1)
        best = loss.argmin(axis=1)
        score = 1 / np.exp(-(loss - order[:, :1])).sum(axis=1)
        if len(self.langs) == 1:
            return best, score, np.zeros(len(best), bool)
        apart = (self.code.shape[1] - self.code.astype(int) @ self.code.T.astype(int)) // 2
        radius = (apart[~np.eye(len(apart), dtype=bool)].min() - 1) // 2
        wrong = (np.sign(margins) != self.code[best]).sum(axis=1)
        return best, score, (wrong > radius) | (order[:, 1] - order[:, 0] < 1)


def fit(docs: DataFrame, max_langs: int = 256) -> Model:
    """Learn from every row that has a language and text and whose crc32(doc_id) mod 4 is not 2. Only (languages x 65,536) counts reach the driver, 270 MB at most.

    Classes are the max_langs most frequent languages, ties by name: a bound of the classifier, which keeps a lang column full of noise from filling a task.
    """
    rows = docs.where((remainder(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()]
    known = sorted(known)
    number = F.array_position(F.array(*map(F.lit, known)), F.col("lang")).cast("int") - 1 if known else F.lit(0)
    got = count_trigrams(rows.where(F.col("lang").isin(known))).select(number.alias("lang"), F.col("slot").cast("int").alias("slot"), F.col("n").cast("long").alias("n")).toArrow()  # numbers, 16 bytes a count
    own, place = np.unique(got.column("lang").to_numpy(), return_inverse=True)
    langs = [known[i] for i in own]
    counts = np.zeros((len(langs), SLOTS))
    counts[place, got.column("slot").to_numpy()] = got.column("n").to_numpy()
    counts[:, 0] = 0
    share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * SLOTS) if len(langs) else counts
    code = codewords(len(langs)) if langs else np.zeros((0, 0), np.int8)
    weights = np.zeros((code.shape[1], SLOTS), np.float32)
    for bit in range(code.shape[1]):
        weights[bit] = np.log(share[code[:, bit] > 0].mean(axis=0)) - np.log(share[code[:, bit] < 0].mean(axis=0))
    weights[:, 0] = 0
    return Model(langs, code, weights)


_LETTER = regex.compile(rb"[A-Za-z]"), regex.compile(r"\p{L}")


def has_letter(raw: bytes) -> bool:
    return bool(_LETTER[0].search(raw)) or (not raw.isascii() and bool(_LETTER[1].search(raw.decode("utf-8", "replace"))))


def margins(model: Model, raws: list[bytes]) -> np.ndarray:
    """(documents, bits): the mean log odds of a document's trigrams, times the root of their number up to 10."""
    sums, seen = np.zeros((len(raws), len(model.weights))), np.zeros(len(raws))
    for slots, at in _pieces(raws):
        doc, begin = at[:, 0], at[:, 1]
        np.add.at(seen, doc, np.add.reduceat((slots != 0).astype(np.int64), begin))
        for bit, w in enumerate(model.weights):
            np.add.at(sums[:, bit], doc, np.add.reduceat(w[slots], begin, dtype=np.float64))
    seen = np.maximum(seen, 1)[:, None]
    return sums / seen * np.minimum(np.sqrt(seen), 10)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs plus held_out, lang_pred, score and ambiguous, on whole texts. Without a model one is fitted to docs, of the 256 most frequent languages at most.

    Edge cases: a null text or one without a letter is `und` with score 0, and so is every row if no row has a
    language. Rows without doc_id are not learned from and not held out. Repeated rows are each answered; ties go to the first
    language by name. An empty table gives an empty table. Input columns with a result's name are replaced; all others, of whatever name, come along.
    """
    own = ["held_out", "lang_pred", "score", "ambiguous"]
    small_batches(docs.sparkSession)
    docs, restored = plain(docs.drop(*own))
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                raws = [r or b"" for r in part.column("text").cast(pa.binary()).to_pylist()]
                known = np.array([bool(model.langs) and has_letter(r) for r in raws])
                best, score, unsure = np.zeros(len(raws), int), np.zeros(len(raws)), np.ones(len(raws), bool)
                if known.any():
                    best[known], score[known], unsure[known] = model.decode(margins(model, [r for r, k in zip(raws, known, strict=True) if k]))
                lang = [model.langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], [*part.schema.names, *own[1:]])

    rows = docs.withColumn("text", F.col("text").cast("string"))
    out = rows.mapInArrow(run, extended(rows.schema, "lang_pred string, score double, ambiguous boolean"))
    return restored(out.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))))
