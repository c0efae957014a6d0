"""Line dedup: levelled sorted runs of line hashes.

A run is a Parquet table bucketed and sorted by a 16-byte line hash. A batch of documents is
aggregated to one row per line, merge-anti-joined with the runs, and added as a run of its own:
lines not seen before fix their keeper, known ones add to the tally only. As known lines are tallied too, the anti-join
is an outer merge join that flags what the runs know. When a level holds `fanout`
runs they are merged into one run of the next level, so a line is rewritten once per level.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import scratch
from tidemark.llm.arrow import small_batches
from tidemark.llm.columns import extended, plain, spare

SPACE = b" \t\n\x0b\x0c\r"
#: A key in more than this share of all (line, document) rows is hot; there can be no more of them than its inverse.
HOT_SHARE = 1 / 4096


def _norm(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # bytes: ASCII white space and A-Z only


def _hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _long(key: bytes, n: int) -> bool:
    """At least n code points; only keys whose byte length leaves it open are decoded."""
    return len(key) >= n and (len(key) >= 4 * n or len(key.decode("utf-8", "replace")) >= n)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, key): each distinct long line of each row. Rows without doc_id give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, keys = [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    found = {k for k in map(_norm, (text or b"").split(b"\n")) if _long(k, min_chars)}
                    keys += map(_hash, found)
                    ids += [doc] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.where("doc_id is not null and length(text) >= " + str(int(min_chars))).mapInArrow(run, "doc_id long, key binary")


class LineRuns:
    """The levelled runs. A row is (key, n_docs, keeper); keeper is null where an older run has fixed it."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 3):
        self.spark, self.path, self.fanout = spark, path, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _write(self, rows: DataFrame) -> str:
        name = f"tidemark_run_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            scratch.drop(self.spark, f"{self.path}/{name}")

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> str:
        """Merge-anti-join one batch of (doc_id, key) with every run and add it as a run. Feed batches by falling doc_id to keep the largest."""
        batch = keys.groupBy("key").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("top"))
        seen = F.lit(False)
        for i, name in enumerate(self.runs()):
            batch = batch.join(self.spark.table(name).select("key", F.lit(True).alias(f"in_{i}")), "key", "left")
            seen = seen | F.coalesce(F.col(f"in_{i}"), F.lit(False))
        name = self._write(batch.select("key", "n_docs", F.when(~seen, F.col("top")).alias("keeper")))
        self.levels[0].append(name)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self.compact(level)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        # Read as plain files: over a union of bucketed scans Spark 4.1 drops the exchange that groupBy needs, and keys stay apart.
        rows = self.spark.read.schema("key binary, n_docs long, keeper long").parquet(*[f"{self.path}/{name}" for name in names])
        return rows.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def compact(self, level: int) -> None:
        """Merge the runs of a level into one of the next."""
        names = self.levels[level]
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level + 1].append(self._write(self._merged(names)))
        self.levels[level] = []
        self._drop(names)

    def lines(self) -> DataFrame:
        """(key, n_docs, keeper) over all runs."""
        return self._merged(self.runs())

    def close(self) -> None:
        self._drop(self.runs())
        self.levels = [[]]


def _cut(names: list[str], drops: str, min_chars: int):
    """Of rows with an array of key hashes in column `drops`: the text without their lines, the number of lines and of dropped ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts, total, gone = [], [], []
                for text, drop in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column(drops).to_pylist(), strict=True):
                    lines = (text or b"").split(b"\n")
                    left = lines
                    if drop:
                        drop = set(drop)
                        left = [x for x in lines if not (_long(k := _norm(x), min_chars) and _hash(k) in drop)]
                    texts.append(b"\n".join(left).decode("utf-8", "replace"))
                    total.append(len(lines))
                    gone.append(len(lines) - len(left))
                cols = [pa.array(texts, pa.string()) if n == "text" else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    """docs with repeated lines gone, plus n_lines (before) and n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least
    min_chars code points that at least min_docs documents hold lose their lines, except in the
    largest doc_id that holds them. Batches are equal ranges of doc_id, fed from the largest down.

    Edge cases: a null or empty text is one empty line, and comes back empty. Rows that share a doc_id
    count as one document and keep or lose lines together. Rows without doc_id neither count nor lose
    lines. An empty table gives an empty table. Input columns named n_lines or n_dropped are replaced; all others, of whatever name, come along.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs, restored = plain(docs.drop("n_lines", "n_dropped"))
    low, high = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    low, high = (0, 0) if low is None else (low, high)
    width = max(1, -(-(high - low + 1) // batches))
    wide = lambda v: f"cast({v} as decimal(20,0))"  # noqa: E731  ids may lie further apart than a long reaches
    sliced = line_keys(docs, min_chars).withColumn("slice", F.expr(f"int(({wide(repr(str(high)))} - {wide('doc_id')}) div {wide(repr(str(width)))})"))
    path = scratch.folder(spark, "line-keys")
    sliced.write.partitionBy("slice").parquet(path)
    keys = spark.read.schema(sliced.schema).parquet(path)

    runs = LineRuns(spark, scratch.folder(spark, "line-runs"), fanout)
    try:
        for i in range(batches):
            runs.add(keys.where(F.col("slice") == i))
        heavy, _ = scratch.stored(runs.lines().where(F.col("n_docs") >= min_docs), "line-heavy")
    finally:  # runs are tables of the session's catalogue, which must not outlive a failure
        runs.close()

    # A hot line would send all its documents to one task: hot ones, of which there can be 1/HOT_SHARE, are broadcast.
    total = keys.count()
    hot = heavy.where(F.col("n_docs") > total * HOT_SHARE).select("key", "keeper")
    cold = heavy.where(F.col("n_docs") <= total * HOT_SHARE).select("key", "keeper")
    pairs = keys.select("key", "doc_id")
    hits = pairs.join(F.broadcast(hot), "key").unionByName(pairs.join(cold, "key")).where("doc_id <> keeper")
    doc, drop = spare(docs, "_doc", "_drop")
    drops = hits.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("key").alias(drop))
    rows = docs.withColumn("text", F.col("text").cast("string")).join(drops, F.col("doc_id").cast("long") == F.col(doc), "left").drop(doc)
    kept = rows.drop(drop)
    return restored(rows.mapInArrow(_cut(kept.columns, drop, min_chars), extended(kept.schema, "n_lines long, n_dropped long")))
