"""What the two vector searches share: valid rows, packing for the shuffle, and exact top-k of score tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): one row per vec_id with a finite vector of doubles. Of rows that share an id the largest vector counts; a null id is no row.

    Ids are counted on their own first: only where some repeat are vectors shuffled to meet.
    """
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(~bad)
    once = vectors.groupBy(F.col("vec_id").cast("long").alias("vec_id")).count().where("vec_id is not null and count > 1").isEmpty()
    return rows if once else rows.groupBy("vec_id").agg(F.max("x").alias("x"))


def is_query(vec_id: str, every: int):
    return F.col(vec_id) % every == 0


def matrix(column: pa.ListArray, dim: int, kind=np.float64) -> np.ndarray:
    """(rows, dim) of a list column; shorter lists are padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim).astype(kind, copy=False)
    out = np.zeros((len(sizes), dim), kind)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def packed(x: np.ndarray) -> pa.Array:
    """A row of bytes for each row of a matrix."""
    data = np.ascontiguousarray(x)
    width = data.dtype.itemsize * data.shape[1]
    offsets = np.arange(len(data) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def unpacked(column: pa.Array, dim: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dim)


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query, ties to the smaller vec_id. Rows are cut to k before the shuffle too."""
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    rows = scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return rows.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
