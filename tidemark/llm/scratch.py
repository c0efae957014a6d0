"""Tables that outlive an executor: written in the cluster's shared checkpoint folder and read again."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_run: ContextVar[str] = ContextVar("run", default="")


def root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session on one machine that names none, as in tests, gets a folder of its own; on a cluster no machine's own folder will do."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path under root(); nothing is created yet."""
    return f"{root(spark)}/tidemark/{_run.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def run(spark: SparkSession) -> Iterator[None]:
    """All scratch tables made within are deleted at its end: write what a query gives before that. Runs may nest, and do not touch each other's tables."""
    own = f"{_run.get()}run-{uuid.uuid4().hex}/"
    before = _run.set(own)
    try:
        yield
    finally:
        _run.reset(before)
        drop(spark, f"{root(spark)}/tidemark/{own}")


def read(spark: SparkSession, like: DataFrame, path: str) -> DataFrame:
    """Parquet at path with the known schema of like: no job for inference, and empty folders are read too."""
    return spark.read.schema(like.schema).parquet(path)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df once and read it again, which cuts its lineage. Gives the table and its path, for drop()."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return read(df.sparkSession, df, path), path


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later step reads."""
    for path in paths:
        fs, p = _fs(spark, path)
        fs.delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Delete all scratch tables of all runs. Only when no query that reads them is still to run."""
    drop(spark, f"{root(spark)}/tidemark")
