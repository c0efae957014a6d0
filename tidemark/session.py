"""Session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, ANSI arithmetic and adaptive execution. Partition counts are left to the cluster unless given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    return builder.config(map=base | conf).getOrCreate()
