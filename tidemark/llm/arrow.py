"""Arrow batches for texts of any length."""

from __future__ import annotations

from pyspark.sql import SparkSession

_KEY, _DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", ("64m", "64mb", "67108864", "67108864b"), "8m"


def small_batches(spark: SparkSession) -> None:
    """Let a Python worker get 8 MB of texts at a time, not 64: of long documents it then holds few. A session that chose a size of its own keeps it."""
    if spark.conf.get(_KEY, "64m").lower() in _DEFAULT:
        spark.conf.set(_KEY, BATCH)
