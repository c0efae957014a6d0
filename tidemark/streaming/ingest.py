"""Event ingest as a stream: validate, deduplicate, route, and count in windows.

Offsets live in the checkpoint and sinks are keyed by batch, so a restart neither loses nor repeats an event. An offset that is
committed before what was read is stored would lose orders that a sender was told are accepted.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.registry import Event
from tidemark.operators import ingest

SCHEMA = "event_id string, event string, product string, ts timestamp, account_id string, device_id string, props map<string,string>, schema_version int"
#: How late an event may come and still be known as a repeat. No bound is given for offline clients, so it is a parameter.
WATERMARK = "7 days"


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for a stream's state or result under spark.checkpoint.dir, or where that is unset and all runs on one machine, as in tests, under a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def drained(result: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and give its result as a table. Appended rows are written batch by batch, a complete result anew each time."""
    spark, path = result.sparkSession, folder(result.sparkSession, name)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number if mode == 'append' else 0}")

    query = result.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", folder(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).option("recursiveFileLookup", True).parquet(path)


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """JSON lines as they land in a folder; files_per_batch holds back a backlog."""
    reader = spark.readStream.schema(SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def deduplicated(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Each event_id once within the watermark. A row without ts cannot be placed in time and goes on to be rejected."""
    return stream.withColumn("seen_at", F.coalesce("ts", F.current_timestamp())).withWatermark("seen_at", watermark).dropDuplicatesWithinWatermark(["event_id"]).drop("seen_at")


def route(stream: DataFrame, events: list[Event], accepted: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Write accepted events by month and rejected ones with their reason, each batch in one pass over its rows.

    A batch writes folders named by its number and overwrites them if it runs again, so a repeat after a failure changes nothing.
    """

    def store(batch: DataFrame, number: int) -> None:
        checked = ingest.validate(batch, events).persist()
        month = F.date_format(F.coalesce("ts", F.lit(0).cast("timestamp")), "yyyy-MM")
        checked.where("reason is null").drop("reason").withColumn("month", month).write.mode("overwrite").partitionBy("month").parquet(f"{accepted}/batch={number}")
        checked.where("reason is not null").write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        checked.unpersist()

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Weekly actives by Moscow Monday: windows of seven days that begin on Sunday at 21:00 UTC. Exact distinct counts need a batch."""
    w = F.window("ts", "7 days", startTime="3 days 21 hours")
    return stream.withWatermark("ts", watermark).groupBy(w).agg(F.approx_count_distinct("account_id").alias("wau"), F.count(F.lit(1)).alias("events")).select("window.start", "window.end", "wau", "events")


def weekly_accounts(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """(start, account_id), each once: who was active in a Moscow week, for exact counts. What a week's state holds goes when the watermark has passed its end."""
    w = F.window("ts", "7 days", startTime="3 days 21 hours")
    return stream.withWatermark("ts", watermark).select(w.alias("week"), "account_id").dropDuplicates(["week", "account_id"]).select("week.start", "account_id")


def sliding(stream: DataFrame, length: str = "24 hours", step: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """Events per sliding window and kind, for bursts and trailing counts."""
    return stream.withWatermark("ts", watermark).groupBy(F.window("ts", length, step), "event").agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "event", "n")


def session_counts(stream: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", watermark).groupBy(w, "account_id").agg(F.count(F.lit(1)).alias("n_events")).select("account_id", F.col("session_window.start").alias("started"), "n_events")
