"""The outbox: one row for each (session, kind), whatever comes how often.

Rows lie in buckets by a hash of their key. A change reads the buckets of the keys it names, merges, and puts new buckets in their place by one manifest; a
second writer finds that out and does it again on what is there then. A micro-batch leaves its number in the same manifest, so one that is run again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.snapshots import Conflict, SnapshotTable

SCHEMA = "bucket int, session_id long, kind string, due_at timestamp, status string, attempts int, send_count int, late boolean, locked_by string, locked_at timestamp, sent_at timestamp, last_error string"
KEY = ("session_id", "kind")
# Attempts before a message is given up, minutes after which a sent one counts as late, and tries of a change that meets another writer.
ATTEMPTS, LATE_MINUTES, RETRIES = 5, 15, 8
LEASE_MINUTES = 10


class Outbox:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.table = SnapshotTable(spark, path, SCHEMA, "bucket")

    def rows(self) -> DataFrame:
        return self.table.read()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def _change(self, keyed: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], source: str, batch: int | None) -> bool:
        """Merge a row for each key into the table. False if this source's batch has been merged before."""
        for left in reversed(range(RETRIES)):
            base = self.table.manifest()
            if batch is not None and base["marks"].get(source, -1) >= batch:
                return False
            own = keyed.withColumn("bucket", self._bucket())
            touched = [r[0] for r in own.select("bucket").distinct().collect()]  # a row for each bucket
            new = merge(self.table.read(touched, base), own)
            try:
                self.table.replace(new.hint("rebalance", "bucket"), touched, {source: batch} if batch is not None else {}, base)
                return True
            except Conflict:
                if not left:
                    raise
        return False

    @staticmethod
    def _beside(old: DataFrame, new: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        """All rows of old, and for keys of new its columns as n_<name>; keys that old lacks have nulls in old's columns."""
        right = new.select("bucket", *KEY, *[F.col(c).alias(f"n_{c}") for c in columns], F.lit(True).alias("n_here"))
        return old.withColumn("here", F.lit(True)).join(right, ["bucket", *KEY], "full_outer")

    def plan(self, messages: DataFrame, source: str = "plan", batch: int | None = None) -> bool:
        """messages: (session_id, kind, due_at). A new key is entered; one that is not sent yet takes the new time, also if it was skipped; what is sent stays. Of several rows of a key the latest time counts."""
        keyed = messages.where("session_id is not null and kind is not null").groupBy(*KEY).agg(F.max("due_at").alias("due_at"))

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            both = self._beside(old, new, ("due_at",))
            fresh, open_ = F.col("here").isNull(), F.col("status").isin("pending", "skipped") & F.col("n_here").isNotNull()
            zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
            return both.select("bucket", *KEY, F.when(fresh | open_, F.col("n_due_at")).otherwise(F.col("due_at")).alias("due_at"), F.when(fresh | open_, "pending").otherwise(F.col("status")).alias("status"), zero("attempts"), zero("send_count"), F.coalesce("late", F.lit(False)).alias("late"), "locked_by", "locked_at", "sent_at", "last_error")

        return self._change(keyed, merge, source, batch)

    def skip(self, keys: DataFrame, source: str = "skip", batch: int | None = None) -> bool:
        """Messages that are no longer wanted; what is sent stays sent."""

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            both = self._beside(old, new, ()).where("here")
            return both.withColumn("status", F.when(F.col("n_here").isNotNull() & (F.col("status") == "pending"), "skipped").otherwise(F.col("status"))).select(*old.columns)

        return self._change(keys.select(*KEY).distinct(), merge, source, batch)

    def _due(self, rows: DataFrame, now: Column) -> Column:
        free = F.col("locked_at").isNull() | (F.col("locked_at") < now - F.make_dt_interval(mins=F.lit(LEASE_MINUTES)))
        return (F.col("status") == "pending") & (F.col("due_at") <= now) & free

    def claim(self, worker: str, now: Column, limit: int | None = None) -> DataFrame:
        """Lock for this worker what was due and is not sent, however long ago, the longest due first if limited; gives those rows. A lock whose lease has run out is free."""
        due = self.rows().where(self._due(self.rows(), now)).select(*KEY, "due_at")
        keyed = (due.orderBy("due_at", *KEY).limit(limit) if limit else due).select(*KEY)

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            both = self._beside(old, new, ()).where("here")
            take = F.col("n_here").isNotNull() & self._due(old, now)  # another worker may have been quicker
            return both.withColumn("locked_by", F.when(take, F.lit(worker)).otherwise(F.col("locked_by"))).withColumn("locked_at", F.when(take, now).otherwise(F.col("locked_at"))).select(*old.columns)

        self._change(keyed, merge, "claim", None)
        return self.rows().where((F.col("locked_by") == worker) & (F.col("locked_at") == now))

    def settle(self, results: DataFrame, source: str = "settle", batch: int | None = None) -> bool:
        """results: (session_id, kind, ok, at, error), a row for each attempt. A message that went out is sent, late if more than 15 minutes after its time; after five attempts without success it has failed."""
        keyed = results.groupBy(*KEY).agg(F.count(F.lit(1)).cast("int").alias("tries"), F.count_if("ok").cast("int").alias("sends"), F.min(F.when(F.col("ok"), F.col("at"))).alias("first"), F.max_by("error", F.when(~F.col("ok"), F.col("at"))).alias("error"))

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            both = self._beside(old, new, ("tries", "sends", "first", "error")).where("here")
            n = lambda c: F.coalesce(f"n_{c}", F.lit(0))
            tried, sent = F.col("n_here").isNotNull(), F.coalesce("sent_at", "n_first")
            attempts = F.col("attempts") + n("tries")
            status = F.when(~tried, F.col("status")).when(sent.isNotNull(), "sent").when(attempts >= ATTEMPTS, "failed").otherwise(F.col("status"))
            late = F.coalesce(sent > F.col("due_at") + F.make_dt_interval(mins=F.lit(LATE_MINUTES)), F.lit(False))
            lock = lambda c: F.when(~tried, F.col(c)).alias(c)
            return both.select("bucket", *KEY, "due_at", status.alias("status"), attempts.alias("attempts"), (F.col("send_count") + n("sends")).alias("send_count"), late.alias("late"), lock("locked_by"), lock("locked_at"), sent.alias("sent_at"), F.when(sent.isNull(), F.coalesce("n_error", "last_error")).alias("last_error"))

        return self._change(keyed, merge, source, batch)

    def counters(self, now: Column) -> DataFrame:
        """due, sent, sent_twice and late: what the panel shows."""
        due = (F.col("due_at") <= now) & (F.col("status") != "skipped")
        return self.rows().agg(F.count_if(due).alias("due"), F.count_if(F.col("send_count") > 0).alias("sent"), F.count_if(F.col("send_count") > 1).alias("sent_twice"), F.count_if("late").alias("late"))


def plan_from(stream: DataFrame, outbox: Outbox, checkpoint: str, source: str = "plan") -> StreamingQuery:
    """A stream of (session_id, kind, due_at) into the outbox; a micro-batch that is run again after a failure is known by its number."""
    return stream.writeStream.foreachBatch(lambda batch, number: outbox.plan(batch, source, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
