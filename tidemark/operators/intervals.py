"""Joins on a key and a stretch of time, and as-of lookups.

Spark has no as-of join, and a range join multiplies the rows of a busy key. Here a key's time is cut into chunks: a window
runs within (key, chunk), and a summary with a row per (key, chunk) carries over what a neighbouring chunk knows. No task
has to hold all rows of a key, and a row is never paired with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR = 3_600_000_000
#: Length of a chunk. A key that holds a third of all rows is spread over as many tasks as it has chunks.
CHUNK_HOURS = 24


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def chunk_of(ts: Column, hours: float = CHUNK_HOURS) -> Column:
    return F.floor(micros(ts) / int(hours * HOUR))


def within(left: Column, right: Column, hours: float) -> Column:
    """right is at most `hours` after left, both ends included."""
    gap = micros(right) - micros(left)
    return (gap >= 0) & (gap <= int(hours * HOUR))


def _carried(left: DataFrame, known: DataFrame, key: str, best, frame) -> DataFrame:
    """(_key, _c, _carry): for each (key, chunk) of left the best of what chunks in frame know. Works on summaries only."""
    asked = left.select(key, "_chunk").distinct().withColumn("_ask", F.lit(True))
    marks = known.withColumn("_ask", F.lit(False)).unionByName(asked, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy("_chunk").rangeBetween(*frame)
    return marks.withColumn("_carry", best("_known").over(w)).where("_ask").select(F.col(key).alias("_key"), F.col("_chunk").alias("_c"), "_carry")


def next_after(left: DataFrame, right: DataFrame, key: str, ts: str = "ts", alias: str = "next_ts", strict: bool = True) -> DataFrame:
    """left plus the time of the first right row of the same key after it (or at the same time, if not strict)."""
    left, right = left.withColumn("_chunk", chunk_of(F.col(ts))), right.select(key, ts).withColumn("_chunk", chunk_of(F.col(ts)))
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    here = W.partitionBy(key, "_chunk").orderBy(micros(F.col(ts))).rangeBetween(1 if strict else 0, W.unboundedFollowing)
    near = both.withColumn("_near", F.min(F.when(F.col("_side") == 1, F.col(ts))).over(here)).where("_side = 0")
    firsts = right.groupBy(key, "_chunk").agg(F.min(ts).alias("_known"))
    later = _carried(left, firsts, key, F.min, (1, W.unboundedFollowing))
    out = near.join(later, (F.col(key) == F.col("_key")) & (F.col("_chunk") == F.col("_c")), "left")
    return out.withColumn(alias, F.coalesce("_near", "_carry")).drop("_side", "_chunk", "_near", "_key", "_c", "_carry")


def last_before(left: DataFrame, right: DataFrame, key: str, value: str, tie: str, ts: str = "ts", alias: str = "last_value", strict: bool = True) -> DataFrame:
    """left plus `value` of the last right row of the same key before it (or at the same time, if not strict); of rows at one time that with the largest `tie`."""
    row = F.struct(F.col(ts).alias("t"), F.col(tie).alias("i"), F.col(value).alias("v")).alias("_r")
    left, right = left.withColumn("_chunk", chunk_of(F.col(ts))), right.select(key, ts, row).withColumn("_chunk", chunk_of(F.col(ts)))
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    here = W.partitionBy(key, "_chunk").orderBy(micros(F.col(ts))).rangeBetween(W.unboundedPreceding, -1 if strict else 0)
    near = both.withColumn("_near", F.max("_r").over(here)).where("_side = 0").drop("_r")
    lasts = right.groupBy(key, "_chunk").agg(F.max("_r").alias("_known"))
    before = _carried(left, lasts, key, F.max, (W.unboundedPreceding, -1))
    out = near.join(before, (F.col(key) == F.col("_key")) & (F.col("_chunk") == F.col("_c")), "left")
    return out.withColumn(alias, F.coalesce("_near", "_carry")["v"]).drop("_side", "_chunk", "_near", "_key", "_c", "_carry")


def recent_count(rows: DataFrame, key: str, seconds: int, alias: str = "n_recent") -> DataFrame:
    """rows plus how many of the same key lie in the `seconds` up to and including each, by whole seconds.

    A row whose reach ends in the next chunk is also a witness there, so every window has all that it counts.
    """
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    length = max(seconds, CHUNK_HOURS * 3600)
    own, reach = F.floor(at / length), F.floor((at + seconds) / length)
    spread = rows.withColumn("_at", at).withColumn("_own", own).withColumn("_chunk", F.explode(F.array_distinct(F.array(own, reach))))
    w = W.partitionBy(key, "_chunk").orderBy("_at").rangeBetween(-seconds, 0)
    return spread.withColumn(alias, F.count(F.lit(1)).over(w)).where("_chunk = _own").drop("_at", "_own", "_chunk")


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """(account_id, started, ended, n_events) of technical sessions: a gap of more than gap_minutes begins another.

    Within a chunk the row before tells whether a session begins; the first row of a chunk looks at the last of the chunk before
    it. Sessions are numbered within the chunk, on top of the number begun in earlier chunks.
    """
    rows = events.select("account_id", "ts", "event_id").withColumn("_chunk", chunk_of(F.col("ts")))
    w = W.partitionBy("account_id", "_chunk").orderBy("ts", "event_id")
    by_chunk = W.partitionBy("account_id").orderBy("_chunk")
    ends = rows.groupBy("account_id", "_chunk").agg(F.max("ts").alias("_end")).withColumn("_prev", F.lag("_end").over(by_chunk))
    keys = ["account_id", "_chunk"]
    before = F.coalesce(F.lag("ts").over(w), F.col("_prev"))
    gap = micros(F.col("ts")) - micros(before)
    marked = rows.join(ends.drop("_end"), keys).withColumn("_begins", F.coalesce(gap > gap_minutes * 60_000_000, F.lit(True)).cast("int"))
    begun = marked.groupBy(*keys).agg(F.sum("_begins").alias("_n")).withColumn("_head", F.coalesce(F.sum("_n").over(by_chunk.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    numbered = marked.join(begun.drop("_n"), keys).withColumn("_session", F.col("_head") + F.sum("_begins").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("account_id", "_session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n_events")).drop("_session")


def running(probes: DataFrame, totals: DataFrame, at: str, n: str, alias: str = "head") -> DataFrame:
    """(at, head) of distinct probes: the sum of n over all totals before each. Both have a row for an hour or so at most, so one task holds them."""
    marks = probes.select(at, F.lit(True).alias("_probe")).unionByName(totals.select(at, n, F.lit(False).alias("_probe")), allowMissingColumns=True)
    before = F.sum(F.coalesce(n, F.lit(0))).over(W.orderBy(at).rangeBetween(W.unboundedPreceding, -1))
    return marks.withColumn(alias, F.coalesce(before, F.lit(0))).where("_probe").select(at, alias)
