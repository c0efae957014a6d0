"""Streams over the events table, run over all its files and read back; where SQL says the same in a batch, they are held against it."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.plans import governance
from tidemark.plans.base import Registry
from tidemark.sources import tables as T
from tidemark.streaming import ingest as S
from tidemark.streaming import limits, outbox, timers

R = Registry()
_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark):
    """Stateful operators of several states need the RocksDB store; the session's own choice comes back after."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def _events(spark, sf):
    ev = T.shaped(T.event_stream(spark, sf))
    return ev.withColumn("ts", F.col("ts").cast("timestamp"))


@R.query("SELECT CAST(date_trunc('week', ts + INTERVAL 3 HOUR) AS TIMESTAMP) - INTERVAL 3 HOUR AS week_start, count(*) AS events FROM events GROUP BY 1")
def stream_weekly(spark, sf):
    """Events per Moscow week from a stream: windows that begin on Sunday at 21:00 UTC."""
    rows = S.drained(S.tumbling(_events(spark, sf)), "weekly", "complete")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("week_start"), "events")


@R.query("SELECT CAST(date_trunc('week', ts + INTERVAL 3 HOUR) AS TIMESTAMP) - INTERVAL 3 HOUR AS week_start, count(DISTINCT user_id) AS wau FROM events WHERE event_type = 'purchase' GROUP BY 1")
def stream_wau(spark, sf):
    """Weekly actives from a stream, exactly: the stream gives each account of a week once, and the table it fills is counted."""
    rows = S.drained(S.weekly_accounts(_events(spark, sf).where("event = 'purchase'")), "wau")
    return rows.groupBy(F.col("start").cast("timestamp_ntz").alias("week_start")).agg(F.count(F.lit(1)).alias("wau"))


@R.query("""
WITH h AS (SELECT event_type AS event, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2)
SELECT start, event, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest([h - INTERVAL 2 HOUR, h - INTERVAL 1 HOUR, h]) AS start, event, n FROM h) GROUP BY 1, 2
""")
def stream_sliding(spark, sf):
    """Events of a kind in every three hours, by the hour."""
    rows = S.drained(S.sliding(_events(spark, sf), "3 hours", "1 hour"), "sliding", "complete")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event", "n")


@R.query("""
WITH g AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT user_id, ts, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id AS account_id, min(ts) AS started, count(*) AS n_events FROM n GROUP BY user_id, s
""")
def stream_sessions(spark, sf):
    """Technical sessions from a stream; the same as in a batch."""
    rows = S.drained(S.session_counts(_events(spark, sf)), "sessions", "complete")
    return rows.select("account_id", F.col("started").cast("timestamp_ntz").alias("started"), "n_events")


@R.query(governance._REASON + "SELECT event_id, coalesce(reason, 'accepted') AS verdict FROM r", uses="ev")
def stream_ingest(spark, sf):
    """Ingest as a stream: each event once, with its verdict."""
    once = S.deduplicated(governance.as_sent(_events(spark, sf)).withColumn("event_id", F.col("event_id").cast("string")))
    checked = ingest.validate(once, governance.EVENTS)
    rows = S.drained(checked.select(F.col("event_id").cast("long").alias("event_id"), F.coalesce("reason", F.lit("accepted")).alias("verdict")), "ingest")
    return rows


@R.query()
def stream_rate_limit(spark, sf):
    """At most two accepted events a device in ten minutes; what is refused does not count, so the rule is no window count."""
    rows = _events(spark, sf).select(F.col("event_id").cast("string").alias("event_id"), F.col("account_id").cast("string").alias("device_id"), "ts")
    with rocksdb(spark):
        out = S.drained(limits.rate_limited(rows, 2, 600), "limited")
    return out.select(F.col("event_id").cast("long").alias("event_id"), "device_id", "accepted")


@R.query("""
WITH once AS (SELECT DISTINCT account_id, day FROM ev WHERE event = 'purchase'), days AS (SELECT DISTINCT day FROM once WHERE day < (SELECT max(day) FROM once))
SELECT d.day, count(DISTINCT o.account_id) AS mau FROM days d JOIN once o ON o.day <= d.day AND o.day > d.day - 30 GROUP BY d.day
""", uses="ev")
def stream_mau(spark, sf):
    """Trailing-30-day actives from a stream, exactly: an account's state says when it joins the count and a timer when it leaves; a day is told once it is over."""
    with rocksdb(spark):
        steps = S.drained(timers.trailing_steps(_events(spark, sf).where("event = 'purchase'").select("account_id", "ts"), watermark="0 seconds"), "mau")
    moves = steps.groupBy("day").agg(F.sum("n").alias("n"), F.max("seen").alias("seen"))
    return moves.withColumn("mau", F.sum("n").over(W.orderBy("day"))).where("seen").select("day", "mau")  # a row for each day


@R.query("""
WITH d AS (SELECT DISTINCT day FROM ev WHERE event = 'purchase' AND k >= 97), s AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) - 1 FROM ev), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT s.day, max(d.day) OVER (ORDER BY s.day) AS last_seen, CAST(s.day - max(d.day) OVER (ORDER BY s.day) AS INT) AS silent_days FROM s LEFT JOIN d ON s.day = d.day
""", uses="ev")
def stream_silence(spark, sf):
    """Days since the last data, from a stream: timers speak of every day that is over, as long as anything at all moves time on."""
    name = F.when((F.col("event") == "purchase") & (F.col("k") >= 97), "pulse")
    with rocksdb(spark):
        rows = S.drained(timers.silence(_events(spark, sf).select("event", "k", "ts"), name, watermark="0 seconds"), "silence")
    return rows.select("day", "last_seen", "silent_days")


@R.query()
def stream_offline_queue(spark, sf):
    """An account's events through its offline queue: an error takes its network down, a sign-up brings it up again. When each was sent, and after how many refusals."""
    ev = _events(spark, sf)
    kind = F.when(F.col("event") == "error", "down").when(F.col("event") == "signup", "up").otherwise("event")
    rows = ev.select(F.col("account_id").cast("string").alias("device_id"), kind.alias("kind"), F.col("event_id").cast("string").alias("event_id"), "ts")
    with rocksdb(spark):
        out = S.drained(timers.offline_queue(rows, watermark="0 seconds"), "offline")
    return out.select(F.col("event_id").cast("long").alias("event_id"), "device_id", F.col("sent_at").cast("timestamp_ntz").alias("sent_at"), "pass", "refused")


@R.query("""
WITH s AS (SELECT event_id AS session_id, k, ts FROM ev WHERE event = 'purchase'), m AS (SELECT s.*, unnest(['client_1h', 'client_24h']) AS kind FROM s),
d AS (SELECT *, CASE WHEN kind = 'client_1h' THEN ts - INTERVAL 1 HOUR ELSE ts - INTERVAL 24 HOUR END + CASE WHEN k >= 90 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS due_at FROM m),
o AS (SELECT *, k % 3 <> 0 AS ok, k % 10 = 1 AS twice FROM d)
SELECT session_id, kind, CASE WHEN k = 13 THEN 'skipped' WHEN ok THEN 'sent' ELSE 'pending' END AS status, CAST(CASE WHEN k = 13 THEN 0 WHEN ok AND twice THEN 2 ELSE 1 END AS INT) AS attempts,
  CAST(CASE WHEN k = 13 OR NOT ok THEN 0 WHEN twice THEN 2 ELSE 1 END AS INT) AS send_count, k <> 13 AND ok AND k % 2 = 0 AS late, due_at FROM o
""", uses="ev")
def outbox_rows(spark, sf):
    """Two reminders a session through the outbox: planned in two micro-batches of which one comes twice and the second moves some, some skipped, all due ones claimed, results settled, one batch of them twice, and some sent again."""
    box = outbox.Outbox(spark, S.folder(spark, "outbox"), 8)
    s = T.of(T.events(spark, sf), "purchase").select(F.col("event_id").alias("session_id"), "k", F.col("ts").cast("timestamp").alias("ts"))
    ahead = F.make_dt_interval(hours=F.when(F.col("kind") == "client_1h", 1).otherwise(24))
    m = s.withColumn("kind", F.explode(F.array(F.lit("client_1h"), F.lit("client_24h")))).withColumn("due_at", F.col("ts") - ahead)
    first = m.where("k < 95").select("session_id", "kind", "due_at")
    moved = m.withColumn("due_at", F.col("due_at") + F.make_dt_interval(hours=F.when(F.col("k") >= 90, 2).otherwise(0))).select("session_id", "kind", "due_at")
    for batch, rows in ((1, first), (1, first), (2, moved)):
        box.plan(rows.unionByName(rows), "plan", batch)
    box.skip(m.where("k = 13").select("session_id", "kind"))
    now = F.lit("2025-01-01").cast("timestamp")
    claimed = box.claim("w1", now).join(s.select("session_id", "k"), "session_id")
    at = F.col("due_at") + F.make_dt_interval(mins=F.when(F.col("k") % 2 == 0, 20).otherwise(5))
    results = claimed.select("session_id", "kind", (F.col("k") % 3 != 0).alias("ok"), at.alias("at"), F.lit("refused").alias("error"), "k")
    box.settle(results.drop("k"), "results", 1)
    box.settle(results.drop("k"), "results", 1)
    again = box.rows().where("status = 'sent'").join(s.select("session_id", "k"), "session_id").where("k % 10 = 1")
    box.settle(again.select("session_id", "kind", F.lit(True).alias("ok"), now.alias("at"), F.lit(None).cast("string").alias("error")), "results", 2)
    return box.rows().select("session_id", "kind", "status", "attempts", "send_count", "late", F.col("due_at").cast("timestamp_ntz").alias("due_at"))


@R.query("""
WITH t AS (SELECT *, event = 'signup' AS toggles, k >= 50 AS grants FROM ev),
s AS (SELECT *, max(CASE WHEN toggles THEN {'t': ts, 'g': grants} END) OVER before AS last, min(CASE WHEN toggles THEN {'t': ts, 'g': grants} END) OVER after AS next FROM t
  WINDOW before AS (PARTITION BY account_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (PARTITION BY account_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT event_id, CAST(account_id AS VARCHAR) AS device_id FROM s WHERE NOT toggles AND (coalesce(last.g, false) OR coalesce(next.g, false))
""", uses="ev")
def stream_consent_queue(spark, sf):
    """Events that consent lets out: sign-ups grant it (k of 50 or more) or revoke it. What waits goes out with the next grant and is erased by a revocation."""
    kind = F.when(F.col("event") != "signup", "event").when(F.col("k") >= 50, "grant").otherwise("revoke")
    rows = _events(spark, sf).select(F.col("account_id").cast("string").alias("device_id"), kind.alias("kind"), F.col("event_id").cast("string").alias("event_id"), "ts")
    with rocksdb(spark):
        out = S.drained(limits.held_until_consent(rows), "consent")
    return out.select(F.col("event_id").cast("long").alias("event_id"), "device_id")
