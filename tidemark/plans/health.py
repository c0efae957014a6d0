"""Reliability, support and trust queries over `events`: an error stands for a crash, a ticket or a negative mention."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import intervals, series
from tidemark.operators.activity import share
from tidemark.plans.base import Registry
from tidemark.sources import tables as T

R = Registry()


def errors(spark, sf):
    return T.of(T.events(spark, sf), "error")


@R.query("""
WITH m AS (SELECT day, date_trunc('minute', ts) AS minute, bool_or(event = 'error') AS bad FROM ev GROUP BY ALL)
SELECT day, count(*) AS minutes, round(avg((NOT bad)::INT), 6) AS uptime FROM m GROUP BY day
""", uses="ev")
def uptime(spark, sf):
    """Share of observed minutes without an error."""
    minute = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60)
    m = T.events(spark, sf).groupBy("day", minute.alias("minute")).agg(F.bool_or(F.col("event") == "error").alias("bad"))
    return m.groupBy("day").agg(F.count(F.lit(1)).alias("minutes"), series.rate(~F.col("bad")).alias("uptime"))


@R.query("SELECT day, event, count(*) AS n, round(quantile_cont(value, 0.95), 6) AS p95 FROM ev GROUP BY day, event", uses="ev")
def p95(spark, sf):
    return T.events(spark, sf).groupBy("day", "event").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@R.query("""
WITH s AS (SELECT week, account_id, day, bool_or(event = 'error') AS bad FROM ev GROUP BY ALL), u AS (SELECT week, account_id, bool_or(bad) AS bad FROM s GROUP BY ALL),
a AS (SELECT week, round(avg((NOT bad)::INT), 6) AS crash_free_sessions FROM s GROUP BY 1), b AS (SELECT week, round(avg((NOT bad)::INT), 6) AS crash_free_users FROM u GROUP BY 1) SELECT * FROM a JOIN b USING (week)
""", uses="ev")
def crash_free(spark, sf):
    """Per session (an account's day) and per user: two numbers that differ."""
    s = T.events(spark, sf).groupBy("week", "account_id", "day").agg(F.bool_or(F.col("event") == "error").alias("bad"))
    u = s.groupBy("week", "account_id").agg(F.bool_or("bad").alias("bad"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("bad")).alias("good"))
    return u.groupBy("week").agg(share(F.sum("good"), F.sum("n")).alias("crash_free_sessions"), series.rate(~F.col("bad")).alias("crash_free_users"))


@R.query("""
WITH t AS (SELECT week, count(DISTINCT (account_id, k)) AS tickets FROM ev WHERE event = 'error' GROUP BY 1), a AS (SELECT week, count(DISTINCT account_id) AS active FROM ev WHERE event = 'purchase' GROUP BY 1)
SELECT week, coalesce(tickets, 0) AS tickets, active, round(coalesce(tickets, 0) * 100.0 / active, 6) AS per_100 FROM a LEFT JOIN t USING (week)
""", uses="ev")
def tickets_per_100(spark, sf):
    """One problem (k) from one person is one ticket."""
    t = errors(spark, sf).select("week", "account_id", "k").distinct().groupBy("week").agg(F.count(F.lit(1)).alias("tickets"))
    a = T.actions(spark, sf).groupBy("week").agg(F.count_distinct("account_id").alias("active"))
    n = F.coalesce("tickets", F.lit(0))
    return a.join(t, "week", "left").select("week", n.alias("tickets"), "active", share(n * 100, F.col("active")).alias("per_100"))


@R.query("SELECT week, count(*) AS mentions, count(*) FILTER (WHERE event = 'error') AS negative, round(avg((event = 'error')::INT), 6) AS negative_share FROM ev WHERE event IN ('error', 'click') GROUP BY week", uses="ev")
def negative_share(spark, sf):
    """The share beside the absolute number."""
    bad = F.col("event") == "error"
    return T.of(T.events(spark, sf), "error", "click").groupBy("week").agg(F.count(F.lit(1)).alias("mentions"), F.count_if(bad).alias("negative"), series.rate(bad).alias("negative_share"))


@R.query("SELECT k // 10 AS theme, count(DISTINCT account_id) AS people FROM ev WHERE event = 'error' GROUP BY 1", uses="ev")
def theme_counts(spark, sf):
    """Distinct people per theme; the theme is the tens of k."""
    return errors(spark, sf).groupBy(F.expr("int(k div 10)").alias("theme")).agg(F.count_distinct("account_id").alias("people"))


@R.query("""
WITH t AS (SELECT k // 10 AS theme, count(DISTINCT account_id) AS people FROM ev WHERE event = 'error' GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY people DESC, theme) AS place FROM t)
SELECT CAST(place AS INT) AS place, theme, people FROM r WHERE place <= 3
""", uses="ev")
def topk_themes(spark, sf):
    rows = theme_counts(spark, sf).withColumn("place", F.row_number().over(W.orderBy(F.col("people").desc(), "theme")))
    return rows.where("place <= 3").select("place", "theme", "people")


@R.query("""
WITH e AS (SELECT event_id, account_id, ts FROM ev WHERE event = 'error'), n AS (SELECT e.event_id, e.ts, min(v.ts) AS nxt FROM e LEFT JOIN ev v ON v.account_id = e.account_id AND v.event = 'click' AND v.ts > e.ts GROUP BY ALL)
SELECT count(*) AS tickets, round(quantile_cont((epoch_us(nxt) - epoch_us(ts)) / 3600000000.0, 0.5), 4) AS median_hours, count(*) FILTER (WHERE nxt IS NULL OR nxt > ts + INTERVAL 24 HOUR) AS overdue FROM n
""", uses="ev")
def median_reply(spark, sf):
    """Median hours to a reply (the next click), and tickets without one for more than 24 hours."""
    ev = T.events(spark, sf)
    rows = intervals.next_after(T.of(ev, "error").select("event_id", "account_id", "ts"), T.of(ev, "click").select("account_id", "ts"), "account_id")
    hours = (intervals.micros(F.col("next_ts")) - intervals.micros(F.col("ts"))) / 3600000000.0
    late = ~F.coalesce(intervals.within(F.col("ts"), F.col("next_ts"), 24), F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("tickets"), F.round(F.percentile(hours, 0.5), 4).alias("median_hours"), F.count_if(late).alias("overdue"))


@R.query("SELECT week, count(*) AS bookings, round(avg((k < 50)::INT), 6) AS self_service FROM ev WHERE event = 'purchase' GROUP BY week", uses="ev")
def self_service_share(spark, sf):
    """Bookings that clients make themselves (k below 50)."""
    return T.actions(spark, sf).groupBy("week").agg(F.count(F.lit(1)).alias("bookings"), series.rate(F.col("k") < 50).alias("self_service"))


@R.query("""
WITH d AS (SELECT event_id, day, account_id, ts FROM ev WHERE event = 'purchase'), n AS (SELECT d.event_id, d.day, count(v.event_id) AS sends, min(v.ts) > d.ts + INTERVAL 15 MINUTE AS late FROM d LEFT JOIN ev v ON v.account_id = d.account_id AND v.event = 'click' AND v.ts >= d.ts AND v.ts <= d.ts + INTERVAL 24 HOUR GROUP BY d.event_id, d.day, d.ts)
SELECT day, count(*) AS due, count(*) FILTER (WHERE sends > 0) AS sent, count(*) FILTER (WHERE sends > 1) AS sent_twice, count(*) FILTER (WHERE late) AS late FROM n GROUP BY day
""", uses="ev")
def outbox_counters(spark, sf):
    """Reminders due, sent, sent twice and sent more than 15 minutes late."""
    ev = T.events(spark, sf)
    due = T.of(ev, "purchase").select("event_id", "account_id", "ts", "day")
    sent = T.of(ev, "click").select(F.col("account_id").alias("_a"), F.col("ts").alias("at"))
    hits = due.join(sent, (F.col("account_id") == F.col("_a")) & intervals.within(F.col("ts"), F.col("at"), 24)).groupBy("event_id").agg(F.count(F.lit(1)).alias("sends"), F.min("at").alias("first"))
    n = due.join(hits, "event_id", "left")
    late = intervals.micros(F.col("first")) - intervals.micros(F.col("ts")) > 15 * 60_000_000
    return n.groupBy("day").agg(F.count(F.lit(1)).alias("due"), F.count_if(F.col("sends") > 0).alias("sent"), F.count_if(F.col("sends") > 1).alias("sent_twice"), F.count_if(late).alias("late"))


@R.query("""
WITH u AS (SELECT account_id, sum(k) AS used FROM ev GROUP BY 1)
SELECT CASE WHEN used < 2800 THEN '1 below 2800' WHEN used < 3300 THEN '2 below 3300' WHEN used < 3800 THEN '3 below 3800' ELSE '4 at quota' END AS bucket, count(*) AS accounts FROM u GROUP BY 1
""", uses="ev")
def bucket_histogram(spark, sf):
    """Accounts by use in four buckets; no account is named."""
    used = F.col("used")
    bucket = F.when(used < 2800, "1 below 2800").when(used < 3300, "2 below 3300").when(used < 3800, "3 below 3800").otherwise("4 at quota")
    return T.events(spark, sf).groupBy("account_id").agg(F.sum("k").alias("used")).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("accounts"))


@R.query("""
WITH a AS (SELECT week, count(DISTINCT account_id) AS active, count(DISTINCT account_id) FILTER (WHERE event = 'error') AS reporting FROM ev GROUP BY 1) SELECT week, active, reporting, round(reporting::DOUBLE / active, 6) AS health FROM a
""", uses="ev")
def channel_health(spark, sf):
    """Users with at least one report among the active."""
    a = T.events(spark, sf).groupBy("week", "account_id").agg(F.bool_or(F.col("event") == "error").alias("reported"))
    return a.groupBy("week").agg(F.count(F.lit(1)).alias("active"), F.count_if("reported").alias("reporting"), series.rate(F.col("reported")).alias("health"))


@R.query("""
WITH e AS (SELECT event_id, k, account_id, ts FROM ev WHERE event = 'error'),
f AS (SELECT e.event_id, EXISTS (SELECT 1 FROM ev v WHERE v.account_id = e.account_id AND v.event = 'purchase' AND v.ts > e.ts AND v.ts <= e.ts + INTERVAL 72 HOUR) AS task, EXISTS (SELECT 1 FROM ev v WHERE v.account_id = e.account_id AND v.event = 'click' AND v.ts > e.ts AND v.ts <= e.ts + INTERVAL 24 HOUR) AS closed FROM e)
SELECT count(*) AS tickets, round(avg(task::INT), 6) AS to_task, round(avg(closed::INT), 6) AS closed_loop, avg(task::INT) < 0.1 OR avg(task::INT) > 0.9 AS suspect FROM f
""", uses="ev")
def ticket_conversion(spark, sf):
    """Tickets that became tasks, and loops closed; a tenth and nine tenths are equally suspect."""
    ev = T.events(spark, sf)
    e = T.of(ev, "error").select("event_id", "account_id", "ts")
    e = intervals.next_after(e, T.of(ev, "purchase").select("account_id", "ts"), "account_id", alias="task_at")
    e = intervals.next_after(e, T.of(ev, "click").select("account_id", "ts"), "account_id", alias="reply_at")
    task = F.coalesce(intervals.within(F.col("ts"), F.col("task_at"), 72), F.lit(False))
    closed = F.coalesce(intervals.within(F.col("ts"), F.col("reply_at"), 24), F.lit(False))
    raw = F.avg(task.cast("int"))
    return e.agg(F.count(F.lit(1)).alias("tickets"), series.rate(task).alias("to_task"), series.rate(closed).alias("closed_loop"), ((raw < 0.1) | (raw > 0.9)).alias("suspect"))


@R.query("SELECT week, k // 10 AS theme, count(*) AS reports, CASE WHEN count(*) >= 3 THEN 'signal' ELSE 'anecdote' END AS verdict FROM ev WHERE event = 'error' GROUP BY 1, 2", uses="ev")
def signal_threshold(spark, sf):
    """Three reports of a kind in a week are a signal, fewer an anecdote."""
    n = errors(spark, sf).groupBy("week", F.expr("int(k div 10)").alias("theme")).agg(F.count(F.lit(1)).alias("reports"))
    return n.withColumn("verdict", F.when(F.col("reports") >= 3, "signal").otherwise("anecdote"))


@R.query("SELECT k >= 50 AS prepaid, count(*) AS booked, count(*) FILTER (WHERE event = 'error') AS missed, round(avg((event = 'error')::INT), 6) AS no_show FROM ev WHERE event IN ('purchase', 'error') GROUP BY 1", uses="ev")
def no_show_split(spark, sf):
    """Missed bookings with and without prepayment (k of 50 or more)."""
    missed = F.col("event") == "error"
    return T.of(T.events(spark, sf), "purchase", "error").groupBy((F.col("k") >= 50).alias("prepaid")).agg(F.count(F.lit(1)).alias("booked"), F.count_if(missed).alias("missed"), series.rate(missed).alias("no_show"))


@R.query("""
WITH c AS (SELECT event_id, account_id, date_trunc('hour', ts) AS slot, k FROM ev WHERE event = 'error'), s AS (SELECT DISTINCT date_trunc('hour', ts) AS slot, account_id FROM ev WHERE event = 'purchase'),
f AS (SELECT c.event_id, c.k, EXISTS (SELECT 1 FROM s WHERE s.slot = c.slot AND s.account_id <> c.account_id) AS resold FROM c)
SELECT count(*) AS cancelled, round(avg(resold::INT), 6) AS resold_share, round(avg((k < 20)::INT), 6) AS late_share FROM f
""", uses="ev")
def resold_share(spark, sf):
    """Cancelled hours that someone else bought, and late cancellations (k below 20).

    Distinct buyers of an hour are counted before the join, with the canceller's own purchase taken off, so an hour's buyers never
    meet its cancellations pair by pair.
    """
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("slot")
    bought = T.actions(spark, sf).select(hour, "account_id").distinct()
    per_slot = bought.groupBy(F.col("slot").alias("_s")).agg(F.count(F.lit(1)).alias("buyers"))
    own = bought.select(F.col("slot").alias("_o"), F.col("account_id").alias("_a"), F.lit(1).alias("own"))
    c = errors(spark, sf).select(hour, "account_id", "k")
    f = c.join(per_slot, F.col("slot") == F.col("_s"), "left").join(own, (F.col("slot") == F.col("_o")) & (F.col("account_id") == F.col("_a")), "left")
    resold = F.coalesce("buyers", F.lit(0)) - F.coalesce("own", F.lit(0)) > 0
    return f.agg(F.count(F.lit(1)).alias("cancelled"), series.rate(resold).alias("resold_share"), series.rate(F.col("k") < 20).alias("late_share"))


@R.query("SELECT day, event AS metric, round(avg(value), 6) AS mean, max(value) AS peak FROM ev GROUP BY day, event", uses="ev")
def gauge_daily(spark, sf):
    return T.events(spark, sf).groupBy("day", F.col("event").alias("metric")).agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("peak"))


@R.query("""
WITH e AS (SELECT a.event_id, a.k // 10 AS theme, a.ts, min(n.ts) AS again FROM ev a LEFT JOIN ev n ON n.event = 'error' AND n.account_id = a.account_id AND n.k // 10 = a.k // 10 AND n.ts > a.ts WHERE a.event = 'error' GROUP BY ALL)
SELECT theme, count(*) AS tickets, round(avg((again IS NULL OR again > ts + INTERVAL 14 DAY)::INT), 6) AS not_returning FROM e GROUP BY theme
""", uses="ev")
def ticket_recurrence(spark, sf):
    """Tickets whose author does not come back with the same theme within 14 days."""
    e = errors(spark, sf).withColumn("theme", F.expr("int(k div 10)")).select("event_id", "theme", F.concat_ws(":", "account_id", "theme").alias("who"), "ts")
    rows = intervals.next_after(e, e, "who")
    back = F.coalesce(intervals.within(F.col("ts"), F.col("next_ts"), 14 * 24), F.lit(False))
    return rows.groupBy("theme").agg(F.count(F.lit(1)).alias("tickets"), series.rate(~back).alias("not_returning"))


@R.query("""
WITH r AS (SELECT event_id, ts FROM ev WHERE event = 'signup' AND k >= 95),
c AS (SELECT r.event_id, r.ts AS released, count(*) FILTER (WHERE v.ts > r.ts AND v.ts <= r.ts + INTERVAL 72 HOUR) AS after, count(*) FILTER (WHERE v.ts <= r.ts AND v.ts >= r.ts - INTERVAL 72 HOUR) AS before FROM r LEFT JOIN ev v ON v.event = 'error' AND v.ts >= r.ts - INTERVAL 72 HOUR AND v.ts <= r.ts + INTERVAL 72 HOUR GROUP BY ALL)
SELECT event_id, released, before, after, after > 2 * before AND after >= 10 AS breach FROM c
""", uses="ev")
def release_cancellations(spark, sf):
    """Cancellations (errors) in the 72 hours after a release (a signup with k of 95 or more) against those before.

    Errors are counted by hour first; a release then looks up running totals at its ends instead of meeting every error.
    """
    ev = T.events(spark, sf)
    release = T.of(ev, "signup").where("k >= 95").select("event_id", F.col("ts").alias("released"))
    third = 72 * 3_600_000_000
    edges = release.select("event_id", "released", F.explode(F.array(F.struct(F.lit(0).alias("edge"), (intervals.micros(F.col("released")) - third - 1).alias("at")), F.struct(F.lit(1).alias("edge"), intervals.micros(F.col("released")).alias("at")), F.struct(F.lit(2).alias("edge"), (intervals.micros(F.col("released")) + third).alias("at")))).alias("e")).select("event_id", "released", "e.*")
    errs = T.of(ev, "error").select(intervals.micros(F.col("ts")).alias("at"))
    hour = F.floor(F.col("at") / 3_600_000_000)
    totals = errs.groupBy(hour.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    points = edges.withColumn("h", hour)
    heads = points.select("h").distinct().withColumn("probe", F.lit(1)).unionByName(totals.withColumn("probe", F.lit(0)), allowMissingColumns=True)
    heads = heads.withColumn("head", F.sum(F.coalesce("n", F.lit(0))).over(W.orderBy("h").rangeBetween(W.unboundedPreceding, -1))).where("probe = 1").select("h", F.coalesce("head", F.lit(0)).alias("head"))
    inside = points.join(errs.select(hour.alias("_h"), F.col("at").alias("_at")), (F.col("h") == F.col("_h")) & (F.col("_at") <= F.col("at"))).groupBy("event_id", "edge").agg(F.count(F.lit(1)).alias("part"))
    counted = points.join(heads, "h").join(inside, ["event_id", "edge"], "left").select("event_id", "released", "edge", (F.col("head") + F.coalesce("part", F.lit(0))).alias("c"))
    wide = counted.groupBy("event_id", "released").agg(*[F.max(F.when(F.col("edge") == i, F.col("c"))).alias(f"c{i}") for i in range(3)])
    before, after = F.col("c1") - F.col("c0"), F.col("c2") - F.col("c1")
    return wide.select("event_id", "released", before.alias("before"), after.alias("after"), ((after > 2 * before) & (after >= 10)).alias("breach"))


@R.query("SELECT event_id, account_id, n_recent, n_recent >= 3 AS burst FROM (SELECT event_id, account_id, count(*) OVER (PARTITION BY account_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n_recent FROM ev WHERE event = 'error')", uses="ev")
def burst_24h(spark, sf):
    """Three negatives within 24 hours."""
    return intervals.recent_count(errors(spark, sf), "account_id", 86400).select("event_id", "account_id", "n_recent", (F.col("n_recent") >= 3).alias("burst"))


@R.query("SELECT day, n_max > 2 AS alert, CAST(n_max AS BIGINT) AS most_restarts FROM (SELECT day, max(n) AS n_max FROM (SELECT day, count(*) OVER (PARTITION BY product ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM ev WHERE event = 'error' AND k >= 90) GROUP BY day)", uses="ev")
def restart_alert(spark, sf):
    """More than two restarts (errors with k of 90 or more) of a product within 24 hours."""
    n = intervals.recent_count(errors(spark, sf).where("k >= 90"), "product", 86400)
    return n.groupBy("day").agg(F.max("n_recent").alias("most_restarts")).select("day", (F.col("most_restarts") > 2).alias("alert"), "most_restarts")


@R.query("""
WITH d AS (SELECT DISTINCT day FROM ev WHERE event = 'purchase' AND k >= 97), s AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day),
l AS (SELECT s.day, max(d.day) OVER (ORDER BY s.day) AS last_seen FROM s LEFT JOIN d ON s.day = d.day)
SELECT day, last_seen, CAST(day - last_seen AS INT) AS silent_days, CASE WHEN day - last_seen >= 7 THEN 'P0' WHEN day - last_seen >= 3 THEN 'P1' END AS priority FROM l
""", uses="ev")
def silence_days(spark, sf):
    """Days since the last data; three make a P1, seven a P0."""
    days = T.actions(spark, sf).where("k >= 97").select("day").distinct()
    s = series.silence(days)
    return s.withColumn("priority", F.when(F.col("silent_days") >= 7, "P0").when(F.col("silent_days") >= 3, "P1"))


@R.query("SELECT event_id, account_id, CAST(n AS BIGINT) AS in_minute, n <= 1 AS accepted FROM (SELECT event_id, account_id, count(*) OVER (PARTITION BY account_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS n FROM ev)", uses="ev")
def rate_limit(spark, sf):
    """The batch form of the sliding rate limit, with one event a minute so that the limit shows on this data."""
    rows = intervals.recent_count(T.events(spark, sf), "account_id", 59, "in_minute")
    return rows.select("event_id", "account_id", "in_minute", (F.col("in_minute") <= 1).alias("accepted"))
