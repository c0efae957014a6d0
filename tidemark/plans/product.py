"""Activity, cohorts and event-time queries over `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.operators import activity, cohorts, intervals, series
from tidemark.operators.activity import share
from tidemark.plans.base import Registry
from tidemark.sources import tables as T

R = Registry()


@R.query("""
WITH w AS (SELECT week, count(DISTINCT account_id) AS wau FROM ev WHERE event = 'purchase' GROUP BY week)
SELECT week, wau, round((wau - lag(wau) OVER (ORDER BY week))::DOUBLE / lag(wau) OVER (ORDER BY week), 6) AS wow_change FROM w
""", uses="ev")
def weekly_active(spark, sf):
    """Weekly active accounts by meaningful action, with the change from week to week."""
    return activity.distinct_accounts(T.actions(spark, sf), "week", alias="wau").select("week", "wau", activity.change("wau", "week", alias="wow_change"))


@R.query("SELECT week, count(*) AS sessions FROM ev WHERE event = 'purchase' GROUP BY week", uses="ev")
def nsm_weekly(spark, sf):
    """Held sessions per Moscow week."""
    return T.actions(spark, sf).groupBy("week").agg(F.count(F.lit(1)).alias("sessions"))


@R.query("SELECT day, count(DISTINCT account_id) AS dau FROM ev WHERE event = 'purchase' GROUP BY day", uses="ev")
def dau(spark, sf):
    return activity.distinct_accounts(T.actions(spark, sf), "day", alias="dau")


@R.query("SELECT week, product, count(DISTINCT account_id) AS wau FROM ev WHERE event = 'purchase' GROUP BY week, product", uses="ev")
def wau(spark, sf):
    return activity.distinct_accounts(T.actions(spark, sf), "week", "product", alias="wau")


_MAU = """
WITH once AS (SELECT DISTINCT account_id, day FROM ev WHERE event = 'purchase'), days AS (SELECT DISTINCT day FROM once),
mau AS (SELECT d.day, count(DISTINCT o.account_id) AS mau FROM days d JOIN once o ON o.day <= d.day AND o.day > d.day - 30 GROUP BY d.day)
"""


@R.query(_MAU + "SELECT day, mau FROM mau", uses="ev")
def mau_trailing30(spark, sf):
    return activity.trailing_distinct(T.actions(spark, sf), 30, "mau")


@R.query(_MAU + ", dau AS (SELECT day, count(*) AS dau FROM once GROUP BY day) SELECT day, dau, mau, round(dau::DOUBLE / mau, 6) AS stickiness FROM dau JOIN mau USING (day)", uses="ev")
def stickiness(spark, sf):
    acts = T.actions(spark, sf)
    both = activity.distinct_accounts(acts, "day", alias="dau").join(activity.trailing_distinct(acts, 30, "mau"), "day")
    return both.select("day", "dau", "mau", share(F.col("dau"), F.col("mau")).alias("stickiness"))


@R.query("""
SELECT week, product, CAST(grouping(product) AS TINYINT) AS is_total, count(DISTINCT account_id) AS wau FROM ev WHERE event = 'purchase' GROUP BY GROUPING SETS ((week, product), (week))
""", uses="ev")
def wau_grouping(spark, sf):
    """Per product and for the company; the parts do not add up to the whole."""
    return activity.with_total(T.actions(spark, sf), "week", "product", "wau")


@R.query("SELECT week, count(*) AS sessions, count(DISTINCT account_id) AS active, round(count(*)::DOUBLE / count(DISTINCT account_id), 6) AS per_active FROM ev WHERE event = 'purchase' GROUP BY week", uses="ev")
def per_active(spark, sf):
    return T.actions(spark, sf).groupBy("week").agg(F.count(F.lit(1)).alias("sessions"), F.count_distinct("account_id").alias("active")).withColumn("per_active", share(F.col("sessions"), F.col("active")))


@R.query("""
WITH s AS (SELECT event_id, week, account_id, ts FROM ev WHERE event = 'purchase'),
f AS (SELECT s.event_id, s.week, EXISTS (SELECT 1 FROM ev n WHERE n.event = 'click' AND n.account_id = s.account_id AND n.ts >= s.ts AND n.ts <= s.ts + INTERVAL 72 HOUR) AS covered FROM s)
SELECT week, count(*) AS held, count(*) FILTER (WHERE covered) AS covered, round(count(*) FILTER (WHERE covered)::DOUBLE / count(*), 6) AS coverage FROM f GROUP BY week
""", uses="ev")
def coverage_72h(spark, sf):
    """Share of held sessions with a note within 72 hours, both ends included."""
    ev = T.events(spark, sf)
    held = T.of(ev, "purchase").select("event_id", "account_id", "ts", "week")
    noted = intervals.next_after(held, T.of(ev, "click").select("account_id", "ts"), "account_id", strict=False)
    flags = noted.withColumn("ok", F.coalesce(intervals.within(F.col("ts"), F.col("next_ts"), 72), F.lit(False)))
    return flags.groupBy("week").agg(F.count(F.lit(1)).alias("held"), F.count_if("ok").alias("covered"), series.rate(F.col("ok")).alias("coverage"))


@R.query("SELECT week, count(k) AS finished, count(*) FILTER (WHERE k < 80) AS unfinished, round(count(*) FILTER (WHERE k < 80)::DOUBLE / nullif(count(k), 0), 6) AS unfinished_share FROM ev WHERE event = 'purchase' GROUP BY week", uses="ev")
def unfinished_share(spark, sf):
    """Practices ended below 80 per cent; an unknown percentage is in neither number."""
    rows = T.actions(spark, sf).groupBy("week").agg(F.count("k").alias("finished"), F.count_if(F.col("k") < 80).alias("unfinished"))
    return rows.withColumn("unfinished_share", share(F.col("unfinished"), F.col("finished")))


_ACT = """
WITH c AS (SELECT e.account_id, e.entered, count(*) FILTER (WHERE event = 'purchase') AS np, count(*) FILTER (WHERE event = 'click') AS nc
  FROM entry e LEFT JOIN ev v ON v.account_id = e.account_id AND v.event IN ('purchase', 'click') AND v.ts >= e.entered AND v.ts <= e.entered + INTERVAL 7 DAY GROUP BY ALL),
a AS (SELECT *, np >= 3 AND nc >= 2 AS activated, CAST(date_trunc('week', entered + INTERVAL 3 HOUR) AS DATE) AS cohort FROM c)
"""


@R.query(_ACT + "SELECT cohort, count(*) AS entered, count(*) FILTER (WHERE activated) AS activated, round(count(*) FILTER (WHERE activated)::DOUBLE / count(*), 6) AS rate FROM a GROUP BY cohort", uses="ev entry")
def activation(spark, sf):
    """Three held sessions and two cards within seven days of entry."""
    rows = cohorts.activation(T.entries(spark, sf), T.events(spark, sf), {"purchase": 3, "click": 2}, 7)
    return rows.withColumn("cohort", calendar.week(F.col("entered"))).groupBy("cohort").agg(F.count(F.lit(1)).alias("entered"), F.count_if("activated").alias("activated"), series.rate(F.col("activated")).alias("rate"))


@R.query("""
WITH c AS (SELECT account_id, CAST(date_trunc('week', entered + INTERVAL 3 HOUR) AS DATE) AS cohort, CAST(entered + INTERVAL 3 HOUR AS DATE) AS start FROM entry),
f AS (SELECT c.cohort, c.account_id, coalesce(bool_or(v.day - c.start = 1), false) AS d1, coalesce(bool_or(v.day - c.start = 7), false) AS d7 FROM c LEFT JOIN ev v ON v.account_id = c.account_id AND v.event = 'purchase' GROUP BY ALL)
SELECT cohort, count(*) AS size, round(avg(d1::INT), 6) AS d1, round(avg(d7::INT), 6) AS d7 FROM f GROUP BY cohort
""", uses="ev entry")
def retention_d(spark, sf):
    """Active on day n exactly."""
    return cohorts.retained_on(T.entries(spark, sf), T.actions(spark, sf), "day", [1, 7], "d")


@R.query("""
WITH c AS (SELECT account_id, CAST(date_trunc('week', entered + INTERVAL 3 HOUR) AS DATE) AS cohort FROM entry),
f AS (SELECT c.cohort, c.account_id, coalesce(bool_or(v.week - c.cohort = 7), false) AS w1, coalesce(bool_or(v.week - c.cohort = 28), false) AS w4 FROM c LEFT JOIN ev v ON v.account_id = c.account_id AND v.event = 'purchase' GROUP BY ALL)
SELECT cohort, count(*) AS size, round(avg(w1::INT), 6) AS w1, round(avg(w4::INT), 6) AS w4 FROM f GROUP BY cohort
""", uses="ev entry")
def retention_w(spark, sf):
    return cohorts.retained_on(T.entries(spark, sf), T.actions(spark, sf), "week", [1, 4], "w")


@R.query("""
WITH c AS (SELECT account_id, CAST(date_trunc('week', entered + INTERVAL 3 HOUR) AS DATE) AS cohort FROM entry),
p AS (SELECT DISTINCT c.cohort, c.account_id, (v.week - c.cohort) // 7 AS i FROM c JOIN ev v ON v.account_id = c.account_id AND v.event = 'purchase' WHERE v.week - c.cohort BETWEEN 0 AND 34)
SELECT cohort, count(*) FILTER (WHERE i = 0) AS w0, count(*) FILTER (WHERE i = 1) AS w1, count(*) FILTER (WHERE i = 2) AS w2, count(*) FILTER (WHERE i = 3) AS w3, count(*) FILTER (WHERE i = 4) AS w4 FROM p GROUP BY cohort
""", uses="ev entry")
def cohort_matrix(spark, sf):
    return cohorts.cohort_matrix(T.entries(spark, sf), T.actions(spark, sf), 5)


@R.query("""
WITH s1 AS (SELECT account_id, min(ts) AS at FROM ev WHERE event = 'signup' GROUP BY 1),
s2 AS (SELECT s.account_id, min(v.ts) AS at FROM s1 s JOIN ev v ON v.account_id = s.account_id AND v.event = 'view' AND v.ts > s.at GROUP BY 1),
s3 AS (SELECT s.account_id, min(v.ts) AS at FROM s2 s JOIN ev v ON v.account_id = s.account_id AND v.event = 'click' AND v.ts > s.at GROUP BY 1),
s4 AS (SELECT s.account_id, min(v.ts) AS at FROM s3 s JOIN ev v ON v.account_id = s.account_id AND v.event = 'purchase' AND v.ts > s.at GROUP BY 1)
SELECT 1 AS step, 'signup' AS name, count(*) AS accounts FROM s1 UNION ALL SELECT 2, 'view', count(*) FROM s2 UNION ALL SELECT 3, 'click', count(*) FROM s3 UNION ALL SELECT 4, 'purchase', count(*) FROM s4
""", uses="ev")
def funnel_ordered(spark, sf):
    """Each step after the one before it."""
    return cohorts.ordered_funnel(T.events(spark, sf), ["signup", "view", "click", "purchase"])


@R.query("""
WITH f AS (SELECT e.account_id, EXISTS (SELECT 1 FROM ev v WHERE v.account_id = e.account_id AND v.event = 'view' AND v.k >= 90 AND v.ts >= e.entered AND v.ts <= e.entered + INTERVAL 7 DAY) AS shared FROM entry e)
SELECT count(*) AS n, count(*) FILTER (WHERE shared) AS shared, round(avg(shared::INT), 6) AS share FROM f
""", uses="ev entry")
def shared_week1(spark, sf):
    """Accounts that shared a link (a view with k of 90 or more) in their first week."""
    shared = T.of(T.events(spark, sf), "view").where("k >= 90").select(F.col("account_id").alias("_a"), F.col("ts").alias("at"))
    entered = T.entries(spark, sf)
    hit = entered.join(shared, (F.col("account_id") == F.col("_a")) & intervals.within(F.col("entered"), F.col("at"), 168), "left_semi").withColumn("ok", F.lit(1))
    flags = entered.join(hit.select("account_id", "ok"), "account_id", "left")
    return flags.agg(F.count(F.lit(1)).alias("n"), F.count("ok").alias("shared"), share(F.count("ok"), F.count(F.lit(1))).alias("share"))


@R.query("""
WITH o AS (SELECT event_id, account_id, ts FROM ev WHERE event = 'view'), n AS (SELECT o.event_id, o.ts, min(v.ts) AS nxt FROM o LEFT JOIN ev v ON v.account_id = o.account_id AND v.event = 'purchase' AND v.ts > o.ts GROUP BY ALL),
f AS (SELECT *, coalesce(nxt <= ts + INTERVAL 24 HOUR, false) AS ok, epoch_us(nxt) - epoch_us(ts) AS us FROM n)
SELECT count(*) AS opened, count(*) FILTER (WHERE ok) AS booked, round(avg(ok::INT), 6) AS conversion, round(quantile_cont(us / 60000000.0, 0.5) FILTER (WHERE ok), 4) AS median_minutes FROM f
""", uses="ev")
def booking_conversion(spark, sf):
    """Opened to confirmed within a day, and how long it took."""
    ev = T.events(spark, sf)
    rows = intervals.next_after(T.of(ev, "view").select("event_id", "account_id", "ts"), T.of(ev, "purchase").select("account_id", "ts"), "account_id")
    ok = F.coalesce(intervals.within(F.col("ts"), F.col("next_ts"), 24), F.lit(False))
    minutes = (intervals.micros(F.col("next_ts")) - intervals.micros(F.col("ts"))) / 60000000.0
    return rows.agg(F.count(F.lit(1)).alias("opened"), F.count_if(ok).alias("booked"), series.rate(ok).alias("conversion"), F.round(F.percentile(F.when(ok, minutes), 0.5), 4).alias("median_minutes"))


@R.query("""
WITH o AS (SELECT event_id, account_id, ts FROM ev WHERE event = 'view' AND k >= 90), n AS (SELECT o.event_id, o.ts, min(v.ts) AS nxt FROM o LEFT JOIN ev v ON v.account_id = o.account_id AND v.event = 'purchase' AND v.ts > o.ts GROUP BY ALL)
SELECT round(avg((nxt IS NOT NULL)::INT), 6) AS share, round(quantile_cont((epoch_us(nxt) - epoch_us(ts)) / 3600000000.0, 0.5), 4) AS median_hours FROM n
""", uses="ev")
def return_by_link(spark, sf):
    ev = T.events(spark, sf)
    rows = intervals.next_after(T.of(ev, "view").where("k >= 90").select("event_id", "account_id", "ts"), T.of(ev, "purchase").select("account_id", "ts"), "account_id")
    hours = (intervals.micros(F.col("next_ts")) - intervals.micros(F.col("ts"))) / 3600000000.0
    return rows.agg(series.rate(F.col("next_ts").isNotNull()).alias("share"), F.round(F.percentile(hours, 0.5), 4).alias("median_hours"))


@R.query("""
WITH b AS (SELECT a.event_id, a.ts, min(n.ts) AS nxt FROM ev a LEFT JOIN ev n ON n.account_id = a.account_id AND n.event = 'purchase' AND n.ts > a.ts WHERE a.event = 'purchase' GROUP BY ALL)
SELECT count(*) AS meetings, round(avg(coalesce(nxt <= ts + INTERVAL 14 DAY, false)::INT), 6) AS rebooked FROM b
""", uses="ev")
def next_booking(spark, sf):
    """Meetings followed by the next booking within two weeks."""
    acts = T.actions(spark, sf).select("event_id", "account_id", "ts")
    rows = intervals.next_after(acts, acts, "account_id")
    ok = F.coalesce(intervals.within(F.col("ts"), F.col("next_ts"), 14 * 24), F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("meetings"), series.rate(ok).alias("rebooked"))


@R.query("""
WITH reg AS (SELECT account_id, min(ts) AS ts FROM ev WHERE event = 'purchase' GROUP BY 1),
l AS (SELECT r.account_id, (SELECT max_by(v.event, (epoch_us(v.ts), v.event_id)) FROM ev v WHERE v.account_id = r.account_id AND v.event IN ('view', 'click') AND v.ts < r.ts) AS channel FROM reg r)
SELECT coalesce(channel, 'unknown') AS channel, count(*) AS accounts FROM l GROUP BY 1
""", uses="ev")
def last_touch(spark, sf):
    """The last touch before the first purchase that is not direct (an error stands for direct); no touch is `unknown`, and its size a metric."""
    ev = T.events(spark, sf)
    reg = cohorts.first_per(T.of(ev, "purchase"), "account_id", "ts", "ts")
    rows = intervals.last_before(reg, T.of(ev, "view", "click").select("account_id", "ts", "event", "event_id"), "account_id", "event", "event_id", alias="channel")
    return rows.groupBy(F.coalesce("channel", F.lit("unknown")).alias("channel")).agg(F.count(F.lit(1)).alias("accounts"))


@R.query("""
WITH g AS (SELECT account_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS begins FROM ev WINDOW w AS (PARTITION BY account_id ORDER BY ts, event_id)),
n AS (SELECT account_id, ts, sum(begins) OVER (PARTITION BY account_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT account_id, min(ts) AS started, max(ts) AS ended, count(*) AS n_events FROM n GROUP BY account_id, s
""", uses="ev")
def sessionize(spark, sf):
    """Technical sessions; exactly 30 minutes is still the same one."""
    return intervals.sessions(T.events(spark, sf))


@R.query("""
SELECT r_name AS region, n_name AS nation, CAST(grouping(r_name) + grouping(n_name) AS INT) AS level, count(*) AS customers
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)
""")
def rollup_source(spark, sf):
    """Customers by store (nation within region) with the totals shown beside the split."""
    c, n, r = (T.read(spark, sf, t) for t in ("customer", "nation", "region"))
    rows = c.select("c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"))
    return rows.rollup("region", "nation").agg((F.grouping("region") + F.grouping("nation")).cast("int").alias("level"), F.count(F.lit(1)).alias("customers"))


@R.query("SELECT CASE WHEN month(f) IN (6, 7, 8) THEN 'summer' ELSE 'other' END AS season, count(*) AS customers FROM (SELECT o_custkey, min(o_orderdate) AS f FROM orders GROUP BY 1) GROUP BY 1")
def cohort_season(spark, sf):
    first = T.read(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("f"))
    return first.groupBy(calendar.season(F.col("f")).alias("season")).agg(F.count(F.lit(1)).alias("customers"))


@R.query("""
WITH d AS (SELECT DISTINCT account_id, day FROM ev WHERE event = 'purchase'), g AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY account_id ORDER BY day) AS INT) AS g FROM d),
i AS (SELECT account_id, min(day) AS start, count(*) AS length FROM g GROUP BY account_id, g)
SELECT length, count(*) AS series FROM i GROUP BY length
""", uses="ev")
def islands(spark, sf):
    """How long runs of consecutive active days are."""
    return series.islands(T.actions(spark, sf), "account_id", "day").groupBy("length").agg(F.count(F.lit(1)).alias("series"))


@R.query("""
WITH d AS (SELECT DISTINCT account_id, day FROM ev WHERE event = 'purchase'), g AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY account_id ORDER BY day) AS INT) AS g FROM d),
i AS (SELECT account_id, count(*) AS length FROM g GROUP BY account_id, g),
s AS (SELECT account_id, dayofweek(day) AS wd, count(*) AS n FROM d GROUP BY ALL), f AS (SELECT account_id, max(n)::DOUBLE / sum(n) AS fixed FROM s GROUP BY 1)
SELECT (SELECT round(avg(length), 6) FROM i) AS mean_length, (SELECT round(avg((length >= 3)::INT), 6) FROM i) AS survive3, (SELECT round(avg((fixed >= 0.5)::INT), 6) FROM f) AS fixed_slot_share
""", uses="ev")
def series_length(spark, sf):
    """Mean length of series, the share that reaches three, and accounts with half their days on one weekday."""
    acts = T.actions(spark, sf)
    runs = series.islands(acts, "account_id", "day").agg(F.round(F.avg("length"), 6).alias("mean_length"), series.rate(F.col("length") >= 3).alias("survive3"))
    slots = acts.select("account_id", "day").distinct().groupBy("account_id", F.weekday("day").alias("wd")).agg(F.count(F.lit(1)).alias("n")).groupBy("account_id").agg((F.max("n") / F.sum("n")).alias("fixed"))
    return runs.crossJoin(slots.agg(series.rate(F.col("fixed") >= 0.5).alias("fixed_slot_share")))  # one row each


@R.query("""
WITH a AS (SELECT account_id, count(*) FILTER (WHERE event = 'purchase' AND day < DATE '2024-01-16') AS early, count(*) FILTER (WHERE event = 'purchase' AND day >= DATE '2024-01-16') AS late, count(*) FILTER (WHERE event = 'click') AS clicks FROM ev GROUP BY 1)
SELECT clicks >= 5 AS used_product, count(*) AS accounts, round(avg((late = 0)::INT), 6) AS churn, 'correlation' AS label FROM a WHERE early > 0 GROUP BY 1
""", uses="ev")
def churn_by_activity(spark, sf):
    """Churn of those who used a product and those who did not; a correlation and labelled so."""
    split = F.to_date(F.lit("2024-01-16"))
    bought = F.col("event") == "purchase"
    a = T.events(spark, sf).groupBy("account_id").agg(F.count_if(bought & (F.col("day") < split)).alias("early"), F.count_if(bought & (F.col("day") >= split)).alias("late"), F.count_if(F.col("event") == "click").alias("clicks"))
    return a.where("early > 0").groupBy((F.col("clicks") >= 5).alias("used_product")).agg(F.count(F.lit(1)).alias("accounts"), series.rate(F.col("late") == 0).alias("churn")).withColumn("label", F.lit("correlation"))


@R.query("""
WITH e AS (SELECT event_id, account_id, ts FROM ev WHERE event = 'purchase'), n AS (SELECT e.event_id, e.ts, min(v.ts) AS nxt FROM e JOIN ev v ON v.account_id = e.account_id AND v.event = 'click' AND v.ts >= e.ts GROUP BY ALL),
h AS (SELECT (epoch_us(nxt) - epoch_us(ts)) / 3600000000.0 AS h FROM n)
SELECT round(quantile_cont(h, 0.5), 4) AS p50, round(quantile_cont(h, 0.9), 4) AS p90, round(quantile_cont(h, 0.99), 4) AS p99, round(avg(h), 4) AS mean FROM h
""", uses="ev")
def note_delay(spark, sf):
    """From the end of a session to its note: the distribution, not only the mean."""
    ev = T.events(spark, sf)
    rows = intervals.next_after(T.of(ev, "purchase").select("event_id", "account_id", "ts"), T.of(ev, "click").select("account_id", "ts"), "account_id", strict=False)
    h = (intervals.micros(F.col("next_ts")) - intervals.micros(F.col("ts"))) / 3600000000.0
    p = F.percentile(h, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    return rows.agg(p.alias("p"), F.round(F.avg(h), 4).alias("mean")).select(*[F.round(F.get("p", F.lit(i)), 4).alias(n) for i, n in enumerate(("p50", "p90", "p99"))], "mean")
