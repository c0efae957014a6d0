"""Ingest, identity, data-quality, alert and backlog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.registry import Event, Field
from tidemark.operators import alerts as A
from tidemark.operators import ingest, intervals, leaks, sets
from tidemark.plans import metrics
from tidemark.plans.base import Registry
from tidemark.sources import connectors, exports
from tidemark.sources import tables as T
from tidemark.streaming import ingest as S

R = Registry()

#: A registry for the events at hand: products p0 and p1 share all events but errors, which p2 alone may send.
EVENTS = [Event(f"p{p}", name, "how is it used?", (Field("k", "number", True),)) for p in range(3) for name in ("signup", "click", "view", "purchase")] + [Event("p2", "error", "what breaks?", (Field("k", "number", True), Field("code", "string")))]


def raw_events(spark, sf):
    return as_sent(T.events(spark, sf))


def as_sent(ev):
    """Events as they might arrive: some without an id, some of the wrong product, with extra, missing or mistyped fields."""
    props = (
        F.when(F.col("k") == 11, F.create_map(F.lit("k"), F.col("k").cast("string"), F.lit("note"), F.lit("x")))
        .when(F.col("k") == 12, F.expr("cast(map() as map<string,string>)"))
        .when(F.col("k") == 13, F.create_map(F.lit("k"), F.lit("many")))
        .otherwise(F.create_map(F.lit("k"), F.col("k").cast("string")))
    )
    account = F.when(F.col("k") % 10 != 0, F.col("account_id").cast("string"))
    device = F.when(F.col("k") % 20 != 0, F.concat(F.lit("dev"), F.col("account_id") % 40))
    return ev.select("event_id", F.when(F.col("k") == 14, "unheard_of").otherwise(F.col("event")).alias("event"), F.concat(F.lit("p"), "product").alias("product"), "ts", "day", account.alias("account_id"), device.alias("device_id"), props.alias("props"), "k")


_REASON = """
WITH r AS (SELECT event_id, day, k, CASE WHEN k % 10 = 0 AND k % 20 = 0 THEN 'no_id' WHEN k = 14 THEN 'unknown_event' WHEN event = 'error' AND product <> 2 THEN 'foreign_product' WHEN k = 11 THEN 'extra_field' WHEN k = 12 THEN 'missing_field' WHEN k = 13 THEN 'bad_type' END AS reason FROM ev)
"""


@R.query(_REASON + "SELECT coalesce(reason, 'accepted') AS verdict, count(*) AS n FROM r GROUP BY 1", uses="ev")
def ingest_validate(spark, sf):
    """Events by verdict; the first reason that holds counts."""
    return ingest.validate(raw_events(spark, sf), EVENTS).groupBy(F.coalesce("reason", F.lit("accepted")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@R.query(_REASON + "SELECT event_id, reason FROM r WHERE reason IS NOT NULL", uses="ev")
def events_rejected(spark, sf):
    return ingest.validate(raw_events(spark, sf), EVENTS).where("reason is not null").select("event_id", "reason")


@R.query("SELECT event_id, CASE WHEN k = 12 THEN 0 ELSE 1 END AS n_fields FROM ev WHERE k <> 14", uses="ev")
def client_trim(spark, sf):
    """A client drops undeclared fields and keeps the event."""
    rows = ingest.trim(raw_events(spark, sf).where("event <> 'unheard_of'"), EVENTS + [Event("p0", "error", "what breaks?", (Field("k", "number"),))])
    return rows.select("event_id", F.size("props").alias("n_fields"))


@R.query("""
WITH raw AS (SELECT event_id, ts, CASE WHEN k % 10 <> 0 THEN CAST(account_id AS VARCHAR) END AS a, CASE WHEN k % 20 <> 0 THEN 'dev' || (account_id % 40) END AS d FROM ev),
link AS (SELECT d, min_by(a, (epoch_us(ts), a)) AS la FROM raw WHERE a IS NOT NULL AND d IS NOT NULL GROUP BY 1)
SELECT coalesce(a, la, 'd:' || raw.d) AS person, count(*) AS events FROM raw LEFT JOIN link ON raw.d = link.d GROUP BY 1
""", uses="ev")
def identity_stitch(spark, sf):
    """Events per person; a device of several accounts belongs to the earliest link, and history stays as it was written."""
    raw = raw_events(spark, sf).select("event_id", "ts", "account_id", "device_id")
    links = raw.where("account_id is not null and device_id is not null").select("device_id", "account_id", "ts")
    return ingest.stitch(raw, links).groupBy("person").agg(F.count(F.lit(1)).alias("events"))


@R.query("""
WITH raw AS (SELECT event_id, ts, CASE WHEN k % 10 <> 0 THEN CAST(account_id AS VARCHAR) END AS a, CASE WHEN k % 20 <> 0 THEN 'dev' || (account_id % 40) END AS d FROM ev),
acc AS (SELECT CAST(account_id AS VARCHAR) AS id, ts, k >= 30 AS granted FROM ev WHERE event = 'signup'), dev AS (SELECT 'dev' || (account_id % 40) AS id, max(ts) AS ts, bool_or(k >= 99) AS granted FROM ev WHERE event = 'signup' GROUP BY 1),
j AS (SELECT r.*, (SELECT max_by(granted, epoch_us(ts)) FROM acc WHERE id = r.a AND acc.ts <= r.ts) AS ga, (SELECT max_by(granted, epoch_us(ts)) FROM dev WHERE id = r.d AND dev.ts <= r.ts) AS gd FROM raw r)
SELECT count(*) AS written, count(d) FILTER (WHERE a IS NULL OR coalesce(ga, false)) AS with_device FROM j WHERE a IS NOT NULL OR coalesce(gd, false)
""", uses="ev")
def consent_filter(spark, sf):
    """What consent lets through: an account's event loses its device, a device's event is not written."""
    raw = raw_events(spark, sf).select("event_id", "ts", "account_id", "device_id")
    s = T.of(T.events(spark, sf), "signup")
    acc = s.select(F.lit("account").alias("kind"), F.col("account_id").cast("string").alias("id"), (F.col("k") >= 30).alias("granted"), "ts")
    dev = s.groupBy(F.concat(F.lit("dev"), F.col("account_id") % 40).alias("id")).agg(F.max("ts").alias("ts"), F.bool_or(F.col("k") >= 99).alias("granted"))
    kept = ingest.consented(raw, acc.unionByName(dev.withColumn("kind", F.lit("device"))))
    return kept.agg(F.count(F.lit(1)).alias("written"), F.count("device_id").alias("with_device"))


@R.query("SELECT event_id, min(ts) AS ts FROM ev GROUP BY 1", uses="ev")
def event_dedup(spark, sf):
    """Twice-delivered events count once."""
    ev = T.events(spark, sf).select("event_id", "ts", "k")
    return ingest.dedup(ev.unionByName(ev.where("k < 30"))).select("event_id", "ts")


@R.query("SELECT month, count(*) AS events, count(DISTINCT account_id) AS accounts FROM (SELECT *, CAST(date_trunc('month', ts) AS DATE) AS month FROM ev) GROUP BY month", uses="ev")
def month_partitions(spark, sf):
    """What the append-only table holds by month, its partition column."""
    return T.events(spark, sf).groupBy(F.trunc(F.col("ts").cast("date"), "month").alias("month")).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("account_id").alias("accounts"))


@R.query("""
WITH v AS (SELECT 'events' AS kind, 180 AS days UNION ALL SELECT 'gauges', 90 UNION ALL SELECT 'inbox', 60 UNION ALL SELECT 'signals', 90 UNION ALL SELECT 'day_log', 14 UNION ALL SELECT 'orders', 30)
SELECT v.kind, count(*) AS kept FROM v JOIN orders ON CAST(o_orderdate AS DATE) >= DATE '2001-07-31' - v.days GROUP BY 1
""")
def ttl_retention(spark, sf):
    """Rows that each kind's time to live would keep on a day."""
    today, orders = F.to_date(F.lit("2001-07-31")), T.read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    parts = [sets.kept(orders, kind, "day", today).select(F.lit(kind).alias("kind")) for kind in sets.KEEP_DAYS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("kept"))


@R.query("SELECT CAST(o_orderdate AS DATE) AS meeting FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 8")
def last_meetings(spark, sf):
    """The last eight meetings (days with orders) stay in the log."""
    return sets.last_meetings(T.read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("meeting")).distinct(), "meeting")


@R.query("SELECT DISTINCT event_type AS event, CAST(json_extract_string(props, '$.k') AS INT) % 7 AS field FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 95 EXCEPT SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) % 7 FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) < 3")
def registry_superset(spark, sf):
    """Event and field pairs that clients declare and the centre lacks; empty would mean that it is a superset."""
    pairs = T.events(spark, sf).select("event", (F.col("k") % 7).alias("field"), "k")
    return sets.missing(pairs.where("k >= 95").drop("k").distinct(), pairs.where("k < 3").drop("k").distinct())


@R.query("""
WITH l AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_size < 3), r AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_size > 48)
SELECT name, 'left_only' AS side FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT name, 'right_only' FROM (SELECT * FROM r EXCEPT SELECT * FROM l)
""")
def drift_except(spark, sf):
    """Drift between two lists of migrations (brands of small and of large parts)."""
    p = T.read(spark, sf, "part")
    name = F.col("p_brand").alias("name")
    return sets.drift(p.where("p_size < 3").select(name), p.where("p_size > 48").select(name))


@R.query("""
WITH u AS (SELECT c_custkey AS k, 'billing' AS source, 0 AS r, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1
  UNION ALL SELECT o_custkey, 'server', 1, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, 'manual', 4, CAST(round(c_acctbal * 100) AS BIGINT) FROM customer),
b AS (SELECT k, min_by(source, r) AS source, min_by(value, r) AS value, min(value) AS lo, max(value) AS hi FROM u GROUP BY k)
SELECT k AS customer, source, value, round(greatest(abs(hi - value), abs(value - lo))::DOUBLE / nullif(abs(value), 0), 6) AS gap, coalesce(greatest(abs(hi - value), abs(value - lo))::DOUBLE / nullif(abs(value), 0) > 0.1, false) AS conflict FROM b
""")
def source_precedence(spark, sf):
    """One value per customer by the most trusted source, with the largest difference to the others."""
    o = T.read(spark, sf, "orders").select("o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    sums = lambda df, name: df.groupBy(F.col("o_custkey").alias("customer")).agg(F.sum("c").alias("value")).withColumn("source", F.lit(name))
    c = T.read(spark, sf, "customer").select(F.col("c_custkey").alias("customer"), F.round(F.col("c_acctbal") * 100).cast("long").alias("value"))
    billing = sums(o.where("o_orderstatus = 'F'").join(c.select("customer"), F.col("o_custkey") == F.col("customer"), "left_semi"), "billing")
    return sets.precedence(billing.unionByName(sums(o, "server")).unionByName(c.withColumn("source", F.lit("manual"))), "customer")


@R.query("SELECT DISTINCT c_mktsegment AS theme, c_nationkey AS nation FROM customer WHERE c_custkey % 3 IN (0, 1, 2) AND c_acctbal > 5000")
def merge_briefs(spark, sf):
    """Three lists merged, duplicates removed."""
    c = T.read(spark, sf, "customer").where("c_acctbal > 5000")
    briefs = [c.where(F.col("c_custkey") % 3 == i).select(F.col("c_mktsegment").alias("theme"), F.col("c_nationkey").alias("nation")) for i in range(3)]
    return sets.merged(*briefs, by=["theme", "nation"])


@R.query("SELECT coalesce(name, 'unknown') AS source, count(*) AS accounts FROM (SELECT account_id, min_by(k, (epoch_us(ts), event_id)) AS k FROM ev GROUP BY 1) LEFT JOIN (SELECT unnest(['search', 'friend', 'store']) AS name, unnest([0, 1, 2]) AS code) ON code = k % 5 GROUP BY 1", uses="ev")
def flow_source(spark, sf):
    """Where accounts come from, by a dictionary; what it lacks is `unknown`, and its size a metric."""
    names = spark.createDataFrame([(0, "search"), (1, "friend"), (2, "store")], "code int, name string")
    first = T.events(spark, sf).groupBy("account_id").agg(F.min_by("k", F.struct("ts", "event_id")).alias("k"))
    return first.join(F.broadcast(names), F.col("k") % 5 == F.col("code"), "left").groupBy(F.coalesce("name", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("accounts"))  # three rows


@R.query("SELECT theme, nation FROM (SELECT DISTINCT p_brand AS theme, p_size AS nation FROM part WHERE p_size <= 5) p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.theme AND q.p_size = 50)")
def duplicate_decision(spark, sf):
    """Proposals (brand and size) whose brand has no closed decision yet."""
    p = T.read(spark, sf, "part")
    closed = p.where("p_size = 50").select(F.col("p_brand").alias("theme"))
    return p.where("p_size <= 5").select(F.col("p_brand").alias("theme"), F.col("p_size").alias("nation")).distinct().join(closed, "theme", "left_anti")


@R.query("SELECT count(*) AS to_tell FROM (SELECT DISTINCT e.account_id, e.k // 10 AS theme FROM ev e WHERE e.event = 'error' AND EXISTS (SELECT 1 FROM ev v WHERE v.event = 'click' AND v.k // 10 = e.k // 10 AND v.k >= 90) AND EXISTS (SELECT 1 FROM ev s WHERE s.event = 'signup' AND s.account_id = e.account_id))", uses="ev")
def loop_closing(spark, sf):
    """Reporters with a contact (a signup) of themes that are resolved (a click with k of 90 or more)."""
    ev = T.events(spark, sf).withColumn("theme", F.expr("int(k div 10)"))
    resolved = T.of(ev, "click").where("k >= 90").select("theme").distinct()
    contact = T.of(ev, "signup").select("account_id").distinct()
    rows = T.of(ev, "error").select("account_id", "theme").distinct().join(resolved, "theme", "left_semi").join(contact, "account_id", "left_semi")
    return rows.agg(F.count(F.lit(1)).alias("to_tell"))


_DQ = _REASON.replace("WITH r AS", "WITH r AS").strip() + """,
days AS (SELECT count(DISTINCT day) AS seen, max(day) - min(day) + 1 AS span FROM ev),
bill AS (SELECT sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS a FROM orders), led AS (SELECT sum(CAST(round(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100) AS BIGINT)) AS b FROM lineitem)
SELECT 'rejected' AS "check", round(avg((reason IS NOT NULL)::INT), 6) AS value, avg((reason IS NOT NULL)::INT) > 0.01 AS alarm FROM r
UNION ALL SELECT 'revenue_gap', round(abs(a - b)::DOUBLE / a, 6), abs(a - b)::DOUBLE / a > 0.005 FROM bill, led
UNION ALL SELECT 'missed_days', CAST(span - seen AS DOUBLE), span - seen > 0 FROM days
UNION ALL SELECT 'null_account', round(avg((k % 10 = 0)::INT), 6), avg((k % 10 = 0)::INT) > 0.001 FROM ev
UNION ALL SELECT 'duplicate_keys', CAST(count(*) - count(DISTINCT event_id) AS DOUBLE), count(*) > count(DISTINCT event_id) FROM ev
"""


@R.query(_DQ, uses="ev")
def dq_report(spark, sf):
    """Five checks, a row each."""
    checked = ingest.validate(raw_events(spark, sf), EVENTS)
    raw = checked.agg(F.avg(F.col("reason").isNotNull().cast("int")).alias("rejected"), F.avg(F.col("account_id").isNull().cast("int")).alias("anonymous"), (F.date_diff(F.max("day"), F.min("day")) + 1 - F.count_distinct("day")).alias("missed"))
    dup = T.events(spark, sf).groupBy("event_id").agg((F.count(F.lit(1)) - 1).alias("extra")).agg(F.sum("extra").alias("extra"))
    cents = lambda c: F.sum(F.round(c * 100).cast("long"))
    bill = T.read(spark, sf, "orders").agg(cents(F.col("o_totalprice")).alias("a"))
    led = T.read(spark, sf, "lineitem").agg(cents(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("b"))
    row = lambda df, name, value, limit: df.select(F.lit(name).alias("check"), F.round(value.cast("double"), 6).alias("value"), (value > limit).alias("alarm"))
    gap = F.try_divide(F.abs(F.col("a") - F.col("b")).cast("double"), F.col("a"))
    parts = [row(raw, "rejected", F.col("rejected"), 0.01), row(bill.crossJoin(led), "revenue_gap", gap, 0.005), row(raw, "missed_days", F.col("missed"), 0), row(raw, "null_account", F.col("anonymous"), 0.001), row(dup, "duplicate_keys", F.col("extra"), 0)]  # one row each
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# The catalogue once more, typed out on its own, so that a wrong threshold in operators.alerts shows.
_RULE_ROWS = """
('M01', 'renewal_success', 'below', 90, 20, 'P0'), ('M02', 'renewal_success', 'drop_pp', 10, 20, 'P0'), ('M03', 'first_payment_success', 'drop_pp', 15, 20, 'P0'), ('M04', 'trial_conversion', 'below', 10, 30, 'P0'),
('M05', 'trial_conversion_two_in_band', 'at_least', 1, 30, 'P1'), ('M06', 'mrr', 'drop_abs', 0, 30, 'P0'), ('M07', 'account_churn', 'above', 8, 30, 'P1'), ('M08', 'involuntary_churn', 'above', 25, 10, 'P1'),
('M09', 'arpu', 'below', 1000, 30, 'P1'), ('M10', 'ltv_cac', 'below', 2.9, NULL, 'P1'), ('M11', 'refunds_week', 'above', 3, NULL, 'P1'),
('P01', 'sessions_week', 'drop_pct', 20, 4, 'P0'), ('P02', 'sessions_stalled_3w', 'at_least', 1, 6, 'P1'), ('P03', 'activation', 'drop_pp', 15, 30, 'P1'), ('P04', 'note_coverage', 'drop_pp', 15, 50, 'P1'),
('P05', 'wau_mau', 'below', 50, 50, 'P1'), ('P06', 'retention_d1', 'drop_pp', 10, 100, 'P1'), ('P07', 'retention_d7', 'drop_pp', 7, 100, 'P1'), ('P08', 'unfinished_share', 'above', 40, 100, 'P2'),
('P09', 'installs_week', 'drop_pct', 30, 4, 'P2'), ('P10', 'cancelled_share', 'rise_pp', 10, 100, 'P2'),
('R01', 'uptime', 'below', 99, NULL, 'P0'), ('R02', 'p95_to_norm', 'above', 2, 1000, 'P1'), ('R03', 'crash_free_sessions', 'below', 99, 500, 'P0'), ('R04', 'crash_free_users', 'drop_pp', 1, 500, 'P1'),
('R05', 'calendar_sync_errors', 'above', 5, 100, 'P1'), ('R06', 'undelivered_reminders', 'above', 3, 100, 'P0'),
('T01', 'tickets_per_100', 'rise_factor', 2, 10, 'P1'), ('T02', 'privacy_tickets', 'at_least', 1, 1, 'P0'), ('T03', 'data_incidents', 'at_least', 1, 1, 'P0'), ('T04', 'negative_share', 'above', 20, 10, 'P1'),
('T05', 'negative_burst_24h', 'at_least', 3, 3, 'P0'), ('T06', 'store_rating', 'below', 4, 20, 'P1'), ('T07', 'store_rating', 'drop_abs', 0.3, 20, 'P1'), ('T08', 'overdue_tickets', 'at_least', 3, 3, 'P1'),
('T09', 'cancellations_after_release', 'rise_factor', 2, 10, 'P0'),
('S01', 'silent_days', 'at_least', 3, NULL, 'P1'), ('S02', 'silent_days', 'at_least', 7, NULL, 'P0'), ('S03', 'contradiction_factor', 'above', 2, NULL, 'P1')
"""


@R.query("WITH " + metrics.VALUES_SQL + f""",
t(rule_id, metric, op, bound, min_n, priority) AS (VALUES {_RULE_ROWS}), rules AS (SELECT * EXCLUDE (bound), bound::DOUBLE AS threshold FROM t),
j AS (SELECT r.*, v.period, v.value, v.prev, v.n, CASE op WHEN 'below' THEN value < threshold WHEN 'above' THEN value > threshold WHEN 'at_least' THEN value >= threshold
  WHEN 'drop_pct' THEN (prev - value) / nullif(prev, 0) * 100 > threshold WHEN 'rise_factor' THEN value > prev * threshold WHEN 'drop_pp' THEN prev - value > threshold WHEN 'rise_pp' THEN value - prev > threshold
  WHEN 'drop_abs' THEN CASE WHEN threshold > 0 THEN prev - value >= threshold ELSE value < prev END END AS hit FROM rules r LEFT JOIN v ON r.metric = v.metric)
SELECT rule_id, metric, period, round(value, 6) AS value, CASE WHEN value IS NULL THEN 'not_checked' WHEN coalesce(hit, false) AND (min_n IS NULL OR n >= min_n) THEN 'breach' WHEN coalesce(hit, false) THEN 'observation' ELSE 'ok' END AS state,
  CASE WHEN value IS NOT NULL AND coalesce(hit, false) AND (min_n IS NULL OR n >= min_n) THEN priority END AS priority FROM j
""")
def alerts(spark, sf):
    """The whole catalogue over all metrics that the daily marts give, by their own periods; rules whose metric is missing (ratings, data incidents, calendar synchronisation) say so."""
    return A.evaluate(A.table(spark), metrics.values(metrics.marts(spark, sf))).withColumn("value", F.round("value", 6))


@R.query("WITH " + metrics.VALUES_SQL + f""",
t(rule_id, metric, op, bound, min_n, priority) AS (VALUES {_RULE_ROWS}), l AS (SELECT * FROM v WHERE period <= DATE '2024-01-31' QUALIFY row_number() OVER (PARTITION BY metric ORDER BY period DESC, value DESC, prev DESC, n DESC) = 1),
j AS (SELECT t.*, l.period, l.value, l.prev, l.n, CASE op WHEN 'below' THEN value < bound WHEN 'above' THEN value > bound WHEN 'at_least' THEN value >= bound
  WHEN 'drop_pct' THEN (prev - value) / nullif(prev, 0) * 100 > bound WHEN 'rise_factor' THEN value > prev * bound WHEN 'drop_pp' THEN prev - value > bound WHEN 'rise_pp' THEN value - prev > bound
  WHEN 'drop_abs' THEN CASE WHEN bound > 0 THEN prev - value >= bound ELSE value < prev END END AS hit FROM t LEFT JOIN l ON t.metric = l.metric)
SELECT rule_id, metric, period, round(value, 6) AS value,
  CASE WHEN value IS NULL THEN 'not_checked' WHEN DATE '2024-01-31' - period > 2 THEN 'stale' WHEN coalesce(hit, false) AND (min_n IS NULL OR n >= min_n) THEN 'breach' WHEN coalesce(hit, false) THEN 'observation' ELSE 'ok' END AS state,
  CASE WHEN DATE '2024-01-31' - period <= 2 AND coalesce(hit, false) AND (min_n IS NULL OR n >= min_n) THEN priority END AS priority FROM j
""")
def alerts_now(spark, sf):
    """The panel of one day: each rule over its metric's last value; one that is more than two days old is stale, whatever it says."""
    today = F.to_date(F.lit("2024-01-31"))
    last = A.latest(metrics.values(metrics.marts(spark, sf)), today)
    return A.evaluate(A.table(spark), last, as_of=today).withColumn("value", F.round("value", 6))


@R.query("""
WITH b AS (SELECT avg((o_orderstatus = 'F')::INT) * 100 AS v FROM orders), e AS (SELECT max(ts) AS now, max(ts) FILTER (WHERE event_type = 'signup') AS backup FROM events), h AS (SELECT (epoch_us(now) - epoch_us(backup)) / 3600000000.0 AS v FROM e)
SELECT 'billing_success' AS metric, round(v, 6) AS value, CASE WHEN v < 85 THEN 'red' WHEN v < 92 THEN 'amber' ELSE 'green' END AS level FROM b
UNION ALL SELECT 'backup_age_hours', round(v, 6), CASE WHEN v > 48 THEN 'red' WHEN v > 26 THEN 'amber' ELSE 'green' END FROM h
UNION ALL SELECT 'disk_free', NULL, 'not_checked'
""")
def panel_levels(spark, sf):
    """The panel's own scale: green only where a value was seen. Hours since the last sign-up stand for a backup's age; nothing stands for free disk."""
    b = T.read(spark, sf, "orders").agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")) * 100, 6).alias("value")).select(F.lit("billing_success").alias("metric"), "value")
    e = T.read(spark, sf, "events").agg(F.max("ts").alias("now"), F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("backup"))
    age = F.round((intervals.micros(F.col("now")) - intervals.micros(F.col("backup"))) / 3600000000.0, 6)
    e = e.select(F.explode(F.array(F.struct(F.lit("backup_age_hours").alias("metric"), age.alias("value")), F.struct(F.lit("disk_free").alias("metric"), F.lit(None).cast("double").alias("value")))).alias("m")).select("m.*")
    return A.panel(b.unionByName(e))


_ITEMS = "WITH i AS (SELECT p_partkey AS item, p_size % 5 + 1 AS impact, p_size % 3 + 1 AS confidence, p_size % 8 + 1 AS effort, p_type LIKE '%PROMO%' AS p0 FROM part),\n s AS (SELECT *, round(impact * confidence / effort::DOUBLE, 6) AS score FROM i), r AS (SELECT *, row_number() OVER (ORDER BY p0 DESC, score DESC, item) AS place FROM s)\n"


def backlog(spark, sf):
    """A backlog: every part is an item."""
    p, size = T.read(spark, sf, "part"), F.col("p_size")
    return p.select(F.col("p_partkey").alias("item"), (size % 5 + 1).alias("impact"), (size % 3 + 1).alias("confidence"), (size % 8 + 1).alias("effort"), F.contains("p_type", F.lit("PROMO")).alias("p0"))


@R.query(_ITEMS + "SELECT item, score, place FROM r")
def priority_rank(spark, sf):
    """Impact times confidence over effort; P0 classes jump the queue."""
    return sets.scored(backlog(spark, sf), F.col("p0")).select("item", "score", "place")


@R.query(_ITEMS + "SELECT item, place, CAST(sum(effort) OVER (ORDER BY place) AS BIGINT) AS load, sum(effort) OVER (ORDER BY place) <= 1000 AS taken FROM r")
def capacity_cut(spark, sf):
    """What fits into the capacity in order of place; the rest is displaced."""
    return sets.capacity_cut(sets.scored(backlog(spark, sf), F.col("p0")), 1000).select("item", "place", "load", "taken")


@R.query("SELECT * FROM (SELECT p_brand AS name, count(*) AS rows FROM part GROUP BY 1) ORDER BY rows DESC, name LIMIT 5")
def five_largest(spark, sf):
    """A report of the five largest."""
    n = T.read(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    return sets.top(n, 5, F.col("rows").desc(), F.col("name"))


@R.query("SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 5")
def human_queue(spark, sf):
    """The queue for a person: five at most, by blocking force."""
    o = T.read(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    return sets.top(o, 5, F.col("priority"), F.col("o_totalprice").desc(), F.col("id")).select("id", "priority")


@R.query("""
WITH m AS (SELECT week AS date, count(*) AS sessions, count(DISTINCT account_id) AS wau FROM ev WHERE event = 'purchase' GROUP BY 1)
SELECT date, 'activity' AS block, unnest(['sessions', 'wau', 'refunds']) AS metric, unnest([sessions, wau, NULL]) AS value, 'server' AS source FROM m
""", uses="ev")
def snapshot_export(spark, sf):
    """Marts in the snapshot's long form; a metric nobody measured is a row with a null, not an absence."""
    m = T.actions(spark, sf).groupBy(F.col("week").alias("date")).agg(F.count(F.lit(1)).alias("sessions"), F.count_distinct("account_id").alias("wau"))
    long = m.withColumn("refunds", F.lit(None).cast("long")).unpivot("date", ["sessions", "wau", "refunds"], "metric", "value")
    return long.select("date", F.lit("activity").alias("block"), "metric", "value", F.lit("server").alias("source"))


@R.query("SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) - epoch_us(o_orderdate) > 30::BIGINT * 86400000000 AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def late_shipments(spark, sf):
    """Lines that shipped more than thirty days after their order was due: late data keeps its rows and says so."""
    due = T.read(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    rows = T.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(due, F.col("l_orderkey") == F.col("o_orderkey"))
    return ingest.late(rows, "o_orderdate", "l_shipdate", 30 * 24 * 60).select("l_orderkey", "l_linenumber", "late")


@R.query("""
SELECT CASE WHEN o_orderkey % 5 = 0 THEN 400 ELSE 200 END AS code, count(*) AS calls, count(DISTINCT o_orderstatus) AS states FROM orders GROUP BY 1
""")
def webhook_calls(spark, sf):
    """Payment calls by answer: every fifth has a signature that was made with another key, or has none."""
    k = F.col("order_id")
    calls = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"))
    sent = F.when(k % 10 == 0, F.lit(None)).when(k % 5 == 0, connectors.signed("other", "order_id", "status")).otherwise(F.upper(connectors.signed("key", "order_id", "status")))
    answered = connectors.verified(calls.withColumn("signature", sent), "key", ("order_id", "status"))
    return answered.groupBy("code").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("status").alias("states"))


@R.query("SELECT o_orderkey AS order_id, o_totalprice AS amount FROM orders WHERE o_orderkey % 7 = 3")
def registry_backfill(spark, sf):
    """What the one-off registry holds and the webhook missed."""
    registry = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("amount"))
    return connectors.backfill(registry, registry.where("order_id % 7 <> 3"))


_PASSAGES = """
WITH o AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
n AS (SELECT list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
op AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM o WHERE len(w) >= 8)),
np AS (SELECT DISTINCT array_to_string(w[i:i + 7], ' ') AS p FROM (SELECT w, unnest(range(1, len(w) - 6)) AS i FROM n WHERE len(w) >= 8)),
hits AS (SELECT item_id, count(*) AS leaked, min(p) AS example FROM op SEMI JOIN np USING (p) GROUP BY 1)
"""


@R.query(_PASSAGES + "SELECT o.item_id, coalesce(leaked, 0) AS leaked, example FROM o LEFT JOIN hits ON o.item_id = hits.item_id")
def leak_guard(spark, sf):
    """Outgoing texts (benchmark items) that hold a passage of eight words of a note (a document), and how many such passages."""
    notes, out = T.spread(T.read(spark, sf, "documents").select("text")), T.read(spark, sf, "benchmark").select("item_id", "text")
    return leaks.leaks(notes, out, "text", "item_id", "text").select("item_id", "leaked", "example")


@R.query("""
WITH RECURSIVE s AS (SELECT day, product, count(*) // 8 AS score FROM ev WHERE event = 'purchase' GROUP BY 1, 2), t AS (SELECT day, product FROM s QUALIFY score = max(score) OVER (PARTITION BY day)),
d AS (SELECT day, row_number() OVER (ORDER BY day) AS i, count(*) > 1 AND bool_or(product = 0) AS tied, min(product) AS first, min(product) FILTER (WHERE product <> 0) AS other FROM t GROUP BY day),
r AS (SELECT i, day, tied, CASE WHEN tied THEN 0 ELSE first END AS product, tied::INT AS run FROM d WHERE i = 1
  UNION ALL SELECT d.i, d.day, d.tied, CASE WHEN NOT d.tied THEN d.first WHEN r.run < 2 THEN 0 ELSE d.other END, CASE WHEN d.tied AND r.run < 2 THEN r.run + 1 ELSE 0 END FROM r JOIN d ON d.i = r.i + 1)
SELECT day, CAST(product AS INT) AS product, run > 0 AS by_tie FROM r
""", uses="ev")
def day_winner(spark, sf):
    """Whose task leads each day's plan: the best score (eights of held sessions), and of equal ones the core product (0), though not by a tie on more than two days in a row."""
    scores = T.actions(spark, sf).groupBy("day", "product").agg(F.expr("count(1) div 8").alias("score"))
    return sets.daily_lead(scores, "day", "product", "score", core=0)


@R.query("""
WITH b AS (SELECT max(CAST(o_orderdate AS DATE)) AS last, count(*) AS n FROM orders), a AS (SELECT count(*) AS n FROM (SELECT DISTINCT day, product FROM ev)), u AS (SELECT count(*) AS n FROM ev WHERE event = 'view')
SELECT 'billing' AS connector, 'stale' AS state, DATE '2024-01-20' AS last_day, n, 0 AS keyless, 0 AS corrupt FROM b UNION ALL SELECT 'app_analytics', 'ok', DATE '2024-01-31', 2 * n, 0, n FROM a UNION ALL SELECT 'uptime', 'ok', DATE '2024-01-31', n, 0, 0 FROM u
UNION ALL SELECT unnest(['web_analytics', 'store_first', 'store_second', 'store_third', 'support_mail', 'channels', 'payment_provider', 'helpdesk', 'social', 'mentions']), 'not_connected', NULL, NULL, NULL, NULL
""", uses="ev")
def connector_status(spark, sf):
    """What is known of the thirteen connectors on a day, when three have delivered: orders as a billing export that is old, two exports of activity of which the second has broken lines, and views as measurements."""
    root = S.folder(spark, "exports")
    o = T.read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").cast("string").alias("account"), F.lit("p").alias("plan"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.col("o_orderstatus").alias("status"))
    o.write.option("header", True).csv(f"{root}/billing/day=2024-01-20")
    ev = T.events(spark, sf)
    act = ev.groupBy(F.col("day").alias("date"), F.col("product").cast("string").alias("product")).agg(F.count_distinct("account_id").alias("active"), F.count(F.lit(1)).alias("sessions"))
    act.write.json(f"{root}/app_analytics/day=2024-01-30")
    again = act.select(F.to_json(F.struct(*act.columns)).alias("value"))
    again.unionByName(act.select(F.lit('{"date": broken').alias("value"))).write.text(f"{root}/app_analytics/day=2024-01-31")
    view = T.of(ev, "view").select(F.col("ts").cast("timestamp").alias("ts"), F.col("product").cast("string").alias("target"), F.lit(True).alias("ok"), F.col("value").alias("p95"), F.lit(0).cast("long").alias("errors"))
    view.write.parquet(f"{root}/uptime/day=2024-01-31")
    return exports.status(spark, root, F.to_date(F.lit("2024-01-31")))
