"""Daily marts, as the build writes them by day, and small reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.functions.registry import EVENTS
from tidemark.operators import cohorts, intervals, lint, orders, series, sets
from tidemark.operators.activity import share
from tidemark.plans import texts
from tidemark.plans.base import Registry
from tidemark.sources import connectors
from tidemark.sources import tables as T

R = Registry()


@R.query("""
WITH c AS (SELECT e.account_id, e.entered, count(*) FILTER (WHERE event = 'purchase') AS np, count(*) FILTER (WHERE event = 'click') AS nc
  FROM entry e LEFT JOIN ev v ON v.account_id = e.account_id AND v.event IN ('purchase', 'click') AND v.ts >= e.entered AND v.ts <= e.entered + INTERVAL 7 DAY GROUP BY ALL)
SELECT CAST(entered + INTERVAL 3 HOUR AS DATE) AS day, count(*) AS entered, count(*) FILTER (WHERE np >= 3 AND nc >= 2) AS activated FROM c GROUP BY 1
""", uses="ev entry")
def mart_activation(spark, sf):
    rows = cohorts.activation(T.entries(spark, sf), T.events(spark, sf), {"purchase": 3, "click": 2}, 7)
    return rows.groupBy(calendar.day(F.col("entered")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if("activated").alias("activated")).select("day", F.col("n").alias("entered"), "activated")


@R.query("""
WITH c AS (SELECT account_id, CAST(entered + INTERVAL 3 HOUR AS DATE) AS day FROM entry),
f AS (SELECT c.day, c.account_id, coalesce(bool_or(v.day - c.day = 1), false) AS d1, coalesce(bool_or(v.day - c.day = 7), false) AS d7, coalesce(bool_or(v.day - c.day = 14), false) AS d14 FROM c LEFT JOIN ev v ON v.account_id = c.account_id AND v.event = 'purchase' GROUP BY ALL)
SELECT day, count(*) AS size, count(*) FILTER (WHERE d1) AS d1, count(*) FILTER (WHERE d7) AS d7, count(*) FILTER (WHERE d14) AS d14 FROM f GROUP BY day
""", uses="ev entry")
def mart_retention(spark, sf):
    """Counts and not shares, so that days can be added up; sizes are what persist_cohorts stores."""
    entered = T.entries(spark, sf).select("account_id", calendar.day(F.col("entered")).alias("day"))
    seen = T.actions(spark, sf).select(F.col("account_id").alias("_a"), F.col("day").alias("at")).distinct()
    gap = F.date_diff("at", "day")
    joined = entered.join(seen, (F.col("account_id") == F.col("_a")) & gap.isin(1, 7, 14), "left")
    flags = joined.groupBy("day", "account_id").agg(*[F.coalesce(F.bool_or(gap == n), F.lit(False)).alias(f"d{n}") for n in (1, 7, 14)])
    return flags.groupBy("day").agg(F.count(F.lit(1)).alias("size"), *[F.count_if(f"d{n}").alias(f"d{n}") for n in (1, 7, 14)])


@R.query("""
WITH f AS (SELECT customer, min(ts) AS first FROM charges GROUP BY 1)
SELECT CAST(c.ts AS DATE) AS day, count(*) AS charges, count(*) FILTER (WHERE ok) AS succeeded, CAST(sum(CAST(round(price * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) FILTER (WHERE c.ts = f.first) AS first_charges FROM charges c JOIN f USING (customer) GROUP BY 1
""", uses="charges")
def mart_revenue(spark, sf):
    c = T.charges(spark, sf)
    first = c.groupBy(F.col("customer").alias("_c")).agg(F.min("ts").alias("first"))
    rows = c.join(first, F.col("customer") == F.col("_c"))
    return rows.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("charges"), F.count_if("ok").alias("succeeded"), F.sum(F.round(F.col("price") * 100).cast("long")).alias("cents"), F.count_if(F.col("ts") == F.col("first")).alias("first_charges"))


@R.query("""
WITH e AS (SELECT event_id, day, account_id, ts FROM ev WHERE event = 'error'), n AS (SELECT e.event_id, e.day, e.ts, min(v.ts) AS nxt FROM e LEFT JOIN ev v ON v.account_id = e.account_id AND v.event = 'click' AND v.ts > e.ts GROUP BY ALL)
SELECT day, count(*) AS tickets, count(*) FILTER (WHERE nxt IS NULL OR nxt > ts + INTERVAL 24 HOUR) AS overdue, round(quantile_cont((epoch_us(nxt) - epoch_us(ts)) / 3600000000.0, 0.5), 4) AS median_hours FROM n GROUP BY day
""", uses="ev")
def mart_support(spark, sf):
    ev = T.events(spark, sf)
    rows = intervals.next_after(T.of(ev, "error").select("event_id", "day", "account_id", "ts"), T.of(ev, "click").select("account_id", "ts"), "account_id")
    hours = (intervals.micros(F.col("next_ts")) - intervals.micros(F.col("ts"))) / 3600000000.0
    late = ~F.coalesce(intervals.within(F.col("ts"), F.col("next_ts"), 24), F.lit(False))
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("tickets"), F.count_if(late).alias("overdue"), F.round(F.percentile(hours, 0.5), 4).alias("median_hours"))


@R.query("""
WITH l AS (SELECT c_custkey AS customer, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT customer, CAST(date_diff('day', CAST(last AS DATE), DATE '2001-08-01') AS INT) AS days_since, CASE WHEN last IS NULL OR date_diff('day', CAST(last AS DATE), DATE '2001-08-01') > 365 THEN 'red' WHEN date_diff('day', CAST(last AS DATE), DATE '2001-08-01') > 90 THEN 'amber' ELSE 'green' END AS level FROM l
""")
def days_since(spark, sf):
    """Days since the last order; never is null and red."""
    c = T.read(spark, sf, "customer").select(F.col("c_custkey").alias("customer"))
    last = T.read(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    d = F.date_diff(F.to_date(F.lit("2001-08-01")), F.col("last").cast("date"))
    return c.join(last, F.col("customer") == F.col("o_custkey"), "left").select("customer", d.alias("days_since"), F.when(d.isNull() | (d > 365), "red").when(d > 90, "amber").otherwise("green").alias("level"))


@R.query("WITH u AS (SELECT o_custkey % 4 AS chat_id, arg_max(o_orderpriority, o_orderkey) AS label FROM orders GROUP BY 1) SELECT chat_id, label FROM u")
def chat_labels(spark, sf):
    """The last label seen of each chat."""
    o = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("update_id"), (F.col("o_custkey") % 4).alias("chat_id"), F.col("o_orderpriority").alias("author"))
    return orders.chat_labels(o)


@R.query("SELECT o_orderkey AS id, '## Открытые' || chr(10) || '#### O-' || o_orderkey || CASE WHEN o_orderstatus = 'F' THEN chr(10) ELSE chr(10) || '#### old' || chr(10) END AS ledger FROM orders")
def ledger_insert(spark, sf):
    """New entries stand above old ones; an empty ledger loses its placeholder."""
    old = F.when(F.col("o_orderstatus") == "F", F.lit("## Открытые\n\n_пусто_\n")).otherwise(F.lit("## Открытые\n#### old\n"))
    added = F.concat(F.lit("\n#### O-"), F.col("o_orderkey").cast("string"))
    return T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), orders.insert(old, added).alias("ledger"))


@R.query("""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS weak, o_orderstatus = 'F' AS dated FROM orders), f AS (SELECT k, 'emoji' AS rule FROM o UNION ALL SELECT k, unnest(['topic_title', 'empty_phrase', 'no_evidence', 'no_decisions']) FROM o WHERE weak)
SELECT k AS doc_id, rule FROM f ORDER BY k, rule LIMIT 5
""")
def findings_top5(spark, sf):
    """A report of five findings, errors before notes."""
    found = lint.lint(texts.decks(spark, sf))
    return sets.top(found.where(F.col("level") == lint.ERROR), 5, F.col("doc_id"), F.col("rule")).select("doc_id", "rule")


@R.query("SELECT event_type AS event, CAST(max(ts) AS TIMESTAMP) AS last_seen, count(*) AS n FROM events GROUP BY 1 ORDER BY last_seen DESC LIMIT 4")
def last_log_lines(spark, sf):
    """The last four kinds of events by when they were last seen, newest first."""
    n = T.read(spark, sf, "events").groupBy(F.col("event_type").alias("event")).agg(F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"))
    return sets.top(n, 4, F.col("last_seen").desc())


@R.query("SELECT event_id, CAST(1 + CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END AS INT) AS fields FROM events")
def outgoing_fields(spark, sf):
    """Outgoing fields without those that are not set."""
    m = F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("kind"), F.when(F.col("event_type") != "view", F.col("event_type")))
    return T.read(spark, sf, "events").select("event_id", F.size(connectors.without_nulls(m)).alias("fields"))


_AREAS = ", ".join(f"('{area}', {len(names)})" for area, names in EVENTS.items())
_NAMES = ", ".join(f"('{area}', '{name}')" for area, names in EVENTS.items() for name in names)


@R.query(f"""
WITH n(area, event) AS (VALUES {_NAMES}), a(area, registered) AS (VALUES {_AREAS}), seen AS (SELECT area, count(*) AS rows FROM events JOIN n ON event = event_type GROUP BY 1)
SELECT a.area, CAST(registered AS BIGINT) AS registered, coalesce(rows, 0) AS rows FROM a LEFT JOIN seen ON a.area = seen.area
UNION ALL SELECT 'unregistered', count(DISTINCT event_type), count(*) FROM events WHERE event_type NOT IN (SELECT event FROM n)
""")
def event_registry(spark, sf):
    """Registered names by area and the rows that the table has of them, and under `unregistered` the names and rows that no area knows. `*` belongs to every product."""
    names = spark.createDataFrame([(area, name) for area, own in EVENTS.items() for name in own], "area string, name string")
    rows = T.read(spark, sf, "events").groupBy(F.col("event_type").alias("event")).agg(F.count(F.lit(1)).alias("n"))  # a row for each kind of event
    known = names.join(rows, F.col("event") == F.col("name"), "left").groupBy("area").agg(F.count(F.lit(1)).alias("registered"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    other = rows.join(names, F.col("event") == F.col("name"), "left_anti").agg(F.count(F.lit(1)).alias("registered"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).select(F.lit("unregistered").alias("area"), "registered", "rows")
    return known.unionByName(other)


@R.query("SELECT source, max(CAST(doc_id AS VARCHAR)) AS newest FROM documents GROUP BY 1")
def newest_match(spark, sf):
    """Of a source's documents the last by name, as text sorts: `9` comes after `10`."""
    return sets.newest(T.read(spark, sf, "documents").select("source", F.col("doc_id").cast("string").alias("name")), "source", "name", "newest")


@R.query("""
WITH w AS (SELECT week, count(*) FILTER (WHERE event = 'purchase') AS held, count(*) FILTER (WHERE event = 'error') AS cancelled FROM ev GROUP BY 1)
SELECT week, round(cancelled::DOUBLE / nullif(held + cancelled, 0), 6) AS cancelled_share, held + cancelled >= 100 AS enough, round((cancelled::DOUBLE / nullif(held + cancelled, 0) - lag(cancelled::DOUBLE / nullif(held + cancelled, 0)) OVER (ORDER BY week)) * 100, 4) AS change_pp FROM w
""", uses="ev")
def cancelled_share(spark, sf):
    """Cancelled among all bookings by week, with the change in points and whether there is enough to judge."""
    w = T.events(spark, sf).groupBy("week").agg(F.count_if(F.col("event") == "purchase").alias("held"), F.count_if(F.col("event") == "error").alias("cancelled"))
    all_ = F.col("held") + F.col("cancelled")
    raw = F.try_divide(F.col("cancelled").cast("double"), all_)
    return w.withColumn("raw", raw).select("week", share(F.col("cancelled"), all_).alias("cancelled_share"), (all_ >= 100).alias("enough"), F.round((F.col("raw") - F.lag("raw").over(series.over("week"))) * 100, 4).alias("change_pp"))
