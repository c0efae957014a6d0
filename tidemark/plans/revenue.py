"""Revenue queries: an order's price stands for a subscription's monthly charge (see tidemark.sources.tables)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.operators import activity, money, series
from tidemark.operators.activity import share
from tidemark.plans.base import Registry
from tidemark.sources import tables as T

R = Registry()

_MOVES = """
WITH r AS (SELECT *, lag(month) OVER w AS prev, lag(amount) OVER w AS pa, lead(month) OVER w AS nx FROM monthly WINDOW w AS (PARTITION BY customer ORDER BY month)),
moves AS (SELECT customer, month, CASE WHEN prev = CAST(month - INTERVAL 1 MONTH AS DATE) THEN pa ELSE 0 END AS before, amount AS after FROM r
  UNION ALL SELECT customer, CAST(month + INTERVAL 1 MONTH AS DATE), amount, 0 FROM r WHERE (nx IS NULL OR nx > month + INTERVAL 1 MONTH) AND month + INTERVAL 1 MONTH <= (SELECT max(month) FROM monthly))
"""


@R.query("SELECT month, CAST(sum(amount) AS BIGINT) AS mrr, count(*) AS paying FROM monthly GROUP BY month", uses="monthly")
def mrr(spark, sf):
    """Monthly recurring revenue in cents, an annual price as a twelfth."""
    return money.mrr(T.monthly(spark, sf)).select("month", "mrr", "paying")


@R.query("SELECT month, round(sum(amount)::DOUBLE / count(*), 6) AS arpu FROM monthly GROUP BY month", uses="monthly")
def arpu(spark, sf):
    return money.mrr(T.monthly(spark, sf)).select("month", "arpu")


@R.query(_MOVES + """
SELECT month, CAST(sum(CASE WHEN before = 0 THEN after ELSE 0 END) AS BIGINT) AS "new", CAST(sum(CASE WHEN before > 0 AND after > before THEN after - before ELSE 0 END) AS BIGINT) AS expansion,
  CAST(sum(CASE WHEN before > 0 AND after > 0 AND after < before THEN after - before ELSE 0 END) AS BIGINT) AS contraction, CAST(sum(CASE WHEN after = 0 THEN after - before ELSE 0 END) AS BIGINT) AS churned
FROM moves GROUP BY month
""", uses="monthly")
def mrr_bridge(spark, sf):
    return money.bridge(T.monthly(spark, sf))


@R.query(_MOVES + """
SELECT month, count(*) AS at_start, count(*) FILTER (WHERE after = 0) AS lost, round(count(*) FILTER (WHERE after = 0)::DOUBLE / count(*), 6) AS account_churn,
  round(sum(CASE WHEN after = 0 THEN before ELSE 0 END)::DOUBLE / sum(before), 6) AS revenue_churn FROM moves WHERE before > 0 GROUP BY month
""", uses="monthly")
def churn(spark, sf):
    return money.churn(T.monthly(spark, sf))


@R.query("""
WITH l AS (SELECT customer, month, bool_or(NOT ok) AS failed FROM charges GROUP BY 1, 2), r AS (SELECT *, lead(month) OVER (PARTITION BY customer ORDER BY month) AS nx FROM l)
SELECT month, count(*) AS left_accounts, count(*) FILTER (WHERE failed) AS involuntary, round(avg(failed::INT), 6) AS involuntary_share
FROM r WHERE (nx IS NULL OR nx > month + INTERVAL 1 MONTH) AND month < (SELECT max(month) FROM l) GROUP BY month
""", uses="charges")
def involuntary_churn(spark, sf):
    """Of those who leave after a month, the share with a charge that did not go through."""
    last = T.charges(spark, sf).groupBy("customer", "month").agg(F.bool_or(~F.col("ok")).alias("failed"))
    rows = last.withColumn("nx", F.lead("month").over(W.partitionBy("customer").orderBy("month")))
    end = T.charges(spark, sf).agg(F.max("month").alias("end"))
    gone = rows.where(F.col("nx").isNull() | (F.col("nx") > F.add_months("month", 1))).join(F.broadcast(end), F.col("month") < F.col("end"), "left_semi")  # end is one row
    return gone.groupBy("month").agg(F.count(F.lit(1)).alias("left_accounts"), F.count_if("failed").alias("involuntary"), series.rate(F.col("failed")).alias("involuntary_share"))


@R.query("""
WITH c AS (SELECT customer, min(ts) AS first, max(ts) FILTER (WHERE ts <= TIMESTAMP '1998-06-30') AS latest FROM charges GROUP BY 1)
SELECT CASE WHEN first > TIMESTAMP '1998-06-30' - INTERVAL 30 DAY THEN 'trial' WHEN latest >= TIMESTAMP '1998-06-30' - INTERVAL 30 DAY THEN 'active' WHEN latest >= TIMESTAMP '1998-06-30' - INTERVAL 37 DAY THEN 'grace' ELSE 'churned' END AS status, count(*) AS accounts
FROM c WHERE first <= TIMESTAMP '1998-06-30' GROUP BY 1
""", uses="charges")
def paying_asof(spark, sf):
    """Accounts by subscription status on a day; up to seven days of grace still pay, a trial does not."""
    asof = F.lit("1998-06-30").cast("timestamp_ntz")
    ago = lambda n: asof - F.make_dt_interval(F.lit(n))
    c = T.charges(spark, sf).groupBy("customer").agg(F.min("ts").alias("first"), F.max(F.when(F.col("ts") <= asof, F.col("ts"))).alias("latest")).where(F.col("first") <= asof)
    status = F.when(F.col("first") > ago(30), "trial").when(F.col("latest") >= ago(30), "active").when(F.col("latest") >= ago(37), "grace").otherwise("churned")
    return c.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("accounts"))


@R.query("""
WITH t AS (SELECT customer, min(ts) AS start FROM charges GROUP BY 1), f AS (SELECT t.*, EXISTS (SELECT 1 FROM charges c WHERE c.customer = t.customer AND c.ts > t.start + INTERVAL 30 DAY AND c.ts <= t.start + INTERVAL 44 DAY) AS paid FROM t)
SELECT CAST(date_trunc('month', start) AS DATE) AS cohort, count(*) AS trials, round(avg(paid::INT), 6) AS conversion FROM f WHERE start + INTERVAL 44 DAY <= (SELECT max(ts) FROM charges) GROUP BY 1
""", uses="charges")
def trial_conversion(spark, sf):
    """Paid within 14 days of the end of a 30-day trial, by cohort of start; closed cohorts only."""
    c = T.charges(spark, sf)
    t = c.groupBy("customer").agg(F.min("ts").alias("start"))
    paid = c.select(F.col("customer").alias("_c"), F.col("ts").alias("at"))
    in_time = (F.col("at") > F.col("start") + F.make_dt_interval(F.lit(30))) & (F.col("at") <= F.col("start") + F.make_dt_interval(F.lit(44)))
    hit = t.join(paid, (F.col("customer") == F.col("_c")) & in_time, "left_semi").select(F.col("customer").alias("_h"))
    closed = t.join(F.broadcast(c.agg(F.max("ts").alias("end"))), F.col("start") + F.make_dt_interval(F.lit(44)) <= F.col("end"), "left_semi")  # end is one row
    flags = closed.join(hit, F.col("customer") == F.col("_h"), "left")
    return flags.groupBy(calendar.month(F.col("start")).alias("cohort")).agg(F.count(F.lit(1)).alias("trials"), series.rate(F.col("_h").isNotNull()).alias("conversion"))


@R.query("""
WITH s AS (SELECT c_mktsegment AS segment, CAST(sum(m.amount) AS BIGINT) AS mrr, count(*) AS months, count(DISTINCT m.customer) AS accounts FROM monthly m JOIN customer ON c_custkey = m.customer GROUP BY 1),
h AS (SELECT count(DISTINCT month) AS history FROM monthly)
SELECT segment, round(mrr::DOUBLE / months, 4) AS arpu, round(months::DOUBLE / accounts, 6) AS lifetime_months, round(mrr::DOUBLE / accounts, 4) AS ltv, round(mrr * 0.05 / accounts, 4) AS cac,
  round((mrr::DOUBLE / accounts) / (mrr * 0.05 / accounts), 4) AS ltv_cac, round((mrr * 0.05 / accounts) / (mrr::DOUBLE / months), 4) AS payback_months, history < 6 AS model FROM s, h
""", uses="monthly")
def ltv_cac(spark, sf):
    """LTV, CAC (five per cent of revenue stands for cost) and payback by segment; `model` marks less than six months of history."""
    m = T.monthly(spark, sf)
    seg = T.read(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    s = m.join(seg, F.col("customer") == F.col("c_custkey")).groupBy("segment").agg(F.sum("amount").alias("mrr"), F.count(F.lit(1)).alias("months"), F.count_distinct("customer").alias("accounts"))
    history = m.agg(F.count_distinct("month").alias("history"))
    rev, per = F.col("mrr").cast("double"), F.col("accounts")
    ltv, cac, arpu_ = rev / per, F.col("mrr") * 0.05 / per, rev / F.col("months")
    r = lambda c, n: F.round(c, 4).alias(n)
    return s.crossJoin(F.broadcast(history)).select("segment", r(arpu_, "arpu"), F.round(F.col("months").cast("double") / per, 6).alias("lifetime_months"), r(ltv, "ltv"), r(cac, "cac"), r(F.try_divide(ltv, cac), "ltv_cac"), r(F.try_divide(cac, arpu_), "payback_months"), (F.col("history") < 6).alias("model"))  # history is one row


@R.query("""
WITH k AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY customer ORDER BY ts, price) = 1 THEN 'first' ELSE 'renewal' END AS kind FROM charges)
SELECT kind, count(*) AS attempts, count(*) FILTER (WHERE ok) AS succeeded, round(avg(ok::INT), 6) AS success FROM k GROUP BY kind
""", uses="charges")
def billing_success(spark, sf):
    """First payments and renewals apart."""
    kind = F.when(F.row_number().over(W.partitionBy("customer").orderBy("ts", "price")) == 1, "first").otherwise("renewal")
    return T.charges(spark, sf).withColumn("kind", kind).groupBy("kind").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("ok").alias("succeeded"), series.rate(F.col("ok")).alias("success"))


_SIDES = """
WITH l AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS lc FROM orders), r AS (SELECT l_orderkey AS k, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100) AS BIGINT)) AS BIGINT) AS rc FROM lineitem GROUP BY 1)
"""


def _sides(spark, sf):
    cents = lambda c: F.round(c * 100).cast("long")
    left = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), cents(F.col("o_totalprice")).alias("cents"))
    line = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    right = T.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(cents(line)).alias("cents"))
    return left, right


@R.query(_SIDES + """
SELECT CASE WHEN rc IS NULL THEN 'only_left' WHEN lc IS NULL THEN 'only_right' WHEN abs(lc - rc) <= 2 THEN 'equal' ELSE 'differs' END AS verdict, count(*) AS n, CAST(sum(lc - rc) AS BIGINT) AS gap FROM l FULL JOIN r ON l.k IS NOT DISTINCT FROM r.k GROUP BY 1
""")
def payments_reconcile(spark, sf):
    """Order totals against the sum of their lines: what is missing on either side, what differs and by how much."""
    return money.reconcile(*_sides(spark, sf), "k", tolerance=2)


@R.query("""
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS billed FROM orders GROUP BY 1),
e AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100) AS BIGINT)) AS BIGINT) AS recorded FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT day, billed, recorded, round(abs(billed - recorded)::DOUBLE / nullif(billed, 0), 6) AS gap, coalesce(abs(billed - recorded)::DOUBLE / nullif(billed, 0) > 0.005, true) AS alarm FROM o FULL JOIN e USING (day)
""")
def billing_vs_events(spark, sf):
    """Billed revenue against revenue by events, day by day; alarm above half a per cent or where a side is missing."""
    cents = lambda c: F.round(c * 100).cast("long")
    orders = T.read(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    billed = orders.groupBy("day").agg(F.sum(cents(F.col("o_totalprice"))).alias("billed"))
    line = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    lines = T.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(cents(line)).alias("c"))
    recorded = lines.join(orders.select("o_orderkey", "day"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("day").agg(F.sum("c").alias("recorded"))
    gap = F.try_divide(F.abs(F.col("billed") - F.col("recorded")).cast("double"), F.col("billed"))
    return billed.join(recorded, "day", "full_outer").select("day", "billed", "recorded", F.round(gap, 6).alias("gap"), F.coalesce(gap > 0.005, F.lit(True)).alias("alarm"))


@R.query("""
WITH c AS (SELECT CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cash FROM customer), s AS (SELECT CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS spent, count(DISTINCT date_trunc('month', l_shipdate)) AS months FROM lineitem)
SELECT cash, round(spent::DOUBLE / months, 2) AS monthly_spend, round(cash / (spent::DOUBLE / months), 6) AS months_left FROM c, s
""")
def runway(spark, sf):
    """Cash over monthly spend; balances stand for cash and shipped goods for spend."""
    cash = T.read(spark, sf, "customer").agg(F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cash"))
    spend = T.read(spark, sf, "lineitem").agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double") / F.count_distinct(F.date_trunc("month", "l_shipdate"))).alias("s"))
    return cash.crossJoin(spend).select("cash", F.round("s", 2).alias("monthly_spend"), F.round(F.try_divide(F.col("cash").cast("double"), F.col("s")), 6).alias("months_left"))  # one row each


_WEEKLY = "WITH s AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS x, count(*) AS n FROM orders GROUP BY 1)\n"


def weekly_orders(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return T.read(spark, sf, "orders").groupBy(F.date_sub(d, F.weekday(d)).alias("week")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("x"), F.count(F.lit(1)).alias("n"))


@R.query(_WEEKLY + "SELECT week, x, round((x - lag(x) OVER (ORDER BY week))::DOUBLE / lag(x) OVER (ORDER BY week), 6) AS change FROM s")
def wow_change(spark, sf):
    return weekly_orders(spark, sf).select("week", "x", activity.change("x", "week"))


@R.query("""
WITH s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS cohort, avg((o_orderstatus = 'F')::INT) AS r FROM orders GROUP BY 1)
SELECT cohort, round(r, 6) AS rate, round((r - lag(r) OVER (ORDER BY cohort)) * 100, 4) AS change_pp FROM s
""")
def pp_change(spark, sf):
    """Difference to the previous cohort in percentage points."""
    s = T.charges(spark, sf).groupBy(F.col("month").alias("cohort")).agg(F.avg(F.col("ok").cast("int")).alias("r"))
    return s.select("cohort", F.round("r", 6).alias("rate"), F.round((F.col("r") - F.lag("r").over(series.over("cohort"))) * 100, 4).alias("change_pp"))


@R.query("""
WITH s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS cohort, avg((o_orderstatus = 'F')::INT) AS r FROM orders GROUP BY 1)
SELECT cohort, count(*) OVER w = 2 AND min((r >= 0.1 AND r < 0.5)::INT) OVER w = 1 AS two_in_band FROM s WINDOW w AS (ORDER BY cohort ROWS 1 PRECEDING)
""")
def streak2(spark, sf):
    """Two cohorts in a row within a band."""
    s = T.charges(spark, sf).groupBy(F.col("month").alias("cohort")).agg(F.avg(F.col("ok").cast("int")).alias("r"))
    return s.select("cohort", series.streak((F.col("r") >= 0.1) & (F.col("r") < 0.5), 2, "cohort").alias("two_in_band"))


@R.query(_WEEKLY + ", f AS (SELECT week, coalesce(x <= lag(x) OVER (ORDER BY week), false) AS flat FROM s) SELECT week, count(*) OVER w = 3 AND min(flat::INT) OVER w = 1 AS stalled FROM f WINDOW w AS (ORDER BY week ROWS 2 PRECEDING)")
def streak3(spark, sf):
    """Three weeks running without growth."""
    flat = weekly_orders(spark, sf).withColumn("flat", F.col("x") <= F.lag("x").over(series.over("week")))
    return flat.select("week", series.streak(F.col("flat"), 3, "week").alias("stalled"))


@R.query("WITH s AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1) SELECT day, n, round(n / avg(n) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS ratio FROM s")
def norm_ratio(spark, sf):
    """A day against the mean of the seven days with data before it."""
    s = T.read(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("day", "n", series.norm_ratio("n", "day").alias("ratio"))


@R.query(_WEEKLY + "SELECT week, array_to_string(list(n) OVER (ORDER BY week ROWS 11 PRECEDING), ',') AS sparkline FROM s")
def sparkline12(spark, sf):
    return weekly_orders(spark, sf).select("week", F.array_join(F.transform(series.sparkline("n", "week"), lambda v: v.cast("string")), ",").alias("sparkline"))


@R.query(_WEEKLY + "SELECT week, x, coalesce(greatest(x::DOUBLE / nullif(lag(x) OVER (ORDER BY week), 0), lag(x) OVER (ORDER BY week)::DOUBLE / nullif(x, 0)) > 2, false) AS contradicts FROM s")
def contradiction(spark, sf):
    return weekly_orders(spark, sf).select("week", "x", F.coalesce(series.contradiction("x", "week"), F.lit(False)).alias("contradicts"))


@R.query("WITH s AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem GROUP BY 1) SELECT day, n, coalesce(n < 0.8 * lag(n) OVER (ORDER BY day), false) AS shrunk FROM s")
def vs_previous(spark, sf):
    """A backup (the day's lines) a fifth smaller than the one before."""
    s = T.read(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("day", "n", F.coalesce(F.col("n") < 0.8 * F.lag("n").over(series.over("day")), F.lit(False)).alias("shrunk"))


@R.query("""
WITH s AS (SELECT day, sum(count(*)) OVER (ORDER BY day) AS used, row_number() OVER (ORDER BY day) AS i FROM ev GROUP BY day), f AS (SELECT regr_slope(used, i) AS g, max_by(used, i) AS latest FROM s)
SELECT round(g, 4) AS growth, round(latest::DOUBLE, 4) AS latest, round(CASE WHEN g > 0 THEN (1000000 - latest) / g END, 2) AS periods_to_full FROM f
""", uses="ev")
def capacity_forecast(spark, sf):
    """Days until a million rows, by a straight line through the total so far."""
    daily = T.events(spark, sf).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    w = W.orderBy("day")
    s = daily.select(F.sum("n").over(w).cast("double").alias("used"), F.row_number().over(w).cast("double").alias("i"))
    return series.forecast(s, "i", "used", 1_000_000)
