"""Daily marts as functions of the facts of some parts.

A part is a day of events or a month of charges. Each function takes facts that cover the parts asked for and their reach (what lies before and after and can change
a part's rows), and gives rows for exactly those parts. So a build may give it everything or only what new facts touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import cohorts, intervals

#: Schemas of facts and marts; the first column is what a table is cut by.
EVENTS = "part date, event_id long, account_id long, event string, ts timestamp_ntz, value double, k int, product int"
CHARGES = "part date, customer long, price double, annual boolean, ok boolean, ts timestamp_ntz"
RETURNS = "part date, shipped timestamp_ntz"
FIRSTS = "part date, key long, ts timestamp_ntz, price double"
ACTIVITY = "part date, account_id long, held long, notes long, opened long, errors long, entered long, finished long, unfinished long, privacy long"
TICKETS = "part date, account_id long, k int"
DAYS = "part date, held long, covered long, due long, sent long, errors long, overdue long, requests long, p95 double, minutes long, good_minutes long, burst long, pulse long"
COHORTS = "part date, entered long, activated long, d1 long, d7 long, d14 long"
RELEASES = "part date, event_id long, before long, after long"
REVENUE = "part date, day date, charges long, succeeded long, cents long, first_charges long, first_succeeded long, paid_after_trial long"
MONTHS = "part date, customer long, segment string, amount long, failed boolean"
RETURNED = "part date, day date, returned long"
TRIAL, IN_TIME = 30, 14


def _is(*names: str) -> Column:
    return F.col("event").isin(*names)


def activity(facts: DataFrame) -> DataFrame:
    """An account's day: how often it did what."""
    n = lambda flag: F.count_if(flag)
    return facts.groupBy("part", "account_id").agg(
        n(_is("purchase")).alias("held"), n(_is("click")).alias("notes"), n(_is("view")).alias("opened"), n(_is("error")).alias("errors"), n(_is("signup")).alias("entered"),
        n(_is("purchase") & F.col("k").isNotNull()).alias("finished"), n(_is("purchase") & (F.col("k") < 80)).alias("unfinished"), n(_is("error") & (F.col("k") < 1)).alias("privacy"),
    )


def tickets(facts: DataFrame) -> DataFrame:
    """One problem (k) of one account on one day."""
    return facts.where(_is("error")).select("part", "account_id", "k").distinct()


def days(facts: DataFrame, wanted: Column) -> DataFrame:
    """A day's counters: sessions with a note within 72 hours, reminders due and sent within 24, tickets without a reply within 24, the p95 of views, minutes without an error, and the densest 24 hours of negatives.

    Looking for the next note, held sessions and errors are one set of rows, so there is one pass over notes for all three counters.
    """
    notes = facts.where(_is("click")).select("account_id", "ts")
    asked = facts.where(_is("purchase", "error") & wanted).select("event_id", "event", "k", "account_id", "ts", "part")
    # A note at the very time counts for a session and a reminder, but answers no ticket: tickets look from a microsecond later.
    asked = asked.withColumn("at", F.when(F.col("event") == "error", F.timestamp_add("MICROSECOND", F.lit(1), F.col("ts"))).otherwise(F.col("ts")))
    found = intervals.next_after(asked, notes.withColumnRenamed("ts", "at"), "account_id", ts="at", strict=False)
    near = lambda hours: F.coalesce(intervals.within(F.col("ts"), F.col("next_ts"), hours), F.lit(False))
    held, error = _is("purchase"), _is("error")
    counted = found.groupBy("part").agg(F.count_if(held).alias("held"), F.count_if(held & near(72)).alias("covered"), F.count_if(held).alias("due"), F.count_if(held & near(24)).alias("sent"), F.count_if(error).alias("errors"), F.count_if(error & ~near(24)).alias("overdue"), F.count_if(held & (F.col("k") >= 97)).alias("pulse"))
    minute = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60)
    minutes = facts.where(wanted).groupBy("part", minute.alias("m")).agg(F.bool_or(error).alias("bad")).groupBy("part").agg(F.count(F.lit(1)).alias("minutes"), F.count_if(~F.col("bad")).alias("good_minutes"))
    views = facts.where(_is("view") & wanted).groupBy("part").agg(F.count(F.lit(1)).alias("requests"), F.percentile("value", 0.95).alias("p95"))
    bursts = intervals.recent_count(facts.where(error & (F.col("k") >= 50)).select("part", "product", "ts"), "product", 86400).where(wanted).groupBy("part").agg(F.max("n_recent").alias("burst"))
    out = minutes
    for part in (counted, views, bursts):
        out = out.join(part, "part", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("part", zero("held"), zero("covered"), zero("due"), zero("sent"), zero("errors"), zero("overdue"), zero("requests"), "p95", "minutes", "good_minutes", F.col("burst").cast("long").alias("burst"), zero("pulse"))


def entry_cohorts(firsts: DataFrame, facts: DataFrame) -> DataFrame:
    """By day of entry: accounts, those activated within seven days, and those active exactly 1, 7 and 14 days later. firsts: (part, key, ts), an account's entry."""
    entered = firsts.select(F.col("part").alias("_part"), F.col("key").alias("account_id"), F.col("ts").alias("entered"))
    used = facts.where(_is("purchase", "click")).select("account_id", "event", "ts", F.col("part").alias("at"))
    window = (F.col("ts") >= F.col("entered")) & (F.col("ts") <= F.col("entered") + F.make_dt_interval(F.lit(7)))
    gap, held = F.date_diff("at", "_part"), F.col("event") == "purchase"
    back = [F.coalesce(F.bool_or(held & (gap == n)), F.lit(False)).alias(f"d{n}") for n in (1, 7, 14)]
    rows = entered.join(used, "account_id", "left").groupBy("_part", "account_id").agg(F.count_if(held & window).alias("held"), F.count_if((F.col("event") == "click") & window).alias("notes"), *back)
    return rows.groupBy(F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("entered"), F.count_if((F.col("held") >= 3) & (F.col("notes") >= 2)).alias("activated"), *[F.count_if(f"d{n}").alias(f"d{n}") for n in (1, 7, 14)])


def releases(facts: DataFrame, wanted: Column) -> DataFrame:
    """A release (a signup with k of 95 or more) and the cancellations (errors) in the 72 hours after it and before it.

    Errors are counted by hour; a release adds the whole hours within its window and meets single errors only in the two hours that the window cuts.
    """
    made = facts.where(_is("signup") & (F.col("k") >= 95) & wanted).select("part", "event_id", intervals.micros(F.col("ts")).alias("t"))
    errors = facts.where(_is("error")).select(intervals.micros(F.col("ts")).alias("at"))
    hour, span = 3_600_000_000, 72 * 3_600_000_000
    # Edges of the windows: [t - span, t] before and (t, t + span] after.
    edges = made.select("part", "event_id", F.explode(F.array(*[F.struct(F.lit(i).alias("edge"), e.alias("upto")) for i, e in enumerate((F.col("t") - span - 1, F.col("t"), F.col("t") + span))])).alias("e")).select("part", "event_id", "e.*").withColumn("h", F.floor(F.col("upto") / hour))
    totals = errors.groupBy(F.floor(F.col("at") / hour).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    heads = intervals.running(edges.select("h").distinct(), totals, "h", "n")
    inside = edges.join(errors.select(F.floor(F.col("at") / hour).alias("_h"), "at"), (F.col("h") == F.col("_h")) & (F.col("at") <= F.col("upto"))).groupBy("event_id", "edge").agg(F.count(F.lit(1)).alias("inside"))
    counted = edges.join(heads, "h").join(inside, ["event_id", "edge"], "left").select("part", "event_id", "edge", (F.col("head") + F.coalesce("inside", F.lit(0))).alias("c"))
    at = lambda i: F.max(F.when(F.col("edge") == i, F.col("c")))
    return counted.groupBy("part", "event_id").agg((at(1) - at(0)).alias("before"), (at(2) - at(1)).alias("after"))


def revenue(charges: DataFrame, firsts: DataFrame, wanted: Column) -> DataFrame:
    """By day: charges, those that succeeded, and the same of first charges; by the first charge's day: who paid within 14 days of the end of a 30-day trial.

    firsts: (part, key, ts, price), a customer's first charge: the earliest, and the cheapest of those at one time. Charges that agree with it in both are all first.
    """
    first = firsts.select(F.col("part").alias("_part"), "key", F.col("ts").alias("_ts"), F.col("price").alias("_price"))
    own = charges.where(wanted).join(first, (F.col("customer") == F.col("key")) & (F.col("part") == F.col("_part")), "left")
    is_first = F.coalesce((F.col("ts") == F.col("_ts")) & (F.col("price") == F.col("_price")), F.lit(False))
    by_day = own.groupBy("part", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("charges"), F.count_if("ok").alias("succeeded"), F.sum(F.round(F.col("price") * 100).cast("long")).alias("cents"), F.count_if(is_first).alias("first_charges"), F.count_if(is_first & F.col("ok")).alias("first_succeeded"))
    after = lambda n: F.col("start") + F.make_dt_interval(F.lit(n))
    start = firsts.where(wanted).select("key", F.col("ts").alias("start"))
    paid = start.join(charges.select("customer", "ts"), (F.col("key") == F.col("customer")) & (F.col("ts") > after(TRIAL)) & (F.col("ts") <= after(TRIAL + IN_TIME)), "left_semi")
    trials = paid.groupBy(F.col("start").cast("date").alias("_day")).agg(F.count(F.lit(1)).alias("paid_after_trial"))
    return by_day.join(trials, F.col("day") == F.col("_day"), "left").select("part", "day", "charges", "succeeded", "cents", "first_charges", "first_succeeded", F.coalesce("paid_after_trial", F.lit(0)).cast("long").alias("paid_after_trial"))


def months(charges: DataFrame, segments: DataFrame) -> DataFrame:
    """A customer's month: recurring revenue in cents (an annual price as a twelfth), and whether a charge failed. segments: (customer, segment)."""
    cents = F.round(F.when(F.col("annual"), F.col("price") / 12).otherwise(F.col("price")) * 100).cast("long")
    rows = charges.groupBy("part", "customer").agg(F.sum(cents).alias("amount"), F.bool_or(~F.col("ok")).alias("failed"))
    return rows.join(segments.select(F.col("customer").alias("_c"), "segment"), F.col("customer") == F.col("_c"), "left").select("part", "customer", "segment", "amount", "failed")


def returned(returns: DataFrame) -> DataFrame:
    return returns.groupBy("part", F.col("shipped").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("returned"))


def first_of(rows: DataFrame, key: str, price: Column) -> DataFrame:
    """(part, key, ts, price): a key's earliest row, of those at one time that of the least price."""
    best = rows.groupBy(F.col(key).cast("long").alias("key")).agg(F.min(F.struct("ts", price.cast("double").alias("price"), "part")).alias("b"))
    return best.select("b.part", "key", "b.ts", "b.price")
