"""Cohorts: activation, retention on a day, funnels and trials.

An account stays in the denominator of its cohort whatever becomes of it later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.operators.activity import share


def activation(entries: DataFrame, actions: DataFrame, needs: dict[str, int], days: int) -> DataFrame:
    """(account_id, entered, activated): each event of `needs` as often as asked within `days` of entry. Thresholds are hypotheses, so they are arguments."""
    window = (F.col("ts") >= F.col("entered")) & (F.col("ts") <= F.col("entered") + F.make_dt_interval(F.lit(days)))
    joined = entries.join(actions.where(F.col("event").isin(*needs)).select("account_id", "event", "ts"), "account_id", "left")
    counts = [F.count_if(window & (F.col("event") == e)).alias(f"n_{e}") for e in needs]
    reached = F.lit(True)
    for e, n in needs.items():
        reached = reached & (F.col(f"n_{e}") >= n)
    return joined.groupBy("account_id", "entered").agg(*counts).withColumn("activated", reached)


def retained_on(entries: DataFrame, actions: DataFrame, unit: str, steps: list[int], prefix: str) -> DataFrame:
    """(cohort, size, <prefix><n>) by entry week: share of accounts active exactly n days (or weeks) after entry, not within n."""
    cohort = entries.select("account_id", calendar.week(F.col("entered")).alias("cohort"), (calendar.day if unit == "day" else calendar.week)(F.col("entered")).alias("start"))
    seen = actions.select("account_id", (F.col("day") if unit == "day" else F.col("week")).alias("at")).distinct()
    gap = F.date_diff("at", "start") / (1 if unit == "day" else 7)
    joined = cohort.join(seen, "account_id", "left").withColumn("gap", gap)
    flags = joined.groupBy("cohort", "account_id").agg(*[F.max(F.coalesce((F.col("gap") == n).cast("int"), F.lit(0))).alias(f"f{n}") for n in steps])
    return flags.groupBy("cohort").agg(F.count(F.lit(1)).alias("size"), *[share(F.sum(f"f{n}"), F.count(F.lit(1))).alias(f"{prefix}{n}") for n in steps])


def cohort_matrix(entries: DataFrame, actions: DataFrame, weeks: int) -> DataFrame:
    """cohort week x weeks since entry, as counts of active accounts."""
    cohort = entries.select("account_id", calendar.week(F.col("entered")).alias("cohort"))
    seen = actions.select("account_id", "week").distinct()
    pairs = cohort.join(seen, "account_id").withColumn("offset", (F.date_diff("week", "cohort") / 7).cast("int")).where(F.col("offset").between(0, weeks - 1))
    cells = pairs.groupBy("cohort").pivot("offset", list(range(weeks))).agg(F.count_distinct("account_id"))
    return cells.select("cohort", *[F.coalesce(F.col(f"`{i}`"), F.lit(0)).alias(f"w{i}") for i in range(weeks)])


def ordered_funnel(events: DataFrame, steps: list[str]) -> DataFrame:
    """(step, name, accounts): accounts that did the steps in order, each after the one before.

    A step's time is the account's first one after the step before it, and an account keeps the times of its steps in one row, so each step's events are read once. Each step is a join on
    the account with one row on its other side and a minimum that is pre-aggregated, so no account's events meet in one place.
    """
    times = ["_at0"]
    reached = events.where(F.col("event") == steps[0]).groupBy("account_id").agg(F.min("ts").alias("_at0"))
    for i, name in enumerate(steps[1:], 1):
        later = events.where(F.col("event") == name).select(F.col("account_id").alias("_a"), "ts")
        reached = reached.join(later, (F.col("account_id") == F.col("_a")) & (F.col("ts") > F.col(times[-1])), "left").groupBy("account_id", *times).agg(F.min("ts").alias(f"_at{i}"))
        times.append(f"_at{i}")
    counts = reached.agg(*[F.count(t).alias(t) for t in times])  # one row
    rows = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("name"), F.col(t).alias("accounts")) for i, (name, t) in enumerate(zip(steps, times, strict=True))])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def first_per(rows: DataFrame, key: str, ts: str, alias: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(ts).alias(alias))


def conversion(flags: DataFrame, by: str, flag: Column, alias: str) -> DataFrame:
    return flags.groupBy(by).agg(F.count(F.lit(1)).alias("n"), share(F.count_if(flag), F.count(F.lit(1))).alias(alias))
