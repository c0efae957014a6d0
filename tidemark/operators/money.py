"""Recurring revenue. Amounts are whole cents, so that sums are the same in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.activity import share


def mrr(monthly: DataFrame) -> DataFrame:
    """(month, mrr, paying, arpu) of (customer, month, amount)."""
    return monthly.groupBy("month").agg(F.sum("amount").alias("mrr"), F.count_distinct("customer").alias("paying")).withColumn("arpu", share(F.col("mrr"), F.col("paying")))


def moves(monthly: DataFrame) -> DataFrame:
    """(customer, month, before, after) for every month in which a customer pays or has just stopped.

    A customer's previous row is found by lag; a gap of more than a month means churn in the month after it and a fresh start
    later. Nobody churns after the last month of the data, as that is not known yet.
    """
    w = W.partitionBy("customer").orderBy("month")
    rows = monthly.select("customer", "month", "amount", F.lag("month").over(w).alias("prev"), F.lag("amount").over(w).alias("prev_amount"), F.lead("month").over(w).alias("following"))
    adjacent = F.col("prev") == F.add_months("month", -1)
    paying = rows.select("customer", "month", F.when(adjacent, F.col("prev_amount")).otherwise(F.lit(0)).alias("before"), F.col("amount").alias("after"))
    last = monthly.agg(F.max("month").alias("last"))
    gone = rows.where(F.col("following").isNull() | (F.col("following") > F.add_months("month", 1))).select("customer", F.add_months("month", 1).alias("month"), F.col("amount").alias("before"), F.lit(0).cast("long").alias("after"))
    gone = gone.join(F.broadcast(last), F.col("month") <= F.col("last"), "left_semi")  # last is one row
    return paying.unionByName(gone)


def bridge(monthly: DataFrame) -> DataFrame:
    """(month, new, expansion, contraction, churned)."""
    d = F.col("after") - F.col("before")
    part = lambda cond, value, name: F.sum(F.when(cond, value).otherwise(F.lit(0))).alias(name)
    return moves(monthly).groupBy("month").agg(
        part(F.col("before") == 0, F.col("after"), "new"),
        part((F.col("before") > 0) & (d > 0), d, "expansion"),
        part((F.col("before") > 0) & (F.col("after") > 0) & (d < 0), d, "contraction"),
        part(F.col("after") == 0, d, "churned"),
    )


def churn(monthly: DataFrame) -> DataFrame:
    """(month, at_start, lost, account_churn, revenue_churn): three numbers that are not to be mixed up."""
    lost = F.col("after") == 0
    return moves(monthly).where("before > 0").groupBy("month").agg(F.count(F.lit(1)).alias("at_start"), F.count_if(lost).alias("lost"), share(F.count_if(lost), F.count(F.lit(1))).alias("account_churn"), share(F.sum(F.when(lost, F.col("before")).otherwise(0)), F.sum("before")).alias("revenue_churn"))


def reconcile(left: DataFrame, right: DataFrame, key: str, tolerance: int = 0) -> DataFrame:
    """(verdict, n, gap) of two (key, cents) tables: differences are recorded, not smoothed."""
    both = left.select(F.col(key).alias("_l"), F.col("cents").alias("lc")).join(right.select(F.col(key).alias("_r"), F.col("cents").alias("rc")), F.expr("_l <=> _r"), "full_outer")
    gap = F.col("lc") - F.col("rc")
    verdict = F.when(F.col("rc").isNull(), "only_left").when(F.col("lc").isNull(), "only_right").when(F.abs(gap) <= tolerance, "equal").otherwise("differs")
    return both.select(verdict.alias("verdict"), gap.alias("gap")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("gap").alias("gap"))
