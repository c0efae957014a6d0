"""Who was active, how often, and how that moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole, null where there is no whole: unknown is not zero."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def distinct_accounts(actions: DataFrame, *by: str, alias: str) -> DataFrame:
    return actions.groupBy(*by).agg(F.count_distinct("account_id").alias(alias))


def trailing_distinct(actions: DataFrame, days: int, alias: str) -> DataFrame:
    """(day, n) distinct accounts of the `days` days up to each day that has data.

    An account's days are merged into stretches without a gap of `days`; it joins the count where one begins and leaves it `days` after its last day. So
    a row per account and day gives two steps at most, and the count is a running sum over days.
    """
    w = W.partitionBy("account_id").orderBy("day")  # a row for each day of an account
    once = actions.select("account_id", "day").distinct()
    known = F.col("account_id").isNotNull()
    joins = known & F.coalesce(F.date_diff("day", F.lag("day").over(w)) > days, F.lit(True))
    leaves = known & F.coalesce(F.date_diff(F.lead("day").over(w), "day") > days, F.lit(True))
    step = lambda d, n, seen: F.struct(d.alias("day"), n.alias("n"), F.lit(seen).alias("seen"))
    steps = F.array(step(F.col("day"), joins.cast("int"), True), F.when(leaves, step(F.date_add("day", days), F.lit(-1), False)))
    moves = once.select(steps.alias("steps")).select(F.explode(F.array_compact("steps")).alias("s")).groupBy("s.day").agg(F.sum("s.n").alias("n"), F.max("s.seen").alias("seen"))
    return moves.withColumn(alias, F.sum("n").over(W.orderBy("day"))).where("seen").select("day", alias)


def with_total(actions: DataFrame, period: str, part: str, alias: str) -> DataFrame:
    """Distinct accounts by part and over all parts; adding up the parts would count people twice."""
    return actions.groupingSets([[period, part], [period]], period, part).agg(F.grouping(part).alias("is_total"), F.count_distinct("account_id").alias(alias))


def change(value: str, order: str, by: list[str] | None = None, alias: str = "change") -> Column:
    """Relative change against the previous row."""
    w = W.partitionBy(*(by or [])).orderBy(order)
    return F.round(F.try_divide(F.col(value).cast("double") - F.lag(value).over(w), F.lag(value).over(w).cast("double")), 6).alias(alias)
