"""Windows over a metric's own time series: changes, streaks, norms, silence.

A series has a row per period, so these windows are small whatever the events behind them weigh; series with several parts are
partitioned by part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.operators.activity import share


def over(order: str, by: list[str] | None = None):
    return W.partitionBy(*(by or [])).orderBy(order)


def streak(flag: Column, length: int, order: str, by: list[str] | None = None) -> Column:
    """The flag holds for this row and the length - 1 before it; false while there are fewer rows."""
    frame = over(order, by).rowsBetween(-(length - 1), 0)
    return (F.count(F.lit(1)).over(frame) == length) & (F.min(F.coalesce(flag, F.lit(False)).cast("int")).over(frame) == 1)


def norm_ratio(value: str, order: str, rows: int = 7, by: list[str] | None = None) -> Column:
    """value against the mean of the `rows` rows before it."""
    return F.round(F.try_divide(F.col(value).cast("double"), F.avg(value).over(over(order, by).rowsBetween(-rows, -1))), 6)


def sparkline(value: str, order: str, rows: int = 12, by: list[str] | None = None) -> Column:
    return F.collect_list(value).over(over(order, by).rowsBetween(-(rows - 1), 0))


def contradiction(value: str, order: str, by: list[str] | None = None, factor: float = 2.0) -> Column:
    """The value differs from the one before by more than `factor` either way."""
    before = F.lag(value).over(over(order, by)).cast("double")
    now = F.col(value).cast("double")
    return F.greatest(F.try_divide(now, before), F.try_divide(before, now)) > factor


def silence(days: DataFrame, on: str = "day") -> DataFrame:
    """(day, last_seen, silent_days) on an unbroken spine of days."""
    spine = calendar.day_spine(days, on)
    marked = spine.join(days.select(F.col(on).alias("_d")).distinct(), F.col(on) == F.col("_d"), "left")
    last = F.max("_d").over(W.orderBy(on).rowsBetween(W.unboundedPreceding, 0))
    return marked.select(on, last.alias("last_seen"), F.date_diff(F.col(on), last).alias("silent_days"))


def islands(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, start, length) of runs of consecutive days."""
    w = W.partitionBy(key).orderBy(order)
    once = rows.select(key, order).distinct()
    return once.withColumn("_g", F.date_sub(order, F.row_number().over(w))).groupBy(key, "_g").agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("length")).drop("_g")


def forecast(rows: DataFrame, x: str, y: str, limit: float) -> DataFrame:
    """(growth, latest, periods_to_full): a straight line through the series; null where it does not grow."""
    fit = rows.agg(F.regr_slope(y, x).alias("growth"), F.max_by(y, x).alias("latest"))
    left = F.when(F.col("growth") > 0, (limit - F.col("latest")) / F.col("growth"))
    return fit.select(F.round("growth", 4).alias("growth"), F.round("latest", 4).alias("latest"), F.round(left, 2).alias("periods_to_full"))


def rate(flag: Column) -> Column:
    return share(F.count_if(flag), F.count(F.lit(1)))
