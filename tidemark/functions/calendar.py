"""The business calendar: Moscow days and Monday weeks over UTC time stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = "Europe/Moscow"


def local(ts: Column) -> Column:
    """A UTC time stamp without zone as Moscow wall time, whatever the session's zone is."""
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), ts.cast("timestamp_ntz"))


def day(ts: Column) -> Column:
    return local(ts).cast("date")


def week(ts: Column) -> Column:
    """The Monday of the Moscow week."""
    d = day(ts)
    return F.date_sub(d, F.weekday(d))


def monday(d: Column) -> Column:
    """The Monday of a date's week."""
    return F.date_sub(d, F.weekday(d))


def month(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "month")


def hours_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later) / 3600.0


def day_spine(days: DataFrame, column: str = "day") -> DataFrame:
    """Every day from the first to the last of a column, so that a missing day is a row and not an absence."""
    return days.agg(F.min(column).alias("a"), F.max(column).alias("z")).where("a is not null").select(F.explode(F.sequence("a", "z")).alias(column))


def compact(d: Column) -> Column:
    """YYMMDD, as identifiers carry it."""
    return F.date_format(d, "yyMMdd")


def season(d: Column) -> Column:
    return F.when(F.month(d).isin(6, 7, 8), "summer").otherwise("other")
