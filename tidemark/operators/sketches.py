"""Summaries of days that merge: theta sketches of accounts, KLL sketches of values.

A day's sketch has a bounded size whatever the day weighs, so weeks, trailing months and norms come from marts of sketches and no event is read
again. A theta sketch is exact up to 2^LG_ENTRIES accounts and errs by about 1/sqrt(2^LG_ENTRIES) beyond; unions keep that, an intersection errs in proportion to the
union it is cut from. A KLL sketch holds all values up to KLL_K of them and errs in rank by about 2.3 / KLL_K^0.9 beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import calendar

LG_ENTRIES, KLL_K = 14, 2048
ACTIVES = "part date, product int, sketch binary"
LATENCIES = "part date, event string, sketch binary"


def actives(facts: DataFrame, lg: int = LG_ENTRIES) -> DataFrame:
    """A day's active accounts by product. Rows without an account are in none."""
    return facts.where((F.col("event") == "purchase") & F.col("account_id").isNotNull()).groupBy("part", "product").agg(F.theta_sketch_agg("account_id", lg).alias("sketch"))


def latencies(facts: DataFrame, k: int = KLL_K) -> DataFrame:
    """A day's values by kind of event. Rows without a value are in none."""
    return facts.where("value is not null").groupBy("part", "event").agg(F.kll_sketch_agg_double("value", k).alias("sketch"))


def estimate(sketch: Column) -> Column:
    return F.theta_sketch_estimate(sketch).cast("long")


def with_total(days: DataFrame, period: Column, alias: str, lg: int = LG_ENTRIES) -> DataFrame:
    """(period, product, is_total, n): accounts by product and over all products. Union, not sums: a person counts once."""
    parts = days.groupBy(period.alias("period"), "product").agg(F.theta_union_agg("sketch", lg).alias("sketch"))
    whole = parts.groupBy("period").agg(F.theta_union_agg("sketch", lg).alias("sketch")).select("period", F.lit(None).cast("int").alias("product"), F.lit(1).alias("is_total"), "sketch")
    return parts.select("period", "product", F.lit(0).alias("is_total"), "sketch").unionByName(whole).select("period", "product", "is_total", estimate(F.col("sketch")).alias(alias))


def trailing(days: DataFrame, length: int, alias: str, lg: int = LG_ENTRIES) -> DataFrame:
    """(part, n): accounts of the `length` days up to each day that has data.

    A union may count a day twice without harm, so spans of 2, 4, 8 ... days are made of two halves, and two overlapping spans of the largest power of two make
    up the length: for 30 days five unions a day and not thirty.
    """
    own = days.groupBy("part").agg(F.theta_union_agg("sketch", lg).alias("own"))
    rows = calendar.day_spine(own, "part").join(own, "part", "left").withColumn("span", F.col("own"))
    at = F.unix_date("part")

    def with_earlier(rows: DataFrame, by: int) -> DataFrame:
        earlier = F.first("span").over(W.orderBy(at).rangeBetween(-by, -by))  # a row for each day
        return rows.withColumn("earlier", earlier).withColumn("span", F.coalesce(F.theta_union("span", "earlier", lg), "span", "earlier")).drop("earlier")

    size = 1
    while size * 2 <= length:
        rows, size = with_earlier(rows, size), size * 2
    if size < length:
        rows = with_earlier(rows, length - size)
    return rows.where("own is not null").select("part", estimate(F.col("span")).alias(alias))


def shared(days: DataFrame, period: Column, lg: int = LG_ENTRIES) -> DataFrame:
    """(period, a, b, both, only_a): accounts active in two products, and in the first alone, for each pair a < b of the few products."""
    parts = days.groupBy(period.alias("period"), "product").agg(F.theta_union_agg("sketch", lg).alias("sketch"))
    left, right = parts.withColumnsRenamed({"product": "a", "sketch": "sa"}), parts.withColumnsRenamed({"product": "b", "sketch": "sb", "period": "_period"})
    pairs = left.join(right, (F.col("period") == F.col("_period")) & (F.col("a") < F.col("b")))
    return pairs.select("period", "a", "b", estimate(F.theta_intersection("sa", "sb")).alias("both"), estimate(F.theta_difference("sa", "sb")).alias("only_a"))


def quantile(days: DataFrame, period: Column, q: float, alias: str, *by: str, k: int = KLL_K) -> DataFrame:
    """(period, by..., n, quantile) from the merged sketches of a period's days."""
    merged = days.groupBy(period.alias("period"), *by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))
    return merged.select("period", *by, F.kll_sketch_get_n_double("sketch").alias("n"), F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(alias))


def against_norm(days: DataFrame, q: float, length: int, alias: str, k: int = KLL_K) -> DataFrame:
    """(part, quantile, norm, ratio): a day's quantile against that of all values of the `length` days before it; null before there are any."""
    own = days.groupBy("part").agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))
    ahead = own.select(F.explode(F.sequence(F.date_add("part", 1), F.date_add("part", length))).alias("_part"), "sketch").groupBy("_part").agg(F.kll_merge_agg_double("sketch", k).alias("before"))
    of = lambda s: F.kll_sketch_get_quantile_double(s, F.lit(q))
    rows = own.join(ahead, F.col("part") == F.col("_part"), "left").select("part", of(F.col("sketch")).alias(alias), F.when(F.col("before").isNotNull(), of(F.col("before"))).alias("norm"))
    return rows.withColumn("ratio", F.round(F.try_divide(alias, "norm"), 6))
