"""Exact summaries of days that merge: a day's accounts, each once by product, and its values, each with the number of its rows.

They grow with what a day holds, where sketches do not, and what is read from them is exact whatever that is. Sketches only say where to cut: a quantile is looked for in
the one stretch of values that holds its rank, so no task sorts a whole group.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import sketches

#: Stretches that the values of a kind of event are cut into.
STRETCHES = 64
ACCOUNTS = "part date, product int, account_id long"
VALUES = "part date, event string, value double, n long"


def accounts(facts: DataFrame) -> DataFrame:
    """A day's active accounts by product, each once."""
    return facts.where("event = 'purchase'").select("part", "product", "account_id").distinct()


def values(facts: DataFrame) -> DataFrame:
    """A day's values by kind of event with the number of rows that have them; rows without a value are counted under null."""
    return facts.groupBy("part", "event", "value").agg(F.count(F.lit(1)).alias("n"))


def shared(days: DataFrame, period: Column) -> DataFrame:
    """(period, a, b, both, only_a): accounts active in two products, and in the first alone, for each pair a < b of the few products. Rows without an account are one that is in no other product."""
    once = days.select(period.alias("period"), "product", "account_id").distinct()
    sizes = once.groupBy("period", "product").agg(F.count(F.lit(1)).alias("n"))
    left, right = sizes.withColumnsRenamed({"product": "a", "n": "na"}), sizes.select(F.col("period").alias("_period"), F.col("product").alias("b"))
    pairs = left.join(right, (F.col("period") == F.col("_period")) & (F.col("a") < F.col("b")))  # a row for each period and pair of products
    own = once.where("account_id is not null and product is not null").groupBy("period", "account_id").agg(F.collect_set("product").alias("of"))
    of_one = own.select("period", F.explode("of").alias("a"), "of").select("period", "a", F.explode(F.filter("of", lambda b: F.col("a") < b)).alias("b"))
    both = of_one.groupBy(F.col("period").alias("_p"), F.col("a").alias("_a"), F.col("b").alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    rows = pairs.join(both, (F.col("period") == F.col("_p")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("period", "a", "b", n.cast("long").alias("both"), (F.col("na") - n).alias("only_a"))


def _placed(days: DataFrame, drawn: DataFrame, stretches: int) -> DataFrame:
    """days plus the stretch of its event's values that a value lies in; null without a value. Cuts come from the event's sketches: where they lie changes no result."""
    merged = drawn.groupBy(F.col("event").alias("_event")).agg(F.kll_merge_agg_double("sketch", sketches.KLL_K).alias("s"))
    at = F.kll_sketch_get_quantile_double("s", F.array(*[F.lit(i / stretches) for i in range(1, stretches)]))
    cuts = merged.select("_event", F.when(F.kll_sketch_get_n_double("s") > 0, F.array_distinct(at)).alias("_cuts"))  # a row for each kind of event
    below = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("value"))), F.lit(0))
    rows = days.join(F.broadcast(cuts), F.col("event").eqNullSafe(F.col("_event")), "left")
    return rows.withColumn("stretch", F.when(F.col("value").isNotNull(), below)).drop("_event", "_cuts")


def quantile(days: DataFrame, drawn: DataFrame, periods: Column, q: float, alias: str, stretches: int = STRETCHES) -> DataFrame:
    """(period, event, n, quantile): the value at the rank of q among the rows of the days that count for a period; null where none has a value.

    days: tallies of values; drawn: sketches of the same; periods: an array of the periods that a day's rows count for. What a stretch holds is counted day by day, so that the
    stretch of a period's rank is found among few numbers; only its values are then put in order.
    """
    placed = _placed(days, drawn, stretches)
    counts = placed.groupBy("part", "event", "stretch").agg(F.sum("n").alias("n")).select(F.explode(periods).alias("period"), "event", "stretch", F.when(F.col("stretch").isNotNull(), F.col("n")).otherwise(0).alias("n"))
    counts = counts.groupBy("period", "event", "stretch").agg(F.sum("n").alias("n"))
    group = W.partitionBy("period", "event")  # a row for each stretch
    counts = counts.withColumns({"upto": F.sum("n").over(group.orderBy("stretch")), "total": F.sum("n").over(group)})
    rank = F.greatest(F.lit(1).cast("long"), F.col("total") - F.floor(F.col("total") * F.lit(1 - Decimal(str(q)))).cast("long"))  # decimals, so that no rank is off by rounding
    hit = F.col("stretch").isNotNull() & (rank <= F.col("upto")) & (rank > F.col("upto") - F.col("n"))
    groups = counts.groupBy("period", "event").agg(F.sum("n").alias("n"), F.min(F.when(hit, F.struct("stretch", (rank - F.col("upto") + F.col("n")).alias("rest")))).alias("at"))
    wanted = groups.where("at is not null").select(F.col("period").alias("_p"), F.col("event").alias("_e"), F.col("at.stretch").alias("_s"), F.col("at.rest").alias("_rest"))  # a row for each group
    inside = F.col("event").eqNullSafe(F.col("_e")) & (F.col("stretch") == F.col("_s")) & F.array_contains("_of", F.col("_p"))
    near = placed.withColumn("_of", periods).join(F.broadcast(wanted), inside).groupBy("_p", "_e", "_rest", "value").agg(F.sum("n").alias("_n"))
    near = near.withColumn("_upto", F.sum("_n").over(W.partitionBy("_p", "_e").orderBy("value")))  # the values of one stretch
    found = near.where("_upto >= _rest and _upto - _n < _rest").select("_p", "_e", F.col("value").alias(alias))
    return groups.join(found, (F.col("period") == F.col("_p")) & F.col("event").eqNullSafe(F.col("_e")), "left").select("period", "event", "n", alias)


def against_norm(days: DataFrame, drawn: DataFrame, q: float, length: int, alias: str, stretches: int = STRETCHES) -> DataFrame:
    """(part, quantile, norm, ratio) of one kind of event: a day's quantile against that of all values of the `length` days before it; null before there are any."""
    own = quantile(days, drawn, F.array("part"), q, alias, stretches).select(F.col("period").alias("part"), alias)
    ahead = quantile(days, drawn, F.sequence(F.date_add("part", 1), F.date_add("part", length)), q, "norm", stretches).select(F.col("period").alias("_part"), "norm")
    rows = own.join(ahead, F.col("part") == F.col("_part"), "left").select("part", alias, "norm")
    return rows.withColumn("ratio", F.round(F.try_divide(alias, "norm"), 6))
