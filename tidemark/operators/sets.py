"""Set operations, precedence of sources, ranking under a capacity, and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Sources in order of trust.
SOURCES = ("billing", "server", "store", "web", "manual")
# How long each kind of row is kept, in days; board logs are kept by number instead.
KEEP_DAYS = {"events": 180, "gauges": 90, "inbox": 60, "signals": 90, "day_log": 14, "orders": 30}
KEEP_MEETINGS = 8


def missing(client: DataFrame, central: DataFrame) -> DataFrame:
    """Rows that a client declares and the centre does not; empty means the centre is a superset."""
    return client.exceptAll(central).distinct()


def drift(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, and on which."""
    return left.subtract(right).withColumn("side", F.lit("left_only")).unionByName(right.subtract(left).withColumn("side", F.lit("right_only")))


def precedence(rows: DataFrame, key: str, tolerance: float = 0.1) -> DataFrame:
    """(key, source, value, gap, conflict): the most trusted source's value; a difference of more than tolerance to any other is recorded."""
    rank = F.coalesce(*[F.when(F.col("source") == s, F.lit(i)) for i, s in enumerate(SOURCES)], F.lit(len(SOURCES)))
    best = rows.withColumn("_r", rank).groupBy(key).agg(F.min(F.struct("_r", "source", "value")).alias("b"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    gap = F.try_divide(F.greatest(F.abs(F.col("hi") - F.col("b.value")), F.abs(F.col("b.value") - F.col("lo"))).cast("double"), F.abs(F.col("b.value")))
    return best.select(key, F.col("b.source").alias("source"), F.col("b.value").alias("value"), F.round(gap, 6).alias("gap"), F.coalesce(gap > tolerance, F.lit(False)).alias("conflict"))


def merged(*parts: DataFrame, by: list[str]) -> DataFrame:
    """Several lists as one, without what is in more than one of them."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(by)


def numbered(rows: DataFrame, by: list[str], order: str, alias: str, blocks: int = 256) -> DataFrame:
    """rows plus their number, from 1, within each group of `by`, in the order of a column of numbers, times or strings.

    A group is cut at quantiles of the order, so that one which holds all rows is numbered by many tasks: within a block, on top of the sizes of the blocks before it.
    """
    kind = rows.schema[order].dataType.typeName()
    first_bytes = F.conv(F.substring(F.rpad(F.hex(F.col(order).cast("binary")), 12, "0"), 1, 12), 16, 10)  # strings stand in the order of their bytes
    at = F.unix_micros(F.col(order).cast("timestamp")) if kind.startswith("timestamp") else first_bytes if kind == "string" else F.col(order)
    cuts = rows.agg(F.percentile_approx(at.cast("double"), [i / blocks for i in range(1, blocks)], 10_000)).first()[0] or []  # a fixed number of numbers
    below = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c < at.cast("double"))) if cuts else F.lit(0)
    rows = rows.withColumn("_cut", F.coalesce(below, F.lit(-1)))
    sizes = rows.groupBy(*by, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    heads = sizes.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_cut").alias("_c"), (F.sum("_n").over(W.partitionBy(*by).orderBy("_cut")) - F.col("_n")).alias("_first"))
    same = F.col("_cut") == F.col("_c")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    within = F.row_number().over(W.partitionBy(*by, "_cut").orderBy(order))
    return rows.withColumn("_within", within).join(heads, same).withColumn(alias, F.col("_first") + F.col("_within")).drop("_cut", "_within", "_c", "_first", *[f"_by{i}" for i in range(len(by))])


def scored(rows: DataFrame, jump: Column | None = None, blocks: int = 256) -> DataFrame:
    """rows plus score = impact * confidence / effort and place; what jumps the queue comes first whatever its score.

    Items are numbered within their (jump, score) group, by many tasks where it is large. Where a group begins follows from the sizes of the groups before it in its block, a
    stretch of scores between two of their quantiles, and from the sizes of the blocks before; only the blocks are summed in one task.
    """
    score = F.round(F.try_divide(F.col("impact") * F.col("confidence"), F.col("effort").cast("double")), 6)
    first = F.coalesce(jump, F.lit(False)) if jump is not None else F.lit(False)
    rows = rows.withColumn("score", score).withColumn("_jump", first)
    cuts = rows.agg(F.percentile_approx("score", [i / blocks for i in range(1, blocks)], 10_000)).first()[0] or []
    above = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c > F.col("score"))) if cuts else F.lit(0)
    block = F.when(F.col("_jump"), 0).otherwise(blocks + 1) + F.when(F.col("score").isNull(), blocks).otherwise(above)  # a missing score comes last
    groups = rows.groupBy("_jump", "score").agg(F.count(F.lit(1)).alias("_n")).withColumn("_block", block)
    sums = groups.groupBy("_block").agg(F.sum("_n").alias("_of"))
    heads = sums.select("_block", (F.sum("_of").over(W.orderBy("_block")) - F.col("_of")).alias("_before"))
    within = W.partitionBy("_block").orderBy(F.col("_jump").desc(), F.col("score").desc_nulls_last())
    heads = groups.withColumn("_upto", F.sum("_n").over(within) - F.col("_n")).join(heads, "_block").select(F.col("_jump").alias("_j"), F.col("score").alias("_s"), (F.col("_before") + F.col("_upto")).alias("_head"))
    joined = numbered(rows, ["_jump", "score"], "item", "_place").join(heads, (F.col("_jump") == F.col("_j")) & F.col("score").eqNullSafe(F.col("_s")))
    return joined.withColumn("place", F.col("_head") + F.col("_place")).drop("_jump", "_j", "_s", "_head", "_place")


def capacity_cut(ranked: DataFrame, capacity: float, block: int = 10_000) -> DataFrame:
    """ranked plus load (running effort by place) and taken; the rest is displaced. Sums run within blocks of places, on top of the blocks before."""
    rows = ranked.withColumn("_block", F.floor(F.col("place") / block))
    sums = rows.groupBy("_block").agg(F.sum("effort").alias("_n"))
    heads = sums.select(F.col("_block").alias("_b"), (F.sum("_n").over(W.orderBy("_block")) - F.col("_n")).alias("_head"))
    load = F.col("_head") + F.sum("effort").over(W.partitionBy("_block").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    return rows.join(heads, F.col("_block") == F.col("_b")).withColumn("load", load).withColumn("taken", F.col("load") <= capacity).drop("_block", "_b", "_head")


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def newest(rows: DataFrame, by: str, name: str, alias: str) -> DataFrame:
    """The last name of each group in the order of text: the newest version where names carry it."""
    return rows.groupBy(by).agg(F.max(name).alias(alias))


def kept(rows: DataFrame, kind: str, day: str, today: Column) -> DataFrame:
    """Rows within the time that their kind is kept; on a day-partitioned table the filter prunes partitions."""
    return rows.where(F.col(day) >= F.date_sub(today, KEEP_DAYS[kind]))


def last_meetings(rows: DataFrame, order: str, n: int = KEEP_MEETINGS) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.orderBy(F.col(order).desc()))).where(F.col("_n") <= n).drop("_n")


def daily_lead(scores: DataFrame, day: str, product: str, score: str, core, most: int = 2) -> DataFrame:
    """(day, product, by_tie): the product with the best score of a day; of equal ones the core product, though not by a tie on more than `most` days in a row, and then the least of the others.

    Whether a tie may go to the core depends on how the ties of the days before went, so days are folded in order: one row for each day, whatever the tasks behind it.
    A day on which the core does not lead by a tie ends the run.
    """
    best = scores.groupBy(day).agg(F.max(F.struct(F.col(score).alias("s"))).alias("m"), F.collect_list(F.struct(F.col(score).alias("s"), F.col(product).alias("p"))).alias("all"))
    top = F.array_sort(F.transform(F.filter("all", lambda x: x["s"] == F.col("m.s")), lambda x: x["p"]))
    days = best.select(F.col(day).alias("d"), top.alias("top")).where(F.size("top") > 0)
    tied = lambda x: (F.size(x["top"]) > 1) & F.array_contains(x["top"], core)
    ordered = days.agg(F.array_sort(F.collect_list(F.struct("d", "top"))).alias("days"))
    kind = days.schema["top"].dataType.elementType.simpleString()
    start = F.expr(f"named_struct('run', 0, 'out', cast(array() as array<struct<d: {days.schema['d'].dataType.simpleString()}, p: {kind}, t: boolean>>))")

    def step(state: Column, x: Column) -> Column:
        takes = tied(x) & (state["run"] < most)
        other = F.get(F.filter(x["top"], lambda p: ~tied(x) | (p != core)), F.lit(0))
        row = F.struct(x["d"].alias("d"), F.when(takes, F.lit(core).cast(kind)).otherwise(other).alias("p"), takes.alias("t"))
        return F.struct(F.when(takes, state["run"] + 1).otherwise(0).alias("run"), F.concat(state["out"], F.array(row)).alias("out"))

    return ordered.select(F.explode(F.aggregate("days", start, step)["out"]).alias("r")).select(F.col("r.d").alias(day), F.col("r.p").alias(product), F.col("r.t").alias("by_tie"))
