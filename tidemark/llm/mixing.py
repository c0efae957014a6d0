"""Mixing sources to target weights along a time-varying curriculum.

Each source's weight is a schedule over training time; its integral is the source's cumulative token
demand, and the inverse of that gives the training position at which a document is due. All of it is
DataFrame arithmetic: one shuffle by (source, hash bucket) and a range sort by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import scratch
from tidemark.llm.columns import quoted, spare

#: Documents in a bucket of the prefix sum; buckets of one source are of even size, as they are cut by a hash.
BUCKET_ROWS = 1_000


def words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(source, source_size, weight, rank, target) of (source, source_size).

    Sources by code point, null last, weigh `weights`, repeating; they share share[0]/share[1] of all sizes. A
    target stops at `most` times its source's size and the excess is shared anew by weight: all targets
    are min(most * size, level * weight), and the level follows from the order of size/weight. Windows
    run over one row per source, never over documents.
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("rank", F.row_number().over(ordered) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    by_ratio = W.orderBy((F.col("source_size") * 1.0 / F.col("weight")), "rank")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    rows = rows.withColumns({"capped": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "used": F.coalesce(F.sum("weight").over(before), F.lit(0)), "all_size": F.sum("source_size").over(whole), "all_weight": F.sum("weight").over(whole)})
    # The level if exactly the sources before this one are capped, as a fraction num/den.
    rows = rows.withColumns({"num": F.col("all_size") * share[0] - F.col("capped") * (most * share[1]), "den": (F.col("all_weight") - F.col("used")) * share[1]})
    fits = F.col("num") * F.col("weight") <= F.col("source_size") * most * F.col("den")
    level = F.min_by(F.struct("num", "den"), F.when(fits, F.struct(F.col("source_size") * 1.0 / F.col("weight"), F.col("rank")))).over(whole)
    rows = rows.withColumn("level", level)
    free = (F.col("level.num") * F.col("weight")).cast("double") / F.col("level.den").cast("double")
    cap = (F.col("source_size") * most).cast("double")
    return rows.select("source", "source_size", "weight", "rank", F.coalesce(F.least(cap, free), cap).alias("target"))


def schedule(rank: Column, sources: Column) -> Column:
    """Slope of a source's relative weight over training time t in [0, 1]: weight(t) = 1 + slope * (2t - 1).

    Early sources fall from 1.5 to 0.5, late ones rise from 0.5 to 1.5, those between in even steps.
    """
    return F.when(sources > 1, rank / (sources - 1) - 0.5).otherwise(F.lit(0.0))


def due(demand: Column, slope: Column) -> Column:
    """Training time at which the share `demand` of a source's tokens is due: the inverse of slope*t^2 + (1 - slope)*t, the integral of schedule()."""
    return F.when(F.abs(slope) < 1e-12, demand).otherwise(2 * demand / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * demand)))


def _repeated(docs: DataFrame) -> DataFrame | None:
    """(_word, _bits): marks in 2^24 bits, 2^18 rows at most, for doc_ids that several rows share. None where no two rows share one."""
    slot = F.pmod(F.xxhash64("_id"), F.lit(1 << 24))
    twice = docs.select(F.col("doc_id").cast("string").alias("_id")).where("_id is not null").groupBy("_id").count().where("count > 1").select(slot.alias("_slot"))
    bits, path = scratch.stored(twice.groupBy(F.floor(F.col("_slot") / 64).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, int(_slot % 64))")).alias("_bits")), "mix-repeats")
    if bits.isEmpty():
        scratch.drop(docs.sparkSession, path)
        return None
    return bits


def _keyed(rows: DataFrame, repeated: DataFrame | None, key: str) -> DataFrame:
    """rows plus what a source's documents stand in the order of: md5 of doc_id, and of doc_id and text where the id, or one with its mark, is repeated; without doc_id of the text."""
    text, id_ = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("string")
    own = F.coalesce(F.md5(id_), F.md5(text))  # a key for all rows without doc_id would be one bucket
    if repeated is None:
        return rows.withColumn(key, own)
    slot = F.pmod(F.xxhash64(id_), F.lit(1 << 24))
    told = rows.join(F.broadcast(repeated), F.floor(slot / 64) == F.col("_word"), "left")  # 2^18 rows at most
    marked = F.coalesce(F.col("_bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))) != 0, F.lit(False))
    return told.withColumn(key, F.when(marked, F.md5(F.concat(id_, F.lit(":"), text))).otherwise(own)).drop("_word", "_bits")


def placed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2, tie: str | None = None) -> DataFrame:
    """One row per document: its columns, size, source_size, target, taken and positions, in no order yet; and, if named, a column `tie` with a hash of what it is ordered by.

    A source's documents stand in the order of md5(doc_id), those without doc_id in that of md5(text), and those whose doc_id is repeated in that of md5(doc_id:text), so that many of them are
    many places; their words fill [0, source_size), and
    each further pass over the source follows on. A copy is taken while it begins before the target.
    The copy at offset x is due at the inverse demand of x / target. taken is size times the copies
    taken, so it is at most `most` times size, and a source's sum misses its target by less than a document.

    Edge cases: null text has size 0 and null source is a source of its own. Documents of size 0 are
    taken while their offset lies before the target, adding nothing. A document whose id shares its mark with a repeated one stands by its text as well. Rows that agree
    in doc_id and text stand together and are interchangeable. Input columns that carry a result's name are replaced; all others, of whatever name, come along.
    """
    own = ("size", "source_size", "target", "taken", "positions")
    docs = docs.drop(*own)
    largest = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    buckets = max(1, -(-largest // BUCKET_ROWS))
    repeated = _repeated(docs)
    bucket = F.floor(F.conv(F.substring(F.concat(F.col("_md5"), F.lit("0000000")), 1, 7), 16, 10).cast("long") * buckets / 268435456).cast("int")

    # Sums by source and bucket, made before the shuffle and written once: sources and the offsets of buckets both follow from them.
    sized = _keyed(docs.select("source", "doc_id", "text"), repeated, "_md5").select("source", "_md5", words(F.col("text").cast("string")).alias("size")).withColumn("_bucket", bucket)
    summed, _ = scratch.stored(sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum")), "mix-sums")
    sizes = summed.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    plan = targets(sizes, weights, share, most).withColumn("slope", schedule(F.col("rank"), F.count(F.lit(1)).over(W.partitionBy())))
    kept = _keyed(docs.select(*[F.col(quoted(c)).alias(f"_in_{c}") for c in docs.columns], "source", "doc_id", "text"), repeated, "_md5")
    kept = kept.withColumns({"size": words(F.col("text").cast("string")), "_bucket": bucket}).drop("text")
    heads = summed.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), (F.sum("_sum").over(W.partitionBy("source").orderBy("_bucket")) - F.col("_sum")).alias("_head"))
    rows = kept.join(heads, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    within = W.partitionBy("source", "_bucket").orderBy("_md5", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_at", F.sum("size").over(within) - F.col("size") + F.col("_head"))
    plan = plan.select(F.col("source").alias("_ps"), "source_size", "target", "slope")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_ps")))
    begins = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: p * F.col("source_size") + F.col("_at"))
    rows = rows.withColumn("_begins", F.filter(begins, lambda x: x < F.col("target")))
    rows = rows.withColumn("positions", F.transform("_begins", lambda x: due(x / F.col("target"), F.col("slope"))))
    out = rows.withColumn("taken", F.col("size") * F.size("_begins"))
    return out.select(*[F.col(quoted(f"_in_{c}")).alias(c) for c in docs.columns], *own, *([F.xxhash64("_md5").alias(tie)] if tie else []))


def mix(docs: DataFrame, **how) -> DataFrame:
    """placed(), range-sorted by first position; documents that are not taken come last."""
    first, tie = spare(docs, "_first", "_tie")
    rows = placed(docs, tie=tie, **how).withColumn(first, F.get("positions", F.lit(0)))
    order = F.col(first).asc_nulls_last(), F.col(tie).asc()  # by hash after that, or all that are not taken would share a task
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop(first, tie)


def training_order(docs: DataFrame, **how) -> DataFrame:
    """A row for each copy that the mix takes, with its `position`, range-sorted by it. Texts are shuffled twice: by bucket and by position."""
    rows = placed(docs.drop("position"), **how)
    copies = rows.select(*[quoted(c) for c in rows.columns if c != "positions"], F.explode("positions").alias("position"))
    return copies.repartitionByRange("position").sortWithinPartitions("position")
