"""The engine's concepts bound to the tables at hand.

The tables hold no devices, sessions or subscriptions of their own; each binding says what stands in. Readers name only the
columns they use, so scans stay narrow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendar

MEANINGFUL = ("purchase",)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task that reads texts or counts what stood in them, so that neither its time nor what it holds grows with the table; many enough that starting it, some seconds for the rules, weighs little.
A_TASK = 100_000


def tasks(rows: DataFrame, most: int = A_TASK) -> int:
    """How many tasks of at most about `most` rows there are in rows, and one for each core at least. Parquet knows its number of rows without a scan."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))


def spread(rows: DataFrame, most: int = A_TASK) -> DataFrame:
    """rows in partitions of about `most` rows, as a file of few bytes may have many: for work that takes long a row and shuffles nothing."""
    parts = tasks(rows, most)
    return rows if rows.rdd.getNumPartitions() >= parts else rows.repartition(parts)


RAW_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files. A pattern, as a table may be one file, which a stream does not take by its plain name."""
    return spark.readStream.schema(RAW_EVENTS).parquet(f"{sf_dir}/events.parque[t]")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(read(spark, sf_dir, "events"))


def shaped(raw: DataFrame) -> DataFrame:
    """event_id, account_id, event, ts, value, k, product, day, week. Product is k mod 3; day and week are Moscow's."""
    k = F.get_json_object("props", "$.k").cast("int")
    return raw.select("event_id", F.col("user_id").alias("account_id"), F.col("event_type").alias("event"), "ts", "value", k.alias("k"), (k % 3).alias("product"), calendar.day(F.col("ts")).alias("day"), calendar.week(F.col("ts")).alias("week"))


def of(events_: DataFrame, *names: str) -> DataFrame:
    return events_.where(F.col("event").isin(*names))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meaningful actions: opening something is none."""
    return of(events(spark, sf_dir), *MEANINGFUL)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_id, entered: the first registration, once per account, fixed."""
    return of(events(spark, sf_dir), "signup").groupBy("account_id").agg(F.min("ts").alias("entered"))


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer, month, price, annual, ok, ts, segment of each order; an order of the most urgent priority stands for an annual plan."""
    orders = read(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").alias("customer"), calendar.month(F.col("o_orderdate")).alias("month"), F.col("o_totalprice").alias("price"), (F.col("o_orderpriority") == "1-URGENT").alias("annual"), (F.col("o_orderstatus") == "F").alias("ok"), F.col("o_orderdate").alias("ts"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer, month, amount: recurring revenue in cents, an annual price as a twelfth. Whole cents make sums the same in any order."""
    cents = F.round(F.when(F.col("annual"), F.col("price") / 12).otherwise(F.col("price")) * 100).cast("long")
    return charges(spark, sf_dir).groupBy("customer", "month").agg(F.sum(cents).alias("amount"))
