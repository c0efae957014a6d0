"""One key on all rows: no task holds more than a share of them, and the result is what one task would make."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest, intervals, orders, sets

N = 20_000
T0 = dt.datetime(2024, 1, 1)


def minutes(spark):
    return spark.range(N).select("id", (F.lit(T0) + F.make_dt_interval(mins=F.col("id") * 7)).cast("timestamp_ntz").alias("ts"))


def scored(spark):
    rows = spark.range(N).select(F.col("id").alias("item"), F.lit(3).alias("impact"), F.lit(2).alias("confidence"), F.lit(1).alias("effort"))
    return sets.scored(rows), lambda r: r["place"] == r["item"] + 1


def numbered_orders(spark):
    rows = minutes(spark).select(F.col("id").alias("update_id"))
    none = spark.createDataFrame([("O-240101-07",)], "order_id string")
    return orders.next_ids(rows, none, F.to_date(F.lit("2024-01-01")), "update_id"), lambda r: r["order_id"] == f"O-240101-{r['update_id'] + 8:02d}"


def consented(spark):
    rows = minutes(spark).select(F.col("id").alias("event_id"), "ts", F.lit("a").alias("account_id"), F.lit("d").alias("device_id"))
    consent = spark.createDataFrame([("account", "a", False, T0), ("account", "a", True, T0 + dt.timedelta(minutes=7 * 100))], "kind string, id string, granted boolean, ts timestamp_ntz")
    return ingest.consented(rows, consent), lambda r: (r["device_id"] == "d") == (r["event_id"] >= 100)


def as_of(spark):
    rows = minutes(spark).withColumn("key", F.lit("k"))
    return intervals.last_before(rows, rows, "key", "id", "id", alias="before"), lambda r: r["before"] == (r["id"] - 1 if r["id"] else None)


@pytest.mark.parametrize("case", [scored, numbered_orders, consented, as_of])
def test_one_key_is_many_tasks(spark, case):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        result, right = case(spark)
        rows = result.withColumn("_task", F.spark_partition_id()).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(rows) == N and all(map(right, rows))
    sizes = {}
    for r in rows:
        sizes[r["_task"]] = sizes.get(r["_task"], 0) + 1
    assert max(sizes.values()) < N / 2 and len(sizes) >= 6


def test_numbers_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([("a", 1.5), ("a", None), ("a", 1.5), (None, 2.0), (None, 1.0), ("b", 9.0)], "g string, x double")
    got = sets.numbered(rows, ["g"], "x", "n", 4).collect()
    assert sorted(((r["g"] or "", r["x"] is not None, r["x"] or 0, r["n"]) for r in got)) == [("", True, 1.0, 1), ("", True, 2.0, 2), ("a", False, 0, 1), ("a", True, 1.5, 2), ("a", True, 1.5, 3), ("b", True, 9.0, 1)]


def test_numbers_along_strings(spark):
    rows = spark.createDataFrame([(x,) for x in ("b", "a", "", "abcdefgh2", "abcdefgh1", "é", "Z", "日本", "a")], "x string").withColumn("g", F.lit(1))
    got = {r["n"]: r["x"] for r in sets.numbered(rows, ["g"], "x", "n", 5).collect()}
    assert [got[i] for i in range(1, 10)] == sorted(("b", "a", "", "abcdefgh2", "abcdefgh1", "é", "Z", "日本", "a"))
