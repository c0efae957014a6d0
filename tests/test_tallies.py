"""Actives and percentiles from daily marts, where there are more accounts and values than a sketch holds exactly."""

import os

import duckdb
import pytest
from conftest import SF, held_against
from pyspark.sql import functions as F

from tidemark.operators import tallies
from tidemark.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Two weeks of events of 100,000 accounts with as many values; some without an account, a value or a product, and a kind of event without any value."""
    path = tmp_path_factory.mktemp("many")
    i = F.col("id")
    h = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))
    kind = F.get(F.array(*map(F.lit, ("purchase", "purchase", "view", "click", "silent"))), h(1, 5).cast("int"))
    value = F.when((kind != "silent") & (h(2, 50) > 0), F.when(h(3, 4) == 0, F.lit(7.5)).otherwise(F.round(F.exp(h(4, 100_000) / 20_000), 4)))
    ts = (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=h(5, 14 * 86400))).cast("timestamp_ntz")
    props = F.when(h(6, 100) > 0, F.concat(F.lit('{"k": '), h(7, 30), F.lit("}"))).otherwise("{}")
    events = spark.range(400_000).select(i.alias("event_id"), ts.alias("ts"), F.when(h(8, 400) > 0, h(9, 100_000)).alias("user_id"), kind.alias("event_type"), value.alias("value"), props.alias("props"))
    events.write.parquet(str(path / "events.parquet"))
    os.symlink(f"{SF}/customer.parquet", path / "customer.parquet")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/events.parquet/*.parquet')")
    return str(path), c


@pytest.mark.parametrize("name", ["cross_product_actives", "mau_sketch", "wau_sketch", "p95_sketch", "p95_against_norm"])
def test_exact_beyond_what_a_sketch_holds(spark, many, name):
    held_against(many[1], ORACLES[name], QUERIES[name](spark, many[0]))


@pytest.mark.parametrize("stretches", [1, 2, 64])
def test_where_stretches_are_cut_changes_no_quantile(spark, stretches):
    """Sketches of other values put the cuts in bad places."""
    days = spark.range(3000).select(F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("id") % 3).cast("int")).alias("part"), F.lit("view").alias("event"), (F.col("id") * F.col("id")).cast("double").alias("value"), F.lit(2).cast("long").alias("n"))
    drawn = spark.range(10).select(F.lit("view").alias("event"), F.col("id").cast("double").alias("value")).groupBy("event").agg(F.kll_sketch_agg_double("value").alias("sketch"))
    for q, at in ((0.5, 499), (0.95, 949), (0.0, 0), (1.0, 999)):
        got = {r["period"].day - 1: (r["n"], r["x"]) for r in tallies.quantile(days, drawn, F.array("part"), q, "x", stretches).collect()}
        assert got == {d: (2000, float((3 * at + d) ** 2)) for d in range(3)}
