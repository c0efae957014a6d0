"""Snapshots and the daily build: late rows rebuild what they touch and nothing else, and the result is that of a full build."""

import datetime as dt
import random
import uuid

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.operators import activity, alerts, sketches
from tidemark.plans import QUERIES
from tidemark.sources import build
from tidemark.sources.snapshots import Conflict, SnapshotTable

from conftest import SF  # isort: skip

EVENT = "event_id long, account_id long, event string, ts timestamp_ntz, value double, k int, product int"
CHARGE = "customer long, price double, annual boolean, ok boolean, ts timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def some_events(rng, first, n, days=(0, 60)):
    kinds = ["signup", "click", "view", "purchase", "purchase", "error"]
    return [(first + i, rng.randrange(12), rng.choice(kinds), T0 + dt.timedelta(days=rng.uniform(*days)), rng.random(), rng.choice([0, 30, 60, 90, 96, 99]), rng.randrange(3)) for i in range(n)]


def some_charges(rng, n, days=(0, 300)):
    return [(rng.randrange(8), float(rng.randrange(100, 2000)), rng.random() < 0.2, rng.random() < 0.8, T0 + dt.timedelta(days=rng.uniform(*days))) for _ in range(n)]


def facts(spark, events=None, charges=None, returns=None):
    out = {}
    if events is not None:
        out["events"] = spark.createDataFrame(events, EVENT).withColumn("part", calendar.day(F.col("ts")))
    if charges is not None:
        out["charges"] = spark.createDataFrame(charges, CHARGE).withColumn("part", calendar.month(F.col("ts")))
    if returns is not None:
        out["returns"] = spark.createDataFrame([(t,) for t in returns], "shipped timestamp_ntz").withColumn("part", calendar.month(F.col("shipped")))
    return out


def new_build(spark, tmp_path):
    return build.DailyBuild(spark, str(tmp_path / uuid.uuid4().hex), spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "customer long, segment string"))


def fed(made, batch, **of):
    for name, df in facts(made.spark, **of).items():
        made.add(name, df, batch)
    return made.refresh()


def state(made):
    """Rows of all tables; of sketches, as their bytes may differ, what they say."""
    said = {"actives": lambda df: df.select("part", "product", F.theta_sketch_estimate("sketch").alias("n")), "latencies": lambda df: df.select("part", "event", F.kll_sketch_get_n_double("sketch").alias("n"), F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("q"))}
    return {name: rows(said.get(name, lambda df: df)(made.read(name))) for name in made.tables}


def test_late_rows_rebuild_what_they_touch_and_equal_a_full_build(spark, tmp_path, monkeypatch):
    rng = random.Random(71)
    events, charges = some_events(rng, 0, 600), some_charges(rng, 120)
    returns = [T0 + dt.timedelta(days=rng.uniform(0, 100)) for _ in range(30)]
    made = new_build(spark, tmp_path)
    fed(made, 1, events=events, charges=charges, returns=returns)
    first = {name: t.manifest()["folders"] for name, t in made.tables.items()}

    day = T0 + dt.timedelta(days=30, hours=5)
    late = [(9001, 3, "click", day, 0.5, 30, 0), (9002, 4, "error", day + dt.timedelta(hours=1), 0.5, 60, 1), (9003, 50, "signup", day, 0.1, 96, 2), next(e for e in events if e[3].date() == dt.date(2024, 1, 30))]  # one comes again
    read = []
    whole = SnapshotTable.read
    monkeypatch.setattr(SnapshotTable, "read", lambda self, keys=None, manifest=None: read.append((self.path.rsplit("/", 1)[1], whole(self, keys, manifest))) or read[-1][1])
    done = fed(made, 2, events=late)
    monkeypatch.undo()
    assert done["activity"] == done["tickets"] == {"2024-01-31"}
    assert done["days"] == {f"2024-01-{d}" for d in (28, 29, 30, 31)} | {"2024-02-01"} and done["revenue"] == done["months"] == done["returned"] == set()
    assert done["entries"] == {"2024-01-31"} and min(done["cohorts"]) == "2024-01-17" and max(done["cohorts"]) == "2024-01-31"
    for name, df in read:  # only files of parts within reach
        parts = {f.split("/part=")[1].split("/")[0] for f in df.inputFiles()}
        if name == "events":
            assert parts and min(parts) >= "2024-01-17" and max(parts) <= "2024-02-14", name
    for name in ("activity", "days", "cohorts", "releases"):
        now = made.tables[name].manifest()["folders"]
        assert {p for p in now if now[p] != first[name].get(p)} <= done[name], name

    moved = [(9100, 5, "signup", T0 - dt.timedelta(days=3), 0.5, 1, 0)]  # an entry earlier than what is known moves the account
    old = [r for r in some_charges(rng, 3, (10, 12))] + [(7, 5.0, False, True, T0 - dt.timedelta(days=40))]
    fed(made, 3, events=moved, charges=old)
    full = new_build(spark, tmp_path)
    fed(full, 1, events=events + late[:3] + moved, charges=charges + old, returns=returns)
    assert state(made) == state(full)
    assert all(not parts for parts in made.refresh().values())  # nothing left to do


def test_a_batch_that_comes_twice_and_a_build_that_dies(spark, tmp_path, monkeypatch):
    rng = random.Random(72)
    events, charges = some_events(rng, 0, 200, (0, 20)), some_charges(rng, 40)
    made = new_build(spark, tmp_path)
    fed(made, 1, events=events, charges=charges)
    before = state(made)
    fed(made, 1, events=some_events(rng, 500, 10), charges=charges)
    assert state(made) == before  # the number is known
    more = some_events(rng, 1000, 30, (0, 20))
    whole = SnapshotTable.replace

    def dies(self, rows_, keys, marks=None, base=None):
        if self.path.endswith(("/days", "/cohorts")):
            raise OSError("lost")
        return whole(self, rows_, keys, marks, base)

    monkeypatch.setattr(SnapshotTable, "replace", dies)
    with pytest.raises(OSError):
        fed(made, 2, events=more)
    monkeypatch.undo()
    assert made.refresh()["days"]
    full = new_build(spark, tmp_path)
    fed(full, 1, events=events + more, charges=charges)
    assert state(made) == state(full)


def test_marts_of_nothing(spark, tmp_path):
    made = new_build(spark, tmp_path)
    assert all(not parts for parts in fed(made, 1, events=[], charges=[]).values())
    assert all(not r for r in state(made).values())


def test_snapshots_are_whole_numbered_and_swept(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), "part int, z int", "part")
    df = lambda *r: spark.createDataFrame(list(r), "part int, z int")
    assert t.read().count() == 0 and t.keys() == []
    base = t.manifest()
    one = t.replace(df((1, 1), (2, 2)), [1, 2, 3])
    with pytest.raises(Conflict):
        t.replace(df((1, 9)), [1], base=base)
    old = t.read(manifest=one)
    t.append(df((1, 5)), {"batch": 4})
    assert rows(t.read()) == [(1, 1), (1, 5), (2, 2)] and rows(t.read([2])) == [(2, 2)] and t.manifest()["marks"] == {"batch": 4}
    t.replace(df(), [2])
    assert t.keys() == ["1"] and rows(old) == [(1, 1), (2, 2)]  # a reader of the old state still has it
    with pytest.raises(ValueError):
        t.replace(df((7, 7)), [1])
    with open(tmp_path / "t" / "manifests" / "00000099.json", "w") as f:
        f.write("{")  # a writer that died within its manifest
    assert rows(t.read()) == [(1, 1), (1, 5)]
    with pytest.raises(Conflict):
        t.append(df((3, 3)))  # or is still at it
    import os

    os.utime(tmp_path / "t" / "manifests" / "00000099.json", (0, 0))
    assert t.append(df((3, 3)))["number"] == 100
    assert t.vacuum(keep=1) > 0 and rows(t.read()) == [(1, 1), (1, 5), (3, 3)]


def test_sketches_err_within_their_bounds(spark):
    day = lambda i: F.date_add(F.to_date(F.lit("2024-01-01")), i.cast("int"))
    ev = spark.range(400_000).select(day(F.col("id") % 40).alias("part"), (F.xxhash64("id") % 60_000).alias("account_id"), (F.col("id") % 2).cast("int").alias("product"), F.lit("purchase").alias("event"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000)) / 1e6).alias("value"))
    ev = ev.unionByName(ev.limit(3).withColumns({"account_id": F.lit(None).cast("long"), "value": F.lit(None).cast("double")}))
    for lg, bound in ((10, 0.1), (14, 0.025)):  # three standard errors
        days = sketches.actives(ev, lg)
        exact = {r["part"]: r["n"] for r in activity.trailing_distinct(ev.where("account_id is not null").withColumnRenamed("part", "day"), 30, "n").withColumnRenamed("day", "part").collect()}
        got = {r["part"]: r["n"] for r in sketches.trailing(days, 30, "n", lg).collect()}
        assert set(got) == set(exact) and all(abs(got[d] / exact[d] - 1) < bound for d in exact)
        both = sketches.shared(days, F.lit(1), lg).first()["both"]
        want = ev.where("product = 0").select("account_id").intersect(ev.where("product = 1").select("account_id")).where("account_id is not null").count()
        assert abs(both - want) < bound * ev.select("account_id").distinct().count()
    r = sketches.quantile(sketches.latencies(ev, 200), F.lit(1), 0.95, "p", k=200).first()
    assert r["n"] == 400_000 and abs(r["p"] - 0.95) < 0.02  # values are even on [0, 1], so a value is its rank
    assert abs(sketches.quantile(sketches.latencies(ev), F.lit(1), 0.95, "p").first()["p"] - 0.95) < 0.004
    assert all(0.98 < r["ratio"] < 1.02 for r in sketches.against_norm(sketches.latencies(ev), 0.95, 7, "p").where("norm is not null").collect())


def test_stale_and_missing_values_are_never_green(spark):
    values = spark.createDataFrame([("uptime", dt.date(2024, 1, 30), 99.9, 99.0, None), ("uptime", dt.date(2024, 2, 2), 50.0, 99.0, None), ("arpu", dt.date(2024, 1, 1), 500.0, 900.0, 40)], "metric string, period date, value double, prev double, n long")
    today = F.to_date(F.lit("2024-01-31"))
    got = {r["rule_id"]: r["state"] for r in alerts.evaluate(alerts.table(spark), alerts.latest(values, today), as_of=today).collect()}
    assert got["R01"] == "ok" and got["M09"] == "stale" and got["M06"] == "not_checked"


def test_the_panel_of_a_day_knows_stale(spark):
    states = {r["state"] for r in QUERIES["alerts_now"](spark, SF).select("state").distinct().collect()}
    assert {"stale", "not_checked", "ok"} <= states
