"""Timers and the outbox: what they give does not depend on batches, order or repeats."""

import datetime as dt
import json
import random
from collections import defaultdict

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.operators import activity
from tidemark.plans import QUERIES
from tidemark.sources import tables
from tidemark.sources.snapshots import Conflict, SnapshotTable
from tidemark.streaming import outbox as O
from tidemark.streaming import timers

T0 = dt.datetime(2024, 1, 1)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    with open(folder / f"{name}.json", "w", encoding="utf-8") as f:
        f.writelines(json.dumps({k: v.isoformat() + "Z" if isinstance(v, dt.datetime) else v for k, v in r.items()}) + "\n" for r in rows)


def run(df, out, ck):
    df.writeStream.format("parquet").option("checkpointLocation", str(ck)).trigger(availableNow=True).start(str(out)).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(str(out))


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def replay(rows, batch=timers.BATCH, pause=timers.PAUSE, longest=timers.LONGEST, until=None):
    """(event, sent at, pass, refused) of one device, second by second of what happens."""
    order = {"down": 0, "up": 1, "event": 2}
    rows = sorted(rows, key=lambda r: (r[0], order[r[1]], r[2] or ""))
    up, wait, retry, queue, refused, out = True, 0, None, [], 0, []

    def attempt(t):
        nonlocal wait, retry, queue, refused
        retry = None
        if not queue:
            return
        if not up:
            wait = min(2 * wait, longest) if wait else pause
            retry, refused = t + dt.timedelta(seconds=wait), refused + 1
            return
        for i, e in enumerate(queue):
            out.append((e, t, i // batch, refused if i == 0 else 0))
        queue, wait, refused = [], 0, 0

    for t, kind, event in [*rows, (until, "end", None)]:
        while retry is not None and retry <= t:
            attempt(retry)
        if kind == "event":
            queue.append(event)
            if retry is None:
                attempt(t)
        elif kind != "end":
            up = kind == "up"
    return out


def test_offline_queue_replays_a_send_log(spark, tmp_path):
    rng = random.Random(81)
    log = []
    for device in "abc":
        t = T0
        for i in range(150):
            t += dt.timedelta(seconds=rng.choice([1, 1, 5, 40, 700, 4000]))
            log.append({"device_id": device, "kind": rng.choice(["event"] * 6 + ["down", "up"]), "event_id": f"{device}{i:04d}", "ts": t})
    log.append({"device_id": "end", "kind": "event", "event_id": "end", "ts": T0 + dt.timedelta(days=9)})
    parts = [log[i::4] for i in range(4)]  # later files hold earlier rows
    for i, part in enumerate(parts):
        rng.shuffle(part)
        put(tmp_path / "in", str(i), part)
    rows = stream(spark, tmp_path / "in", "device_id string, kind string, event_id string, ts timestamp")
    got = run(timers.offline_queue(rows, watermark="10 days"), tmp_path / "out", tmp_path / "ck").collect()
    assert not got  # nothing is sure yet
    put(tmp_path / "in", "9", [{"device_id": "end", "kind": "event", "event_id": "end2", "ts": T0 + dt.timedelta(days=19)}])
    got = run(timers.offline_queue(rows, watermark="10 days"), tmp_path / "out", tmp_path / "ck").collect()
    for device in "abc":
        own = [(r["ts"], r["kind"], r["event_id"]) for r in log if r["device_id"] == device]
        assert sorted((r["event_id"], r["sent_at"], r["pass"], r["refused"]) for r in got if r["device_id"] == device) == sorted(replay(own, until=T0 + dt.timedelta(days=9)))
    assert max(r["pass"] for r in got) >= 1 and max(r["refused"] for r in got) > 5


def test_offline_queue_over_the_events(spark):
    got = defaultdict(list)
    for r in QUERIES["stream_offline_queue"](spark, SF).collect():
        got[r["device_id"]].append((str(r["event_id"]), r["sent_at"], r["pass"], r["refused"]))
    rows, last = defaultdict(list), None
    for r in tables.read(spark, SF, "events").collect():
        ms = r["ts"].replace(microsecond=r["ts"].microsecond // 1000 * 1000)
        rows[str(r["user_id"])].append((ms, {"error": "down", "signup": "up"}.get(r["event_type"], "event"), str(r["event_id"])))
        last = max(last or ms, ms)
    for device, own in rows.items():
        assert sorted(got.pop(device, [])) == sorted(x for x in replay(own, until=last))
    assert not got


def test_trailing_steps_and_silence_over_batches(spark, tmp_path):
    rng = random.Random(82)
    rows = [{"account_id": rng.randrange(15), "event": rng.choice("xxy"), "ts": T0 + dt.timedelta(hours=rng.uniform(0, 24 * 90))} for _ in range(160)]
    rows.append({"account_id": 99, "event": "z", "ts": T0 + dt.timedelta(days=200)})
    for i in range(4):
        put(tmp_path / "in", str(i), rows[i::4])
    schema = "account_id long, event string, ts timestamp"
    source = stream(spark, tmp_path / "in", schema)
    # The day 200 is in the first file: late rows are only those beyond the watermark, which is longer here.
    steps = run(timers.trailing_steps(source, 30, "250 days"), tmp_path / "steps", tmp_path / "ck1")
    told = run(timers.silence(source, F.when(F.col("event") != "z", F.col("event")), "250 days"), tmp_path / "told", tmp_path / "ck2")
    assert steps.count() == 0 and told.count() == 0
    put(tmp_path / "in", "9", [{"account_id": 98, "event": "z", "ts": T0 + dt.timedelta(days=400)}])
    steps = run(timers.trailing_steps(source, 30, "250 days"), tmp_path / "steps", tmp_path / "ck1")
    told = run(timers.silence(source, F.when(F.col("event") != "z", F.col("event")), "250 days"), tmp_path / "told", tmp_path / "ck2")

    batch = spark.createDataFrame([(r["account_id"], r["event"], r["ts"]) for r in rows[:-1]], schema).withColumn("day", calendar.day(F.col("ts").cast("timestamp_ntz")))
    want = {r["day"]: r["n"] for r in activity.trailing_distinct(batch, 30, "n").collect()}
    total, got = 0, {}
    for r in steps.groupBy("day").agg(F.sum("n").alias("n"), F.max("seen").alias("seen")).orderBy("day").collect():
        total += r["n"]
        if r["seen"]:
            got[r["day"]] = total
    assert got == want and total == 0  # in the end all have left
    for name in "xy":
        days = {r["day"] for r in batch.where(F.col("event") == name).select("day").collect()}
        own = {r["day"]: (r["last_seen"], r["silent_days"]) for r in told.where(F.col("name") == name).collect()}
        spine = [min(days) + dt.timedelta(days=i) for i in range((dt.date(2024, 1, 1) + dt.timedelta(days=150) - min(days)).days)]
        assert own == {d: (max(x for x in days if x <= d), (d - max(x for x in days if x <= d)).days) for d in spine}
    assert {r["name"] for r in told.select("name").distinct().collect()} == {"x", "y"}


# ---- the outbox -----------------------------------------------------------

PLAN = "session_id long, kind string, due_at timestamp"
RESULT = "session_id long, kind string, ok boolean, at timestamp, error string"


def by_key(box):
    return {(r["session_id"], r["kind"]): r for r in box.rows().collect()}


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def when(minutes):
    return F.lit(at(minutes))


def test_outbox_is_one_row_a_key_whatever_comes(spark, tmp_path):
    box = O.Outbox(spark, str(tmp_path / "box"), 4)
    plan = lambda *r: spark.createDataFrame(list(r), PLAN)
    assert box.plan(plan((1, "a", at(0)), (1, "a", at(5)), (2, "a", at(1)), (None, "a", at(1))), "s", 0)
    assert not box.plan(plan((1, "a", at(99)), (3, "a", at(1))), "s", 0)  # the same micro-batch again
    box.plan(plan((1, "a", at(7)), (2, "b", at(50))), "s", 1)
    assert {k: (r["due_at"], r["status"]) for k, r in by_key(box).items()} == {(1, "a"): (at(7), "pending"), (2, "a"): (at(1), "pending"), (2, "b"): (at(50), "pending")}
    one = box.claim("w1", when(10)).collect()
    assert sorted((r["session_id"], r["kind"]) for r in one) == [(1, "a"), (2, "a")] and box.claim("w2", when(11)).count() == 0  # locked
    assert box.claim("w2", when(30)).count() == 2  # the lease of w1 has run out
    result = lambda *r: spark.createDataFrame(list(r), RESULT)
    sent = result((1, "a", True, at(31), None), (2, "a", False, at(31), "no net"), (9, "z", True, at(31), None))
    assert box.settle(sent, "r", 1) and not box.settle(sent, "r", 1)
    rows = by_key(box)
    assert (rows[1, "a"]["status"], rows[1, "a"]["late"], rows[1, "a"]["attempts"], rows[1, "a"]["send_count"]) == ("sent", True, 1, 1) and len(rows) == 3
    assert (rows[2, "a"]["status"], rows[2, "a"]["last_error"], rows[2, "a"]["locked_by"]) == ("pending", "no net", None)
    for i in range(4):
        box.settle(result((2, "a", False, at(40 + i), f"e{i}")))
    assert by_key(box)[2, "a"]["status"] == "failed" and by_key(box)[2, "a"]["last_error"] == "e3"
    box.plan(plan((1, "a", at(500))))
    assert by_key(box)[1, "a"]["due_at"] == at(7)  # what is sent stays
    box.skip(plan((1, "a", at(0)), (2, "b", at(0))))
    assert (by_key(box)[1, "a"]["status"], by_key(box)[2, "b"]["status"]) == ("sent", "skipped")
    box.plan(plan((2, "b", at(60))))
    assert by_key(box)[2, "b"]["status"] == "pending" and box.claim("w", when(100), limit=1).count() == 1
    assert box.counters(when(100)).first()[:] == (3, 1, 0, 1)


def test_two_writers_of_one_bucket_lose_nothing(spark, tmp_path, monkeypatch):
    box, other = O.Outbox(spark, str(tmp_path / "box"), 1), O.Outbox(spark, str(tmp_path / "box"), 1)
    plan = lambda i: spark.createDataFrame([(i, "a", at(i))], PLAN)
    whole, met = SnapshotTable.replace, []

    def between(self, rows, keys, marks=None, base=None):
        if not met:
            met.append(1)
            other.plan(plan(2))
        try:
            return whole(self, rows, keys, marks, base)
        except Conflict:
            met.append("conflict")
            raise

    monkeypatch.setattr(SnapshotTable, "replace", between)
    box.plan(plan(1), "s", 0)
    assert "conflict" in met and sorted(by_key(box)) == [(1, "a"), (2, "a")]


def test_outbox_takes_a_stream_once(spark, tmp_path):
    box = O.Outbox(spark, str(tmp_path / "box"), 2)
    for i in range(3):
        put(tmp_path / "in", str(i), [{"session_id": s, "kind": "a", "due_at": at(10 * i + s)} for s in range(i + 2)])
    for _ in range(2):
        O.plan_from(stream(spark, tmp_path / "in", PLAN), box, str(tmp_path / "ck")).awaitTermination()
        rows = by_key(box)
        assert len(rows) == 4 and box.table.manifest()["marks"]["plan"] == 2
    O.plan_from(stream(spark, tmp_path / "in", PLAN), box, str(tmp_path / "ck2")).awaitTermination()  # a new checkpoint numbers its batches alike
    assert by_key(box) == rows
