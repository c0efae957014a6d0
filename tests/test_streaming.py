"""Streams give what a batch over the same rows gives, also after late, repeated and restarted delivery."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.registry import Event, Field
from tidemark.operators import ingest
from tidemark.sources.polling import PolledMessages, Stretch, message_stream
from tidemark.streaming import ingest as S
from tidemark.streaming import limits

EVENTS = [Event("p", "go", "?", (Field("n", "number", True),))]
T0 = dt.datetime(2024, 1, 10, 12)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    with open(folder / f"{name}.json", "w", encoding="utf-8") as f:
        f.writelines(json.dumps({"event_id": i, "event": e, "product": "p", "ts": t.isoformat() + "Z" if t else None, "account_id": "a", "device_id": d, "props": {"n": "1"}}) + "\n" for i, e, t, d in rows)


def drain(df, tmp, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_route_is_idempotent_and_deduplicates(spark, tmp_path):
    at = lambda h: T0 + dt.timedelta(hours=h)
    src, acc, rej, ck = tmp_path / "in", str(tmp_path / "acc"), str(tmp_path / "rej"), str(tmp_path / "ck")
    put(src, "1", [("e1", "go", at(0), "d"), ("e2", "no", at(1), "d"), ("e1", "go", at(0), "d")])
    S.route(S.deduplicated(S.read_events(spark, str(src))), EVENTS, acc, rej, ck).awaitTermination()
    put(src, "2", [("e3", "go", at(-30), "d"), ("e1", "go", at(0), "d"), ("e4", "go", None, "d")])
    S.route(S.deduplicated(S.read_events(spark, str(src))), EVENTS, acc, rej, ck).awaitTermination()
    S.route(S.deduplicated(S.read_events(spark, str(src))), EVENTS, acc, rej, ck).awaitTermination()
    good = spark.read.option("recursiveFileLookup", True).parquet(acc)
    bad = spark.read.option("recursiveFileLookup", True).parquet(rej)
    assert sorted(r["event_id"] for r in good.collect()) == ["e1", "e3"]
    assert sorted((r["event_id"], r["reason"]) for r in bad.collect()) == [("e2", "unknown_event"), ("e4", "no_ts")]
    batch = ingest.validate(ingest.dedup(spark.read.schema(S.SCHEMA).json(str(src))), EVENTS)
    assert sorted(r["event_id"] for r in batch.where("reason is null").collect()) == ["e1", "e3"]


def test_windows_equal_batch(spark, tmp_path):
    src = tmp_path / "in"
    times = [dt.datetime(2024, 1, 7, 20, 59), dt.datetime(2024, 1, 7, 21), dt.datetime(2024, 1, 9), dt.datetime(2024, 1, 9, 0, 20), dt.datetime(2024, 1, 9, 1)]
    put(src, "1", [(f"e{i}", "go", t, "d") for i, t in enumerate(times)])
    weeks = drain(S.tumbling(S.read_events(spark, str(src))), tmp_path, "weeks", "complete")
    assert sorted((str(r["start"]), r["wau"], r["events"]) for r in weeks.collect()) == [("2023-12-31 21:00:00", 1, 1), ("2024-01-07 21:00:00", 1, 4)]
    slid = drain(S.sliding(S.read_events(spark, str(src))), tmp_path, "slid", "complete")
    batch = spark.read.schema(S.SCHEMA).json(str(src)).groupBy(F.window("ts", "24 hours", "1 hour"), "event").count()
    assert sorted((str(r["start"]), r["n"]) for r in slid.collect()) == sorted((str(r["window"]["start"]), r["count"]) for r in batch.collect())
    sess = drain(S.session_counts(S.read_events(spark, str(src))), tmp_path, "sess", "complete")
    assert sorted(r["n_events"] for r in sess.collect()) == [1, 2, 2]


def test_rate_limit_keeps_its_state(spark, tmp_path):
    src = tmp_path / "in"
    sec = lambda s: T0 + dt.timedelta(seconds=s)
    put(src, "1", [("a", "go", sec(0), "d"), ("b", "go", sec(10), "d"), ("c", "go", sec(20), "d"), ("x", "go", sec(0), "e")])
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        limits.rate_limited(S.read_events(spark, str(src), 1), 2, 60).writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out).awaitTermination()
        return {r["event_id"]: r["accepted"] for r in spark.read.parquet(out).collect()}

    first = {"a": True, "b": True, "c": False, "x": True}
    assert run() == first
    put(src, "2", [("d", "go", sec(59), "d"), ("f", "go", sec(60), "d"), ("g", "go", sec(61), "d")])
    assert run() == first | {"d": False, "f": True, "g": False}


def test_revoked_consent_erases_the_queue(spark, tmp_path):
    src = tmp_path / "q"
    src.mkdir()
    rows = [("d", "event", "1", 0), ("d", "revoke", None, 1), ("d", "event", "2", 2), ("d", "grant", None, 3), ("d", "event", "3", 4), ("e", "event", "4", 0)]
    (src / "1.json").write_text("\n".join(json.dumps({"device_id": d, "kind": k, "event_id": e, "ts": (T0 + dt.timedelta(seconds=s)).isoformat() + "Z"}) for d, k, e, s in rows))
    stream = spark.readStream.schema("device_id string, kind string, event_id string, ts timestamp").json(str(src))
    assert sorted(r["event_id"] for r in drain(limits.held_until_consent(stream), tmp_path, "held").collect()) == ["2", "3"]


def test_polled_messages_resume_after_the_offset(spark, tmp_path):
    spark.dataSource.register(PolledMessages)
    src, out, ck = tmp_path / "updates", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    line = lambda i, text: json.dumps({"update_id": i, "message": {"text": text, "chat": {"id": 5}, "from": {"first_name": "n"}}})
    (src / "1.jsonl").write_text("\n".join([line(1, "/cpo a"), "no json", line(2, "/cpo b"), json.dumps({"message": {}})]))

    def poll():
        q = spark.readStream.format("polled_messages").load(str(src)).writeStream.format("parquet").option("checkpointLocation", ck).start(out)
        q.processAllAvailable()
        q.stop()
        return sorted((r["update_id"], r["text"], r["chat_id"]) for r in spark.read.parquet(out).collect())

    assert poll() == [(1, "/cpo a", 5), (2, "/cpo b", 5)]
    (src / "2.jsonl").write_text(line(3, "/cpo c"))
    assert poll() == [(1, "/cpo a", 5), (2, "/cpo b", 5), (3, "/cpo c", 5)]


def test_a_backlog_is_polled_in_bounded_batches_by_several_tasks(spark, tmp_path):
    spark.dataSource.register(PolledMessages)
    src, out, ck, own = tmp_path / "updates", str(tmp_path / "out"), str(tmp_path / "ck"), str(tmp_path / "own")
    src.mkdir()
    line = lambda i: json.dumps({"update_id": i, "message": {"text": "é" * (i % 37), "chat": {"id": 5}, "from": {"first_name": "n"}}}) + "\n"
    for part in range(4):
        (src / f"{part}.jsonl").write_text("".join(line(i) for i in range(part * 200, part * 200 + 200)), encoding="utf-8")
    bytes_ = sum(p.stat().st_size for p in src.iterdir())

    def poll():
        rows = spark.readStream.format("polled_messages").option("splitBytes", 1000).option("maxBytesPerBatch", 9000).option("progress", own).load(str(src))
        sizes = []
        q = rows.withColumn("task", F.spark_partition_id()).writeStream.foreachBatch(lambda b, n: (sizes.append((b.count(), b.select("task").distinct().count())), b.write.mode("overwrite").parquet(f"{out}/batch={n}"))).option("checkpointLocation", ck).start()
        q.processAllAvailable()
        q.stop()
        return [s for s in sizes if s[0]], sorted(r["update_id"] for r in spark.read.parquet(out).collect())

    sizes, ids = poll()
    assert ids == list(range(800)) and len(sizes) >= bytes_ // 9000 and max(n for n, _ in sizes) < 200 and max(t for _, t in sizes) >= 8
    with open(src / "3.jsonl", "a", encoding="utf-8") as f:
        f.write(line(800))
    (src / "4.jsonl").write_text(line(801))
    assert poll()[1] == list(range(802))  # after a restart, also what was appended
    with pytest.raises(ValueError):
        PolledMessages({"path": str(src), "maxBytesPerBatch": "5"}).streamReader(None)


def test_every_line_is_in_one_stretch(tmp_path):
    p = tmp_path / "f"
    p.write_bytes(b"a\nbb\n\nccc\nd")
    for split in range(1, 14):
        lines = [x for at in range(0, 11, split) for x in Stretch(str(p), at, min(at + split, 11)).lines()]
        assert lines == [b"a\n", b"bb\n", b"\n", b"ccc\n", b"d"]


def test_message_stream_reads_each_file_once(spark, tmp_path):
    src = tmp_path / "updates"
    src.mkdir()
    line = lambda i, text: json.dumps({"update_id": i, "message": {"text": text, "chat": {"id": 5}, "from": {"first_name": "n"}}})
    (src / "1.jsonl").write_text("\n".join([line(1, "/cpo a"), "no json", json.dumps({"message": {}}), json.dumps({"update_id": 2})]))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def poll():
        message_stream(spark, str(src), 1).writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r["update_id"], r["chat_id"], r["author"], r["text"]) for r in spark.read.parquet(out).collect())

    assert poll() == [(1, 5, "n", "/cpo a"), (2, None, None, None)]
    (src / "2.jsonl").write_text(line(3, "/cpo c"))
    assert poll()[2:] == [(3, 5, "n", "/cpo c")]
