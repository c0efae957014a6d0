"""Stateful operators: a sliding rate limit per device, and a queue that consent can erase."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "event_id string, device_id string, ts timestamp, accepted boolean"


class RateLimit(StatefulProcessor):
    """At most `limit` accepted events within `seconds`; what is above it is written nowhere and does not count.

    A device's state is the times of its accepted events within the window: `limit` numbers at most.
    """

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        kept, out = [t for (t,) in self.times.get()], []
        for t in frame["ts"].astype("datetime64[us]").astype("int64").tolist():
            kept = [k for k in kept if k > t - self.seconds * 1_000_000]
            ok = len(kept) < self.limit
            if ok:
                kept.append(t)
            out.append(ok)
        self.times.put([(t,) for t in kept])
        yield pd.DataFrame({"event_id": frame["event_id"], "device_id": frame["device_id"], "ts": frame["ts"], "accepted": out})

    def close(self) -> None:
        pass


class ErasableQueue(StatefulProcessor):
    """Holds a device's events until consent: granted releases them, revoked erases them at once. Rows: kind event|grant|revoke."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "event_id string, ts timestamp")
        self.granted = handle.getValueState("granted", "g boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("ts", kind="stable")
        held = list(self.waiting.get())
        granted = bool(self.granted.get()[0]) if self.granted.exists() else False
        out = []
        for r in frame.itertuples():
            if r.kind == "grant":
                granted, out, held = True, out + held, []
            elif r.kind == "revoke":
                granted, held = False, []
            elif granted:
                out.append((r.event_id, r.ts))
            else:
                held.append((r.event_id, r.ts))
        self.waiting.put(held) if held else self.waiting.clear()
        self.granted.update((granted,))
        if out:
            yield pd.DataFrame({"event_id": [e for e, _ in out], "device_id": [key[0]] * len(out), "ts": [t for _, t in out], "accepted": [True] * len(out)})

    def close(self) -> None:
        pass


def rate_limited(stream: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """(event_id, device_id, ts, accepted) of a stream with device_id. The state store must be RocksDB's."""
    rows = stream.select("event_id", F.coalesce("device_id", F.lit("")).alias("device_id"), "ts")
    return rows.groupBy("device_id").transformWithStateInPandas(RateLimit(limit, seconds), OUT, "append", "none")


def held_until_consent(stream: DataFrame) -> DataFrame:
    """Released events of a stream (device_id, kind, event_id, ts)."""
    return stream.groupBy("device_id").transformWithStateInPandas(ErasableQueue(), OUT, "append", "none")
