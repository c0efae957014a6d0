"""Stateful processors with event-time timers: they also speak when nothing comes.

Rows of a key are put aside until the watermark has passed them, so that what is said does not depend on how rows were batched or in which order they came. A timer stands at the
next moment at which something can happen, and one firing plays all that lies before the watermark. Times are wall-clock micro- or milliseconds of the
stream's own watermark column; the state store must be RocksDB's.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import calendar

DAY_MS = 86_400_000
EPOCH = dt.date(1970, 1, 1)


def _date(day: int) -> dt.date:
    return EPOCH + dt.timedelta(days=day)


class _Timed(StatefulProcessor):
    """One timer a key, at `self.due(key state)`; what it finds is played by the subclass."""

    handle: StatefulProcessorHandle

    def alarm(self, at: int | None) -> None:
        """Let the key's only timer stand at this time, in milliseconds."""
        for known in list(self.handle.listTimers()):
            self.handle.deleteTimer(known)
        if at is not None:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class TrailingSteps(_Timed):
    """Rows (account_id, day): +1 on the day on which an account joins the count of the last `days` days, -1 on that on which it leaves.

    State: the last active day of the stretch that is open, and the days that the watermark has not passed. A day is known once it is over.
    """

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "day int")
        self.coming = handle.getListState("coming", "day int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days = {d for (d,) in self.coming.get()}
        for frame in rows:
            days.update((frame["day"].to_numpy().astype("datetime64[D]").astype("int64")).tolist())
        self.coming.put([(d,) for d in sorted(days)])
        self._wait(sorted(days))
        return iter([])

    def _wait(self, days: list[int]) -> None:
        leaves = [self.last.get()[0] + self.days] if self.last.exists() else []
        moments = [(d + 1) * DAY_MS for d in days[:1]] + [d * DAY_MS for d in leaves]
        self.alarm(min(moments) if moments else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        last = self.last.get()[0] if self.last.exists() else None
        days, out = sorted(d for (d,) in self.coming.get()), []
        over = [d for d in days if (d + 1) * DAY_MS <= now]
        for d in over:
            if last is not None and d > last + self.days - 1:
                out.append((last + self.days, -1, False))
                last = None
            out.append((d, int(last is None), True))
            last = d
        rest = days[len(over) :]
        # Nobody leaves before it is sure that no day that is still to come holds them.
        if last is not None and (last + self.days) * DAY_MS <= now and not (rest and rest[0] < last + self.days):
            out.append((last + self.days, -1, False))
            last = None
        self.coming.put([(d,) for d in rest]) if rest else self.coming.clear()
        self.last.update((last,)) if last is not None else self.last.clear()
        self._wait(rest)
        if out:
            yield pd.DataFrame({"day": [_date(d) for d, _, _ in out], "n": [n for _, n, _ in out], "seen": [s for _, _, s in out]})


class Silence(_Timed):
    """Rows (name, day): for every day that is over, from the first with data, when data was last seen. Goes on for as long as the watermark moves, also when the name says nothing more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "day int, last int")
        self.coming = handle.getListState("coming", "day int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] == "":
            return iter([])
        days = {d for (d,) in self.coming.get()}
        for frame in rows:
            days.update((frame["day"].to_numpy().astype("datetime64[D]").astype("int64")).tolist())
        self.coming.put([(d,) for d in sorted(days)])
        self.alarm((self.told.get()[0] + 2 if self.told.exists() else min(days) + 1) * DAY_MS)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = timerValues.getCurrentWatermarkInMs() // DAY_MS  # days before this one are over
        days = sorted(d for (d,) in self.coming.get())
        at, last = self.told.get() if self.told.exists() else (days[0] - 1, days[0])
        out, seen = [], set(days)
        for d in range(at + 1, over):
            last = d if d in seen else last
            out.append((d, last))
        rest = [d for d in days if d >= over]
        self.coming.put([(d,) for d in rest]) if rest else self.coming.clear()
        self.told.update((over - 1, last))
        self.alarm((over + 1) * DAY_MS)
        if out:
            yield pd.DataFrame({"name": [key[0]] * len(out), "day": [_date(d) for d, _ in out], "last_seen": [_date(p) for _, p in out], "silent_days": pd.Series([d - p for d, p in out], dtype="int32")})


# How many events a pass sends, and the pause after a refusal, doubled up to its limit, in seconds.
BATCH, PAUSE, LONGEST = 20, 30, 1800


class OfflineQueue(_Timed):
    """Rows (device_id, kind, event_id, ts), kind event, up or down: a device's queue of events, and whether its network works.

    A pass runs when an event comes or a pause ends. It sends what waits, oldest first, `batch` events at most, and takes each off the queue as it is sent; while more wait, the next pass follows at
    once. A refusal ends the pass and begins a pause, twice as long as the one before up to the longest; no pass runs within it, whatever comes. A success makes the next
    pause short again. Out come the sent events with their times and the number of refusals that each waited through as the first in line.
    """

    def __init__(self, batch: int, pause: int, longest: int):
        self.batch, self.pause, self.longest = batch, pause * 1000, longest * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.coming = handle.getListState("coming", "t long, kind string, event_id string")
        self.waiting = handle.getListState("waiting", "event_id string")
        self.mode = handle.getValueState("mode", "up boolean, pause long, until long, refused int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, least = [], None
        for frame in rows:
            times = frame["ts"].astype("datetime64[ms]").astype("int64").tolist()
            for t, kind, event in zip(times, frame["kind"], frame["event_id"], strict=True):
                new.append((t, kind, event))
                least = t if least is None else min(least, t)
        self.coming.appendList(new)
        known = list(self.handle.listTimers())
        if least is not None and (not known or least < min(known)):
            self.alarm(least)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        coming = sorted(self.coming.get(), key=lambda r: (r[0], {"down": 0, "up": 1}.get(r[1], 2), r[2] or ""))
        up, pause, until, refused = self.mode.get() if self.mode.exists() else (True, 0, -1, 0)
        waiting, sent, at = [e for (e,) in self.waiting.get()], [], 0
        played = [r for r in coming if r[0] <= now]

        def passes(t: int) -> None:
            nonlocal pause, until, refused, waiting
            if not waiting:
                return
            if not up:
                pause = min(pause * 2, self.longest) if pause else self.pause
                until, refused = t + pause, refused + 1
                return
            for i, event in enumerate(waiting):
                sent.append((event, t, i // self.batch, refused if i == 0 else 0))
            pause, until, refused, waiting = 0, -1, 0, []

        while True:
            row = played[at] if at < len(played) else None
            if until >= 0 and until <= now and (row is None or until <= row[0]):
                t, until = until, -1
                passes(t)
                continue
            if row is None:
                break
            t, kind, event = row
            at += 1
            if kind == "event":
                waiting.append(event)
                if until < 0:
                    passes(t)
            else:
                up = kind == "up"
        rest = coming[at:]
        self.coming.put(rest) if rest else self.coming.clear()
        self.waiting.put([(e,) for e in waiting]) if waiting else self.waiting.clear()
        self.mode.update((up, pause, until, refused))
        moments = ([rest[0][0]] if rest else []) + ([until] if until >= 0 else [])
        self.alarm(min(moments) if moments else None)
        if sent:
            yield pd.DataFrame({"event_id": [e for e, *_ in sent], "device_id": [key[0]] * len(sent), "sent_at": pd.to_datetime([t for _, t, *_ in sent], unit="ms"), "pass": pd.Series([p for *_, p, _ in sent], dtype="int32"), "refused": pd.Series([r for *_, r in sent], dtype="int32")})


def _days(stream: DataFrame, watermark: str) -> DataFrame:
    """stream plus the Moscow `day` and `at`, its beginning, by which the watermark moves: a day is over when one comes that is later by more than the watermark."""
    return stream.withColumn("day", calendar.day(F.col("ts").cast("timestamp_ntz"))).withColumn("at", F.to_timestamp("day")).withWatermark("at", watermark)


def trailing_steps(stream: DataFrame, days: int = 30, watermark: str = "7 days") -> DataFrame:
    """(day, n, seen) steps of the trailing distinct count of accounts: sums of n by day, added up over days, are the count. Each account's day comes once, so no account's events meet."""
    once = _days(stream.where("account_id is not null"), watermark).select("account_id", "day", "at").dropDuplicates(["account_id", "day", "at"])
    return once.groupBy("account_id").transformWithStateInPandas(TrailingSteps(days), "day date, n int, seen boolean", "append", "eventTime")


def silence(stream: DataFrame, name: Column, watermark: str = "7 days") -> DataFrame:
    """(name, day, last_seen, silent_days) of every day that is over; name is null for rows that count for nothing but the passing of time."""
    # Rows without a name stay as the name '', which says nothing: a filter would go below the watermark, and time would stand still.
    once = _days(stream, watermark).select(F.coalesce(name, F.lit("")).alias("name"), "day", "at").dropDuplicates(["name", "day", "at"])
    return once.groupBy("name").transformWithStateInPandas(Silence(), "name string, day date, last_seen date, silent_days int", "append", "eventTime")


def offline_queue(stream: DataFrame, batch: int = BATCH, pause: int = PAUSE, longest: int = LONGEST, watermark: str = "10 minutes") -> DataFrame:
    """(event_id, device_id, sent_at, pass, refused) of a stream (device_id, kind, event_id, ts)."""
    rows = stream.withWatermark("ts", watermark).select("device_id", "kind", "event_id", "ts")
    return rows.groupBy("device_id").transformWithStateInPandas(OfflineQueue(batch, pause, longest), "event_id string, device_id string, sent_at timestamp, pass int, refused int", "append", "eventTime")
