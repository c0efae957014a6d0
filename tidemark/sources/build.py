"""The daily build: facts as they arrive, and marts that are recomputed only where new facts touch them.

Facts are appended by part (a day of events, a month of charges). Every mart remembers which folders of its sources it was built from; the parts whose folders
differ now are what changed, also for rows that arrive late. From how far a fact reaches follows which parts of the mart are dirty, and from
that which parts of the sources are read. All else of facts and marts is neither read nor written.

A build that dies leaves each mart as it was before or after, with what it was built from, so the next build does the rest.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import daily, sketches, tallies
from tidemark.sources.snapshots import SnapshotTable


def _moved(part: str, by: int, unit: str) -> str:
    d = dt.date.fromisoformat(part)
    if unit == "day":
        return str(d + dt.timedelta(days=by))
    months = d.year * 12 + d.month - 1 + by
    return str(dt.date(months // 12, months % 12 + 1, 1))


def spread(parts: set[str], before: int, after: int, unit: str) -> set[str]:
    """The parts and those up to `before` before and `after` after them."""
    return {_moved(p, by, unit) for p in parts for by in range(-before, after + 1)}


@dataclass(frozen=True)
class Mart:
    """make(sources by name, condition on part) gives the rows of the parts that the condition names.

    reach: for each source, how many parts before and after its own a fact can change.
    """

    name: str
    schema: str
    unit: str
    reach: dict[str, tuple[int, int]]
    make: Callable[[dict[str, DataFrame], Column], DataFrame]


MARTS = (
    Mart("activity", daily.ACTIVITY, "day", {"events": (0, 0)}, lambda s, _: daily.activity(s["events"])),
    Mart("tickets", daily.TICKETS, "day", {"events": (0, 0)}, lambda s, _: daily.tickets(s["events"])),
    Mart("days", daily.DAYS, "day", {"events": (3, 1)}, lambda s, wanted: daily.days(s["events"], wanted)),
    Mart("releases", daily.RELEASES, "day", {"events": (3, 3)}, lambda s, wanted: daily.releases(s["events"], wanted)),
    Mart("cohorts", daily.COHORTS, "day", {"entries": (0, 0), "events": (14, 0)}, lambda s, _: daily.entry_cohorts(s["entries"], s["events"])),
    Mart("actives", sketches.ACTIVES, "day", {"events": (0, 0)}, lambda s, _: sketches.actives(s["events"])),
    Mart("latencies", sketches.LATENCIES, "day", {"events": (0, 0)}, lambda s, _: sketches.latencies(s["events"])),
    Mart("accounts", tallies.ACCOUNTS, "day", {"events": (0, 0)}, lambda s, _: tallies.accounts(s["events"])),
    Mart("values", tallies.VALUES, "day", {"events": (0, 0)}, lambda s, _: tallies.values(s["events"])),
    Mart("revenue", daily.REVENUE, "month", {"first_charges": (0, 0), "charges": (2, 0)}, lambda s, wanted: daily.revenue(s["charges"], s["first_charges"], wanted)),
    Mart("months", daily.MONTHS, "month", {"charges": (0, 0)}, lambda s, _: daily.months(s["charges"], s["segments"])),
    Mart("returned", daily.RETURNED, "month", {"returns": (0, 0)}, lambda s, _: daily.returned(s["returns"])),
)
#: Facts by name, with their key against repeated delivery: a row that has come before is not written again.
FACTS = {"events": (daily.EVENTS, "event_id"), "charges": (daily.CHARGES, None), "returns": (daily.RETURNS, None)}
#: First rows of a key: name to (facts, unit, filter, key, price).
FIRSTS = {"entries": ("events", "day", "event = 'signup'", "account_id", None), "first_charges": ("charges", "month", "true", "customer", "price")}


@dataclass
class DailyBuild:
    """Facts and marts under one path. segments: (customer, segment), a small dimension that is read whole; marts: those to build, all of them if none are named."""

    spark: SparkSession
    path: str
    segments: DataFrame
    marts: tuple[str, ...] = tuple(m.name for m in MARTS)
    tables: dict[str, SnapshotTable] = field(init=False)

    def __post_init__(self) -> None:
        schemas = {name: schema for name, (schema, _) in FACTS.items()} | dict.fromkeys(FIRSTS, daily.FIRSTS) | {m.name: m.schema for m in MARTS}
        self.tables = {name: SnapshotTable(self.spark, f"{self.path.rstrip('/')}/{name}", schema, "part") for name, schema in schemas.items()}

    def add(self, name: str, rows: DataFrame, batch: int) -> None:
        """Append a batch of facts. Batches are numbered from 1 and rise; one that has been applied is not applied again. Rows without a part are not facts."""
        table, key = self.tables[name], FACTS[name][1]
        base = table.manifest()
        if base["marks"].get("batch", 0) >= batch:
            return
        rows = rows.where("part is not null")
        if key:
            rows = rows.dropDuplicates([key])
            if base["folders"]:
                rows = self._new(table, base, rows, key)
        table.append(rows.hint("rebalance", "part"), {"batch": batch}, base)

    def _new(self, table: SnapshotTable, base: dict, rows: DataFrame, key: str) -> DataFrame:
        """rows that the table lacks, by key; looked for in the parts that rows have, as a row that comes again has its old time."""
        parts = {str(r[0]) for r in rows.select("part").distinct().collect()}  # a row for each part
        return rows.join(table.read(parts, base).select(F.col(key).alias("_known")), F.col(key) == F.col("_known"), "left_anti")

    def _changed(self, source: str, built: dict) -> tuple[set[str], dict]:
        manifest = self.tables[source].manifest()
        now = manifest["folders"]
        return {p for p in {*now, *built} if now.get(p) != built.get(p)}, manifest

    def _firsts(self, name: str) -> set[str]:
        """Bring a table of first rows up to date from the parts that changed; gives the parts rewritten.

        A key whose new rows begin earlier than what is stored moves: it leaves its old part and enters the new one.
        """
        source, _, condition, key, price = FIRSTS[name]
        table = self.tables[name]
        base = table.manifest()
        changed, facts = self._changed(source, base["marks"].get("built", {}))
        if not changed:
            return set()
        new = daily.first_of(self.tables[source].read(changed, facts).where(condition), key, F.col(price) if price else F.lit(None))
        if not base["folders"]:
            table.replace(new.hint("rebalance", "part"), spread(changed, 0, 0, "day"), {"built": facts["folders"]}, base)
            return changed
        old = table.read(manifest=base).select(F.col("key").alias("_key"), F.col("part").alias("_part"), F.struct("ts", "price").alias("_old"))
        moved = new.join(old, F.col("key") == F.col("_key"), "left").where(F.col("_old").isNull() | (F.struct("ts", "price") < F.col("_old")))
        touched = {str(p) for r in moved.select(F.array_compact(F.array("part", "_part")).alias("p")).select(F.explode("p").alias("p")).distinct().collect() for p in r}  # a row for each part
        stay = table.read(touched, base).join(moved.select(F.col("key").alias("_moved")), F.col("key") == F.col("_moved"), "left_anti")
        table.replace(stay.unionByName(moved.select("part", "key", "ts", "price")).hint("rebalance", "part"), touched, {"built": facts["folders"]}, base)
        return touched

    def _refreshed(self, mart: Mart) -> set[str]:
        table = self.tables[mart.name]
        base = table.manifest()
        built, dirty, sources = base["marks"].get("built", {}), set(), {}
        for name, (before, after) in mart.reach.items():
            changed, sources[name] = self._changed(name, built.get(name, {}))
            dirty |= spread(changed, before, after, mart.unit)
        if not dirty:
            return set()
        # A part's rows need what can change them: facts as far after it as a fact reaches back, and the other way round.
        read = {name: self.tables[name].read(spread(dirty, after, before, mart.unit), sources[name]) for name, (before, after) in mart.reach.items()}
        wanted = F.col("part").isin(*[dt.date.fromisoformat(p) for p in sorted(dirty)])
        rows = mart.make(read | {"segments": self.segments}, wanted).where(wanted)
        table.replace(rows.hint("rebalance", "part"), dirty, {"built": {name: m["folders"] for name, m in sources.items()}}, base)
        return dirty

    def refresh(self) -> dict[str, set[str]]:
        """Recompute what is dirty; gives the parts rewritten by table. Marts are independent and run at once; those that read a table of first rows wait for it."""
        wanted = [m for m in MARTS if m.name in self.marts]
        sources = {s for m in wanted for s in m.reach}
        with ThreadPoolExecutor(len(MARTS) + len(FIRSTS)) as pool:
            firsts = {name: pool.submit(self._firsts, name) for name in FIRSTS if name in sources}

            def run(mart: Mart) -> set[str]:
                for source in mart.reach:
                    if source in firsts:
                        firsts[source].result()
                return self._refreshed(mart)

            marts = {m.name: pool.submit(run, m) for m in wanted}
            return {name: made.result() for name, made in (firsts | marts).items()}

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()
