"""Closed-world validation, consent, deduplication and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.registry import ANY, Event, Field
from tidemark.operators import intervals

#: Order of the tests: an event gets the first reason that holds.
REASONS = ("no_id", "no_ts", "unknown_event", "foreign_product", "extra_field", "missing_field", "bad_type")


def _typed(value: Column, f: Field) -> Column:
    if f.type == "number":
        return value.try_cast("double").isNotNull()
    if f.type == "boolean":
        return F.lower(value).isin("true", "false")
    return value.isin(*f.values) if f.values else F.lit(True)


def reason(events: list[Event]) -> Column:
    """Of (event, product, ts, account_id, device_id, props map): the first reason to reject, or null.

    The registry is code of bounded size, so it becomes one expression: no join, and the check runs inside the scan's stage.
    """
    known = F.col("event").isin(*{e.name for e in events})
    owned = extra = missing = bad = F.lit(False)
    for name in sorted({e.name for e in events}):
        mine = [e for e in events if e.name == name]
        here = F.col("event") == name
        owned = owned | (here & (F.lit(True) if any(e.product == ANY for e in mine) else F.col("product").isin(*{e.product for e in mine})))
        fields = {f.name: f for e in mine for f in e.fields}
        allowed = F.array(*map(F.lit, fields)) if fields else F.expr("cast(array() as array<string>)")
        extra = extra | (here & (F.size(F.array_except(F.map_keys("props"), allowed)) > 0))
        for f in fields.values():
            value = F.try_element_at("props", F.lit(f.name))
            if f.required:
                missing = missing | (here & value.isNull())
            bad = bad | (here & value.isNotNull() & ~_typed(value, f))
    no = lambda c: F.coalesce(c, F.lit(False))
    tests = (F.col("account_id").isNull() & F.col("device_id").isNull(), F.col("ts").isNull(), ~no(known), ~no(owned), no(extra), no(missing), no(bad))
    return F.coalesce(*[F.when(t, F.lit(r)) for t, r in zip(tests, REASONS, strict=True)])


def validate(rows: DataFrame, events: list[Event]) -> DataFrame:
    """rows plus `reason`; null props are an empty map. Write accepted and rejected rows from one pass by this column."""
    filled = rows.withColumn("props", F.coalesce("props", F.expr("cast(map() as map<string,string>)")))
    return filled.withColumn("reason", reason(events))


def trim(rows: DataFrame, events: list[Event]) -> DataFrame:
    """What a client does: undeclared fields are dropped silently, the event is kept. The server rejects; keep the two apart."""
    by_event = F.create_map(*[x for name in sorted({e.name for e in events}) for x in (F.lit(name), F.array(*[F.lit(f.name) for e in events if e.name == name for f in e.fields]) if any(e.fields for e in events if e.name == name) else F.expr("cast(array() as array<string>)"))])
    return rows.withColumn("props", F.map_filter("props", lambda k, v: F.array_contains(F.coalesce(F.try_element_at(by_event, F.col("event")), F.expr("cast(array() as array<string>)")), k)))


def consented(rows: DataFrame, consent: DataFrame) -> DataFrame:
    """Events that consent lets through. consent: (kind account|device, id, granted, ts).

    Without the account's consent an account's event is written without its device; a device's event without the device's consent
    is not written at all. The state that counts is the last one at the time of the event, of several at one time a grant; the two are kept apart, also after linking.
    """
    who = F.concat_ws(":", "_kind", "_id")
    of = lambda kind, id_: F.struct(F.lit(kind).alias("_kind"), F.col(id_).cast("string").alias("_id"))
    asked = rows.select("event_id", "ts", F.explode(F.array(of("account", "account_id"), of("device", "device_id"))).alias("_w")).select("event_id", "ts", "_w.*").where(F.col("_id").isNotNull()).withColumn("_who", who)
    known = consent.select(F.concat_ws(":", "kind", "id").alias("_who"), "ts", "granted", F.col("granted").cast("int").alias("_tie"))
    # Looked up by stretches of time, so that a busy account or device is many tasks.
    told = intervals.last_before(asked, known, "_who", "granted", "_tie", alias="_granted", strict=False)
    told = told.groupBy("event_id").agg(*[F.bool_or(F.when(F.col("_kind") == kind, F.col("_granted"))).alias(f"_{kind}") for kind in ("account", "device")])
    joined = rows.join(told, "event_id", "left")
    ok = F.coalesce("_device", F.lit(False))
    kept = joined.where(F.col("account_id").isNotNull() | ok)
    device = F.when(F.col("account_id").isNotNull() & ~F.coalesce("_account", F.lit(False)), F.lit(None)).otherwise(F.col("device_id"))
    return kept.withColumn("device_id", device).drop("_account", "_device")


def dedup(rows: DataFrame, key: str = "event_id", order: str = "ts") -> DataFrame:
    """One row per key, the earliest: the same whatever order deliveries came in."""
    w = W.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def stitch(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows plus person: the account, else the account that the device was linked to, else the device itself.

    links: (device_id, account_id, ts), written at login; history is not rewritten. A device with several accounts belongs to the
    earliest link.
    """
    first = links.groupBy(F.col("device_id").alias("_d")).agg(F.min_by("account_id", F.struct("ts", "account_id")).alias("_linked"))
    joined = rows.join(first, F.col("device_id") == F.col("_d"), "left")
    return joined.withColumn("person", F.coalesce("account_id", "_linked", F.concat(F.lit("d:"), "device_id"))).drop("_d", "_linked")


def late(rows: DataFrame, due: str, done: str, minutes: int = 15) -> DataFrame:
    return rows.withColumn("late", F.unix_micros(F.col(done).cast("timestamp")) - F.unix_micros(F.col(due).cast("timestamp")) > minutes * 60_000_000)
