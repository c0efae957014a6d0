"""Exports of outside systems: what each connector delivers, read by its agreed columns, and what is known of each.

An export lies under root/<connector>/day=<date>/ as csv, json or parquet. A connector without a folder is not connected, which is unknown and not zero; a
row that does not fit the columns keeps its text in _corrupt; of a key that several exports hold, the last export counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Export:
    """columns: agreed DDL, without the export's day; key: what a row is known by; fresh_days: how old the last export may be."""

    name: str
    kind: str
    columns: str
    key: tuple[str, ...]
    fresh_days: int


# The thirteen connectors of the road map, by what they give. None asks for content of notes, names or card numbers.
EXPORTS = (
    Export("web_analytics", "csv", "date date, source string, page string, visits long, signups long, payments long", ("date", "source", "page"), 2),
    Export("billing", "csv", "date date, account string, plan string, amount decimal(18,2), status string", ("date", "account", "plan"), 2),
    Export("app_analytics", "json", "date date, product string, active long, installs long, crashes long, sessions long", ("date", "product"), 2),
    Export("store_first", "csv", "date date, installs long, rating double, reviews long", ("date",), 7),
    Export("store_second", "csv", "date date, installs long, removals long, crashes long, rating double, reviews long", ("date",), 7),
    Export("store_third", "csv", "date date, installs long, listing_views long, crashes long, rating double, reviews long", ("date",), 7),
    Export("support_mail", "json", "message_id string, received timestamp, theme string, answered timestamp", ("message_id",), 2),
    Export("channels", "json", "update_id long, chat_id long, ts timestamp, kind string", ("update_id",), 2),
    Export("payment_provider", "csv", "payment_id string, ts timestamp, amount decimal(18,2), status string, refused_for string", ("payment_id",), 2),
    Export("helpdesk", "json", "ticket_id string, opened timestamp, closed timestamp, tags array<string>, reopened int", ("ticket_id",), 2),
    Export("uptime", "parquet", "ts timestamp, target string, ok boolean, p95 double, errors long", ("ts", "target"), 1),
    Export("social", "csv", "date date, account string, reach long, engaged long", ("date", "account"), 7),
    Export("mentions", "json", "mention_id string, ts timestamp, venue string, tone string, topic string", ("mention_id",), 7),
)
BY_NAME = {e.name: e for e in EXPORTS}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """All exports of a connector: its columns, `day` (of the export) and `_corrupt`; None if it is not connected. Columns beyond the agreed ones are not read."""
    e, path = BY_NAME[name], f"{root.rstrip('/')}/{name}"
    if not _exists(spark, path):
        return None
    if e.kind == "parquet":
        return spark.read.schema(f"{e.columns}, day date").parquet(path).withColumn("_corrupt", F.lit(None).cast("string"))
    reader = spark.read.schema(f"{e.columns}, _corrupt string, day date").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    rows = reader.option("header", True).csv(path) if e.kind == "csv" else reader.json(path)
    # A row is judged by all its columns, whichever are asked for: a reader leaves out what nobody reads, and what does not fit there.
    every = F.concat_ws("", *[F.to_json(F.struct(F.col(c))) for c in rows.columns if c not in ("_corrupt", "day")])
    return rows.withColumn("_corrupt", F.when(F.length(every) >= 0, F.col("_corrupt")))


def latest(rows: DataFrame, name: str) -> DataFrame:
    """The rows of a connector, each key as its last export has it; corrupt rows and rows without a key are left out."""
    e = BY_NAME[name]
    columns = [f for f in rows.columns if f not in ("day", "_corrupt", *e.key)]
    whole = rows.where(F.col("_corrupt").isNull()).dropna(how="any", subset=list(e.key))
    best = whole.groupBy(*e.key).agg(F.max_by(F.struct(*columns) if columns else F.lit(None), "day").alias("r"))
    return best.select(*e.key, *[F.col(f"r.{c}").alias(c) for c in columns])


def status(spark: SparkSession, root: str, as_of: Column) -> DataFrame:
    """(connector, state, last_day, n, keyless, corrupt) of all thirteen: not_connected, empty, stale or ok; n rows can be used, keyless ones cannot be told apart. Numbers of what is not connected are null."""
    out = None
    for e in EXPORTS:
        rows = read(spark, root, e.name)
        if rows is None:
            one = spark.range(1).select(F.lit(e.name).alias("connector"), F.lit("not_connected").alias("state"), F.lit(None).cast("date").alias("last_day"), *[F.lit(None).cast("long").alias(c) for c in ("n", "keyless", "corrupt")])
        else:
            fits, keyed = F.col("_corrupt").isNull(), F.lit(True)
            for k in e.key:
                keyed = keyed & F.col(k).isNotNull()
            told = rows.select("day", "_corrupt", *e.key).agg(F.max("day").alias("last_day"), F.count_if(fits & keyed).alias("n"), F.count_if(fits & ~keyed).alias("keyless"), F.count("_corrupt").alias("corrupt"))
            state = F.when(F.col("last_day").isNull(), "empty").when(F.date_diff(as_of, F.col("last_day")) > e.fresh_days, "stale").otherwise("ok")
            one = told.select(F.lit(e.name).alias("connector"), state.alias("state"), "last_day", "n", "keyless", "corrupt")
        out = one if out is None else out.unionByName(one)
    return out
