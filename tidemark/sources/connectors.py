"""Readers and sinks: payments, exports, partitioned tables and marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What of a payment is kept. Identifiers that can charge a card again are never read.
PAYMENT = "order_id string, ts timestamp, status string, amount decimal(18,2), plan string, months int, terminal string"
BILLING_CSV = "day date, account string, plan string, amount decimal(18,2), status string"
GAUGE = "ts timestamp, metric string, entity string, value double"


def signed(secret: str, *columns: str) -> Column:
    """The signature that a caller who knows the secret would send: SHA-256 over the columns and the secret. Null columns are empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns], F.lit(secret)), 256)


def verified(calls: DataFrame, secret: str, columns: tuple[str, ...] = ("order_id", "ts", "status", "amount")) -> DataFrame:
    """Webhook calls plus `code`: 200 where the signature agrees, else 400; only the former are to be written."""
    ok = F.coalesce(F.lower("signature") == signed(secret, *columns), F.lit(False))
    return calls.withColumn("code", F.when(ok, 200).otherwise(400))


def backfill(registry: DataFrame, stored: DataFrame, key: str = "order_id") -> DataFrame:
    """What a registry holds and the table lacks: the rows to append."""
    return registry.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def read_billing_csv(spark: SparkSession, path: str) -> DataFrame:
    """The agreed columns; a row that does not fit them keeps its text in _corrupt."""
    return spark.read.schema(f"{BILLING_CSV}, _corrupt string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)


def append_by_month(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """The append-only table; filters on `month` prune its folders."""
    rows.withColumn("month", F.date_format(ts, "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)


def write_mart(rows: DataFrame, path: str, day: str = "day") -> None:
    """Replace the days that rows hold and leave the others: a daily build can run again."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def append_gauges(rows: DataFrame, path: str) -> None:
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def expired_days(spark: SparkSession, path: str, keep_days: int, today: str) -> list[str]:
    """Day folders older than the time to live. Folder names only; a table has one per day."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    limit = str(spark.range(1).select(F.date_sub(F.to_date(F.lit(today)), keep_days)).first()[0])
    return sorted(n for n in names if n.startswith("day=") and n[4:] < limit)


def drop_expired(spark: SparkSession, path: str, keep_days: int, today: str) -> int:
    """Delete them; the number of days dropped."""
    gone = expired_days(spark, path, keep_days, today)
    for name in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(gone)


def persist_cohorts(sizes: DataFrame, path: str) -> DataFrame:
    """Append cohorts (cohort, size) not stored yet and give all stored ones: a size is fixed at entry and outlives the events behind it."""
    spark = sizes.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        sizes.join(spark.read.schema(sizes.schema).parquet(path).select("cohort"), "cohort", "left_anti").write.mode("append").parquet(path)
    else:
        sizes.write.parquet(path)
    return spark.read.schema(sizes.schema).parquet(path)


def read_export(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """An export of any connected source (parquet, csv or json) with its agreed schema; columns beyond it are not read."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if kind == "csv" else getattr(reader, {"parquet": "parquet", "json": "json"}[kind])(path)


def without_nulls(fields: Column) -> Column:
    """A map of outgoing fields without those that are not set."""
    return F.map_filter(fields, lambda _, v: v.isNotNull())
