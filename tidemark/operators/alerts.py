"""Threshold rules over a table of metric values.

A breach counts only with enough data; below the minimum it is an observation. Green means verified: a value that is not
there is `not_checked`, and one that is old is `stale`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPS = ("below", "above", "at_least", "drop_pct", "drop_pp", "drop_abs", "rise_factor", "rise_pp")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    metric: str
    op: str
    threshold: float
    min_n: int | None
    priority: str


# Thresholds, minimum data and priorities of the catalogue. A row with "or" is two rules.
RULES = (
    Rule("M01", "renewal_success", "below", 90.0, 20, "P0"),
    Rule("M02", "renewal_success", "drop_pp", 10.0, 20, "P0"),
    Rule("M03", "first_payment_success", "drop_pp", 15.0, 20, "P0"),
    Rule("M04", "trial_conversion", "below", 10.0, 30, "P0"),
    Rule("M05", "trial_conversion_two_in_band", "at_least", 1.0, 30, "P1"),
    Rule("M06", "mrr", "drop_abs", 0.0, 30, "P0"),
    Rule("M07", "account_churn", "above", 8.0, 30, "P1"),
    Rule("M08", "involuntary_churn", "above", 25.0, 10, "P1"),
    Rule("M09", "arpu", "below", 1000.0, 30, "P1"),
    Rule("M10", "ltv_cac", "below", 2.9, None, "P1"),
    Rule("M11", "refunds_week", "above", 3.0, None, "P1"),
    Rule("P01", "sessions_week", "drop_pct", 20.0, 4, "P0"),
    Rule("P02", "sessions_stalled_3w", "at_least", 1.0, 6, "P1"),
    Rule("P03", "activation", "drop_pp", 15.0, 30, "P1"),
    Rule("P04", "note_coverage", "drop_pp", 15.0, 50, "P1"),
    Rule("P05", "wau_mau", "below", 50.0, 50, "P1"),
    Rule("P06", "retention_d1", "drop_pp", 10.0, 100, "P1"),
    Rule("P07", "retention_d7", "drop_pp", 7.0, 100, "P1"),
    Rule("P08", "unfinished_share", "above", 40.0, 100, "P2"),
    Rule("P09", "installs_week", "drop_pct", 30.0, 4, "P2"),
    Rule("P10", "cancelled_share", "rise_pp", 10.0, 100, "P2"),
    Rule("R01", "uptime", "below", 99.0, None, "P0"),
    Rule("R02", "p95_to_norm", "above", 2.0, 1000, "P1"),
    Rule("R03", "crash_free_sessions", "below", 99.0, 500, "P0"),
    Rule("R04", "crash_free_users", "drop_pp", 1.0, 500, "P1"),
    Rule("R05", "calendar_sync_errors", "above", 5.0, 100, "P1"),
    Rule("R06", "undelivered_reminders", "above", 3.0, 100, "P0"),
    Rule("T01", "tickets_per_100", "rise_factor", 2.0, 10, "P1"),
    Rule("T02", "privacy_tickets", "at_least", 1.0, 1, "P0"),
    Rule("T03", "data_incidents", "at_least", 1.0, 1, "P0"),
    Rule("T04", "negative_share", "above", 20.0, 10, "P1"),
    Rule("T05", "negative_burst_24h", "at_least", 3.0, 3, "P0"),
    Rule("T06", "store_rating", "below", 4.0, 20, "P1"),
    Rule("T07", "store_rating", "drop_abs", 0.3, 20, "P1"),
    Rule("T08", "overdue_tickets", "at_least", 3.0, 3, "P1"),
    Rule("T09", "cancellations_after_release", "rise_factor", 2.0, 10, "P0"),
    Rule("S01", "silent_days", "at_least", 3.0, None, "P1"),
    Rule("S02", "silent_days", "at_least", 7.0, None, "P0"),
    Rule("S03", "contradiction_factor", "above", 2.0, None, "P1"),
)
# The panel's second scale, as (metric, direction, amber, red).
PANEL = (
    ("billing_success", "below", 92.0, 85.0),
    ("disk_free", "below", 20.0, 10.0),
    ("certificate_days", "below", 21.0, 7.0),
    ("backup_age_hours", "above", 26.0, 48.0),
)


def table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return spark.createDataFrame([(r.rule_id, r.metric, r.op, r.threshold, r.min_n, r.priority) for r in rules], "rule_id string, metric string, op string, threshold double, min_n int, priority string")


def breached() -> Column:
    v, p, t, op = F.col("value"), F.col("prev"), F.col("threshold"), F.col("op")
    return (
        F.when(op == "below", v < t).when(op == "above", v > t).when(op == "at_least", v >= t)
        .when(op == "drop_pct", F.try_divide(p - v, p) * 100 > t).when(op == "rise_factor", v > p * t)
        .when(op == "drop_pp", p - v > t).when(op == "rise_pp", v - p > t)
        .when(op == "drop_abs", F.when(t > 0, p - v >= t).otherwise(v < p))
    )


def latest(values: DataFrame, as_of: Column) -> DataFrame:
    """The last value of each metric that was known on a day; of several in one period the largest."""
    best = values.where(F.col("period") <= as_of).groupBy("metric").agg(F.max(F.struct("period", "value", "prev", "n")).alias("b"))
    return best.select("metric", "b.*")


def evaluate(rules: DataFrame, values: DataFrame, as_of: Column | None = None, fresh_days: int = 2) -> DataFrame:
    """(rule_id, metric, period, value, state, priority); values: (metric, period, value, prev, n).

    Every rule has a row for every period of its metric, and one without a period if the metric is missing altogether. A missing
    minimum is no minimum; a missing previous value cannot breach a rule that compares.
    """
    joined = rules.join(values, "metric", "left")  # values are series, a row per period, and are made once
    hit = F.coalesce(breached(), F.lit(False))
    enough = F.coalesce(F.col("n") >= F.col("min_n"), F.col("min_n").isNull(), F.lit(False))
    state = F.when(F.col("value").isNull(), "not_checked")
    if as_of is not None:
        state = state.when(F.date_diff(as_of, F.col("period")) > fresh_days, "stale")
    state = state.when(hit & enough, "breach").when(hit, "observation").otherwise("ok")
    return joined.select("rule_id", "metric", "period", "value", state.alias("state"), F.when(state == "breach", F.col("priority")).alias("priority"))


def panel(values: DataFrame) -> DataFrame:
    """(metric, value, level): green, amber, red or not_checked. green is said only of a value that is there."""
    level = F.lit(None).cast("string")
    for metric, way, amber, red in PANEL:
        v, here = F.col("value"), F.col("metric") == metric
        worse = (lambda a, b: a < b) if way == "below" else (lambda a, b: a > b)
        level = F.when(here, F.when(v.isNull(), "not_checked").when(worse(v, red), "red").when(worse(v, amber), "amber").otherwise("green")).otherwise(level)
    return values.select("metric", "value", F.coalesce(level, F.lit("not_checked")).alias("level"))
