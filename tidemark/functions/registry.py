"""The event registry: which product may send which event with which fields. Closed world: what is not listed is rejected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ANY = "*"


@dataclass(frozen=True)
class Field:
    name: str
    type: str  # string, number or boolean; enumerations are strings with a list of values
    required: bool = False
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Event:
    product: str
    name: str
    question: str
    fields: tuple[Field, ...] = ()


# Event names by area. Linking and consent belong to every product.
EVENTS: dict[str, tuple[str, ...]] = {
    "billing": ("payment_initiated", "payment_succeeded", "payment_failed", "subscription_started", "subscription_renewed", "subscription_churned"),
    ANY: ("identity_linked", "consent_updated"),
    "booking": ("booking_link_opened", "booking_time_selected", "booking_form_started", "booking_consent_shown", "booking_completed", "booking_created_by"),
    "notes": ("note_saved", "note_searched", "sync_completed", "export_requested"),
    "practice": ("app_installed", "first_open", "practice_opened", "practice_started", "practice_finished", "content_saved", "notification_opt_in", "crossed_to_product"),
    "feedback": ("prompted", "opened", "submitted", "cancelled", "replied", "resolved", "loop_closed"),
}

SCHEMA = T.StructType([T.StructField("product", T.StringType()), T.StructField("event", T.StringType()), T.StructField("field", T.StringType()), T.StructField("type", T.StringType()), T.StructField("required", T.BooleanType()), T.StructField("question", T.StringType())])


def load(events: list[Event]) -> list[Event]:
    """The registry does not load with an event that answers no question, or with one that is listed twice."""
    seen = set()
    for e in events:
        if not e.question.strip():
            raise ValueError(f"{e.product}/{e.name} answers no question")
        if (e.product, e.name) in seen:
            raise ValueError(f"{e.product}/{e.name} is listed twice")
        seen.add((e.product, e.name))
    return events


def table(spark: SparkSession, events: list[Event]) -> DataFrame:
    """A row per field; an event without fields has one row with a null field."""
    rows = [(e.product, e.name, f.name if f else None, f.type if f else None, f.required if f else False, e.question) for e in load(events) for f in (e.fields or (None,))]
    return spark.createDataFrame(rows, SCHEMA)
