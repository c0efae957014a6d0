"""The order ledger: what a message becomes, its number, and what is still open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.functions import text as X
from tidemark.operators import sets

# Commands that address the board, the product chief, and the bot itself.
ADDRESSEES = {"борд": "БОРД", "board": "БОРД", "цпо": "CPO", "cpo": "CPO"}
HELP, QUEUE = ("start", "помощь", "help"), ("очередь", "queue")
# First words of the states of an open order.
OPEN = ("принято", "в")
QUEUE_LENGTH = 15


def verdicts(messages: DataFrame, allowed: Column, addressees: dict[str, str] | None = None) -> DataFrame:
    """messages (update_id, chat_id, author, text) plus verdict, addressee, urgent and body; the first test that holds counts.

    A stranger gets no answer; null and blank texts are blank.
    """
    table = addressees or ADDRESSEES
    text = F.coalesce("text", F.lit(""))
    rows = messages.withColumns({"_cmd": X.command(text), "_rest": X.rest(text), "_blank": X.strip(text) == ""})
    cmd, rest = F.col("_cmd"), F.col("_rest")
    name = F.coalesce(*[F.when(cmd == k, F.lit(v)) for k, v in table.items()])
    rows = rows.withColumns({"_name": name, "_urgent": X.urgent(rest)})
    verdict = (
        F.when(~F.coalesce(allowed, F.lit(False)), "stranger").when(F.col("_blank"), "blank").when(cmd.isNull() | cmd.isin(*HELP), "help").when(cmd.isin(*QUEUE), "queue")
        .when(F.col("_name").isNull(), "unknown").when(rest == "", "empty").otherwise("accepted")
    )
    rows = rows.withColumn("verdict", verdict)
    ok, urgent = F.col("verdict") == "accepted", F.col("_urgent")
    rows = rows.withColumn("_plain", F.when(urgent, X.without_urgency(rest)).otherwise(rest))
    rows = rows.withColumns({"addressee": F.when(ok, F.col("_name")), "urgent": F.when(ok, urgent), "command": cmd, "body": F.when(ok, X.sanitize(F.col("_plain")))})
    return rows.drop("_cmd", "_rest", "_blank", "_name", "_urgent", "_plain")


def next_ids(accepted: DataFrame, existing: DataFrame, day: Column, order: str, prefix: str = "O") -> DataFrame:
    """accepted plus order_id PREFIX-YYMMDD-NN, numbered within the day after the largest number in existing (order_id)."""
    used = existing.select(F.regexp_extract("order_id", rf"^{prefix}-(\d{{6}})-(\d+)$", 1).alias("_d"), F.regexp_extract("order_id", rf"^{prefix}-(\d{{6}})-(\d+)$", 2).alias("_n")).where("_d <> ''")
    top = used.groupBy("_d").agg(F.max(F.col("_n").cast("int")).alias("_top"))
    rows = accepted.withColumn("_day", calendar.compact(day))
    rows = sets.numbered(rows, ["_day"], order, "_place").join(top, F.col("_day") == F.col("_d"), "left")
    n = F.coalesce("_top", F.lit(0)) + F.col("_place")
    number = F.when(n < 100, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
    return rows.withColumn("order_id", F.concat_ws("-", F.lit(prefix), "_day", number)).drop("_day", "_d", "_top", "_place")


def open_orders(entries: DataFrame, n: int | None = None) -> DataFrame:
    """Open entries of a ledger (doc_id, entry, header, fields) with their addressee, newest first; n is the length of the queue."""
    field = lambda k: F.regexp_extract(F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit("")), r"(?U)^\s*(\S+)", 1)
    rows = entries.where(field("Статус").isin(*OPEN)).select("doc_id", "entry", "header", F.coalesce(F.nullif(field("Адресат"), F.lit("")), F.lit("—")).alias("addressee"))
    return rows.orderBy("doc_id", "entry").limit(n) if n else rows


def queue(stored: DataFrame, pending: DataFrame, n: int = QUEUE_LENGTH) -> DataFrame:
    """(header, addressee) of the n first open orders of one ledger: stored entries (doc_id, entry, header, fields) in their order, then pending ones (order_id, body, addressee) by number."""
    old = open_orders(stored).select(F.lit(0).alias("_new"), F.col("entry").cast("string").alias("_at"), F.col("entry").cast("long").alias("_n"), "header", "addressee")
    header = F.concat("order_id", F.lit(" · "), X.first_line(F.col("body")))
    new = pending.select(F.lit(1).alias("_new"), F.col("order_id").alias("_at"), F.lit(0).cast("long").alias("_n"), header.alias("header"), "addressee")
    return old.unionByName(new).orderBy("_new", "_n", "_at").limit(n).select("header", "addressee")


def render(order_id: Column, addressee: Column, urgent: Column, body: Column, when: Column, author: Column) -> Column:
    """A ledger entry as text."""
    priority = F.when(urgent, "P0 · срочно").otherwise("обычный")
    return F.concat(F.lit("\n#### "), order_id, F.lit(" · "), X.first_line(body), F.lit("\n- **Адресат:** "), addressee, F.lit("\n- **Принято:** "), when, F.lit(" от "), author, F.lit("\n- **Приоритет:** "), priority, F.lit("\n- **Статус:** принято\n- **Распоряжение:**\n"), X.quote(body), F.lit("\n"))


# The heading under which open orders stand, and what stands there while there are none.
MARKER, PLACEHOLDER = "## Открытые", r"^\s*\n_пусто_\n"


def insert(ledger: Column, additions: Column) -> Column:
    """A ledger's text with additions right below the heading, above older ones; the placeholder goes. Null if there is no such heading."""
    at = F.instr(ledger, MARKER)
    head = F.substring(ledger, 1, at + len(MARKER) - 1)
    tail = F.regexp_replace(F.substring(ledger, at + len(MARKER), F.length(ledger)), PLACEHOLDER, "\n")
    return F.when(at > 0, F.concat(head, additions, tail))


def chat_labels(updates: DataFrame) -> DataFrame:
    """(chat_id, label): the last name seen of each chat."""
    return updates.groupBy("chat_id").agg(F.max_by("author", "update_id").alias("label"))
