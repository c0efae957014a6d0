"""A polled message source: updates with a rising update_id, from JSON lines as they land in a folder.

message_stream() reads any path that Spark reaches, in tasks, and lets the checkpoint know which files are done. PolledMessages is a source of its own for a
spool that all machines mount: files whose names rise, to the last of which whole lines are appended. It asks for what follows an offset, as a poll does, in batches of bounded size; the driver
looks at names and sizes only, and tasks read the lines.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "update_id long, chat_id long, author string, text string"
UPDATE = "update_id long, message struct<text: string, chat: struct<id: long>, `from`: struct<first_name: string>>"
#: Where an update holds each column of SCHEMA.
PLACES = {"update_id": "update_id", "chat_id": "message.chat.id", "author": "message.from.first_name", "text": "message.text"}


def message_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """(update_id, chat_id, author, text) of a folder's files as a stream. A line that is no JSON or has no update_id is skipped; files_per_batch holds back a backlog."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.text(path).select(F.from_json("value", UPDATE).alias("u")).where("u.update_id is not null")
    return rows.select(*[F.col(f"u.{place}").alias(name) for name, place in PLACES.items()])


def flat(update: dict) -> tuple:
    """The columns of SCHEMA; what is missing is null."""
    row = []
    for place in PLACES.values():
        value = update
        for key in place.split("."):
            value = value.get(key) if isinstance(value, dict) else None
        row.append(value)
    return tuple(row)


class Stretch(InputPartition):
    """The lines of a file that begin at a byte from begin up to end."""

    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end

    def lines(self) -> Iterator[bytes]:
        with open(self.path, "rb") as f:
            f.seek(max(0, self.begin - 1))
            if self.begin and f.read(1) != b"\n":
                f.readline()  # began before
            while f.tell() < self.end and (line := f.readline()):
                yield line


class PolledReader(DataSourceStreamReader):
    """Asks for what follows the offset: a file's name and a byte in it; files of earlier names are done.

    An offset can only be bounded from where the last one ended. Spark does not say that when it asks, so what was planned last is kept in the folder
    `progress`, one for each query. A crash between planning and Spark's own log makes the next batch twice as large at most; no line is lost or read twice, as Spark's log alone says where a batch begins.
    """

    def __init__(self, path: str, split: int, most: int | None, progress: str | None):
        if most is not None and not progress:
            raise ValueError("maxBytesPerBatch needs a folder of the query's own as `progress`")
        self.path, self.split, self.most, self.progress = path, split, most, progress

    def initialOffset(self) -> dict:
        return {"file": "", "at": 0}

    def _planned(self) -> dict:
        at = os.path.join(self.progress, "planned.json")
        if not os.path.exists(at):
            return self.initialOffset()
        with open(at, encoding="utf-8") as f:
            return json.load(f)

    def _plan(self, offset: dict) -> dict:
        os.makedirs(self.progress, exist_ok=True)
        at = os.path.join(self.progress, "planned.json")
        with open(f"{at}.new", "w", encoding="utf-8") as f:
            json.dump(offset, f)
        os.replace(f"{at}.new", at)
        return offset

    def _files(self, start: dict) -> list[tuple[str, int, int]]:
        """(name, first byte, size) of what may follow the offset, by name."""
        if not os.path.isdir(self.path):
            return []
        with os.scandir(self.path) as found:
            files = sorted((e.name, e.stat().st_size) for e in found if e.is_file() and e.name >= start["file"] and not e.name.startswith((".", "_")))
        return [(name, start["at"] if name == start["file"] else 0, size) for name, size in files]

    def latestOffset(self) -> dict:
        start = self._planned() if self.most is not None else self.initialOffset()
        end, left = start, self.most
        for name, begin, size in self._files(start):
            take = max(0, size - begin) if left is None else min(max(0, size - begin), left)
            end = {"file": name, "at": begin + take}
            if left is not None:
                left -= take
                if not left:
                    break
        return end if self.most is None else self._plan(end)

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for name, begin, size in self._files(start):
            if name > end["file"]:
                break
            upto = min(size, end["at"]) if name == end["file"] else size
            out += [Stretch(os.path.join(self.path, name), at, min(at + self.split, upto)) for at in range(begin, upto, self.split)]
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        """A line that is no JSON or has no update_id is skipped, as a poll would not return it."""
        for line in partition.lines():
            try:
                row = flat(json.loads(line))
            except (ValueError, AttributeError):
                continue
            if isinstance(row[0], int):
                yield row


class PolledMessages(DataSource):
    """spark.dataSource.register(PolledMessages); spark.readStream.format("polled_messages").load(folder)

    Options: splitBytes, what a task reads; maxBytesPerBatch, what a batch takes of a backlog, and with it progress, a folder of the query's own.
    """

    @classmethod
    def name(cls) -> str:
        return "polled_messages"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> PolledReader:
        most = self.options.get("maxBytesPerBatch")
        return PolledReader(self.options["path"], int(self.options.get("splitBytes", 4 << 20)), int(most) if most else None, self.options.get("progress"))
