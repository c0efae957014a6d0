"""Cutting long text into messages: the one table function that built-in expressions cannot say."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate, groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4096


def stretches(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of the longest stretches of neighbours that, with a character between each two, hold at most `limit`; none begins with an empty one.

    Running totals rise, so where a stretch ends is a binary search. No size is above the limit.
    """
    totals, at = list(accumulate((n + 1 for n in sizes), initial=0)), 0
    while at < len(sizes):
        if sizes[at]:
            end = bisect_right(totals, totals[at] + limit + 1) - 1
            yield at, end
            at = end
        else:
            at += 1


def joined(items: Sequence[str], by: str, limit: int) -> Iterator[str]:
    yield from (by.join(items[a:b]) for a, b in stretches([len(x) for x in items], limit))


def pieces(text: str | None, limit: int = LIMIT) -> list[str]:
    """Lines packed greedily into parts of at most `limit` characters; parts of white space only are dropped, a short text stays as it is.

    A line that is too long is packed by words on its own, and a word that is too long by stretches of `limit`.
    """
    if not text or len(text) <= limit:
        return [text] if text else []
    out: list[str] = []
    for long, lines in groupby(text.split("\n"), key=lambda line: len(line) > limit):
        if long:
            for line in lines:
                words = [word[i : i + limit] for word in line.split(" ") for i in range(0, max(len(word), 1), limit)]
                out.extend(joined(words, " ", limit))
        else:
            out.extend(part.rstrip("\n") for part in joined(list(lines), "\n", limit) if part.strip())
    return out


def split_text(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, part, text) of (doc_id, text), in Arrow batches; a row is read whole and its parts are written one by one."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, nos, texts = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, part in enumerate(pieces(text, limit)):
                    ids.append(doc)
                    nos.append(i)
                    texts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), pa.array(texts, pa.string())], ["doc_id", "part", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, part int, text string")
