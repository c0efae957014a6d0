"""Structured text as tables: decks, ledgers and inbox blocks.

A document is one row, and all that its text holds is cut out within that row, by functions over arrays of its lines: nothing is
shuffled, and a row stands for itself whatever its doc_id. Malformed text is kept and flagged, never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of whole files; none where the path holds none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    if found is None or not len(found):
        return spark.createDataFrame([], "doc_id string, text string")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


# The keys of a deck's meta lines.
META = ("title", "date", "meeting")
_META_LINE = rf"^@({'|'.join(META)}) "


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, all): the trimmed lines of each text, line ends normalised."""
    return docs.select("doc_id", F.transform(F.split(X.newlines(F.col("text")), "\n", -1), X.strip).alias("all"))


def _said(key: str) -> Column:
    """The value of the last meta line of a key, empty without one."""
    last = F.try_element_at(F.filter("all", lambda s: F.startswith(s, F.lit(f"@{key} "))), F.lit(-1))
    return F.coalesce(X.strip(F.substring(last, len(key) + 3, 1_000_000_000)), F.lit(""))


def meta(docs: DataFrame) -> DataFrame:
    """(doc_id, title, date, meeting): @-lines from anywhere in a document; the last one counts, a missing one is empty."""
    return _lines(docs).select("doc_id", *[_said(k).alias(k) for k in META])


def decks(docs: DataFrame) -> DataFrame:
    """(doc_id, title, date, meeting, slides): slides without empty ones, each an array of (kind, s) for its lines but meta lines. Slides end at lines of dashes."""
    kind = lambda s: F.when(F.rlike(s, F.lit(r"^-{3,}$")), F.lit("rule")).otherwise(X.line_kind(s))
    body = F.transform(F.filter("all", lambda s: ~F.rlike(s, F.lit(_META_LINE))), lambda s: F.struct(kind(s).alias("kind"), s.alias("s")))
    rows = _lines(docs).select("doc_id", *[_said(k).alias(k) for k in META], body.alias("body"))
    ends = F.filter(F.sequence(F.lit(0), F.size("body")), lambda i: (i == F.size("body")) | (F.get("body", i)["kind"] == "rule"))
    rows = rows.withColumn("ends", ends)
    begin = lambda j: F.coalesce(F.get("ends", j - 1) + 1, F.lit(0))
    parts = F.transform("ends", lambda end, j: F.slice("body", begin(j) + 1, end - begin(j)))
    return rows.select("doc_id", *META, F.filter(parts, lambda p: F.exists(p, lambda x: x["kind"] != "blank")).alias("slides"))


def _item(x: Column) -> Column:
    """What a line says without its prefix."""
    s, kind = x["s"], x["kind"]
    cut = lambda n: X.strip(F.substring(s, n, 1_000_000_000))
    return (
        F.when(F.startswith(s, F.lit("# ")), cut(3)).when(F.startswith(s, F.lit("## ")), cut(4)).when(kind == "bullets", cut(3)).when(kind == "metrics", cut(9))
        .when(kind == "status", cut(9)).when(kind == "human", X.strip(F.regexp_replace(cut(7), "^:+", ""))).when(kind == "note", cut(3)).otherwise(s)
    )


def with_blocks(slides: DataFrame, lines: str) -> DataFrame:
    """A table with a slide's lines in each row, and its `blocks`: an array of (kind, items) instead.

    Neighbouring lines of a kind make a block; a blank line, a title, a subtitle and a status end one. The
    first title of a slide is its `title`; a further one is a subtitle, so that crooked input loses no text.
    """
    more = [c for c in slides.columns if c != lines]
    rows = slides.withColumn("_first", F.array_position(F.transform(lines, lambda x: x["kind"]), "title"))
    rows = rows.select(*more, F.transform(lines, lambda x, i: F.struct(F.when((x["kind"] == "title") & (i + 1 != F.col("_first")), F.lit("sub")).otherwise(x["kind"]).alias("kind"), _item(x).alias("item"))).alias("_rows"))
    begins = lambda i: (i == 0) | (F.get("_rows", i)["kind"] != F.get("_rows", i - 1)["kind"]) | F.get("_rows", i)["kind"].isin("title", "sub", "status")
    rows = rows.withColumn("_starts", F.filter(F.sequence(F.lit(0), F.size("_rows") - 1), begins))
    runs = F.transform("_starts", lambda at, j: F.slice("_rows", at + 1, F.coalesce(F.get("_starts", j + 1), F.size("_rows")) - at))
    full = F.filter(runs, lambda run: F.get(run, F.lit(0))["kind"] != "blank")
    return rows.select(*more, F.transform(full, lambda run: F.struct(F.get(run, F.lit(0))["kind"].alias("kind"), F.transform(run, lambda x: x["item"]).alias("items"))).alias("blocks"))


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, slide, block, kind, item_no, item): the content of decks, a row per item. Slides and blocks are numbered without empty ones."""
    # Outer, as before an inner explode the optimiser puts a filter on the array's size, and makes all of the array a second time for it.
    slides = with_blocks(decks(docs).select("doc_id", F.posexplode_outer("slides").alias("pos", "lines")).where("pos is not null"), "lines")
    rows = slides.select("doc_id", (F.col("pos") + 1).alias("slide"), F.posexplode_outer("blocks").alias("b", "of")).where("b is not null")
    rows = rows.select("doc_id", "slide", (F.col("b") + 1).alias("block"), "of.kind", F.posexplode_outer("of.items").alias("i", "item"))
    return rows.select("doc_id", "slide", "block", "kind", (F.col("i") + 1).alias("item_no"), "item")


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, entry, header, fields): ledger entries in the order of the text, newest first, with their `**Key:** value` lines."""
    split = F.slice(F.split(X.newlines(F.col("text")), "\n#### ", -1), F.lit(2), F.lit(1_000_000_000))
    rows = docs.select("doc_id", F.posexplode(split).alias("entry", "body"))
    lines = F.split("body", "\n", -1)
    pairs = F.filter(F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"\*\*([^*:]+):\*\*", 1).alias("k"), F.regexp_extract(x, r"\*\*[^*:]+:\*\*[ \t]*(.*)$", 1).alias("v"))), lambda p: p["k"] != "")
    firsts = F.aggregate(pairs, F.expr("cast(map() as map<string,string>)"), lambda m, p: F.when(F.map_contains_key(m, p["k"]), m).otherwise(F.map_concat(m, F.create_map(p["k"], p["v"]))))
    return rows.select("doc_id", "entry", F.get(lines, F.lit(0)).alias("header"), firsts.alias("fields"))


def inbox(docs: DataFrame) -> DataFrame:
    """(doc_id, day, block, metric, value, source, malformed, free): blocks `## date · TYPE` with a table of metric, value, source.

    `—` is unknown and becomes null, `0` stays zero; a block without a table is one row that was looked at and had nothing, with its
    text kept; a header that names no date or no type is malformed.
    """
    split = F.slice(F.split(F.concat(F.lit("\n"), X.newlines(F.col("text"))), "\n## ", -1), F.lit(2), F.lit(1_000_000_000))
    rows = docs.select("doc_id", F.posexplode(split).alias("n", "body"))
    head = F.get(F.split("body", "\n", 2), F.lit(0))
    day = F.try_to_date(F.nullif(F.regexp_extract(head, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")))
    kind = F.nullif(F.regexp_extract(head, r"· *([A-Z]+)", 1), F.lit(""))
    cells = X.table_rows(F.col("body"))
    data = F.when(X.has_header(cells), F.slice(cells, F.lit(3), F.greatest(F.size(cells) - 2, F.lit(0))))
    data = F.when(F.size(data) > 0, data).otherwise(F.array(F.expr("cast(null as array<string>)")))
    rows = rows.select("doc_id", day.alias("day"), kind.alias("block"), "body", F.explode(data).alias("c"))
    unknown = lambda c: F.when(~c.isin("—", "-", ""), c)
    bad = F.col("day").isNull() | F.col("block").isNull() | (F.col("c").isNotNull() & (F.size("c") < 3))
    return rows.select("doc_id", "day", "block", F.get("c", F.lit(0)).alias("metric"), unknown(F.get("c", F.lit(1))).alias("value"), unknown(F.get("c", F.lit(2))).alias("source"), bad.alias("malformed"), F.when(F.col("c").isNull() | bad, F.col("body")).alias("free"))
