"""The text rules as Column expressions over slides: one row per finding. A deck is read, cut and judged within its row; nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import phrases as P
from tidemark.functions import text as X
from tidemark.sources import markdown

ERROR, NOTE = "error", "note"
#: Of a level and a rule, whether it is asked for.
Wanted = Callable[[str, str], bool]


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def item_text(kind: Column, item: Column) -> Column:
    """What the rules read of an item: the values of a metric or status as one line."""
    said = lambda *keys: lambda x: F.concat_ws(" ", *[F.nullif(x[k], F.lit("")) for k in keys])
    metric = X.let(X.metric_tile(item), said("name", "value", "delta", "dir", "note"))
    state = X.let(X.status(item), said("color", "text"))
    return F.when(kind == "metrics", metric).when(kind == "status", state).otherwise(item)


def slides(rows: DataFrame) -> DataFrame:
    """A table with a slide's `blocks` in each row, and what rules read instead: title, items, text, kinds and sizes; items keep their order, sizes are the lengths of bullet blocks."""
    more = [c for c in rows.columns if c != "blocks"]
    none = F.expr("cast(array() as array<string>)")
    titles = F.filter("blocks", lambda b: b["kind"] == "title")
    body = F.filter("blocks", lambda b: b["kind"] != "title")
    items = F.flatten(F.transform(body, lambda b: F.transform(b["items"], lambda x: F.struct(b["kind"].alias("kind"), item_text(b["kind"], x).alias("text")))))
    rows = rows.select(
        *more, F.coalesce(F.get(F.get(titles, F.lit(0))["items"], F.lit(0)), F.lit("")).alias("title"), F.filter(items, lambda e: X.strip(e["text"]) != "").alias("items"),
        F.transform(body, lambda b: b["kind"]).alias("kinds"), F.transform(F.filter("blocks", lambda b: b["kind"] == "bullets"), lambda b: F.size(b["items"])).alias("sizes"),
    )
    text = F.array_join(F.concat(F.when(F.col("title") != "", F.array("title")).otherwise(none), F.transform("items", lambda e: e["text"])), "\n")
    rows = rows.withColumn("text", text)
    # Columns of their own, for what many rules read: within a rule's loop over words it would be made for each word anew.
    return rows.withColumns({"low": F.lower("text"), "title_words": X.word_count(F.col("title")), "emoji": F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(X.EMOJI), F.lit(0))))})


def _finding(level: str, rule: str, quote: Column | None = None) -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"), (quote if quote is not None else F.lit(None).cast("string")).alias("quote"))


_NONE = "cast(array() as array<struct<level:string,rule:string,quote:string>>)"


def _one(test: Column, level: str, rule: str, quote: Column | None = None) -> tuple[str, str, Column]:
    return level, rule, F.when(test, F.array(_finding(level, rule, quote))).otherwise(F.expr(_NONE))


def _each(quotes: Column, level: str, rule: str) -> tuple[str, str, Column]:
    return level, rule, F.transform(quotes, lambda q: _finding(level, rule, q))


def _of(parts: list[tuple[str, str, Column]], wanted: Wanted | None) -> Column:
    """One array of what the wanted rules find. A rule that is left out here costs nothing; a filter after the explode would pay for it in every slide."""
    kept = [found for level, rule, found in parts if wanted is None or wanted(level, rule)]
    return F.concat(*kept) if kept else F.expr(_NONE)


def slide_findings(wanted: Wanted | None = None) -> Column:
    """All wanted findings of a slide, of the columns that slides() makes, as one array."""
    title, low, n = F.col("title"), F.col("low"), F.col("title_words")
    bare = F.regexp_replace(F.lower(title), r"^[ .:—-]+|[ .:—-]+$", "")
    topic, short = bare.isin(*P.TOPICS), (n < P.TITLE_MIN) & ~X.has_digit(title)
    parts = [
        _one(title == "", ERROR, "no_title"),
        _one((title != "") & topic, ERROR, "topic_title", title),
        _one((title != "") & ~topic & short, ERROR, "short_title", title),
        _one(n > P.TITLE_MAX, NOTE, "long_title", title),
    ]
    for words, level, rule in ((P.EMPTY, ERROR, "empty_phrase"), (P.BANNED, ERROR, "banned_word"), (P.NOMINAL, NOTE, "nominal_verb")):
        found = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
        parts.append(_each(found, level, rule))
    parts.append(_one(F.size("emoji") > 0, ERROR, "emoji", F.array_join("emoji", " ")))
    prose = F.filter("items", lambda e: e["kind"].isin(*P.PROSE))
    said = F.flatten(F.transform(prose, lambda e: X.sentences(e["text"])))
    parts.append(_each(F.transform(F.filter(said, lambda x: X.word_count(x) > P.SENTENCE_WORDS), lambda x: F.concat(F.substring(X.strip(x), 1, 90), F.lit("…"))), NOTE, "long_sentence"))
    evident = F.exists("kinds", lambda k: k.isin(*P.EVIDENCE)) | X.has_digit(F.col("text")) | contains_any(low, P.NO_DATA)
    parts.append(_one(~evident, ERROR, "no_evidence"))
    parts.append(_each(F.transform(F.filter("sizes", lambda x: x > P.BULLETS), lambda x: x.cast("string")), NOTE, "many_bullets"))
    wordy = F.filter("items", lambda e: (e["kind"] == "bullets") & (X.word_count(e["text"]) > P.BULLET_WORDS))
    parts.append(_each(F.transform(wordy, lambda e: F.concat(F.substring(e["text"], 1, 90), F.lit("…"))), NOTE, "long_bullet"))
    return _of(parts, wanted)


def lint(docs: DataFrame, wanted: Wanted | None = None) -> DataFrame:
    """(doc_id, level, slide, rule, quote) of decks (doc_id, text); slide is null for what concerns a whole deck. wanted says of a level and a rule whether to judge by it; all are, without it."""
    n = F.coalesce(F.size("slides"), F.lit(0))
    closing = lambda x: (x["kind"] == "human") | F.contains(F.lower(x["s"]), F.lit(P.CANCELLED))
    closed = F.exists(F.slice("slides", F.greatest(n - 1, F.lit(1)), F.lit(2)), lambda lines: F.exists(lines, closing))
    whole = [
        _one(n == 0, ERROR, "no_slides"),
        _one(n > P.SLIDES, NOTE, "many_slides", n.cast("string")),
        _one((n > 0) & (F.col("date") == ""), NOTE, "no_date"),
        _one((n > 0) & ~closed, ERROR, "no_decisions"),
    ]
    rows = markdown.decks(docs).select("doc_id", _of(whole, wanted).alias("whole"), F.posexplode_outer("slides").alias("pos", "lines"))
    rows = slides(markdown.with_blocks(rows, "lines"))
    at = lambda slide: lambda f: F.struct(slide.cast("int").alias("slide"), f["level"].alias("level"), f["rule"].alias("rule"), f["quote"].alias("quote"))
    first = F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, F.col("whole")).otherwise(F.expr(_NONE))  # once a deck
    own = F.when(F.col("pos").isNotNull(), slide_findings(wanted)).otherwise(F.expr(_NONE))
    found = F.concat(F.transform(first, at(F.lit(None))), F.transform(own, at(F.col("pos") + 1)))
    return rows.select("doc_id", F.explode_outer(found).alias("f")).where("f is not null").select("doc_id", "f.level", "f.slide", "f.rule", "f.quote")


def summary(findings: DataFrame, tasks: int | None = None) -> DataFrame:
    """Findings and documents by rule. tasks: how many to count documents in, so that each holds few of them; else as many as the session has for a shuffle."""
    rows = findings.select("level", "rule", "doc_id")
    rows = rows.repartition(tasks, "doc_id") if tasks else rows
    return rows.groupBy("level", "rule").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))
