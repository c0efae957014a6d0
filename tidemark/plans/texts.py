"""Text queries over `documents`, `conversations`, `pages` and strings built from `orders` and `part`."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import phrases as P
from tidemark.functions import splitting
from tidemark.functions import text as X
from tidemark.operators import lint, orders, series
from tidemark.plans.base import Registry
from tidemark.sources import markdown
from tidemark.sources import tables as T

R = Registry()

_SPACE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def documents(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", "text")


@R.query(rf"SELECT doc_id, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}+'), lambda w: w <> '')) AS INT) AS words, regexp_matches(coalesce(text, ''), '[0-9]') AS has_digit FROM documents")
def word_count(spark, sf):
    text = F.coalesce("text", F.lit(""))
    return documents(spark, sf).select("doc_id", X.word_count(text).alias("words"), X.has_digit(text).alias("has_digit"))


@R.query(rf"""
WITH p AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?]){_SPACE}+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents),
n AS (SELECT doc_id, len(list_filter(string_split_regex(s, '{_SPACE}+'), lambda w: w <> '')) AS n FROM p)
SELECT doc_id, CAST(max(n) AS INT) AS longest, count(*) FILTER (WHERE n > 25) AS too_long FROM n GROUP BY doc_id
""")
def sentence_len(spark, sf):
    """The longest sentence of a document in words, and how many are above the limit."""
    counts = F.transform(X.sentences(F.col("text")), X.word_count)
    d = documents(spark, sf).where("text is not null").select("doc_id", counts.alias("n"))
    return d.select("doc_id", F.array_max("n").alias("longest"), F.size(F.filter("n", lambda n: n > P.SENTENCE_WORDS)).cast("long").alias("too_long"))


_LISTED = ", ".join(f"'{w}'" for w in (*P.EMPTY, *P.BANNED, *P.NOMINAL, "idiot", "the and of"))


@R.query(f"SELECT w AS phrase, count(*) AS docs FROM documents, (SELECT unnest([{_LISTED}]) AS w) WHERE contains(lower(text), w) GROUP BY 1")
def phrase_flags(spark, sf):
    """Documents per listed phrase, in one pass over the texts; two phrases of this corpus stand beside the fixed lists."""
    listed = F.array(*map(F.lit, (*P.EMPTY, *P.BANNED, *P.NOMINAL, "idiot", "the and of")))
    low = documents(spark, sf).select(F.lower("text").alias("low"))
    return low.select(F.explode(F.filter(listed, lambda w: F.contains(F.col("low"), w))).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("docs"))


@R.query(r"""
WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+', '[email]', 'g'), 'https?://[^\s]+', '[link]', 'g'), '@[A-Za-z0-9_]{3,}', '[handle]', 'g'), '\+?[0-9][0-9() -]{7,}[0-9]', '[number]', 'g') AS t FROM documents)
SELECT doc_id, md5(t) AS clean_md5, CAST(len(regexp_extract_all(t, '\[(email|link|handle|number)\]')) AS INT) AS masked FROM s
""")
def pii_scrub(spark, sf):
    """Addresses, links, handles and long numbers masked; only a digest of the clean text leaves."""
    t = documents(spark, sf).select("doc_id", X.scrub(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5("t").alias("clean_md5"), F.size(F.regexp_extract_all("t", F.lit(r"\[(email|link|handle|number)\]"), F.lit(0))).alias("masked"))


@R.query(r"SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_md5, CASE WHEN length(html) > 1024 THEN rtrim(left(html, 1023), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160)) || '…' ELSE html END AS caption FROM pages")
def escape_and_clip(spark, sf):
    return T.read(spark, sf, "pages").select("page_id", F.md5(X.escape(F.col("html"))).alias("escaped_md5"), X.clip(F.col("html")).alias("caption"))


@R.query("SELECT o_orderkey AS id, CASE WHEN d IN ('0%', '—', '') THEN 'flat' WHEN left(d, 1) IN ('+', '↑') THEN 'up' WHEN left(d, 1) IN ('-', '−') THEN 'down' ELSE 'flat' END AS dir FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '0%' WHEN 1 THEN '+' || o_orderkey WHEN 2 THEN '−' || o_orderkey WHEN 3 THEN '—' WHEN 4 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS d FROM orders)")
def delta_dir(spark, sf):
    k = F.col("o_orderkey")
    s, i = k.cast("string"), k % 6
    d = F.when(i == 0, " 0% ").when(i == 1, F.concat(F.lit("+"), s)).when(i == 2, F.concat(F.lit("−"), s)).when(i == 3, "—").when(i == 4, "").otherwise(s)
    return T.read(spark, sf, "orders").select(k.alias("id"), X.delta_direction(d).alias("dir"))


@R.query("SELECT o_orderkey AS id, o_orderpriority AS name, CAST(o_orderkey AS VARCHAR) AS value, '-' || o_custkey AS delta, 'down' AS dir, 'a | b' AS note FROM orders")
def metric_tile(spark, sf):
    o = T.read(spark, sf, "orders")
    payload = F.concat_ws("|", "o_orderpriority", F.concat(F.lit(" "), "o_orderkey", F.lit(" ")), F.concat(F.lit("-"), "o_custkey"), F.lit(" a "), F.lit("b"))
    return o.select(F.col("o_orderkey").alias("id"), X.metric_tile(payload).alias("m")).select("id", "m.*")


@R.query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'green' WHEN 'O' THEN 'red' ELSE 'amber' END AS color, CASE o_orderstatus WHEN 'F' THEN o_orderpriority WHEN 'O' THEN o_orderpriority ELSE 'purple ' || o_orderpriority END AS text FROM orders")
def status_line(spark, sf):
    """Known colours and an unknown one, which keeps its text."""
    word = F.when(F.col("o_orderstatus") == "F", "Зелёный:").when(F.col("o_orderstatus") == "O", "red").otherwise("purple")
    return T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), X.status(F.concat_ws(" ", word, "o_orderpriority")).alias("s")).select("id", "s.*")


@R.query("SELECT o_orderkey AS n, o_orderkey || CASE WHEN o_orderkey % 10 = 1 AND o_orderkey % 100 <> 11 THEN ' слайд' WHEN o_orderkey % 10 IN (2, 3, 4) AND o_orderkey % 100 NOT IN (12, 13, 14) THEN ' слайда' ELSE ' слайдов' END AS said FROM orders")
def plural_ru(spark, sf):
    return T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("n"), X.plural_slides(F.col("o_orderkey")).alias("said"))


@R.query("""
SELECT o_orderkey AS id, concat_ws(' · ', CASE WHEN o_orderstatus = 'F' THEN 'Board N' || o_custkey WHEN o_orderstatus = 'O' THEN 'Board' ELSE 'deck' END, CASE WHEN o_orderstatus <> 'F' THEN '№ ' || o_custkey END, strftime(o_orderdate, '%Y-%m-%d'),
  o_custkey || CASE WHEN o_custkey % 10 = 1 AND o_custkey % 100 <> 11 THEN ' слайд' WHEN o_custkey % 10 IN (2, 3, 4) AND o_custkey % 100 NOT IN (12, 13, 14) THEN ' слайда' ELSE ' слайдов' END) AS caption FROM orders
""")
def build_caption(spark, sf):
    key = F.col("o_custkey").cast("string")
    title = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Board N"), key)).when(F.col("o_orderstatus") == "O", "Board").otherwise("")
    said = X.caption(title, key, F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_custkey"), F.lit("deck"))
    return T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), said.alias("caption"))


@R.query("SELECT l_linenumber AS attempt, round(least(1.5 * pow(2, l_linenumber - 1), 30), 6) AS seconds FROM lineitem GROUP BY 1")
def backoff(spark, sf):
    return T.read(spark, sf, "lineitem").select(F.col("l_linenumber").alias("attempt")).distinct().select("attempt", F.round(X.backoff(F.col("attempt")), 6).alias("seconds"))


@R.query("""
WITH r AS (SELECT p_partkey AS id, [[p_brand, CAST(p_size AS VARCHAR), ''], ['--', ':--:', ''], [p_type, 'x', 'y']] AS rows FROM part)
SELECT id, 3 AS width, true AS header, list_aggregate(list_transform(rows, lambda c: list_aggregate(c, 'string_agg', '/')), 'string_agg', ';') AS cells FROM r
""")
def md_table(spark, sf):
    """A table whose rows are uneven: cells, header and the widest row."""
    p = T.read(spark, sf, "part")
    text = F.concat(F.lit("| "), "p_brand", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |\n|--|:--:|\n| "), "p_type", F.lit(" | x | y |\nafter"))
    t = p.select(F.col("p_partkey").alias("id"), X.table_rows(text).alias("rows"))
    return t.select("id", F.size(F.get("rows", F.lit(0))).alias("width"), X.has_header(F.col("rows")).alias("header"), F.array_join(F.transform("rows", lambda c: F.array_join(c, "/")), ";").alias("cells"))


@R.query("SELECT p_partkey % 7 AS kind_of_row, CAST(max(p_size % 5 + 1) AS INT) AS width FROM part GROUP BY 1")
def table_width(spark, sf):
    """The widest table row of each kind."""
    row = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("c"), F.col("p_size") % 5 + 1), "|"), F.lit("|"))
    t = T.read(spark, sf, "part").select((F.col("p_partkey") % 7).alias("kind_of_row"), X.table_rows(row).alias("rows"))
    return t.groupBy("kind_of_row").agg(F.max(F.array_max(F.transform("rows", F.size))).alias("width"))


def messages(spark, sf):
    """Messages built from orders: strangers, blanks, help, queues, unknown and empty commands, and orders, some urgent."""
    k = F.col("o_orderkey") % 9
    text = (
        F.when(k == 0, "  ").when(k == 1, "просто борд").when(k == 2, "/help").when(k == 3, "/Queue@some_bot").when(k == 4, "/nobody do it").when(k == 5, "/борд")
        .when(k == 6, F.concat(F.lit("/БОРД@b СРОЧНО, сделать "), F.col("o_orderkey"))).when(k == 7, F.concat(F.lit("/cpo несрочно "), F.col("o_orderkey"))).otherwise(F.concat(F.lit("/board\nnow "), F.col("o_orderkey")))
    )
    o = T.read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("update_id"), (F.col("o_custkey") % 4).alias("chat_id"), F.lit("a").alias("author"), text.alias("text"), F.col("o_orderdate").cast("date").alias("day"))


_VERDICT = """
v AS (SELECT o_orderkey AS update_id, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_custkey % 4 = 3 THEN 'stranger' WHEN o_orderkey % 9 = 0 THEN 'blank' WHEN o_orderkey % 9 IN (1, 2) THEN 'help' WHEN o_orderkey % 9 = 3 THEN 'queue' WHEN o_orderkey % 9 IN (4, 8) THEN 'unknown' WHEN o_orderkey % 9 = 5 THEN 'empty' ELSE 'accepted' END AS verdict FROM orders)
"""


@R.query("WITH " + _VERDICT + "SELECT verdict, count(*) AS n FROM v GROUP BY 1")
def order_verdicts(spark, sf):
    return orders.verdicts(messages(spark, sf), F.col("chat_id") < 3).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@R.query("WITH " + _VERDICT + "SELECT update_id, CASE update_id % 9 WHEN 6 THEN 'борд' ELSE 'cpo' END AS command, update_id % 9 = 6 AS urgent, CASE update_id % 9 WHEN 6 THEN 'сделать ' || update_id ELSE 'несрочно ' || update_id END AS body, CASE update_id % 9 WHEN 6 THEN 'БОРД' ELSE 'CPO' END AS addressee FROM v WHERE verdict = 'accepted'")
def parse_command(spark, sf):
    """Command, urgency by the first word only, body and addressee of accepted orders."""
    rows = orders.verdicts(messages(spark, sf), F.col("chat_id") < 3).where("verdict = 'accepted'")
    return rows.select("update_id", "command", "urgent", "body", "addressee")


@R.query("SELECT conv_id, turn, regexp_matches(text, '(?i)^\\s*(срочно|urgent|p0)\\b') AS urgent FROM conversations")
def urgent_flag(spark, sf):
    return T.read(spark, sf, "conversations").select("conv_id", "turn", X.urgent(F.col("text")).alias("urgent"))


@R.query(r"""
WITH c AS (SELECT doc_id, trim(regexp_replace(text, '[\x00-\x09\x0B-\x1F]', '', 'g'), ' ' || chr(10) || chr(133) || chr(160)) AS t FROM documents)
SELECT doc_id, md5(CASE WHEN length(t) > 2000 THEN rtrim(left(t, 2000), ' ' || chr(10) || chr(133) || chr(160)) || ' […обрезано]' ELSE t END) AS clean_md5 FROM c
""")
def sanitize_text(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(X.sanitize(F.col("text"))).alias("clean_md5"))


@R.query("WITH " + _VERDICT + ", e AS (SELECT day, update_id % 50 AS n FROM v WHERE verdict = 'help'), t AS (SELECT day, max(n) AS top FROM e GROUP BY 1), a AS (SELECT update_id, day, row_number() OVER (PARTITION BY day ORDER BY update_id) AS i FROM v WHERE verdict = 'accepted') SELECT update_id, 'O-' || strftime(a.day, '%y%m%d') || '-' || lpad(CAST(coalesce(top, 0) + i AS VARCHAR), 2, '0') AS order_id FROM a LEFT JOIN t ON a.day = t.day")
def order_id_seq(spark, sf):
    """Numbers within a day go on after the largest one in the ledger."""
    rows = orders.verdicts(messages(spark, sf), F.col("chat_id") < 3)
    existing = rows.where("verdict = 'help'").select(F.concat_ws("-", F.lit("O"), F.date_format("day", "yyMMdd"), F.lpad((F.col("update_id") % 50).cast("string"), 2, "0")).alias("order_id"))
    return orders.next_ids(rows.where("verdict = 'accepted'"), existing, F.col("day"), "update_id").select("update_id", "order_id")


def ledgers(spark, sf):
    """A ledger per day: its orders as entries."""
    state = F.when(F.col("o_orderstatus") == "F", "исполнено").when(F.col("o_orderstatus") == "O", "принято").otherwise("в работе")
    entry = F.concat(F.lit("\n#### O-"), "o_orderkey", F.lit(" · title\n- **Адресат:** "), F.col("o_orderpriority"), F.lit("\n- **Статус:** "), state, F.lit("\n"))
    o = T.read(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").cast("string").alias("doc_id"))
    return o.agg(F.concat(F.lit("## Открытые"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", entry.alias("e")))), lambda x: x["e"]), "")).alias("text"))


@R.query("SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS doc_id, 'O-' || o_orderkey || ' · title' AS header, regexp_extract(o_orderpriority, '^\\S+') AS addressee FROM orders WHERE o_orderstatus <> 'F'")
def open_orders(spark, sf):
    """Entries of the ledger whose state begins with an open word."""
    return orders.open_orders(markdown.ledger(ledgers(spark, sf))).select("doc_id", "header", "addressee")


@R.query("SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) - 1 AS INT) AS entry, 'O-' || o_orderkey || ' · title' AS header FROM orders")
def ledger_blocks(spark, sf):
    return markdown.ledger(ledgers(spark, sf)).select("doc_id", "entry", "header")


@R.query("""
WITH q AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS doc_id, o_orderkey, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS i FROM orders WHERE o_orderstatus <> 'F') SELECT doc_id, 'O-' || o_orderkey || ' · title' AS header FROM q WHERE i <= 15
""")
def order_queue(spark, sf):
    """The first fifteen open orders."""
    return orders.open_orders(markdown.ledger(ledgers(spark, sf)), orders.QUEUE_LENGTH).select("doc_id", "header")


@R.query("SELECT CAST(o_orderdate AS DATE) AS day, 'METRICS' AS block, unnest(['orders', 'paid', 'refunds']) AS metric, unnest([CAST(count(*) AS VARCHAR), CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS VARCHAR), NULL]) AS value, 'server' AS source, false AS malformed FROM orders GROUP BY 1")
def inbox_scan(spark, sf):
    """Snapshot blocks read back as long rows: `0` is zero, `—` is unknown."""
    o = T.read(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("paid"))
    text = F.concat(F.lit("intro\n## "), F.col("d").cast("string"), F.lit(" · METRICS\nperiod\n| metric | value | source |\n|---|---|---|\n| orders | "), "n", F.lit(" | server |\n| paid | "), "paid", F.lit(" | server |\n| refunds | — | server |\n"))
    return markdown.inbox(o.select(F.col("d").cast("string").alias("doc_id"), text.alias("text"))).select("day", "block", "metric", "value", "source", "malformed")


def decks(spark, sf):
    """A two-slide deck per order, some without a date, some with too little on them."""
    k = F.col("o_orderkey")
    head = F.when(F.col("o_orderstatus") == "F", F.lit("@title Board\n@date 2026-01-01\n")).otherwise("@title Board\r\n")
    first = F.concat(F.lit("# Revenue of the week grew by "), k, F.lit("\n## why\n- one\n- two 😀\n\n@metric MRR | 10 | +1 | note\n@status зелёный all good\n| a | b |\n|---|---|\n| 1 | 2 |\n---\n"))
    second = F.when(k % 2 == 0, F.lit("# Риски\nполная синергия без опоры\n")).otherwise("# Decide on the price before 1 May\n@human: choose A or B\n")
    return T.spread(T.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")).select(F.col("o_orderkey").alias("doc_id"), F.concat(head, first, second).alias("text"))


@R.query("""
WITH o AS (SELECT o_orderkey % 2 = 0 AS weak, o_orderstatus = 'F' AS dated FROM orders)
SELECT 'error' AS level, 'emoji' AS rule, count(*) AS n, count(*) AS docs FROM o UNION ALL SELECT 'error', 'topic_title', count(*), count(*) FROM o WHERE weak UNION ALL SELECT 'error', 'empty_phrase', count(*), count(*) FROM o WHERE weak
UNION ALL SELECT 'error', 'no_evidence', count(*), count(*) FROM o WHERE weak UNION ALL SELECT 'error', 'no_decisions', count(*), count(*) FROM o WHERE weak UNION ALL SELECT 'note', 'no_date', count(*), count(*) FROM o WHERE NOT dated
""")
def lint_summary(spark, sf):
    return lint.summary(lint.lint(decks(spark, sf)), T.tasks(T.read(spark, sf, "orders")))


_GOOD, _LAST = "# Revenue grew by 5 percent\n", "---\n# Decide on the price now please\n@human choose"
#: Decks that break one rule each, but for the first, which breaks none.
BROKEN = (
    "@date 2026-01-01\n" + _GOOD + "@metric a | 1\n" + _LAST,
    " \n---\n",
    "@date 2026-01-01\njust 5 words\n" + _LAST,
    "@date 2026-01-01\n# Риски:\n5 facts\n" + _LAST,
    "@date 2026-01-01\n# Two words\n5 facts\n" + _LAST,
    "@date 2026-01-01\n# " + " ".join(["w"] * 15) + "\n5 facts\n" + _LAST,
    "@date 2026-01-01\n" + _GOOD + "полная Синергия\n" + _LAST,
    "@date 2026-01-01\n" + _GOOD + "@status green гармония\n" + _LAST,
    "@date 2026-01-01\n" + _GOOD + "> осуществляется\n" + _LAST,
    "@date 2026-01-01\n" + _GOOD + "🚀 one 😀 two 🚀\n" + _LAST,
    "@date 2026-01-01\n" + _GOOD + " ".join(["word"] * 26) + ". Short.\n" + _LAST,
    "@date 2026-01-01\n# Revenue grew a lot lately\nflat words\n" + _LAST,
    "@date 2026-01-01\n" + _GOOD + "- b\n" * 7 + _LAST,
    "@date 2026-01-01\n" + _GOOD + "- " + " ".join(["word"] * 23) + "\n" + _LAST,
    "@date 2026-01-01\n" + (_GOOD + "---\n") * 9 + _LAST,
    "@title Board\n" + _GOOD + _LAST,
    "@date 2026-01-01\n" + _GOOD + "---\n# Decide on the price now please\n5 facts",
)


@R.query("""
WITH rules(v, level, rule, slide, quote) AS (VALUES (1, 'error', 'no_slides', NULL, NULL), (2, 'error', 'no_title', 1, NULL), (3, 'error', 'topic_title', 1, 'Риски:'), (4, 'error', 'short_title', 1, 'Two words'),
  (5, 'note', 'long_title', 1, 'w w w w w w w w w w w w w w w'), (6, 'error', 'empty_phrase', 1, 'синергия'), (7, 'error', 'banned_word', 1, 'гармония'), (8, 'note', 'nominal_verb', 1, 'осуществляется'), (9, 'error', 'emoji', 1, '😀 🚀'),
  (10, 'note', 'long_sentence', 1, repeat('word ', 18) || '…'), (11, 'error', 'no_evidence', 1, NULL), (12, 'note', 'many_bullets', 1, '7'), (13, 'note', 'long_bullet', 1, repeat('word ', 18) || '…'), (14, 'note', 'many_slides', NULL, '10'),
  (15, 'note', 'no_date', NULL, NULL), (16, 'error', 'no_decisions', NULL, NULL))
SELECT o_orderkey AS doc_id, level, rule, slide, quote FROM orders JOIN rules ON o_orderkey % 17 = v
""")
def lint_rules(spark, sf):
    """All sixteen rules, each by decks that break it and nothing else."""
    text = F.get(F.array(*map(F.lit, BROKEN)), (F.col("o_orderkey") % len(BROKEN)).cast("int"))
    return lint.lint(T.spread(T.read(spark, sf, "orders").select("o_orderkey")).select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))


@R.query("SELECT o_orderkey AS doc_id, 1 AS slide, '😀' AS quote FROM orders")
def lint_emoji(spark, sf):
    return lint.lint(decks(spark, sf), lambda level, rule: rule == "emoji").select("doc_id", "slide", "quote")


@R.query("""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS weak FROM orders)
SELECT kind, CAST(count(*) AS BIGINT) AS items, count(DISTINCT k) AS docs FROM (SELECT k, unnest(['title', 'sub', 'bullets', 'bullets', 'metrics', 'status', 'table', 'table', 'table', 'title', CASE WHEN weak THEN 'para' ELSE 'human' END]) AS kind FROM o) GROUP BY kind
""")
def deck_blocks(spark, sf):
    """Items by kind of block."""
    items = markdown.blocks(decks(spark, sf)).select("kind", "doc_id").repartition(T.tasks(T.read(spark, sf, "orders")), "doc_id")
    return items.groupBy("kind").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("doc_id").alias("docs"))


@R.query("SELECT o_orderkey AS doc_id, 'Board' AS title, CASE WHEN o_orderstatus = 'F' THEN '2026-01-01' ELSE '' END AS date FROM orders")
def deck_meta(spark, sf):
    return markdown.meta(decks(spark, sf)).select("doc_id", "title", "date")


@R.query()
def lint_findings(spark, sf):
    """Every finding of the rules over the documents read as decks; tests hold it against literal decks."""
    return lint.lint(documents(spark, sf).where("text is not null"))


@R.query()
def split_text(spark, sf):
    """Documents cut into messages."""
    return splitting.split_text(documents(spark, sf)).select("doc_id", "part", F.length("text").alias("length"), F.md5("text").alias("text_md5"))


@R.query("""
WITH d AS (SELECT source, count(*) AS docs, count(l.doc_id) AS labelled, count(*) FILTER (WHERE l.toxic = 1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1)
SELECT source, docs, labelled, toxic, round(toxic::DOUBLE / nullif(labelled, 0), 6) AS share FROM d
""")
def label_join(spark, sf):
    """Texts with their labels where there are any; an unlabelled text is in no share."""
    d, l = T.read(spark, sf, "documents").select("doc_id", "source"), T.read(spark, sf, "labels").select(F.col("doc_id").alias("_l"), "toxic")
    rows = d.join(l, F.col("doc_id") == F.col("_l"), "left").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count("_l").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return rows.withColumn("share", series.share(F.col("toxic"), F.col("labelled")))


@R.query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, round(quantile_cont(length(text), 0.5), 4) AS median_chars, CAST(max(turn) AS BIGINT) AS longest FROM conversations GROUP BY role")
def conversation_profile(spark, sf):
    """Lengths only; no text leaves."""
    c = T.read(spark, sf, "conversations")
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.round(F.percentile(F.length("text"), 0.5), 4).alias("median_chars"), F.max("turn").cast("long").alias("longest"))


@R.query("""
WITH v AS (SELECT o_orderkey AS update_id, 'p' || o_orderkey % 4 AS command FROM orders)
SELECT CASE WHEN command = 'p3' THEN 'unknown' ELSE 'accepted' END AS verdict, CASE WHEN command <> 'p3' THEN upper(command) END AS addressee, count(*) AS n FROM v GROUP BY 1, 2
""")
def product_orders(spark, sf):
    """Orders to products, whose names the caller adds to the commands that are there."""
    table = orders.ADDRESSEES | {f"p{i}": f"P{i}" for i in range(3)}
    m = messages(spark, sf).withColumn("text", F.concat(F.lit("/p"), F.col("update_id") % 4, F.lit(" do it")))
    return orders.verdicts(m, F.lit(True), table).groupBy("verdict", "addressee").agg(F.count(F.lit(1)).alias("n"))


@R.query("""
WITH s AS (SELECT o_orderkey, min(CAST(o_orderdate AS DATE)) OVER () AS day, CAST(o_orderdate AS DATE) AS d, o_orderpriority, o_orderstatus FROM orders),
q AS (SELECT 0 AS new, o_orderkey AS k, 'O-' || o_orderkey || ' · title' AS header, regexp_extract(o_orderpriority, '^\\S+') AS addressee FROM s WHERE d = day AND o_orderstatus <> 'F'
  UNION ALL SELECT 1, row_number() OVER (ORDER BY o_orderkey), 'O-240101-' || lpad(CAST(row_number() OVER (ORDER BY o_orderkey) AS VARCHAR), 2, '0') || ' · pending ' || o_orderkey, 'CPO' FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 30))
SELECT header, addressee FROM (SELECT *, row_number() OVER (ORDER BY new, k) AS i FROM q) WHERE i <= 15
""")
def pending_orders(spark, sf):
    """The queue of one ledger, that of the first day: what it stores first, then what has just come (the thirty orders of the least keys) by number."""
    o = T.read(spark, sf, "orders")
    first = ledgers(spark, sf).join(F.broadcast(o.agg(F.min(F.col("o_orderdate").cast("date")).cast("string").alias("_d"))), F.col("doc_id") == F.col("_d"), "left_semi")  # one row
    fresh = o.orderBy("o_orderkey").limit(30).select(F.col("o_orderkey").alias("update_id"), F.concat(F.lit("pending "), "o_orderkey").alias("body"), F.lit("CPO").alias("addressee"))
    none = spark.createDataFrame([], "order_id string")
    return orders.queue(markdown.ledger(first), orders.next_ids(fresh, none, F.to_date(F.lit("2024-01-01")), "update_id"))


_QUOTE = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "[email]"), (r"https?://[^\s]+", "[link]"), (r"@[A-Za-z0-9_]{3,}", "[handle]"), (r"[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}", "[date]"), (r"\+?[0-9][0-9() -]{7,}[0-9]", "[number]"),
    (r"(?:[А-ЯЁ][а-яё]+ )?[А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]*(?:вич|вна|ична|ьич)(?: [А-ЯЁ][а-яё]+)?", "[name]"), (r"[А-ЯЁ][а-яё]+ [А-ЯЁ]\. ?[А-ЯЁ]\.", "[name]"), (r"(?:Mr|Mrs|Ms|Dr)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?", "[name]"),
    (r"(?:ул|пр|просп|пер|наб)\. ?[А-ЯЁ][а-яё-]+(?:, ?(?:д\. ?)?[0-9]+)?(?:, ?кв\. ?[0-9]+)?", "[address]"), (r"[0-9]+ [A-Z][a-z]+ (?:Street|Avenue|Road|Lane)", "[address]"),
)


def _quoted_sql(text: str) -> str:
    for pattern, mask in _QUOTE:
        text = f"regexp_replace({text}, '{pattern}', '{mask}', 'g')"
    return text


@R.query(f"""
WITH s AS (SELECT doc_id, regexp_extract({_quoted_sql("trim(text)")}, '^[^.!?…]*(?:[.!?…]+[^.!?…]*[.!?…]*)?') AS quote FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(quote) AS quote_md5, CAST(len(regexp_extract_all(quote, '\\[(?:email|link|handle|date|number|name|address)\\]')) AS INT) AS masked, CAST(len(regexp_extract_all(quote, '[.!?…]+')) AS INT) AS stops FROM s
""")
def quote_hygiene(spark, sf):
    """What of a text may be quoted: two sentences at most, without names, addresses, dates, contacts and long numbers."""
    q = documents(spark, sf).where("text is not null").select("doc_id", X.quotable(F.col("text")).alias("quote"))
    masks = F.regexp_extract_all("quote", F.lit(r"\[(?:email|link|handle|date|number|name|address)\]"), F.lit(0))
    return q.select("doc_id", F.md5("quote").alias("quote_md5"), F.size(masks).alias("masked"), F.size(F.regexp_extract_all("quote", F.lit(r"[.!?…]+"), F.lit(0))).alias("stops"))
