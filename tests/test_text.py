"""Text functions, decks, ledgers and lint rules on literal input."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import phrases, splitting
from tidemark.functions import text as X
from tidemark.operators import lint, orders
from tidemark.sources import connectors, exports, markdown


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "fn,value,want",
    [
        (X.urgent, "СРОЧНО сделать", True), (X.urgent, "несрочно", False), (X.urgent, "сделать срочно", False), (X.urgent, "  p0: x", True), (X.urgent, "p01", False),
        (X.without_urgency, "Срочно, — сделать", "сделать"), (X.command, "/Борд@bot сделать", "борд"), (X.command, "/cmd\nnext word", "cmd\nnext"), (X.command, "борд", None), (X.rest, "/cmd  a b ", "a b"), (X.rest, "no command ", "no command"),
        (X.sanitize, " a\tb\x01\nc ", "ab\nc"), (X.sanitize, "x" * 2001, "x" * 2000 + " […обрезано]"), (X.first_line, "", "без текста"), (X.first_line, "y" * 81, "y" * 77 + "…"), (X.quote, "a\n\nb\n", "  > a\n  >\n  > b"),
        (X.word_count, "a b  c", 3), (X.word_count, "  ", 0), (X.has_digit, "a٣", True), (X.delta_direction, "+5", "up"), (X.delta_direction, "−5", "down"), (X.delta_direction, "—", "flat"), (X.delta_direction, "0%", "flat"), (X.delta_direction, "", "flat"),
        (X.escape, "<a & b>", "&lt;a &amp; b&gt;"), (X.inline, "**b** _i_ a_b_c `c`", "<strong>b</strong> <em>i</em> a_b_c <code>c</code>"), (X.clip, "z" * 1024, "z" * 1024), (X.clip, "z" * 1025, "z" * 1023 + "…"), (X.newlines, "a\r\nb\rc", "a\nb\nc"),
        (X.scrub, "mail me a.b@c.org or @handle, +7 (900) 123-45-67, https://x.y/z", "mail me [email] or [handle], [number], [link]"), (X.token_shape, "123456:" + "a" * 30, True), (X.token_shape, " 123456:" + "a" * 30, False),
    ],
)
def test_scalars(spark, fn, value, want):
    assert one(spark, fn, value) == want


@pytest.mark.parametrize("n,word", [(1, "слайд"), (2, "слайда"), (5, "слайдов"), (11, "слайдов"), (14, "слайдов"), (21, "слайд"), (112, "слайдов")])
def test_plural(spark, n, word):
    assert spark.range(1).select(X.plural_slides(F.lit(n))).first()[0] == f"{n} {word}"


def test_tiles_and_status(spark):
    assert tuple(one(spark, X.metric_tile, "a | 1")) == ("a", "1", "", "flat", "")
    assert tuple(one(spark, X.metric_tile, "a|1|▲2|x | y")) == ("a", "1", "▲2", "up", "x | y")
    assert tuple(one(spark, X.status, "Красный: down")) == ("red", "down")
    assert tuple(one(spark, X.status, "blue sky")) == ("amber", "blue sky")


def test_caption(spark):
    said = lambda t, m, d, n: spark.range(1).select(X.caption(F.lit(t), F.lit(m), F.lit(d), F.lit(n), F.lit("file"))).first()[0]
    assert said("Board", "7", "May", 2) == "Board · № 7 · May · 2 слайда"
    assert said("Board N7", "7", "", 1) == "Board N7 · 1 слайд"
    assert said("", "", "", 5) == "file · 5 слайдов"


def test_table(spark):
    text = "| a | b |\n|--|:--:|\n| 1 |\nno row"
    rows = one(spark, X.table_rows, text)
    assert rows == [["a", "b"], ["--", ":--:"], ["1", ""]]
    assert one(spark, lambda c: X.has_header(X.table_rows(c)), text) is True
    assert one(spark, lambda c: X.has_header(X.table_rows(c)), "|a|\n|b|") is False


@pytest.mark.parametrize(
    "text,limit,want",
    [
        ("", 5, []), (None, 5, []), ("abc", 5, ["abc"]), ("ab\ncd\nef", 5, ["ab\ncd", "ef"]), ("a bb ccc", 4, ["a bb", "ccc"]), ("x" * 10, 4, ["xxxx", "xxxx", "xx"]), ("x" * 8, 4, ["xxxx", "xxxx"]),
        ("ab\n\n\n\n\ncd", 4, ["ab", "cd"]), ("    \n\nab cd ef", 5, ["ab cd", "ef"]), ("aa bbbbbb c", 4, ["aa", "bbbb", "bb c"]),
    ],
)
def test_split(text, limit, want):
    assert splitting.pieces(text, limit) == want


def pieces_by_hand(text, limit):
    """The rule read aloud: take the next line as long as the part holds it; a line too long goes word by word, a word too long is cut."""
    if not text or len(text) <= limit:
        return [text] if text else []
    out, part = [], None

    def take(unit, gap):
        nonlocal part
        if not part:
            part = unit
        elif len(part + gap + unit) <= limit:
            part = part + gap + unit
        else:
            out.append((gap, part))
            part = unit

    def close(gap):
        nonlocal part
        if part:
            out.append((gap, part))
        part = None

    for line in text.split("\n"):
        if len(line) <= limit:
            take(line, "\n")
            continue
        close("\n")
        for word in line.split(" "):
            while len(word) > limit:
                take(word[:limit], " ")
                word = word[limit:]
            take(word, " ")
        close(" ")
    close("\n")
    return [p.rstrip("\n") if gap == "\n" else p for gap, p in out if gap == " " or p.strip()]


@pytest.mark.parametrize("seed", range(40))
def test_split_agrees_with_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        text, limit = "".join(rng.choices("ab  \n\n\t", k=rng.randint(0, 80))) + "x" * rng.choice([0, 0, 7, 20]), rng.randint(1, 14)
        got = splitting.pieces(text, limit)
        assert got == pieces_by_hand(text, limit) and all(len(p) <= limit for p in got)
        assert "".join("".join(got).split()) == "".join(text.split())


def test_split_at_the_message_limit(spark):
    assert [len(p) for p in splitting.pieces("w" * 4096)] == [4096] and [len(p) for p in splitting.pieces("w" * 4097)] == [4096, 1]
    df = spark.createDataFrame([(1, "ab\ncd"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in splitting.split_text(df, 3).orderBy("part").collect()] == [(1, 0, "ab"), (1, 1, "cd")]


DECK = """@title Old
# Revenue grew by 5 percent this week
first para
second para

- one
- two
## why
@metric MRR | 10 | +1 | note | more
@status зелёный fine
@title Board
---
----
# Риски
@date 2026-01-01
text
# again
@human: choose now
> quoted
| a | b |
"""


def test_deck_blocks(spark):
    docs = spark.createDataFrame([("d", DECK), ("empty", ""), ("rule", "---\n---")], "doc_id string, text string")
    got = [tuple(r)[1:] for r in markdown.blocks(docs).where("doc_id = 'd'").orderBy("slide", "block", "item_no").collect()]
    assert got == [
        (1, 1, "title", 1, "Revenue grew by 5 percent this week"), (1, 2, "para", 1, "first para"), (1, 2, "para", 2, "second para"), (1, 3, "bullets", 1, "one"), (1, 3, "bullets", 2, "two"), (1, 4, "sub", 1, "why"),
        (1, 5, "metrics", 1, "MRR | 10 | +1 | note | more"), (1, 6, "status", 1, "зелёный fine"), (2, 1, "title", 1, "Риски"), (2, 2, "para", 1, "text"), (2, 3, "sub", 1, "again"), (2, 4, "human", 1, "choose now"), (2, 5, "note", 1, "quoted"), (2, 6, "table", 1, "| a | b |"),
    ]
    assert {r["doc_id"]: (r["title"], r["date"]) for r in markdown.meta(docs).collect()} == {"d": ("Board", "2026-01-01"), "empty": ("", ""), "rule": ("", "")}


def found(spark, text):
    df = lint.lint(spark.createDataFrame([("d", text)], "doc_id string, text string"))
    return sorted(((r["rule"], r["slide"], r["level"]) for r in df.collect()), key=str)


def test_lint_of_an_empty_deck(spark):
    assert found(spark, "") == [("no_slides", None, "error")]


def test_lint_rules(spark):
    bullets = "\n".join(["- b"] * 7)
    long = " ".join(["word"] * 26)
    text = f"# Итоги.\nполная синергия и гармония, осуществляется 🚀\n{bullets}\n{long}. Short.\n---\nno title here\n---\n# Two words\nданных нет\n---\n# {' '.join(['w'] * 15)}\nflat words\n- {' '.join(['w'] * 23)}"
    got = found(spark, text)
    want = [
        ("topic_title", 1, "error"), ("empty_phrase", 1, "error"), ("banned_word", 1, "error"), ("nominal_verb", 1, "note"), ("emoji", 1, "error"), ("many_bullets", 1, "note"), ("long_sentence", 1, "note"), ("no_evidence", 1, "error"),
        ("no_title", 2, "error"), ("no_evidence", 2, "error"), ("short_title", 3, "error"), ("long_title", 4, "note"), ("no_evidence", 4, "error"), ("long_bullet", 4, "note"), ("no_date", None, "note"), ("no_decisions", None, "error"),
    ]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_lint_of_a_clean_deck(spark):
    assert found(spark, "@date 2026-01-01\n# Revenue grew by 5 percent\n@metric a | 1\n---\n# Decide on the price now please\n@human choose") == []
    assert found(spark, "@date 1\n# The meeting of May is lost\nзаседание несостоявшееся, 0 решений") == []


def test_ledger(spark):
    text = "## Открытые\n#### O-260101-01 · a\n- **Адресат:** CPO\n- **Статус:** в работе\n\n#### O-260101-02 · b\n- **Статус:** исполнено\n#### O-260101-03 · c\n- **Статус:** принято\n"
    docs = spark.createDataFrame([("l", text), ("none", "")], "doc_id string, text string")
    got = orders.open_orders(markdown.ledger(docs)).orderBy("entry").collect()
    assert [(r["header"], r["addressee"]) for r in got] == [("O-260101-01 · a", "CPO"), ("O-260101-03 · c", "—")]


def test_orders_end_to_end(spark):
    rows = [(1, 5, "a", "/борд срочно: do it\nnow"), (2, 6, "a", "/борд x"), (3, 5, "a", None), (4, 5, "a", "hi"), (5, 5, "a", "/очередь"), (6, 5, "a", "/xyz a"), (7, 5, "a", "/cpo"), (8, 5, "a", "/CPO несрочно")]
    df = orders.verdicts(spark.createDataFrame(rows, "update_id long, chat_id long, author string, text string"), F.col("chat_id") == 5)
    assert {r["update_id"]: r["verdict"] for r in df.collect()} == {1: "accepted", 2: "stranger", 3: "blank", 4: "help", 5: "queue", 6: "unknown", 7: "empty", 8: "accepted"}
    have = spark.createDataFrame([("O-260101-99",), ("O-260102-05",), ("junk",)], "order_id string")
    ids = orders.next_ids(df.where("verdict = 'accepted'"), have, F.to_date(F.lit("2026-01-01")), "update_id")
    got = {r["update_id"]: (r["order_id"], r["urgent"], r["body"], r["addressee"]) for r in ids.collect()}
    assert got == {1: ("O-260101-100", True, "do it\nnow", "БОРД"), 8: ("O-260101-101", False, "несрочно", "CPO")}
    text = ids.where("update_id = 1").select(orders.render(F.col("order_id"), F.col("addressee"), F.col("urgent"), F.col("body"), F.lit("noon"), F.col("author"))).first()[0]
    assert text.startswith("\n#### O-260101-100 · do it\n") and text.endswith("  > do it\n  > now\n")


def test_queue_holds_stored_and_pending_orders(spark):
    text = "#### O-260101-01 · a\n- **Адресат:** CPO\n- **Статус:** в работе\n\n#### O-260101-02 · b\n- **Статус:** исполнено"
    stored = markdown.ledger(spark.createDataFrame([("l", "\n" + text)], "doc_id string, text string"))
    pending = spark.createDataFrame([("O-260102-02", "second", "CPO"), ("O-260102-01", "first\nmore", "БОРД")], "order_id string, body string, addressee string")
    got = [tuple(r) for r in orders.queue(stored, pending).collect()]
    assert got == [("O-260101-01 · a", "CPO"), ("O-260102-01 · first", "БОРД"), ("O-260102-02 · second", "CPO")]
    assert len(orders.queue(stored, pending, 2).collect()) == 2


def test_inbox_tells_unknown_from_zero(spark):
    text = "## 2026-01-01 · METRICS\n| metric | value | source |\n|--|--|--|\n| a | 0 | web |\n| b | — | web |\n## 2026-01-02 · SUPPORT\nнет данных\n## someday\n| x |"
    got = [(str(r["day"]), r["block"], r["metric"], r["value"], r["malformed"], r["free"] is not None) for r in markdown.inbox(spark.createDataFrame([("i", text)], "doc_id string, text string")).collect()]
    assert got == [("2026-01-01", "METRICS", "a", "0", False, False), ("2026-01-01", "METRICS", "b", None, False, False), ("2026-01-02", "SUPPORT", None, None, False, True), ("None", None, None, None, True, True)]


def test_no_text_leaves_analytics(spark):
    from conftest import SF

    from tidemark.plans import QUERIES

    for name in ("pii_scrub", "split_text", "word_count", "conversation_profile", "label_join"):
        assert "text" not in QUERIES[name](spark, SF).columns


def test_sources_and_sinks(spark, tmp_path):
    assert markdown.read_texts(spark, str(tmp_path / "none*")).count() == 0
    (tmp_path / "a.md").write_text("#### x", encoding="utf-8")
    assert markdown.read_texts(spark, str(tmp_path / "*.md")).first()["text"] == "#### x"
    calls = spark.createDataFrame([("1", "s"), ("2", None)], "order_id string, signature string").withColumn("signature", F.when(F.col("order_id") == "1", connectors.signed("key", "order_id")))
    assert {r["order_id"]: r["code"] for r in connectors.verified(calls, "key", ("order_id",)).collect()} == {"1": 200, "2": 400}
    assert [r[0] for r in connectors.backfill(spark.createDataFrame([("1",), ("2",), ("2",)], "order_id string"), spark.createDataFrame([("1",)], "order_id string")).collect()] == ["2"]
    (tmp_path / "bill.csv").write_text("day,account,plan,amount,status\n2026-01-01,a,pro,1.50,ok\nnot a day,a,pro,x,ok\n")
    bill = connectors.read_billing_csv(spark, str(tmp_path / "bill.csv")).collect()
    assert [r["_corrupt"] is None for r in bill] == [True, False]
    mart = str(tmp_path / "mart")
    connectors.write_mart(spark.createDataFrame([("2026-01-01", 1), ("2026-01-02", 2)], "day string, n int"), mart)
    connectors.write_mart(spark.createDataFrame([("2026-01-02", 3)], "day string, n int"), mart)
    assert sorted((str(r["day"]), r["n"]) for r in spark.read.parquet(mart).collect()) == [("2026-01-01", 1), ("2026-01-02", 3)]
    assert connectors.drop_expired(spark, mart, 5, "2026-01-07") == 1 and spark.read.parquet(mart).count() == 1
    sizes = str(tmp_path / "cohorts")
    connectors.persist_cohorts(spark.createDataFrame([("c1", 5)], "cohort string, size long"), sizes)
    later = connectors.persist_cohorts(spark.createDataFrame([("c1", 3), ("c2", 4)], "cohort string, size long"), sizes)
    assert sorted(map(tuple, later.collect())) == [("c1", 5), ("c2", 4)]


def test_lists_have_no_repeats():
    for words in (phrases.EMPTY, phrases.BANNED, phrases.NOMINAL, phrases.TOPICS):
        assert len(words) == len(set(words))


def test_strip_takes_off_what_the_pattern_would(spark):
    """Every character of the basic plane that is white space to Java, and no other."""
    rows = spark.range(1, 0x10000).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    rows = rows.select(F.concat(F.lit(" "), "c", F.lit("x y"), "c", F.lit("\n")).alias("s"))
    assert rows.where(~X.strip(F.col("s")).eqNullSafe(F.regexp_replace("s", r"(?U)^\s+|\s+$", ""))).count() == 0


def test_what_may_be_quoted(spark):
    said = {
        "Иван Петрович Сидоров пишет: пропала заметка. Вторая фраза! Третья.": "[name] пишет: пропала заметка. Вторая фраза!",
        "Сидоров И. П. был 12.08.2026 на ул. Ленина, д. 5, кв. 7? Да": "[name] был [date] на [address]? Да",
        "Dr. Jane Doe, 12 Baker Street, a@b.co, @handle, +7 999 123-45-67": "[name], [address], [email], [handle], [number]",
        "no stop at all": "no stop at all", "": "",
    }
    got = spark.createDataFrame([(k,) for k in said], "t string").select("t", X.quotable(F.col("t")).alias("q")).collect()
    assert {r["t"]: r["q"] for r in got} == said


def test_exports_by_their_agreed_columns(spark, tmp_path):
    root = str(tmp_path / "exports")
    (tmp_path / "exports" / "billing" / "day=2024-01-01").mkdir(parents=True)
    (tmp_path / "exports" / "billing" / "day=2024-01-02").mkdir()
    (tmp_path / "exports" / "billing" / "day=2024-01-01" / "a.csv").write_text("date,account,plan,amount,status\n2023-12-31,a1,p,10.50,ok\n2023-12-31,a2,p,oops,ok\n2023-12-31,,p,1.00,ok\n")
    (tmp_path / "exports" / "billing" / "day=2024-01-02" / "a.csv").write_text("date,account,plan,amount,status\n2023-12-31,a1,p,11.00,refunded\n")
    rows = exports.read(spark, root, "billing")
    assert [r["account"] for r in rows.where("_corrupt is not null").select("account", "_corrupt").collect()] == ["a2"] and exports.read(spark, root, "social") is None
    assert [(r["account"], str(r["amount"]), r["status"]) for r in exports.latest(rows, "billing").collect()] == [("a1", "11.00", "refunded")]
    state = {r["connector"]: (r["state"], r["n"], r["keyless"], r["corrupt"]) for r in exports.status(spark, root, F.to_date(F.lit("2024-01-03"))).collect()}
    assert len(state) == 13 and state["billing"] == ("ok", 2, 1, 1) and state["social"] == ("not_connected", None, None, None)
    assert len({e.name for e in exports.EXPORTS}) == 13
