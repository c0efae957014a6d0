"""Literal frames for the edges of each rule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.functions.registry import ANY, Event, Field, load, table
from tidemark.operators import activity, alerts, cohorts, ingest, intervals, money, series, sets

T0 = dt.datetime(2024, 1, 10, 12)


def at(**delta):
    return T0 + dt.timedelta(**delta)


def stamps(df, *names):
    for n in names:
        df = df.withColumn(n, F.col(n).cast("timestamp_ntz"))
    return df


@pytest.mark.parametrize("seconds,n", [(29 * 60 + 59, 1), (30 * 60, 1), (30 * 60 + 1, 2)])
def test_session_gap(spark, seconds, n):
    ev = stamps(spark.createDataFrame([(1, T0, 1), (1, at(seconds=seconds), 2)], "account_id long, ts timestamp, event_id long"), "ts")
    assert intervals.sessions(ev).count() == n


def test_session_over_midnight_and_two_chunks(spark):
    start = dt.datetime(2024, 1, 10, 23, 50)
    times = [start, start + dt.timedelta(minutes=20), start + dt.timedelta(days=2), start + dt.timedelta(days=2, minutes=15)]
    ev = stamps(spark.createDataFrame([(1, t, i) for i, t in enumerate(times)], "account_id long, ts timestamp, event_id long"), "ts")
    assert sorted(r["n_events"] for r in intervals.sessions(ev).collect()) == [2, 2]


@pytest.mark.parametrize("hours,seconds,ok", [(72, -1, True), (72, 0, True), (72, 1, False), (24, -1, True), (24, 0, True), (24, 1, False), (14 * 24, 0, True), (14 * 24, 1, False)])
def test_within(spark, hours, seconds, ok):
    df = stamps(spark.createDataFrame([(T0, at(hours=hours, seconds=seconds))], "a timestamp, b timestamp"), "a", "b")
    assert df.select(intervals.within(F.col("a"), F.col("b"), hours)).first()[0] is ok


def test_next_and_last_cross_chunks_and_keys(spark):
    left = stamps(spark.createDataFrame([(1, 1, T0), (2, 1, at(days=9)), (3, 2, T0)], "id long, k long, ts timestamp"), "ts")
    right = stamps(spark.createDataFrame([(1, T0, 7, "same"), (1, at(days=3), 8, "late"), (1, at(hours=1), 9, "soon"), (1, at(hours=1), 10, "tie")], "k long, ts timestamp, n long, v string"), "ts")
    nxt = {r["id"]: r["next_ts"] for r in intervals.next_after(left, right.select("k", "ts"), "k").collect()}
    assert nxt == {1: at(hours=1), 2: None, 3: None}
    same = {r["id"]: r["next_ts"] for r in intervals.next_after(left, right.select("k", "ts"), "k", strict=False).collect()}
    assert same[1] == T0
    last = {r["id"]: r["last_value"] for r in intervals.last_before(left, right, "k", "v", "n").collect()}
    assert last == {1: None, 2: "late", 3: None}


def test_recent_count_sees_the_chunk_before(spark):
    midnight = dt.datetime(2024, 1, 10)
    times = [midnight - dt.timedelta(hours=1), midnight + dt.timedelta(hours=22), midnight + dt.timedelta(hours=23), midnight + dt.timedelta(hours=23, seconds=1)]
    ev = stamps(spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "k long, i long, ts timestamp"), "ts")
    assert {r["i"]: r["n_recent"] for r in intervals.recent_count(ev, "k", 86400).collect()} == {0: 1, 1: 2, 2: 3, 3: 3}


def test_moscow_monday(spark):
    df = stamps(spark.createDataFrame([(dt.datetime(2024, 1, 7, 20, 59),), (dt.datetime(2024, 1, 7, 21),)], "ts timestamp"), "ts")
    assert [r[0] for r in df.orderBy("ts").select(calendar.week(F.col("ts"))).collect()] == [dt.date(2024, 1, 1), dt.date(2024, 1, 8)]
    assert [r[0] for r in df.orderBy("ts").select(calendar.day(F.col("ts"))).collect()] == [dt.date(2024, 1, 7), dt.date(2024, 1, 8)]


@pytest.mark.parametrize("day,d7", [(6, 0.0), (7, 1.0), (8, 0.0)])
def test_retention_is_on_the_day(spark, day, d7):
    entered = stamps(spark.createDataFrame([(1, T0)], "account_id long, entered timestamp"), "entered")
    seen = spark.createDataFrame([(1, T0.date() + dt.timedelta(days=day), dt.date(2024, 1, 8))], "account_id long, day date, week date")
    assert cohorts.retained_on(entered, seen, "day", [7], "d").first()["d7"] == d7


def test_deleted_account_stays_in_the_denominator(spark):
    entered = stamps(spark.createDataFrame([(1, T0), (2, T0)], "account_id long, entered timestamp"), "entered")
    seen = spark.createDataFrame([(1, T0.date() + dt.timedelta(days=1), dt.date(2024, 1, 8))], "account_id long, day date, week date")
    r = cohorts.retained_on(entered, seen, "day", [1], "d").first()
    assert (r["size"], r["d1"]) == (2, 0.5)


def test_activation_window_ends_inclusive(spark):
    entered = stamps(spark.createDataFrame([(1, T0), (2, T0)], "account_id long, entered timestamp"), "entered")
    ev = stamps(spark.createDataFrame([(1, "use", at(hours=24)), (2, "use", at(hours=24, seconds=1))], "account_id long, event string, ts timestamp"), "ts")
    got = {r["account_id"]: r["activated"] for r in cohorts.activation(entered, ev, {"use": 1}, 1).collect()}
    assert got == {1: True, 2: False}


def test_funnel_needs_the_order(spark):
    ev = stamps(spark.createDataFrame([(1, "a", T0), (1, "b", at(hours=1)), (2, "b", T0), (2, "a", at(hours=1)), (3, "a", T0), (3, "b", T0)], "account_id long, event string, ts timestamp"), "ts")
    assert [(r["name"], r["accounts"]) for r in cohorts.ordered_funnel(ev, ["a", "b"]).orderBy("step").collect()] == [("a", 3), ("b", 1)]


def test_company_total_counts_a_person_once(spark):
    df = spark.createDataFrame([(1, "w", p) for p in "xyz"], "account_id long, week string, product string")
    got = {(r["product"], r["is_total"]): r["n"] for r in activity.with_total(df, "week", "product", "n").collect()}
    assert got == {("x", 0): 1, ("y", 0): 1, ("z", 0): 1, (None, 1): 1}


def test_trailing_distinct_drops_after_its_days(spark):
    d = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(1, d), (2, d + dt.timedelta(days=29)), (2, d + dt.timedelta(days=30))], "account_id long, day date")
    assert sorted((r["day"], r["n"]) for r in activity.trailing_distinct(df, 30, "n").collect()) == [(d, 1), (d + dt.timedelta(days=29), 2), (d + dt.timedelta(days=30), 1)]


def test_share_of_nothing_is_unknown(spark):
    df = spark.createDataFrame([(0, 0), (0, 5)], "a int, b int")
    assert [r[0] for r in df.select(activity.share(F.col("a"), F.col("b"))).collect()] == [None, 0.0]


def test_bridge_and_churn(spark):
    m = lambda i: dt.date(2024, i, 1)
    df = spark.createDataFrame([(1, m(1), 100), (1, m(2), 150), (2, m(1), 100), (2, m(2), 40), (3, m(1), 70), (4, m(2), 30), (3, m(3), 70), (1, m(3), 150), (2, m(3), 40), (4, m(3), 30)], "customer long, month date, amount long")
    b = {r["month"]: (r["new"], r["expansion"], r["contraction"], r["churned"]) for r in money.bridge(df).collect()}
    assert b == {m(1): (270, 0, 0, 0), m(2): (30, 50, -60, -70), m(3): (70, 0, 0, 0)}
    c = {r["month"]: (r["at_start"], r["lost"], r["account_churn"]) for r in money.churn(df).collect()}
    assert c == {m(2): (3, 1, round(1 / 3, 6)), m(3): (3, 0, 0.0)}


def test_reconcile_keeps_differences(spark):
    left = spark.createDataFrame([(1, 100), (2, 200), (3, 300)], "k long, cents long")
    right = spark.createDataFrame([(1, 100), (2, 190), (4, 5)], "k long, cents long")
    assert {r["verdict"]: r["n"] for r in money.reconcile(left, right, "k").collect()} == {"equal": 1, "differs": 1, "only_left": 1, "only_right": 1}


def test_streak_needs_its_length(spark):
    df = spark.createDataFrame([(i, f) for i, f in enumerate([True, True, True, None, True])], "i int, f boolean")
    assert [r[0] for r in df.select("i", series.streak(F.col("f"), 3, "i").alias("s")).orderBy("i").select("s").collect()] == [False, False, True, False, False]


def test_silence_and_islands(spark):
    d = lambda i: dt.date(2024, 1, i)
    days = spark.createDataFrame([(d(1),), (d(2),), (d(6),)], "day date")
    assert [r["silent_days"] for r in series.silence(days).orderBy("day").collect()] == [0, 0, 1, 2, 3, 0]
    runs = series.islands(days.withColumn("k", F.lit(1)), "k", "day").orderBy("start").collect()
    assert [(r["start"], r["length"]) for r in runs] == [(d(1), 2), (d(6), 1)]


@pytest.mark.parametrize("value,n,state", [(None, 100, "not_checked"), (95.0, 20, "ok"), (89.0, 19, "observation"), (89.0, 20, "breach"), (0.0, 20, "breach")])
def test_alert_states(spark, value, n, state):
    rules = alerts.table(spark, (alerts.Rule("a", "m", "below", 90.0, 20, "P0"),))
    values = spark.createDataFrame([("m", dt.date(2024, 1, 1), value, 99.0, n)], "metric string, period date, value double, prev double, n long")
    got = alerts.evaluate(rules, values).first()
    assert (got["state"], got["priority"]) == (state, "P0" if state == "breach" else None)


def test_alert_without_metric_and_stale(spark):
    rules = alerts.table(spark, (alerts.Rule("a", "m", "below", 90.0, None, "P0"), alerts.Rule("b", "gone", "above", 1.0, None, "P1")))
    values = spark.createDataFrame([("m", dt.date(2024, 1, 1), 10.0, None, None)], "metric string, period date, value double, prev double, n long")
    got = {r["rule_id"]: r["state"] for r in alerts.evaluate(rules, values, as_of=F.to_date(F.lit("2024-01-09"))).collect()}
    assert got == {"a": "stale", "b": "not_checked"}


def test_catalogue_has_each_rule_once():
    assert len(alerts.RULES) == 39 == len({r.rule_id for r in alerts.RULES}) and {r.op for r in alerts.RULES} <= set(alerts.OPS)


EVENTS = [Event("p", "go", "?", (Field("n", "number", True), Field("s", "string", values=("a", "b")), Field("b", "boolean"))), Event(ANY, "link", "?")]


@pytest.mark.parametrize(
    "row,reason",
    [
        (("go", "p", T0, "1", None, {"n": "1"}), None), (("go", "p", T0, None, "d", {"n": "1.5", "s": "a", "b": "true"}), None), (("go", "p", T0, None, None, {"n": "1"}), "no_id"),
        (("go", "p", None, "1", None, {"n": "1"}), "no_ts"), (("no", "p", T0, "1", None, {}), "unknown_event"), ((None, "p", T0, "1", None, {}), "unknown_event"), (("go", "q", T0, "1", None, {"n": "1"}), "foreign_product"),
        (("link", "q", T0, "1", None, None), None), (("link", "q", T0, "1", None, {"x": "1"}), "extra_field"), (("go", "p", T0, "1", None, {"n": "1", "x": "1"}), "extra_field"), (("go", "p", T0, "1", None, {}), "missing_field"),
        (("go", "p", T0, "1", None, {"n": "one"}), "bad_type"), (("go", "p", T0, "1", None, {"n": "1", "s": "c"}), "bad_type"), (("go", "p", T0, "1", None, {"n": "1", "b": "2"}), "bad_type"), (("go", "q", T0, None, None, {"x": "1"}), "no_id"),
    ],
)
def test_rejection_reasons(spark, row, reason):
    df = spark.createDataFrame([row], "event string, product string, ts timestamp, account_id string, device_id string, props map<string,string>")
    assert ingest.validate(df, EVENTS).first()["reason"] == reason


def test_registry_refuses_events_without_a_question(spark):
    with pytest.raises(ValueError):
        load([Event("p", "e", " ")])
    with pytest.raises(ValueError):
        load([Event("p", "e", "?"), Event("p", "e", "?")])
    assert table(spark, EVENTS).count() == 4


def test_client_trims_where_the_server_rejects(spark):
    df = spark.createDataFrame([("go", {"n": "1", "x": "2"})], "event string, props map<string,string>")
    assert ingest.trim(df, EVENTS).first()["props"] == {"n": "1"}


def test_consent(spark):
    ev = spark.createDataFrame([(1, T0, "a", "d"), (2, at(hours=2), "a", "d"), (3, T0, None, "d"), (4, at(hours=2), None, "d"), (5, at(hours=4), None, "d")], "event_id long, ts timestamp, account_id string, device_id string")
    told = spark.createDataFrame([("account", "a", True, at(hours=1)), ("device", "d", True, at(hours=1)), ("device", "d", False, at(hours=3))], "kind string, id string, granted boolean, ts timestamp")
    got = {r["event_id"]: r["device_id"] for r in ingest.consented(ev, told).collect()}
    assert got == {1: None, 2: "d", 4: "d"}


def test_stitch_takes_the_earliest_link(spark):
    ev = spark.createDataFrame([(1, None, "d"), (2, "z", "d"), (3, None, "e")], "event_id long, account_id string, device_id string")
    links = spark.createDataFrame([("d", "late", at(hours=1)), ("d", "early", T0)], "device_id string, account_id string, ts timestamp")
    assert {r["event_id"]: r["person"] for r in ingest.stitch(ev, links).collect()} == {1: "early", 2: "z", 3: "d:e"}


def test_late_and_repeated_delivery_changes_nothing(spark):
    once = [(1, T0), (2, at(hours=1)), (3, at(hours=2))]
    a = ingest.dedup(spark.createDataFrame(once, "event_id long, ts timestamp"))
    b = ingest.dedup(spark.createDataFrame([*reversed(once), once[0], once[2]], "event_id long, ts timestamp"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_reminder_is_late_after_fifteen_minutes(spark):
    df = spark.createDataFrame([(T0, at(minutes=15)), (T0, at(minutes=15, seconds=1))], "due timestamp, sent timestamp")
    assert [r["late"] for r in ingest.late(df, "due", "sent").orderBy("sent").collect()] == [False, True]


def test_precedence_names_the_conflict(spark):
    df = spark.createDataFrame([(1, "manual", 120), (1, "billing", 100), (2, "web", 100), (2, "store", 105)], "k long, source string, value long")
    got = {r["k"]: (r["source"], r["value"], r["conflict"]) for r in sets.precedence(df, "k").collect()}
    assert got == {1: ("billing", 100, True), 2: ("store", 105, False)}


def test_capacity_cut_and_queue_jumpers(spark):
    df = spark.createDataFrame([("a", 5, 5, 5, False), ("b", 1, 1, 4, True), ("c", 9, 1, 3, False), ("d", 1, 1, 0, False)], "item string, impact int, confidence int, effort int, p0 boolean")
    ranked = sets.scored(df, F.col("p0"))
    assert [r["item"] for r in ranked.orderBy("place").collect()] == ["b", "a", "c", "d"]
    got = {r["item"]: (r["load"], r["taken"]) for r in sets.capacity_cut(ranked, 9, block=2).collect()}
    assert got == {"b": (4, True), "a": (9, True), "c": (12, False), "d": (12, False)}


def test_places_over_blocks_of_scores(spark):
    """More distinct scores than blocks, ties, missing scores and items that jump the queue."""
    from tidemark.operators import sets

    rows = [(i, (i * 7) % 50 + 1, i % 3 + 1, i % 11, i % 13 == 0) for i in range(500)]
    got = sets.scored(spark.createDataFrame(rows, "item int, impact int, confidence int, effort int, p0 boolean"), F.col("p0"), blocks=8)
    places = {r["item"]: r["place"] for r in got.collect()}
    score = lambda r: round(r[1] * r[2] / r[3], 6) if r[3] else None
    want = sorted(rows, key=lambda r: (not r[4], score(r) is None, -(score(r) or 0), r[0]))
    assert [places[r[0]] for r in want] == list(range(1, 501))
