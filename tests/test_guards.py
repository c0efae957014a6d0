"""The leak guard and the tie-break over days against brute force."""

import datetime as dt
import random
import re

from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import leaks, sets


def passages(text, n=8):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_leaks_agree_with_brute_force(spark):
    rng = random.Random(91)
    vocabulary = [f"w{i}" for i in range(40)] + ["été", "Пётр", "日本"]
    notes = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90))) for _ in range(60)] + [None, "", "one two three four five six seven eight"]
    notes += [notes[0]] * 30  # copies
    fields = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(80)] + [None, "", "ONE, two; three. FOUR five\nsix seven eight!", "one two three four five six seven nine"]
    for i in range(40):  # passages of known length, some too short
        w = notes[rng.randrange(60)].split()
        at = rng.randrange(max(1, len(w) - 12))
        fields.append("pre fix " + " ".join(w[at : at + rng.randint(3, 12)]) + " suf fix")
    known = set().union(*map(passages, notes))
    want = sorted((len(passages(f) & known), min(passages(f) & known, default=None), i) for i, f in enumerate(fields))
    out = spark.createDataFrame(list(enumerate(fields)), "key long, field string").withColumn("note", F.lit("extra"))
    got = leaks.leaks(spark.createDataFrame([(n,) for n in notes], "note string").repartition(3), out.repartition(3), "note", "key", "field")
    assert sorted(got.columns) == ["example", "field", "key", "leaked", "note"]
    assert sorted(((r["leaked"], r["example"], r["key"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(n > 0 for n, *_ in want) > 10 and sum(n == 0 for n, *_ in want) > 40


def test_any_shared_passage_shares_a_fingerprint(spark):
    rng = random.Random(92)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(40)]
    df = leaks.fingerprints(spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", leaks.words(F.col("t"))), "w", "f").collect()
    for a in df:
        for b in df:
            if passages(a["t"]) & passages(b["t"]):
                assert set(a["f"]) & set(b["f"])
    assert max(len(r["f"]) for r in df) < 26  # fewer than there are places


def test_leaks_of_nothing(spark):
    none = spark.createDataFrame([], "note string")
    out = spark.createDataFrame([(1, "a b c d e f g h i")], "key long, field string")
    assert rows(leaks.leaks(none, out, "note", "key", "field").select("key", "leaked")) == [(1, 0)]
    assert leaks.leaks(none, out.limit(0), "note", "key", "field").count() == 0


def test_the_core_does_not_win_ties_for_long(spark):
    rng = random.Random(93)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    scores = [(d, p, rng.choice([1, 2])) for d in days for p in rng.sample("abc", rng.randint(1, 3))]
    run, want = 0, []
    for d in days:
        own = {p: s for x, p, s in scores if x == d}
        top = sorted(p for p, s in own.items() if s == max(own.values()))
        tie = len(top) > 1 and "b" in top
        by_tie = tie and run < 2
        run = run + 1 if by_tie else 0
        want.append((by_tie, d.isoformat(), "b" if by_tie else next(p for p in top if not tie or p != "b")))
    got = sets.daily_lead(spark.createDataFrame(scores, "day date, product string, score long"), "day", "product", "score", "b")
    assert rows(got) == sorted(want, key=repr)
    flags = [w[0] for w in want]
    assert any(flags[i] and flags[i + 1] for i in range(58)) and not any(all(flags[i : i + 3]) for i in range(58))
    assert sets.daily_lead(spark.createDataFrame([], "day date, product string, score long"), "day", "product", "score", "b").count() == 0
