"""Registered queries against their SQL, and the pipeline stage by stage."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF, held_against
from pyspark.sql import functions as F
from test_operators import VOICE, components_by_hand, fingerprint_by_hand, languages_by_hand, lines_by_hand, targets_by_hand

import corpus_pipeline
from tidemark.llm.oracles import ORACLES
from tidemark.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_operator_agrees_with_sql(spark, duck, name):
    held_against(duck, ORACLES[name], QUERIES[name](spark, SF))


def test_thirteen_operators_and_five_stages():
    assert [int(q[2:].split("_")[0]) for q in QUERIES] == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "source_mix", "packing"]


def test_secret_scan_is_native(spark):
    text = QUERIES["op2_secret_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in text for w in ("Python", "Pandas", "Arrow"))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    odd = spark.createDataFrame([(9001, None, None, None, None, 1), (9002, "", "en", "src0", 0, 1), (9003, "12 34 !!", "en", "src0", 8, 1)], docs.schema)
    now = docs.unionByName(odd)
    counts = [now.count()]
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        if name != "packing":
            assert tuple(now.columns) == corpus_pipeline.COLUMNS
        counts.append(now.count())
        if name == "language_id":
            assert now.where("doc_id > 9000").count() == 0 and counts[1] >= 0.99 * (counts[0] - 3)
        if name == "line_dedup":
            assert counts[2] == counts[1] and now.where("n_chars <> length(text)").count() == 0
        if name == "simhash_dedup":
            assert now.select("doc_id").distinct().count() == counts[3] <= counts[2]
    assert counts[-1] > 0


def test_pipeline_of_nothing(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0


def corpus(rng):
    """(doc_id, text, lang, source) with exact and near copies, lines that many share, and clean short, empty, null and letterless documents."""
    said = lambda lang, n: " ".join(a + b for a, b in zip(rng.choices(VOICE[lang].split(), k=n), rng.choices(VOICE[lang].split(), k=n), strict=True))
    shared = [said(lang, 8) for lang in sorted(VOICE)]
    rows = []
    for i in range(90):
        lang = rng.choice(sorted(VOICE))
        lines = [said(lang, rng.randint(5, 60)) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.5:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice([shared[sorted(VOICE).index(lang)], f"  {shared[sorted(VOICE).index(lang)].upper()}\t"]))
        rows.append((i, "\n".join(lines), lang, rng.choice(["web", "web", "books", None])))
    for i in range(90, 130):
        _, text, lang, source = rng.choice(rows[:90])
        words = text.split(" ")
        if i % 3:  # a near copy
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), lang, source))
    rows += [(130, None, None, "web"), (131, "", "aa", "books"), (132, "12 34 !!", "bb", "web"), (133, "banana mango papaya", "aa", "books"), (134, "word " * 4000 + said("cc", 900), "cc", "web"), (135, "banana xylem", None, None)]
    return rows


def pipeline_by_hand(rows):
    """(doc_id, piece, start, length, ids_crc32) of all pieces, by the five stages in plain Python."""
    from tokenizers import Tokenizer

    from tidemark.llm import packing

    judged = languages_by_hand([(i, t, lang) for i, t, lang, _ in rows])
    assert all(apart > 1e-4 for _, _, _, apart in judged)
    left = [r for r, (lang, _, unsure, _) in zip(rows, judged, strict=True) if lang != "und" and not unsure]
    source = {r[0]: r[3] for r in left}
    left = [(i, t) for i, t, _, _ in lines_by_hand([(i, t) for i, t, _, _ in left])]
    roots, least = components_by_hand([fingerprint_by_hand(t) for _, t in left]), {}
    for (i, _), root in zip(left, roots, strict=True):
        least[root] = min(least.get(root, i), i)
    left = [(i, t) for (i, t), root in zip(left, roots, strict=True) if least[root] == i]
    sizes = Counter()
    for i, t in left:
        sizes[source[i]] += len(t.split())
    targets, at, taken = targets_by_hand(sizes), Counter(), []
    for i, t in sorted(left, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
        s = source[i]
        taken += [(i, t)] * ((at[s] < targets[s]) + (at[s] + sizes[s] < targets[s]))
        at[s] += len(t.split())
    encode, out = Tokenizer.from_file(packing.vocabulary()[0]), Counter()
    for i, t in taken:
        ids = np.array([*encode.encode(t, add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024
        cuts = [*([0] if first else []), *range(first, len(ids), 1024)]
        for piece, (a, z) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True)):
            out[(i, piece, a, z - a, zlib.crc32(ids[a:z].tobytes()))] += 1
    return out


def test_pipeline_agrees_with_brute_force(spark, tmp_path):
    rows = corpus(random.Random(31))
    docs = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = pipeline_by_hand(rows)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    kept = {k[0] for k in want}
    assert 133 in kept and 134 in kept and not kept & {130, 131, 132} and 60 < len(kept) < 120
    at = defaultdict(list)
    for r in got:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in at.values():
        assert [o for o, _ in sorted(items)] == list(np.cumsum([0, *[n for _, n in sorted(items)][:-1]])) and sum(n for _, n in items) <= 1024


def test_pipeline_stages_on_crooked_rows(spark):
    """Repeated and missing ids, ties, a very long text, and columns with the names that operators use inside: every stage gives the columns of documents, whatever the partitions."""
    long = "banana mango papaya lemon " * 40_000
    rows = [(1, "banana mango papaya lemon", "aa", "s"), (1, "xylem phloem quartz zephyr", "bb", "s"), (1, "banana mango papaya lemon", "aa", "s"), (None, "lemon papaya mango banana", "aa", None), (None, None, None, None), (5, long, "aa", "t"), (5, long, "aa", "t"), (6, "", "aa", "t")]
    rows += [(10 + i, f"{VOICE[lang]} {VOICE[lang]}", lang, "u") for i, lang in enumerate(sorted(VOICE) * 6)]
    schema = "doc_id long, text string, lang string, source string"
    made = set()
    for parts in (1, 4):
        now = spark.createDataFrame(rows, schema).repartition(parts).withColumns({"n_chars": F.lit(0).cast("long"), "_doc": F.lit("x"), "_first": F.lit("y"), "size": F.lit(1), "a.b": F.lit("z")})
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert tuple(now.columns) == corpus_pipeline.COLUMNS, name
            now = spark.createDataFrame(now.collect(), now.schema).repartition(parts)
        made.add(tuple(sorted(map(str, now.collect()))))
        assert corpus_pipeline.packing(spark, now, SF).count() >= now.count() > 0
    assert len(made) == 1
