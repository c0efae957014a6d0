"""Clustering, sharding and alignment against brute force and on the edges."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import LONG, docs

from tidemark.llm import alignment, clustering, packing, sharding

# ---- clustering -----------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, cluster string, x int"


def clusters_by_hand(rows, k, rounds, dim):
    """(vec_id, cluster, distance) and centroids in whole numbers of any size."""
    hold = lambda v: max(-clustering.HOLD, min(clustering.HOLD, math.floor(256 * v)))
    kept = [(i, e) for i, e in rows if e is not None and len(e) == dim and all(v is not None and math.isfinite(v) for v in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    kept = [(i, [hold(v) for v in e]) for i, e in kept]
    c = [[hold(v) for v in e] for _, e in order[:k]]
    apart = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    nearest = lambda x: min((apart(x, m), n) for n, m in enumerate(c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, x in kept:
            own[nearest(x)[1]].append(x)
        c = [[sum(col) // len(own[n]) for col in zip(*own[n], strict=True)] if own[n] else m for n, m in enumerate(c)]
    return [(i, nearest(x)[1], nearest(x)[0]) for i, x in kept], c


def check_clusters(spark, rows, k, dim, rounds=5):
    got = clustering.cluster_vectors(spark.createDataFrame([(i, e, "c", 1) for i, e in rows], VECTORS), k=k, rounds=rounds, dim=dim).collect()
    want, c = clusters_by_hand(rows, k, rounds, dim)
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == Counter(want)
    sums = Counter()
    for _, n, d in want:
        sums[n] += d
    assert all(r["cluster_inertia"] == min(sums[r["cluster"]], 2**63 - 1) and r["inertia"] == min(sum(sums.values()), 2**63 - 1) and r["centroid"] == c[r["cluster"]] for r in got)
    return got


def test_clusters_agree_with_brute_force(spark):
    rng = random.Random(41)
    around = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    rows = [(i, [m + rng.gauss(0, 0.2) for m in rng.choice(around)]) for i in range(300)]
    rows += [(None, [0.5] * 6), (7, [0.25] * 6), (7, [0.25] * 6), (900, None), (901, [1.0] * 5), (902, [None] * 6), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (905, [])]
    check_clusters(spark, rows, 12, 6)
    check_clusters(spark, rows, 12, 6, rounds=0)


def test_clusters_of_ties_copies_few_and_huge_vectors(spark):
    rng = random.Random(42)
    check_clusters(spark, [(i, [float(rng.randint(-1, 1)), float(rng.randint(-1, 1))]) for i in range(120)], 10, 2)  # many at equal distance, coinciding starts
    check_clusters(spark, [(i, [1.0, 2.0]) for i in range(50)], 8, 2)
    check_clusters(spark, [(1, [1.0, 2.0])], 8, 2)
    check_clusters(spark, [(i, [rng.choice([-1, 1]) * 10.0 ** rng.randint(0, 300) for _ in range(3)]) for i in range(60)], 5, 3)
    assert clustering.cluster_vectors(spark.createDataFrame([(1, None, "c", 1)], VECTORS)).count() == 0
    assert clustering.cluster_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_bounds_certify_only_what_is_so_and_spare_most_scans():
    rng = np.random.default_rng(43)
    middle = rng.integers(-500, 500, (30, 8))
    x = middle[rng.integers(0, 30, 4000)] + rng.integers(-40, 40, (4000, 8))
    c = x[:30].copy()
    b, spared = clustering.Bounds.measured(x, c, 8), []
    for _ in range(12):
        new = np.array([x[b.cluster == n].sum(0) // max(1, (b.cluster == n).sum()) if (b.cluster == n).any() else c[n] for n in range(30)])
        b.moved(np.sqrt(((new - c) ** 2).sum(1).astype(float)) * (1 + clustering.MARGIN), 6)
        c = new
        used = b.assign(x, c)
        d = clustering.squared(x, c)
        assert (b.cluster == d.argmin(1)).all()
        far = np.sqrt(d.astype(float))
        assert (b.upper >= far[np.arange(len(x)), b.cluster] - 1e-6).all() and (b.low <= np.take_along_axis(far, b.near, 1) + 1e-6).all()
        others = far.copy()
        np.put_along_axis(others, b.near, np.inf, 1)
        others[np.arange(len(x)), b.cluster] = np.inf
        assert (b.rest <= others.min(1) + 1e-6).all()
        spared.append((used == 0).mean())
    assert spared[-1] > 0.95


def test_distances_are_exact_at_any_size():
    for most in (100, 1 << 20, clustering.HOLD):
        x, c = (np.random.default_rng(44).integers(-most, most + 1, (n, 64)) for n in (50, 7))
        assert clustering.squared(x, c).tolist() == [[sum((int(p) - int(q)) ** 2 for p, q in zip(a, b, strict=True)) for b in c] for a in x]


def test_lists_shrink_to_what_serves():
    assert clustering._fewer([990, 10, 0, 0, 0, 0, 0], 5, 16) == 2  # an eighth of k at least
    assert clustering._fewer([500, 0, 0, 490, 10, 0, 0], 5, 16) == 3
    assert clustering._fewer([0, 0, 0, 9, 0, 0, 100], 3, 16) == 3


# ---- sharding -------------------------------------------------------------


def shard_by_hand(key, tree):
    """(region, rack, shard) by descending the tree in plain Python."""
    length = lambda name, w: -math.log((int(hashlib.md5(f"{key}/{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w
    region, rack = defaultdict(float), defaultdict(float)
    for s in tree.base:
        region[s.region] += s.weight
        rack[s.region, s.rack] += s.weight
    tops = [(length(f"region{r}", w), 0, r) for r, w in region.items() if w] + [(length(f"shard{s.number}", s.weight), 1, s) for s in tree.added if s.weight]
    _, late, top = min(tops, key=lambda t: t[0])
    if late:
        return top.region, top.rack, top.number
    k = min((length(f"region{top}/{k}", w), k) for (r, k), w in rack.items() if r == top and w)[1]
    return top, k, min((length(f"region{top}/rack{k}/{s.number}", s.weight), s.number) for s in tree.base if (s.region, s.rack) == (top, k) and s.weight)[1]


UNEVEN = sharding.Tree((sharding.Shard(0, 0, 0, 1.0), sharding.Shard(1, 0, 1, 4.0), sharding.Shard(2, 0, 1, 2.0), sharding.Shard(3, 2, 5, 3.0), sharding.Shard(4, 2, 5, 0.0), sharding.Shard(5, 2, 6, 0.5)), (sharding.Shard(7, 2, 6, 1.5), sharding.Shard(8, 0, 0, 0.25)))


@pytest.mark.parametrize("tree", [sharding.even_tree(), UNEVEN, sharding.even_tree(1, 1, 1)])
def test_shards_agree_with_brute_force(spark, tree):
    rng = random.Random(51)
    texts = ["".join(rng.choice("abé😀 \n") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts[:8] = [None, "", LONG, "same", "same", "same", None, "alone"]
    ids = list(range(400))
    ids[3:8] = [5, 5, 5, None, None]
    got = sharding.shard_documents(docs(spark, texts, ids=ids), tree).collect()
    assert len(got) == 400
    key = lambda i, t: str(i) if i is not None else hashlib.md5((t or "").encode()).hexdigest()
    want = Counter()
    for i, t in zip(ids, texts, strict=True):
        raw = (t or "").encode()
        want[(i, len(raw) + 16, zlib.crc32(raw), "key", *shard_by_hand(key(i, t), tree), shard_by_hand(key(i, t), tree.grown())[2])] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["region"], r["rack"], r["shard"], r["grown_shard"]) for r in got) == want
    of = defaultdict(list)
    for r in got:
        of[r["shard"]].append((r["slot"], (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"])))
    for slots in of.values():
        slots.sort()
        assert [s for s, _ in slots] == list(range(len(slots))) and [o for _, o in slots] == sorted(o for _, o in slots)


def test_movement_stays_in_what_changes():
    tree, keys = sharding.even_tree(24, 3, 2), [str(i) for i in range(4000)]
    before = [shard_by_hand(k, tree) for k in keys]
    counts = Counter(s for _, _, s in before)
    assert len(counts) == 24 and max(counts.values()) < 1.5 * 4000 / 24
    for _ in range(3):  # each further shard takes only into itself
        grown = tree.grown()
        after = [shard_by_hand(k, grown) for k in keys]
        moved = [(a, b) for a, b in zip(before, after, strict=True) if a != b]
        assert moved and all(b[2] == grown.added[-1].number for _, b in moved) and len(moved) < 1.6 * 4000 / (24 + len(grown.added))
        tree, before = grown, after
    base = sharding.even_tree(24, 3, 2)
    heavier = sharding.Tree(tuple(sharding.Shard(s.number, s.region, s.rack, 3.0 if s.number == 5 else 1.0) for s in base.base))
    for a, b in zip((shard_by_hand(k, base) for k in keys), (shard_by_hand(k, heavier) for k in keys), strict=True):
        assert a == b or b[0] == 0 and (a[0] != 0 or b[1] == 1 and (a[1] != 1 or b[2] == 5))  # into the region; within it, into the rack; within that, into the shard


def test_slots_of_one_key_lie_in_many_tasks(spark):
    """All rows share doc_id and text: they have one shard, and no task holds most of them."""
    rows = spark.range(20_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sharding.shard_documents(rows)
        per_task = got.groupBy(F.spark_partition_id()).count().collect()
        assert got.select("shard").distinct().count() == 1 and got.agg(F.count_distinct("slot"), F.max("slot")).first()[:] == (20_000, 19_999)
        assert max(r["count"] for r in per_task) <= 10_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)


def test_shards_of_nothing_and_on_disk(spark, tmp_path):
    assert sharding.shard_documents(docs(spark, [])).count() == 0
    rows = docs(spark, [f"text {i}" for i in range(300)]).withColumn("shard", F.lit("old")).withColumn("a.b", F.lit(1))
    sharding.write_shards(rows, str(tmp_path / "shards"), files=3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    want = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(rows).collect()}
    assert {r["doc_id"]: r["shard"] for r in back.select("doc_id", "shard").collect()} == want and "a.b" in back.columns
    assert max(len(list(p.glob("*.parquet"))) for p in (tmp_path / "shards").glob("shard=*")) in (2, 3)


# ---- alignment ------------------------------------------------------------


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(packing.vocabulary(), alignment.pieces_path())


def alignment_by_hand(texts):
    """Per text: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups), token by token."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    t = Tokenizer.from_file(packing.vocabulary()[0])
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=alignment.pieces_path())
    said = {}  # the byte that each character of a byte-level token stands for
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for b in range(256):
        said[chr(b) if b in plain else chr(256 + [x for x in range(256) if x not in plain].index(b))] = b
    assert set(said) == set(ByteLevel.alphabet())
    out, links, docs_of = [], [], Counter()
    for text in texts:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        bytes_a = [bytes(said[ch] for ch in t.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            a, b, bytes_a, bytes_b = [], [], [], []
        groups, i, j, at_a, at_b, one = [], 0, 0, 0, 0, ([], [])
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                one[0].append(a[i])
                at_a += len(bytes_a[i])
                i += 1
            else:
                one[1].append(b[j])
                at_b += len(bytes_b[j])
                j += 1
            if at_a == at_b:
                groups.append(one)
                one = ([], [])
        own = Counter((p, q) for ga, gb in groups for p in ga for q in gb)
        docs_of.update(own.keys())
        listing = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((len(a), len(b), len(groups), sum(own.values()), hashlib.sha256(listing.encode()).hexdigest() if a else "", groups))
        links.append(own)
    best = defaultdict(int)
    for (p, _), n in docs_of.items():
        best[p] = max(best[p], n)
    return [(*o[:4], sum(m for (p, q), m in own.items() if docs_of[p, q] == best[p]), sum(m * docs_of[k] for k, m in own.items()), *o[4:]) for o, own in zip(out, links, strict=True)]


def check_alignment(spark, texts, ids=None, **how):
    got = alignment.align(docs(spark, texts, ids=ids).repartition(3), keep_groups=True, **how).collect()
    cols = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want = Counter((i, *w[:7]) for i, w in zip(ids or range(len(texts)), alignment_by_hand(texts), strict=True))
    assert Counter((r["doc_id"], *(r[c] for c in cols)) for r in got) == want
    return got


def test_alignment_agrees_with_brute_force(spark):
    rng = random.Random(61)
    voice = ["internationalization", "the", "naïve café", "日本語のテキスト", "😀👍🏽", "\n\n", "    ", "\t", "0123456789", "don't", "<|endoftext|>", "<s>", "<unk>", "</s>", "<0x41>", "Straße", "ﬁ", " ", "▁", "aaaaaaaaaaaaaaaaaaaaaaaa", "http://a.b/c?d=e", "Привет", "é", "\x00", "﻿", " "]
    texts = [rng.choice(["", " "]).join(rng.choice(voice) for _ in range(rng.randint(1, 14))) for _ in range(150)] + [None, "", " ", "a", "a", "a", " lead", "trail "]
    ids = list(range(len(texts)))
    ids[4:7] = [None, 9, 9]
    got = check_alignment(spark, texts, ids)
    assert 0 < sum(r["n_a"] == 0 for r in got) < 60  # some texts are changed by a tokenizer, most are not
    by_hand = {i: g for i, (*_, g) in enumerate(alignment_by_hand(texts))}
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] not in (9,) and r["doc_id"] not in ids[4:7]:
            assert [([*g["a"]], [*g["b"]]) for g in r["groups"]] == by_hand[r["doc_id"]]


def test_alignment_in_many_blocks_and_chunks(spark, monkeypatch):
    rng = random.Random(62)
    texts = [" ".join(rng.choice(["internationalization", "tokenizers", "words", "of", "alignments", "hyperparameterization", "xqzjk"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", 50)
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 300)
    check_alignment(spark, texts)
    assert alignment.tokenized(docs(spark, texts)).where("a is not null").count() > 10


def test_alignment_of_wide_groups_long_texts_and_nothing(spark, monkeypatch):
    texts = ["word " * 3000 + "end", "ab" * 4000, "日本" * 500, "x" * 5000, "the end"]
    check_alignment(spark, texts)
    monkeypatch.setattr(alignment, "WIDE", 0)
    check_alignment(spark, texts)
    assert alignment.align(docs(spark, [])).count() == 0
    assert [r[1:5] for r in alignment.align(docs(spark, [None, ""])).collect()] == [(0, 0, 0, 0)] * 2


def test_union_find_and_groups_agree_with_walks(pair):
    rng = np.random.default_rng(63)
    for _ in range(50):
        n, m = int(rng.integers(1, 60)), int(rng.integers(0, 90))
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        least = list(range(n))
        for _ in range(n):
            for p, q in zip(u, v, strict=True):
                least[p] = least[q] = min(least[p], least[q])
        assert alignment.united(u, v, n).tolist() == least
    ends_a, ends_b = np.array([2, 3, 7, 8]), np.array([1, 3, 4, 8])
    g = alignment.grouped(np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0))
    assert (g.of_a.tolist(), g.of_b.tolist(), g.n_a.tolist(), g.n_b.tolist()) == ([0, 0, 1, 1], [0, 0, 1, 1], [2, 2], [2, 2])


def test_pair_counts_are_of_documents(spark):
    rows, _ = alignment.scratch.stored(alignment.tokenized(docs(spark, ["the the the", "the", "the cat"])), "t")
    got = alignment.pair_counts(rows).collect()
    assert max(r["n_docs"] for r in got) == 3 and all(r["best"] for r in got)


def test_token_map_names_the_partners_in_most_documents(spark, pair):
    texts = ["the cat", "the dog", "the the", None, "a cat"]
    got = {}
    for r in alignment.token_map(docs(spark, texts)).collect():
        got.setdefault(pair.bytes_a[r["a"]], set()).add((pair.bytes_b[r["b"]], r["n_docs"]))
    assert got[b" the"] == {(b" the", 3)} and got[b" cat"] == {(b" cat", 2)}
    assert alignment.token_map(docs(spark, [None, ""])).count() == 0
