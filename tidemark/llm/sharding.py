"""Shards by a hierarchical weighted hash tree.

A document descends from the root to a region, a rack and a shard. At each level every child draws a straw from a hash of the document
and its own name, made shorter by its weight, and the shortest wins: a child wins in proportion to its weight, and a
change of one weight moves documents only into or out of that child. Children that a change does not touch keep their straws, so
movement stays within the subtrees on the path to it.

A shard that is added later hangs in its rack, but draws beside the regions, with a straw of its own weight: what it wins
comes from all shards alike, and none of it lands on a neighbour.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import scratch
from tidemark.llm.columns import quoted, spare

LAW = "key"


@dataclass(frozen=True)
class Shard:
    number: int
    region: int
    rack: int
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    """The shards that the tree was built with, and those added since, in order."""

    base: tuple[Shard, ...]
    added: tuple[Shard, ...] = ()

    def grown(self, weight: float = 1.0) -> Tree:
        """With one more shard, in the rack that weighs least."""
        every, racks = (*self.base, *self.added), {}
        for s in every:
            racks[s.region, s.rack] = racks.get((s.region, s.rack), 0) + s.weight
        region, rack = min(racks, key=lambda r: (racks[r], r))
        return Tree(self.base, (*self.added, Shard(max(s.number for s in every) + 1, region, rack, weight)))


def even_tree(shards: int = 40, regions: int = 4, racks: int = 2) -> Tree:
    """Shards of equal weight, dealt in turn into regions and their racks."""
    per_rack = -(-shards // (regions * racks))
    return Tree(tuple(Shard(i, i // (per_rack * racks), i // per_rack % racks) for i in range(shards)))


def straw(key: Column, name: Column, weight: float | Column) -> Column:
    """-ln(u) / weight for a u in (0, 1) by 52 bits of md5(key/name): the shortest of some is each one's with a chance in proportion to its weight."""
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), name)), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / weight


def _drawn(key: Column, names: list[Column], weights: list[Column]) -> Column:
    """The shortest straw's length and its place n in the list, the earlier of equal ones. A straw without a weight does not take part."""
    straws = [F.when(w.isNotNull(), F.struct(straw(key, name, w).alias("length"), F.lit(n).alias("n"))) for n, (name, w) in enumerate(zip(names, weights, strict=True))]
    return F.array_min(F.array(*straws, F.lit(None)))


def _child(key: Column, path: Column, parent: Column, children: list[list[tuple[int, float]]]) -> Column:
    """The place of the winner among the children (number, weight) of the node with the place `parent`."""
    of = lambda kind, values: F.get(F.array(*[F.array(*[F.lit(v).cast(kind) for v in own]) for own in values]), parent)
    numbers, weights = of("string", [[n for n, _ in own] for own in children]), of("double", [[w for _, w in own] for own in children])
    every = range(max(map(len, children)))
    return _drawn(key, [F.concat(path, F.lit("/"), F.get(numbers, F.lit(i))) for i in every], [F.get(weights, F.lit(i)) for i in every])["n"]


def placed(docs: DataFrame, tree: Tree, key: Column, names: tuple[str, str, str], straw_name: str | None = None) -> DataFrame:
    """docs plus region, rack and shard of the document with that key, under the names given; and, if named, the length of the straw that won at the root."""
    racks, weight = {}, {}
    for s in sorted((s for s in tree.base if s.weight > 0), key=lambda s: s.number):
        racks.setdefault(s.region, {}).setdefault(s.rack, []).append((s.number, s.weight))
        weight[s.region] = weight.get(s.region, 0.0) + s.weight
    regions, late = sorted(racks), [s for s in tree.added if s.weight > 0]
    nodes = [(r, k) for r in regions for k in sorted(racks[r])]
    leaves = [racks[r][k] for r, k in nodes]
    firsts = [nodes.index((r, min(racks[r]))) for r in regions]
    top, node, leaf, drawn = spare(docs, "_top", "_node", "_leaf", "_drawn")
    told = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at)
    out = docs.withColumn(drawn, _drawn(key, [*(F.lit(f"region{r}") for r in regions), *(F.lit(f"shard{s.number}") for s in late)], [F.lit(w) for w in (*(weight[r] for r in regions), *(s.weight for s in late))]))
    out = out.withColumn(top, F.col(drawn)["n"])
    in_region = _child(key, F.concat(F.lit("region"), told(regions, F.col(top)).cast("string")), F.col(top), [[(k, sum(w for _, w in racks[r][k])) for k in sorted(racks[r])] for r in regions])
    out = out.withColumn(node, told(firsts, F.col(top)) + in_region)
    path = F.concat(F.lit("region"), told([r for r, _ in nodes], F.col(node)).cast("string"), F.lit("/rack"), told([k for _, k in nodes], F.col(node)).cast("string"))
    out = out.withColumn(leaf, _child(key, path, F.col(node), leaves))
    base = (told([r for r, _ in nodes], F.col(node)), told([k for _, k in nodes], F.col(node)), F.get(F.get(F.array(*[F.array(*[F.lit(n) for n, _ in own]) for own in leaves]), F.col(node)), F.col(leaf)))
    at = F.col(top) - len(regions)
    since = [told([getattr(s, what) for s in late], F.when(at >= 0, at)) if late else F.lit(None) for what in ("region", "rack", "number")]
    out = out.withColumns({n: F.coalesce(a, b).cast("int") for n, a, b in zip(names, base, since, strict=True)})
    return (out.withColumn(straw_name, F.col(drawn)["length"]) if straw_name else out).drop(top, node, leaf, drawn)


def shard_documents(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, region, rack, shard, slot, and grown_shard, its shard once the tree has grown by one.

    size is the text's bytes in UTF-8 and 16 more. The law is `key`: doc_id and the tree alone decide the shard. Slots number a shard's documents
    from 0 without gaps, by doc_id, then checksum, then size.

    Texts are read once, where they lie. What is sorted for the slots are rows of some numbers, range-partitioned by shard and doc_id and, for rows that
    agree in all, by their place in the first table, so that neither a shard nor a repeated doc_id meets in one task.

    Edge cases: a null text has no bytes, as an empty one. Rows without doc_id are placed by md5 of their text and stand first in their shard. Rows that share a
    doc_id share a shard, at slots of their own. An empty table gives an empty table. Other columns are not read.
    """
    tree = tree or even_tree()
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    own = own.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))).alias("key"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    own = placed(own, tree, F.col("key"), ("region", "rack", "shard"), "straw")
    more = tree.grown().added[-1]  # it draws beside what won at the root
    own = own.withColumn("grown_shard", F.when(straw(F.col("key"), F.lit(f"shard{more.number}"), more.weight) < F.col("straw"), F.lit(more.number)).otherwise(F.col("shard"))).drop("straw", "key")
    light, path = scratch.stored(own.withColumn("at", F.monotonically_increasing_id()), "shard-rows")

    order = ("shard", F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "at")
    ranged = light.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    ranged, ranged_path = scratch.stored(ranged.drop("at"), "shard-ranges")  # the number of a row's task and its place there, fixed by writing
    scratch.drop(light.sparkSession, path)
    tasks = ranged.groupBy(F.shiftright("row", 33).alias("task"), "shard").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    heads = tasks.select(F.col("task").alias("_task"), F.col("shard").alias("_s"), "first", (F.sum("n").over(W.partitionBy("shard").orderBy("task")) - F.col("n")).alias("head"))
    rows = ranged.join(heads, (F.shiftright("row", 33) == F.col("_task")) & (F.col("shard") == F.col("_s")))
    return rows.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "region", "rack", "shard", (F.col("row") - F.col("first") + F.col("head")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, tree: Tree | None = None, files: int = 1) -> None:
    """docs as Parquet, a folder for each shard and `files` files in each at most, dealt by a hash of the row, so that a large shard is not one task."""
    tree = tree or even_tree()
    key, region, rack = spare(docs, "_key", "_region", "_rack")
    keyed = docs.drop("shard").withColumn(key, F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    out = placed(keyed, tree, F.col(key), (region, rack, "shard")).drop(key, region, rack)
    deal = F.pmod(F.xxhash64(*[F.col(quoted(c)) for c in out.columns if c != "shard"]), F.lit(files))
    out.repartition(files * len((*tree.base, *tree.added)), "shard", deal).write.partitionBy("shard").parquet(path)
