"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every text version is a blob named by its SHA-256. The ledger holds which (blob, rule version) pairs
were scanned and what was found; a scan reads only pairs the ledger lacks, appends them, and joins all
findings back to every row that holds the blob. Texts are shuffled only where a blob may occur twice or be in the
ledger; all others are scanned where they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm import scratch
from tidemark.llm.columns import spare


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern, of which those with `group` of at least min_chars count.

    Every match holds one of `needles`, upper and lower case alike if `fold`; without needles any text may match.
    """

    kind: str
    version: int
    pattern: str
    group: int
    min_chars: int
    needles: tuple[str, ...] = ()
    fold: bool = False

    def may_match(self, text: Column, lower: Column) -> Column:
        """A plain search for the needles, far cheaper than the pattern; then the pattern."""
        found = F.lit(not self.needles)
        for needle in self.needles:
            found = found | F.contains(lower if self.fold else text, F.lit(needle))
        return found & F.rlike(text, F.lit(self.pattern))


# The three base kinds as the contract words them, in its order. Runs of one class need no shorter matches than count: a run
# that is too short holds no other match.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ("passw", "secret", "token", "api"), True),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18, ("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
# Public token formats that the base kinds do not name. A jwt is tried once a run of its characters, where the run begins, and from the run's first "eyJ": so
# runs of any length cost no more than their length. What stands before that in the run is part of the span.
EXTRA = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("-----BEGIN ",)),
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?eyJ)[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1, (".eyJ",)),
    Rule("forge", 1, r"gh[opsu]_[A-Za-z0-9]+", 0, 40, ("gho_", "ghp_", "ghs_", "ghu_")),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]+", 0, 20, ("xox",)),
)
RULES = BASE + EXTRA
_FOUND = "sha string, kind string, version int, start long, stop long"
_SEEN = "sha string, kind string, version int"


_PIECE = "rule int, pos int, gap bigint, size bigint, ok boolean, text string"


def _spans(i: int, rule: Rule) -> Column:
    """Of a text: for each match of a rule its place in order, the length of the piece before it, its own, and whether it is long enough."""

    def one(gap: Column, match: Column, pos: Column) -> Column:
        judged = F.regexp_extract(match, rule.pattern, rule.group) if rule.group else match
        return F.struct(F.lit(i).alias("rule"), pos.alias("pos"), F.length(gap).cast("long").alias("gap"), F.length(match).cast("long").alias("size"), (F.length(judged) >= rule.min_chars).alias("ok"), F.lit(None).cast("string").alias("text"))

    said = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    both = F.arrays_zip(F.slice(F.split("text", rule.pattern, -1), F.lit(1), F.size(said)).alias("gap"), said.alias("match"))
    return F.transform(both, lambda m, pos: one(m["gap"], m["match"], pos))


def _pieces(blobs: DataFrame, rules: tuple[Rule, ...], aside: Column | None = None) -> DataFrame:
    """(sha, rule, pos, gap, size, ok, text): the matches of (sha, text, todo), by the rules named in todo. Where `aside` holds nothing is matched and the one row has the text.

    Most texts match no rule: they go by plain tests, and only of the rest are matches listed.
    """
    text, lower = F.col("text"), F.lower("text")
    none = F.expr(f"cast(array() as array<struct<{_PIECE.replace(' ', ':').replace(',:', ',')}>>)")
    found = F.concat(*[F.when(F.array_contains("todo", F.lit(i)) & r.may_match(text, lower), _spans(i, r)).otherwise(none) for i, r in enumerate(rules)])
    if aside is not None:
        empty = F.lit(None)
        whole = F.array(F.struct(empty.cast("int").alias("rule"), empty.cast("int").alias("pos"), empty.cast("long").alias("gap"), empty.cast("long").alias("size"), empty.cast("boolean").alias("ok"), text.alias("text")))
        found = F.when(aside, whole).otherwise(found)
    # Outer, as before an inner explode the optimiser puts a filter on the array's size, and runs all patterns a second time for it.
    return blobs.select("sha", F.explode_outer(found).alias("m")).where("m is not null").select("sha", "m.*")


def _placed(pieces: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings, in code points. Matches and the pieces between them alternate, so a running sum of their lengths gives positions."""
    upto = W.partitionBy("sha", "rule").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    hits = pieces.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(upto)).where("ok")
    kind, version = F.array(*[F.lit(r.kind) for r in rules]), F.array(*[F.lit(r.version) for r in rules])
    return hits.select("sha", F.get(kind, F.col("rule")).alias("kind"), F.get(version, F.col("rule")).alias("version"), (F.col("stop") - F.col("size")).alias("start"), "stop")


def _slot(sha: str) -> Column:
    """One of 2^24 numbers for a digest."""
    return F.conv(F.substring(sha, 1, 6), 16, 10).cast("long")


def _marked(rows: DataFrame, shas: DataFrame) -> DataFrame:
    """rows of (sha, ...) plus `perhaps`: false where sha is surely none of shas. Whatever the number of shas, the marks are 2^18 rows of 64 bits at most, which are broadcast."""
    marks = shas.select(_slot("sha").alias("_slot")).groupBy(F.floor(F.col("_slot") / 64).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, int(_slot % 64))")).alias("_bits"))
    told = rows.withColumn("_slot", _slot("sha")).join(F.broadcast(marks), F.floor(F.col("_slot") / 64) == F.col("_word"), "left")
    return told.withColumn("perhaps", F.coalesce(F.expr("shiftright(_bits, int(_slot % 64)) & 1L = 1L"), F.lit(False))).drop("_slot", "_word", "_bits")


class BlobLedger:
    """Two Parquet folders under path: scanned (blob, kind, version) triples and findings. Both are only appended to.

    Findings are appended before the triples: a job that dies between the two leaves pairs unscanned, and the
    next scan finds them again; equal findings count once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        at = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(at) if scratch.exists(self.spark, at) else self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._table("scanned", _SEEN)

    def findings(self) -> DataFrame:
        return self._table("findings", _FOUND).distinct()

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan what docs holds and the ledger lacks."""
        texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(F.sha2("text", 256).alias("sha"), "text")
        shas, path = scratch.stored(texts.groupBy("sha").agg(F.count(F.lit(1)).alias("n")), "blobs")
        number = F.coalesce(*[F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), F.lit(i)) for i, r in enumerate(rules)])
        seen = self.scanned().select("sha", number.alias("rule")).where("rule is not null").groupBy("sha").agg(F.collect_set("rule").alias("seen"))
        every, none = F.array(*map(F.lit, range(len(rules)))), F.expr("cast(array() as array<int>)")

        def unseen(blobs: DataFrame) -> DataFrame:
            return blobs.join(seen, "sha", "left").withColumn("todo", F.array_except(every, F.coalesce("seen", none))).drop("seen").where(F.size("todo") > 0)

        # One pass over the texts: one whose blob surely occurs once here and is new to the ledger is matched where it is read; only others are put aside, to meet their like.
        told = _marked(texts, shas.where("n > 1").select("sha").unionByName(seen.select("sha"))).withColumn("todo", every)
        pieces, pieces_path = scratch.stored(_pieces(told, rules, F.col("perhaps")), "blob-pieces")
        again = unseen(pieces.where("text is not null").select("sha", "text").dropDuplicates(["sha"]))
        _placed(pieces.where("text is null").unionByName(_pieces(again, rules)), rules).write.mode("append").parquet(f"{self.path}/findings")
        kind, version = F.array(*[F.lit(r.kind) for r in rules]), F.array(*[F.lit(r.version) for r in rules])
        fresh = unseen(shas.select("sha")).select("sha", F.explode("todo").alias("i"))
        fresh.select("sha", F.get(kind, F.col("i")).alias("kind"), F.get(version, F.col("i")).alias("version")).write.mode("append").parquet(f"{self.path}/scanned")
        scratch.drop(self.spark, path, pieces_path)

    def join_back(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """docs plus secrets: array of (start, rank, kind, stop) of the given rule versions, by start and then rule order."""
        docs = docs.drop("secrets")
        own, sha = spare(docs, "_own", "_sha")
        rank = F.coalesce(*[F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), F.lit(i)) for i, r in enumerate(rules)])
        per_blob = self.findings().withColumn("rank", rank).where("rank is not null").groupBy(F.col("sha").alias(sha)).agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "stop"))).alias("secrets"))
        per_blob, _ = scratch.stored(per_blob, "blob-findings")  # a table of its own, so that the join can split a blob that many rows hold
        rows = docs.withColumn(own, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
        none = F.expr("cast(array() as array<struct<start:bigint,rank:int,kind:string,stop:bigint>>)")
        return rows.join(per_blob, F.col(own) == F.col(sha), "left").withColumn("secrets", F.coalesce("secrets", none)).drop(own, sha)


def commits(docs: DataFrame, n: int = 2) -> list[DataFrame]:
    """docs in n parts by the files they lie in, as commits of a history: each reads its own files only. A table of fewer files is one part."""
    files = sorted(docs.inputFiles())
    if len(files) < n:
        return [docs]
    reader = docs.sparkSession.read.schema(docs.schema)
    return [reader.parquet(*files[i::n]) for i in range(n)]


def scan_secrets(docs: DataFrame, ledger: BlobLedger | None = None, rules: tuple[Rule, ...] = RULES, history: list[DataFrame] | None = None) -> DataFrame:
    """docs plus a `secrets` column; unseen (blob, rule version) pairs are scanned, the rest comes from the ledger.

    history: docs in parts that reach the ledger one after another, as commits do; a later part scans
    only what earlier ones did not hold. All rows are answered, whatever the parts. A text is read three times: for its digest, to be
    scanned, and to be answered.

    Edge cases: null text is the empty text, which has no secrets. Equal texts share one blob, whatever
    their ids; rows with null or repeated ids each get the findings of their text. Tokens of any length are found whole. An empty table gives an
    empty table. Without a ledger a new one is made in the shared scratch folder. An input column `secrets` is replaced; all others, of whatever name, come along.
    """
    ledger = ledger or BlobLedger(docs.sparkSession, scratch.folder(docs.sparkSession, "blob-ledger"))
    for part in history or [docs]:
        ledger.scan(part, rules)
    return ledger.join_back(docs, rules)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
