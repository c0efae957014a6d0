"""The corpus pipeline: five stages, each one operator, over `documents`.

Every stage takes tables with any further columns, of whatever name, and gives the columns of documents only. An empty table gives an
empty table, very long texts are read whole, and reruns over the same rows give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import scratch
from tidemark.llm.language import identify
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import training_order
from tidemark.llm.packing import pack_documents
from tidemark.llm.simhash import keep_one

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language stays ambiguous, go.

    Null, empty and letterless texts go; rows without doc_id are judged like others, though not learned from; repeated rows are each judged; equal
    losses are ambiguous. If no row has a language, all go.
    """
    return identify(docs).where("lang_pred <> 'und' and not ambiguous").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat stay in one of them only, that of the largest doc_id.

    No row goes. A null text comes back empty. Rows that share a doc_id are one document; rows without one neither count nor lose lines.
    """
    return _documents(dedup_lines(docs))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least doc_id.

    Null, empty and blank texts are one group. Rows without doc_id all stay. Of rows that share a doc_id each group keeps its own, and of those that agree in their
    fingerprint too the least text stays.
    """
    return keep_one(docs).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 2 times, in training order.

    A null source is a source of its own; null and empty texts have size 0 and are taken where their place is. Rows without doc_id stand by their text, rows that
    share one by it and their text.
    """
    return training_order(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document's tokens, with its sequence and offset.

    A null or empty text is the one end token. Rows with null or repeated doc_id are each packed, so a document taken twice is there twice.
    """
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("source_mix", source_mix), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents in turn; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = scratch.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
