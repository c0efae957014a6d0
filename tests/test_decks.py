"""Deck queries over a table whose file is small for its number of rows."""

import pytest
from conftest import SF, held_against
from pyspark.sql import functions as F

from tidemark.plans import ORACLES, QUERIES, texts
from tidemark.sources import tables as T
from tidemark.sources.markdown import blocks

N = 450_000


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """One file of orders, more to a core than a task is to take."""
    path = tmp_path_factory.mktemp("many")
    status = F.when(F.col("id") % 3 == 0, "F").when(F.col("id") % 3 == 1, "O").otherwise("P")
    spark.range(N).select(F.col("id").alias("o_orderkey"), status.alias("o_orderstatus")).coalesce(1).write.parquet(str(path / "orders.parquet"))
    return str(path)


def largest(rows):
    return rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]


def test_a_task_takes_no_more_decks_where_there_are_more(spark, many):
    assert largest(texts.decks(spark, many)) <= T.A_TASK


def test_where_few_rows_are_a_task_all_cores_have_some(spark):
    assert T.spread(spark.range(0, 40, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert T.spread(spark.range(0, 95, 1, 1), 10).rdd.getNumPartitions() == 10 and largest(T.spread(spark.range(0, 95, 1, 1), 10)) <= 11


@pytest.mark.parametrize("name", ["lint_summary", "deck_blocks"])
def test_documents_are_counted_in_tasks_of_few(spark, many, name):
    """Cut by document into as many tasks as the table asks for; nothing is aggregated by document before, and nothing cut again by it after."""
    plan = QUERIES[name](spark, many)._jdf.queryExecution().executedPlan().toString()
    by_doc = [line for line in plan.splitlines() if "hashpartitioning(" in line and "doc_id" in line]
    assert len(by_doc) == 1 and ", 5), REPARTITION_BY_NUM" in by_doc[0]


def test_blocks_of_many_orders(spark, many):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{many}/orders.parquet/*.parquet')")
    held_against(c, ORACLES["deck_blocks"], QUERIES["deck_blocks"](spark, many))


def test_a_document_that_comes_again_counts_once(spark):
    """All decks under one id, in many tasks."""
    from tidemark.operators import lint

    docs = texts.decks(spark, SF).select(F.lit(7).cast("long").alias("doc_id"), "text")
    n = docs.count()
    got = {(r["level"], r["rule"]): (r["n"], r["docs"]) for r in lint.summary(lint.lint(docs), 3).collect()}
    assert got["error", "emoji"] == (n, 1) and {d for _, d in got.values()} == {1}
    assert blocks(docs).select("doc_id").distinct().count() == 1


def test_emoji_are_looked_for_without_the_other_rules(spark, many):
    """They are cut into as many tasks as the table asks for, and no other rule is judged to be dropped afterwards."""
    plan = QUERIES["lint_emoji"](spark, many)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(5)" in plan and "emoji" in plan
    assert not any(rule in plan for rule in ("no_title", "topic_title", "empty_phrase", "long_sentence", "no_evidence", "no_decisions"))


def test_findings_are_ranked_in_tasks_of_few_decks(spark, many):
    """Each task hands on its first five only, so what is left for the last one is five rows a task."""
    plan = QUERIES["findings_top5"](spark, many)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(5)" in plan and "TakeOrderedAndProject(limit=5" in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("wanted", [lambda level, rule: rule == "emoji", lambda level, rule: level == "error", lambda level, rule: level == "note", lambda level, rule: rule == "no_decisions", lambda level, rule: False])
def test_wanted_rules_find_what_they_find_among_all(spark, wanted):
    """By decks that break each of the sixteen rules."""
    from tidemark.operators import lint

    docs = spark.createDataFrame(list(enumerate(texts.BROKEN)), "doc_id long, text string")
    found = sorted(map(tuple, lint.lint(docs).collect()), key=repr)
    assert len({f[3] for f in found}) == 16
    assert sorted(map(tuple, lint.lint(docs, wanted).collect()), key=repr) == [f for f in found if wanted(f[1], f[3])]
