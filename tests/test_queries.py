"""Every registered query of the engine against its DuckDB SQL, and the shape of its plan."""

import pytest
from conftest import SF, held_against

from tidemark.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    held_against(duck, ORACLES[name], QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["week", "wau", "wow_change"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["dau"](spark, SF))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in text.replace("user_id:bigint,event_type:string,ts:timestamp_ntz", "ts:timestamp_ntz,user_id:bigint,event_type:string")


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if q != "split_text" and not q.startswith("stream_")))
def test_no_python_and_no_pairing_in_plans(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text
    assert "CartesianProduct" not in text


def test_rate_limit_by_hand(spark):
    """The stream's verdicts against a replay of each device's events."""
    import datetime as dt

    from tidemark.sources import tables

    got = {r["event_id"]: r["accepted"] for r in QUERIES["stream_rate_limit"](spark, SF).collect()}
    kept = {}
    for r in sorted(tables.read(spark, SF, "events").collect(), key=lambda r: (r["ts"], str(r["event_id"]))):
        recent = [t for t in kept.get(r["user_id"], []) if t > r["ts"] - dt.timedelta(minutes=10)]
        assert got.pop(r["event_id"]) is (len(recent) < 2)
        kept[r["user_id"]] = recent + [r["ts"]] * (len(recent) < 2)
    assert not got
