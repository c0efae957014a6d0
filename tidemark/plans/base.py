"""A registry of named queries with the DuckDB SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: What tidemark.sources.tables binds, in DuckDB. Moscow has kept UTC+3 since 2014, which covers the events.
CTE = {
    "ev": """ev AS (SELECT event_id, user_id AS account_id, event_type AS event, ts, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(json_extract_string(props, '$.k') AS INT) % 3 AS product,
  CAST(ts + INTERVAL 3 HOUR AS DATE) AS day, CAST(date_trunc('week', ts + INTERVAL 3 HOUR) AS DATE) AS week FROM events)""",
    "entry": "entry AS (SELECT user_id AS account_id, min(ts) AS entered FROM events WHERE event_type = 'signup' GROUP BY user_id)",
    "charges": "charges AS (SELECT o_custkey AS customer, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_totalprice AS price, o_orderpriority = '1-URGENT' AS annual, o_orderstatus = 'F' AS ok, o_orderdate AS ts FROM orders)",
    "monthly": "monthly AS (SELECT o_custkey AS customer, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(sum(CAST(round(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice / 12 ELSE o_totalprice END * 100) AS BIGINT)) AS BIGINT) AS amount FROM orders GROUP BY 1, 2)",
}


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None, uses: str = "") -> Callable[[Query], Query]:
        """Register a function under its own name. uses: names of CTEs to put before sql; more of them may open sql, after WITH."""

        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                body, heads = sql.strip(), [CTE[name] for name in uses.split()]
                start = next((w for w in ("WITH RECURSIVE ", "WITH ") if body.startswith(w)), "")
                if start and heads:
                    body = start + ",\n".join(heads) + ",\n" + body.removeprefix(start)
                elif heads:
                    body = "WITH " + ",\n".join(heads) + "\n" + body
                self.oracles[f.__name__] = body
            return f

        return add
