"""Named queries over the bound tables, each with the DuckDB SQL that it is held against."""

from tidemark.plans import governance, health, marts, metrics, product, revenue, streams, texts

REGISTRIES = tuple(m.R for m in (product, revenue, health, governance, marts, streams, texts, metrics))
QUERIES = {name: f for r in REGISTRIES for name, f in r.queries.items()}
ORACLES = {name: sql for r in REGISTRIES for name, sql in r.oracles.items()}
