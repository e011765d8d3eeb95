"""All queries of the engine and the equivalent DuckDB SQL."""

from __future__ import annotations

from quarry.plans import corpus, evidence, facets, imports, ledger, metrics, quality, retrieval, serving

MODULES = (ledger, corpus, retrieval, metrics, evidence, quality, serving, imports, facets)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
