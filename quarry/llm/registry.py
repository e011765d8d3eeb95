"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from quarry.llm import contamination, lines, mixing, neardup, neighbours, passages, pii, preference, quality, tokens

MODULES = (neighbours, contamination, pii, preference, passages, tokens, neardup, mixing, quality, lines)

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
