"""All queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from codestrata.llm import queries as basic
from codestrata.llm import oracle, text_queries


def queries() -> dict:
    return {**basic.QUERIES, **text_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
