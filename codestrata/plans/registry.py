"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from codestrata.plans import catalog, clustering, evaluation, functions, graph, records, relational, reports, retrieval, streams  # noqa: F401

FLAGSHIP = "bm25_documents_topk"


def queries() -> dict:
    return {**catalog.QUERIES, **records.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**catalog.SQL, **records.SQL}
