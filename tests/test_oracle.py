"""Every query with SQL gives the rows of DuckDB on the smallest tables; every other one runs."""

import os

import oracle
import pytest

from codestrata.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
SQL, QUERIES = registry.oracle_sql(), registry.queries()


@pytest.fixture(scope="module")
def con():
    return oracle.database(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert oracle.compare(spark, con, QUERIES[name], SQL[name], FOLDER) == ""


# Queries without SQL: what must hold of their rows on these tables.
HOLDS = {
    "p4_found": "pos >= 1 and val = trim(val) and val <> '' and src in ('task_metrics', 'agent_result')",
    "p4_malformed": "flag in ('malformed_quote', 'malformed_bracket')",
    "p5_found": "attempt_pos >= 1 and entity_pos >= 1 and file is not null and symbol is not null",
    "mccabe_token_len": "coalesce(complexity, 1) >= 1 and tokens >= 0",
    "complexity_summary": "n >= 1 and failed between 0 and 1 and coalesce(median, 1) <= coalesce(p90, 1) and coalesce(p90, 1) <= coalesce(most, 1)",
    "code_notes": "notes is not null and skeleton is not null",
    "source_entities": "start <= end and kind in ('class', 'function', 'variable')",
    "ppr_converged_topk": "rank between 0 and 1 and place between 1 and 15",
    "gamma_sweep_best": "label is not null and gamma > 0",
    "missing_path_patterns": "n >= 1",
}
EMPTY = {"p4_malformed"}  # these tables have no malformed field; planted ones are in test_records


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER).cache()
    assert df.where(f"not ({HOLDS[name]})").count() == 0
    assert name in EMPTY or df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert registry.FLAGSHIP in e.queries()
