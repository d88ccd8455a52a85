"""Entry points and a cross-section of registered queries next to their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry_points
import tools_check

SF = "/root/testdata/sf0.001"
SAMPLE = ["peer_comparison", "single_quarters", "ttm_cashflow", "upsert_daily", "run_health", "escalation", "result_contract", "manifest_audit", "text_budget", "claim_trace"]


def test_every_query_has_a_builder_and_sql_belongs_to_one():
    queries, oracle = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) >= 100


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_sample(spark, name):
    con = tools_check.connect(SF)
    df = entry_points.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(entry_points.oracle_sql()[name])
    assert tools_check.compare(rows, df.columns, res.fetchall(), [d[0] for d in res.description]) == ""


def test_sql_parses():
    con = duckdb.connect()
    for name, text in entry_points.oracle_sql().items():
        assert con.extract_statements(text), name
