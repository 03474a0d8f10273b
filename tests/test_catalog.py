"""Every SQL twin is valid, names agree, and a cross-section of queries matches it."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.verify import rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "named_secret_hits", "secret_tri_state", "kpi_counts", "drift_timeline", "top_rules", "free_quota", "rate_limit", "debounce_batches", "fix_permission",
    "license_guardrail", "ingest_telemetry", "entitlement_upsert", "parse_remote", "policy_filter", "rule_ssrf", "rule_sql_injection", "rule_auth_bypass",
    "missing_rls", "dependency_unpinned", "module_taint_fixpoint", "trace_to_sink", "diff_findings", "apply_fixes", "stream_alert_state", "stream_dedupe", "scan_project",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def test_every_query_has_a_twin():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    r = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_filters_reach_the_scan(spark):
    plan = entry.queries()["kpi_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts" in plan and "props" not in plan
