"""Entry points and, for a part of the queries, Spark against the oracle.

``python tools/check.py`` compares all of them.
"""

import glob
import os

import duckdb
import pandas as pd
import pytest
from conftest import SF

import __spark_entry__ as entry
from auditflow.plans.queries import ORACLE, QUERIES
from tools.check import normal

CHECKED = (
    "findings_by_label", "page_findings", "merged_findings", "token_numbers", "redacted_text", "redacted_vault",
    "restored_text", "restore_from_store", "decode_assistant", "exposure_rollup", "stable_tokens", "vault_latest",
    "activity_bins", "log_ids", "pause_gate_asof", "choose_semantic_source", "normalise_requests", "stream_counters",
    "report_json", "releasable_corpus", "read_audit_log", "activity_bins_retained", "stream_guard_pauses", "stream_vault", "live_summary",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "risk_score", "risk_level", "n_findings"] and df.count() > 0


def test_registry():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 100
    assert set(QUERIES) == set(ORACLE) <= set(oracle)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns)
    res = con.execute(entry.oracle_sql()[name])
    want = pd.DataFrame(res.fetchall(), columns=[d[0] for d in res.description])
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got).equals(normal(want))
