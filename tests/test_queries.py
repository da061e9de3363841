"""Registered queries beside their SQL twins. RISKFRAME_ALL=1 runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = os.environ.get("RISKFRAME_SF", "/root/testdata/sf0.001")
CORE = """f09_range_history_exact f15_history_mode_short t03_rolling_boundaries t09_validate_folds d02_threshold_grid d04_full_ranks d06_bayes_capacity
d08_priority_trials e01_evaluate c03_reliability_quantile c09_spearman b09_replicate_table b12_interval_summary r05_win_rates r14_replication_matrix
a05_history_feasibility a08_leakage_audit s02_ingest_exact v11_table_difference n03_encode x04_streaming_history d04_invalid_scores v16_validate_results_faults v17_validate_seed_grid_faults v21_result_structure_audit_faults c01_score_equations""".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("RISKFRAME_ALL") else CORE


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, QUERIES[name], ORACLES[name], SF).startswith("ok")


def test_entry(spark):
    assert {r["split"] for r in entry.entry(spark).collect()} == {"train", "validation", "test"}


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
