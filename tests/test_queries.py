"""Registered queries against their SQL on the smallest tables.

A selection runs by default; ALL_QUERIES=1 runs every query (about ten minutes).
"""

import os

import pytest

import __spark_entry__ as entry
from tests.check_oracles import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SELECTION = """p14_interpolate p8_map_labels w2_label_windows w4_peak_windows f12_corr f13_dominant f24_stationary a4_sensor_statistics
a7_diversity_summary g1_subject_split g7_group_kfold j1_fuse_asof j5_near_duplicates q2_per_class q10_loso_table q13_windowing_audit
r4_confirm_falls_balanced r6_escalation r2_stream_ticks s1_sessions s4_adc_text""".split()
ORACLES = entry.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("ALL_QUERIES") else SELECTION

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    assert compare(spark, duck, name, entry.queries()[name], ORACLES[name], SF_DIR) is None


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert sum(r["n_windows"] for r in rows) == 55
