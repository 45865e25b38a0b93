"""Registered queries against DuckDB at the smallest scale.

The default set covers every area; ALL_QUERIES=1 runs every registered query.
"""
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, compare

SF = "/root/testdata/sf0.001"
CORE = """m4_build_severity r3_baseline_profile r5_residual_profile r7_update_status r8_update_summary
r9_review_status j12_control_sweep v16_credit_property_audit a2_overview_board a3_month_totals w2_sort_threat_desc
w3_shards w4_worst_first_top_up f1_search_profile f7_product_facet_and s1_read_advisories
s4_read_epss_last_wins s9_published_datasets k4_publication_gates p1_product_tree p11_product_tags
p14_assemble_records p18_ssvc_points p21_string_leaves j6_refresh_scores v3_framework_floors v8_direction_gate
v12_fail_closed j17_apply_corrections x4_admit_batches x6_revision_diff x8_source_audit x10_run_log
n1_strata n2_dev_holdout_split t4_verify t4_verify_in_corpus t11_review_record a7_check_summary d1_ipv4_reserved
d12_scan_documents d12_offsets_hold""".split()

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = list(QUERIES) if os.environ.get("ALL_QUERIES") else CORE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    verdict, _ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert verdict.startswith(("ok", "rows-only")), verdict


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
