"""Registered queries against DuckDB. FAULTLINE_ALL=1 runs every query, otherwise one or two per group."""

import os

import pytest
from oracle_check import DATA, connect, differences

from __spark_entry__ import entry
from faultline.plans.registry import oracle_texts, spark_queries

SOME = """p1_service_of_pod p10_log_severity p13_kpi_slots t1_top_entities j1_dense_grid j4_asof_logs j5_named_callee
j10_component_tiers j12_normal_mask j15_detected_window a1_service_means a2_edge_features a8_normal_stats a15_summary
w1_forward_fill w5_padded_windows w10_merged_scores w13_anomaly_intervals w14_time_hits r2_fused_ranking m3_node_residuals
m6_mix_divergence g1_edge_list g3_blast_radius s1_metric_files s5_one_object s8_service_metrics u3_pooled_residuals m9_user_model
m9_window_model s11_episodes""".split()
NAMES = sorted(spark_queries()) if os.environ.get("FAULTLINE_ALL") else SOME
SF = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(spark_queries()) == set(oracle_texts())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, con, name):
    rows, problem = differences(spark, con, name, spark_queries()[name], oracle_texts()[name], SF)
    assert not problem, problem
    assert rows > 0


def test_entry(spark):
    ranked = entry(spark)
    assert ranked.columns == ["system", "start", "stop", "entity", "mean_residual", "rank"]
    assert ranked.count() > 0
