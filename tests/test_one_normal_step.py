"""Queries over a record in which faults cover every step but the first, against DuckDB."""

import os

import duckdb
import pytest
from oracle_check import DATA, TABLES, differences

from __spark_entry__ import oracle_sql, queries

#: Findings F6 to F23 of round 3, in this order.
NAMES = """a11_baseline a12_window_means a13_step_peaks a15_summary a16_by_type a18_compare_rankings a21_fit_quality
e2_evaluate_reported e3_evaluate_detected e3_ranked_intervals j14_reported_rows j15_detected_window j16_peak_windows
m1_one_step_fit m3_node_residuals m4_overall_nll m8_objective p15_fault_from_role""".split()
HOURS = 40


@pytest.fixture(scope="module")
def covered(tmp_path_factory):
    """Events of 40 hours and one severe error every nine minutes; a step is normal only before the first."""
    root = tmp_path_factory.mktemp("one") / "sf"
    root.mkdir()
    con = duckdb.connect()
    for name in TABLES:
        rows = f"SELECT * FROM read_parquet('{DATA}/sf0.001/{name}.parquet')"
        if name == "events":
            rows = f"""
                WITH given AS ({rows}), span AS (SELECT date_trunc('hour', min(ts)) AS start FROM given)
                SELECT event_id, (SELECT start FROM span) + to_seconds(60 + (event_id * 7919) % ({HOURS} * 3600 - 60)) AS ts,
                       user_id, event_type, value, props FROM given
                UNION ALL BY NAME
                SELECT 1000000 + n AS event_id, (SELECT start FROM span) + to_seconds(30 + n * 540) AS ts, n % 23 AS user_id,
                       'error' AS event_type, 200.0 + n % 7 AS value, '{{"k": ' || n % 100 || '}}' AS props
                FROM range({HOURS} * 3600 // 540) AS t(n)"""
        con.execute(f"COPY ({rows}) TO '{root}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")
    return con, str(root)


def test_one_step_is_normal(spark, covered):
    from faultline.plans.views import Tables

    steps = Tables(spark, covered[1]).steps.orderBy("t_idx").collect()
    assert [r.t_idx for r in steps if r.is_normal] == [0] and len(steps) == HOURS


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb_without_a_pair_of_normal_steps(spark, covered, name):
    con, root = covered
    _, problem = differences(spark, con, name, queries()[name], oracle_sql()[name], os.path.relpath(root, DATA))
    assert not problem, problem
