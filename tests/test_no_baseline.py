"""Systems in which nothing has a residual have no baseline, so no fault can be judged against it."""

import os

import pytest
from oracle_check import DATA, differences
from test_one_normal_step import covered  # noqa: F401

from __spark_entry__ import oracle_sql, queries
from faultline.operators import detect


@pytest.mark.parametrize("small", [True, False, None])
@pytest.mark.parametrize("rule", ["any", "peak", "report"])
def test_faults_without_a_baseline_are_left_out(spark, rule, small):
    rows = [("s", "a", t, 9.0 if t == 7 else 0.0) for t in range(20)]
    residuals = spark.createDataFrame(rows, "system string, entity string, t_idx bigint, residual double")
    base = spark.createDataFrame([("s", 1.0, 1.0)], "system string, mu double, sigma double")
    placed = [(s, "a", n, 5, 10, 20, 7, 7) for n, s in enumerate("sqs")]
    kind = "system string, entity string, fault_id int, start bigint, stop bigint, n_steps bigint, peak_idx bigint, report_idx bigint"
    hits = detect.time_hits(spark.createDataFrame(placed, kind), residuals, base, rule, small).collect()
    assert sorted((r.system, r.fault_id, r.first_idx, r.time_hit) for r in hits) == [("s", 0, 7, True), ("s", 2, 7, True)]


def test_time_hits_match_duckdb_without_a_pair_of_normal_steps(spark, covered):  # noqa: F811
    con, root = covered
    n, problem = differences(spark, con, "w14_time_hits", queries()["w14_time_hits"], oracle_sql()["w14_time_hits"], os.path.relpath(root, DATA))
    assert not problem and n == 0, problem
