"""Runs of observed cells against the dense, filled grid they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import grid, runs, score

FEATURES = ["x", "y"]


def tables(spark, seed, n=60, entities="abcd", density=0.25):
    r = random.Random(seed)
    steps = [("s", 100 + 10 * t, t, n, r.random() < 0.7) for t in range(n)] + [("q", 7 * t, t, 9, False) for t in range(9)]
    cells = [("s", 100 + 10 * t, e, r.choice([None, 1.5, r.gauss(0, 3)]), 4.0) for e in entities for t in range(n) if r.random() < density]
    cells += [("s", 100, "a", 2.0, 4.0), ("s", 105, "a", 9.0, 9.0), ("s", 100, "zz", 1.0, 1.0), ("q", 0, "k", 3.0, 1.0), ("q", 21, "k", 4.0, 2.0)]
    cells = list({(c[0], c[1], c[2]): c for c in cells}.values())
    members = [("s", e) for e in entities] + [("s", "never"), ("q", "k")]
    return (
        spark.createDataFrame(steps, "system string, ts bigint, t_idx bigint, n_steps bigint, use_step boolean"),
        spark.createDataFrame(cells, "system string, ts bigint, entity string, x double, y double"),
        spark.createDataFrame(members, "system string, entity string"),
    )


def rounded(df, columns):
    return sorted(tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in x) for x in df.select(*columns).collect())


@pytest.mark.parametrize("block", [7, 4096])
def test_runs_stand_for_the_filled_grid(spark, block):
    steps, cells, members = tables(spark, 1)
    dense = grid.fill_grid(grid.dense_grid(steps, members, cells, ["entity"]), features=FEATURES, previous=True)
    made = runs.cell_runs(cells, steps, members, FEATURES, block=block)
    known = cells.join(members, ["system", "entity"], "left_semi").join(steps, ["system", "ts"], "left_semi").count()
    assert made.count() <= known + members.count()
    rows = runs.unrolled(made, steps.drop("n_steps"), ["entity", "n_steps", *FEATURES, "prev_x"], block=block)
    assert rounded(rows, ["system", "entity", "t_idx", "x", "y"]) == rounded(dense, ["system", "entity", "t_idx", "x", "y"])
    starts = rows.where("begins").select("system", "entity", "t_idx", F.coalesce("prev_x", F.lit(-1.0)).alias("p"))
    want = dense.join(starts, ["system", "entity", "t_idx"]).select("system", "entity", "t_idx", F.coalesce("prev_x", F.lit(-1.0)).alias("p"))
    assert rounded(starts, starts.columns) == rounded(want, starts.columns)


@pytest.mark.parametrize("seed", [2, 3])
def test_fits_and_residuals_equal_those_of_dense_rows(spark, seed):
    steps, cells, members = tables(spark, seed)
    steps = steps.withColumn("use_step", F.col("use_step") | (F.col("system") == "q"))
    keys = ["system", "entity"]
    dense = grid.fill_grid(grid.dense_grid(steps, members, cells, ["entity"]), features=FEATURES, previous=True)
    one = score.fit_step(dense, keys, FEATURES)
    weighed = runs.weighted(runs.cell_runs(cells, steps, members, FEATURES, block=8), runs.step_counts(steps, block=8))
    two = runs.fit_runs(weighed, keys, FEATURES)
    columns = [*keys, "feature", "mean", "std", "alpha", "beta", "sigma"]
    for a, b in zip(rounded(one, columns), rounded(two, columns), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-7, abs=1e-7)
    scored = score.run_residuals(weighed, two, keys, FEATURES)
    by_run = score.run_nll(scored).orderBy("system").collect()
    by_row = score.overall_nll(score.step_residuals(dense, one, keys, FEATURES)).orderBy("system").collect()
    assert [(x.system, x.n) for x in by_run] == [(x.system, x.n) for x in by_row]
    assert [x.nll for x in by_run] == pytest.approx([x.nll for x in by_row], rel=1e-9)


def test_members_are_packed_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(grid, "PACK_MEMBERS", 3)
    steps, cells, members = tables(spark, 4, n=5, entities="abcdefghij")
    got = grid.dense_grid(steps, members, cells, ["entity"])
    assert got.count() == 5 * 11 + 9 and got.where("observed").count() > 0
    assert grid.dense_grid(steps, members.where("false"), cells, ["entity"]).count() == 0
