"""Records in which faults cover every step but the first: statistics without a line."""

from faultline.operators import runs, score


def fitted(spark):
    """System s counts its first step only, so no pair; system q counts two steps in a row."""
    steps = [("s", t, t, 4, t == 0) for t in range(4)] + [("q", t, t, 4, t < 2) for t in range(4)]
    steps = spark.createDataFrame(steps, "system string, ts bigint, t_idx bigint, n_steps bigint, use_step boolean")
    cells = spark.createDataFrame([(s, t, "a", float(t * t)) for s in "sq" for t in range(4)], "system string, ts bigint, entity string, x double")
    members = spark.createDataFrame([("s", "a"), ("q", "a")], "system string, entity string")
    weighed = runs.weighted(runs.cell_runs(cells, steps, members, ["x"]), runs.step_counts(steps))
    return weighed, runs.fit_runs(weighed, ["system", "entity"], ["x"])


def test_no_pair_gives_statistics_but_no_line(spark):
    weighed, fit = fitted(spark)
    got = {r.system: r for r in fit.collect()}
    assert got["s"].mean == 0.0 and (got["s"].alpha, got["s"].beta, got["s"].sigma) == (None, None, None)
    assert got["q"].mean == 0.5 and got["q"].alpha is not None
    scored = score.run_residuals(weighed, fit, ["system", "entity"], ["x"])
    nll = {r.system: (r.nll, r.n) for r in score.run_nll(scored).collect()}
    assert nll["s"] == (None, 0) and nll["q"][1] == 3
    edge = spark.createDataFrame([("s", 1.0, 1)], "system string, edge_mse double, n bigint").where("false")
    kl = spark.createDataFrame([("s", 1.0), ("q", 1.0)], "system string, kl double")
    whole = score.objective(score.run_nll(scored), edge, kl).collect()
    assert {(r.system, r.edge_loss, r.total_loss) for r in whole} == {("s", None, None), ("q", None, None)}


def test_edges_without_a_line_have_no_error(spark):
    rows = [(s, "a", "b", t, float(t), float(t - 1) if t else None, s == "q" or t == 0) for s in "sq" for t in range(4)]
    pairs = spark.createDataFrame(rows, "system string, src string, dst string, t_idx bigint, x double, prev_x double, use_step boolean")
    key = ["system", "src", "dst"]
    got = score.edge_error(pairs, score.fit_step(pairs, key, ["x"]), key, ["x"], True).collect()
    assert [(r.system, r.n) for r in got] == [("q", 3)]
