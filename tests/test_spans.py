"""Interval aggregates by running sums and the next-hot index against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import detect, spans

KIND = "system string, entity string, t_idx bigint, residual double, n_steps bigint"


def series(r, entities, n, missing=0.3):
    return [("s", e, t, None if r.random() < missing else r.choice([0.0, r.gauss(0, 1), r.gauss(3, 2)]), n) for e in entities for t in range(n)]


def brute(rows, windows, level):
    out = {}
    for start, stop in set(windows):
        for e in {r[1] for r in rows}:
            inside = [r for r in rows if r[1] == e and start <= r[2] < stop]
            if inside:
                xs = [r[3] for r in inside if r[3] is not None]
                hot = [r[2] for r in inside if r[3] is not None and r[3] > level]
                out[start, stop, e] = (sum(xs) / len(xs) if xs else None, len(inside), min(hot, default=None))
    return out


def answers(found):
    return {(r.start, r.stop, r.entity): (r.mean_residual, r.n_rows, r.first_idx) for r in found.collect()}


@pytest.mark.parametrize("block", [4, 7, 4096])
def test_windows_match_plain_python(spark, block):
    r = random.Random(1)
    rows = series(r, "abc", 61)
    rows = [(*x[:3], None, 61) if x[1] == "b" and 10 <= x[2] < 40 else x for x in rows]
    windows = [(a, a + n) for a in (0, 1, 3, 4, 12, 28, 57) for n in (1, 2, 4, 9, 33, 61)] + [(-5, 3), (50, 200), (61, 70), (9, 9), (8, 2)]
    frame = spark.createDataFrame(rows, KIND)
    asked = spark.createDataFrame([("s", a, b) for a, b in windows] * 2, "system string, start bigint, stop bigint")
    level = spark.createDataFrame([("s", 3.0)], "system string, level double")
    got = answers(spans.over_windows(frame, asked, level, block=block))
    want = brute(rows, windows, 3.0)
    assert set(got) == set(want)
    for k, (mean, n, first) in want.items():
        assert got[k][1:] == (n, first) and (got[k][0] is None) == (mean is None)
        assert mean is None or abs(got[k][0] - mean) < 1e-12
    ask = [("s", r.choice("abc"), a, b) for a, b in windows if 0 <= a]
    hot = spans.first_hot_of(frame, spark.createDataFrame(ask, "system string, entity string, lo bigint, hi bigint"), level, "lo", "hi", block)
    assert all(x.first_idx == want.get((x.lo, x.hi, x.entity), (0, 0, None))[2] for x in hot.collect())


def test_huge_values_do_not_blur_their_neighbours(spark):
    xs = [0.1, 0.2, 0.3, 1e300, 0.1, 0.2, -4e17, 0.7, float("inf"), 0.5, 0.25]
    frame = spark.createDataFrame([("s", "a", t, x, len(xs)) for t, x in enumerate(xs)], KIND)
    asked = spark.createDataFrame([("s", 0, 3), ("s", 4, 6), ("s", 7, 8), ("s", 9, 11), ("s", 2, 5)], "system string, start bigint, stop bigint")
    got = {(r.start, r.stop): r.mean_residual for r in spans.over_windows(frame, asked).collect()}
    assert got[4, 6] == pytest.approx(0.15, abs=1e-15) and got[7, 8] == 0.7 and got[0, 3] == pytest.approx(0.2, abs=1e-15)
    assert got[9, 11] == 0.375 and got[2, 5] == pytest.approx(1e300 / 3)


def rows_out(df):
    """The largest count of rows that a join of the plan gave."""
    df.collect()
    text, most = df._jdf.queryExecution().executedPlan(), 0

    def walk(node):
        nonlocal most
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        if "QueryStage" in name:
            walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(text)
    return most


def test_joined_rows_do_not_follow_the_length_of_windows(spark):
    r = random.Random(2)
    rows = series(r, [f"e{i}" for i in range(20)], 400, 0)
    frame = spark.createDataFrame(rows, KIND)
    asked = lambda n: spark.createDataFrame([("s", 3 * i, 3 * i + n) for i in range(30)], "system string, start bigint, stop bigint")
    for n in (2, 300):
        found = spans.over_windows(frame, asked(n))
        assert rows_out(found) <= max(8000, 2 * 30 * 20)  # the index itself has a row per step: 8000


def test_five_thousand_entities_that_peak_in_one_block(spark):
    n, peak = 24, 11
    data = spark.range(5000 * n).select(
        F.lit("s").alias("system"),
        F.concat(F.lit("e"), (F.col("id") / n).cast("int")).alias("entity"),
        (F.col("id") % n).alias("t_idx"),
        F.when(F.col("id") % n == peak, 9.0).otherwise(F.pmod(F.col("id"), F.lit(7)) / 10.0).alias("residual"),
        F.lit(n).cast("bigint").alias("n_steps"),
    )
    base = spark.createDataFrame([("s", 1.0, 1.0)], "system string, mu double, sigma double")
    faults = data.where(f"t_idx = {peak}").select("system", "entity", F.col("entity").alias("fault_id"))
    placed = detect.peak_windows(faults, detect.entity_peaks(data), 5, 10)
    hits = detect.time_hits(placed, data, base, "peak")
    assert hits.where("time_hit AND first_idx = 11").count() == 5000
    found = spans.over_windows(data, placed, spans.level_of(base, 2.0))
    assert found.count() == 5000 and found.where("first_idx = 11 AND n_rows = 15").count() == 5000


def test_first_interval_that_covers_a_step(spark):
    spans_ = [("s", 2, 9), ("s", 5, 12), ("s", 5, 7), ("s", 20, 22), ("s", 3, 3)]
    got = {r.t_idx: (r.start, r.stop) for r in spans.first_covering(spark.createDataFrame(spans_, "system string, start bigint, stop bigint")).collect()}
    want = {t: min((a, b) for _, a, b in spans_ if a <= t < b) for t in range(30) if any(a <= t < b for _, a, b in spans_)}
    assert got == want
