"""Backward as-of: lookup and merge give the rows of a plain search, over gaps, bursts and dense steps."""

import random
from bisect import bisect_right
from collections import Counter

import pytest

from faultline.operators import joins


def brute(events, steps, keep):
    out = []
    for system, t, tag in events:
        own = sorted({s for y, s in steps if y == system})
        if t is None or not own or t < own[0] or (not keep and t > own[-1]):
            continue
        out.append((system, t, tag, own[bisect_right(own, t) - 1]))
    return Counter(out)


def tables(spark, events, steps):
    return (
        spark.createDataFrame(events, "system string, ts bigint, tag string").repartition(3),
        spark.createDataFrame(steps, "system string, ts bigint"),
    )


def sample():
    r = random.Random(4)
    steps = [("a", 60 * i + r.randint(0, 9)) for i in range(200)] + [("a", 1_700_000_000 + i) for i in range(300)]
    steps += [("b", 5), ("b", 1_000_000), ("b", 5)]
    events = [("a", r.randint(-100, 13_000), f"x{i}") for i in range(400)] + [("a", 1_700_000_000 + r.randint(-50, 400), f"y{i}") for i in range(400)]
    events += [("a", r.randint(13_000, 1_699_999_999), "gap") for _ in range(50)] + [("b", t, "b") for t in (4, 5, 6, 999_999, 1_000_000, 1_000_001)]
    events += [("c", 5, "none"), ("a", None, "null"), ("a", 1_700_000_010, "twin"), ("a", 1_700_000_010, "twin")]
    return events, steps


@pytest.mark.parametrize("after_last", ["drop", "keep"])
@pytest.mark.parametrize("budget, span", [(1 << 40, 3_000_000), (0, 3600), (0, 7), (joins.ASOF_BYTES, 3600)])
def test_asof_matches_a_plain_search(spark, after_last, budget, span):
    events, steps = sample()
    left, right = tables(spark, events, steps)
    got = joins.asof_step(left, right, after_last=after_last, span=span, budget=budget)
    assert got.columns == ["system", "ts", "tag", "step_ts"]
    assert Counter(map(tuple, got.collect())) == brute(events, steps, after_last == "keep")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_long_gap_adds_no_rows(spark):
    events, steps = sample()
    left, right = tables(spark, events, steps)
    merged = joins.asof_step(left, right)
    assert "sequence" not in plan_of(merged).replace("sequence(0, 31", "")  # nothing is unrolled but the salts
    near = joins.asof_step(left, right.where("ts < 20000"))
    assert "collect_list" in plan_of(near)


def test_dense_steps_are_packed_finer(spark):
    steps = [("a", i) for i in range(7200)]
    events = [("a", i * 7, str(i)) for i in range(1000)]
    left, right = tables(spark, events, steps)
    got = joins.asof_step(left, right)
    assert "/ 64" in plan_of(got) or "/ 65" in plan_of(got)  # 3,600 a bucket would be 56 times as many
    assert Counter(map(tuple, got.collect())) == brute(events, steps, False)
    none = spark.createDataFrame([], "system string, ts bigint")
    assert joins.asof_step(left, none).count() == 0 and joins.asof_step(left.where("false"), right).count() == 0
