"""Fault sessions against plain Python, also over day borders and touching spans."""

import random

from faultline.operators import episodes


def brute(times, reach):
    out = []
    for t in sorted(set(times)):
        if out and t - out[-1][1] <= reach:
            out[-1][1] = t
        else:
            out.append([t, t])
    return out


def test_sessions_and_their_rows(spark):
    r = random.Random(2)
    times = [r.randint(0, 900_000) for _ in range(40)] + [86_390, 86_400, 86_399 + 700, 500_000, 500_000]
    faults = spark.createDataFrame([("a", t) for t in times] + [("b", 5), ("b", 5 + 600), ("b", 5 + 600 + 601), ("a", None)], "system string, ts bigint").repartition(4)
    got = episodes.fault_sessions(faults, 600, 0)
    want = {("a", a, z + 600) for a, z in brute(times, 600)} | {("b", 5, 1205), ("b", 1206, 1806)}
    assert {(x.system, x.start, x.stop) for x in got.collect()} == want
    assert {x.episode for x in got.collect()} == {f"{s}-{a}" for s, a, _ in want}
    rows = spark.createDataFrame([("b", t, t) for t in (4, 5, 1204, 1205, 1206, 1806)] + [("c", 5, 0)], "system string, ts bigint, v int")
    held = {(x.system, x.ts): x.episode for x in episodes.in_episodes(rows, got).collect()}
    assert held == {("b", 4): None, ("b", 5): "b-5", ("b", 1204): "b-5", ("b", 1205): None, ("b", 1206): "b-1206", ("b", 1806): None, ("c", 5): None}
    wide = episodes.fault_sessions(faults, 600, 10_000)
    assert wide.where("system = 'a'").count() == len(brute(times, 20_600))
    assert episodes.fault_sessions(faults.where("false")).count() == 0
