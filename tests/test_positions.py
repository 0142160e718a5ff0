"""Positions by sampled ranges and counted offsets, and what slots and features leave out."""

import random
import re

import pytest
from pyspark.sql import functions as F

from faultline.functions import values
from faultline.operators import featurize, graph, grid, windows
from faultline.operators.blocks import positions


@pytest.mark.parametrize("per_part", [7, 40, 1000])
def test_positions_match_a_sort(spark, per_part):
    r = random.Random(1)
    rows = [(s, v, "x") for s, n in (("a", 1), ("b", 90), ("c", 3), ("d", 2), ("e", 55)) for v in r.sample(range(1000), n)]
    frame = spark.createDataFrame(rows, "system string, v bigint, note string").repartition(4)
    got = positions(frame, ["v"], "at", per_part)
    want = sorted((s, v, "x", sorted(w for y, w, _ in rows if y == s).index(v)) for s, v, _ in rows)
    assert sorted(map(tuple, got.collect())) == want and got.columns == ["system", "v", "note", "at"]
    assert positions(frame.where("false"), ["v"], "at", per_part).count() == 0


def test_nothing_is_gathered_by_system_alone(spark, monkeypatch):
    n = 60
    edges = spark.createDataFrame([("s", f"n{i}", f"n{(7 * i) % n}", i) for i in range(n)], "system string, src string, dst string, pos bigint")
    steps = spark.createDataFrame([("s", 10 * (i // 2), f"e{i % 2}") for i in range(n)], "system string, ts bigint, entity string")
    split = spark.createDataFrame([("s", 6 * i, "val") for i in range(n)], "system string, window_start bigint, split string")
    for size in (1 << 20, 8):
        monkeypatch.setattr(positions, "__defaults__", (size,))
        made = [graph.graph_nodes(edges), grid.entities(steps), grid.first_steps(steps, 5), windows.first_windows(split, 3)]
        for df in made:
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"hashpartitioning\(system#\d+, \d+\)", plan), plan
        nodes = {x.entity: x.entity_idx for x in made[0].collect()}
        assert nodes["n0"] == 0 and nodes["n1"] == 1 and nodes["n7"] == 2 and len(set(nodes.values())) == n
        assert sorted(x.window_start for x in made[3].collect()) == [0, 6, 12]
        assert {x.ts for x in made[2].collect()} == {0, 10, 20, 30, 40} and made[2].count() == 10


def test_what_slots_and_features_leave_out(spark, monkeypatch):
    names = [f"c{i:02d}" for i in range(11)]
    kpis = spark.createDataFrame([("s", n) for n in names], "system string, kpi_name string")
    monkeypatch.setattr(featurize, "categorised", lambda k: k.withColumn("category", F.col("kpi_name")))
    got = {x.category: x.slot for x in featurize.name_order_slots(kpis).collect()}
    assert got == {n: i if i < 8 else None for i, n in enumerate(names)}
    assert {x.category for x in featurize.name_order_slots(kpis, drop_rest=True).collect()} == set(names[:8])
    wide = spark.createDataFrame([tuple(range(11))], ", ".join(f"{n} double" for n in names).replace("double", "int"))
    with pytest.raises(ValueError, match="c08, c09, c10"):
        values.fit_features(wide, [], names)
    assert tuple(values.fit_features(wide, [], names, drop_rest=True).first()) == tuple(map(float, range(8)))
