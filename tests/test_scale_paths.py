"""The paths taken beyond the broadcast limit, and small blocks, give the same rows as the plain ones."""

import random

from pyspark.sql import functions as F

from faultline.operators import graph, grid, joins
from faultline.operators.blocks import forward_fill, number_rows, with_previous


def bag(df):
    return sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


def names_of(spark, words):
    return spark.createDataFrame([("s", w, i) for i, w in enumerate(words)], "system string, name string, idx bigint")


def test_attach_with_a_hot_key(spark):
    fact = spark.range(3000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50)).alias("k"), "id")
    dim = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert bag(joins.attach(fact, dim, ["k"], how, True)) == bag(joins.attach(fact, dim, ["k"], how, False))


def test_first_containing_both_ways(spark):
    rng = random.Random(7)
    names = names_of(spark, ["cart", "ca", "frontend", "end", "pay", "checkout", "x", "artpa"])
    words = ["".join(rng.choice(["cart", "fr", "on", "tend", "pay", "-", "c", "a", "x"]) for _ in range(rng.randint(1, 5))) for _ in range(200)]
    rows = spark.createDataFrame([("s", w, rng.choice(["cart", "pay", "none"])) for w in words], "system string, w string, src string")
    for either in (False, True):
        for exclude in (None, "src"):
            small = joins.first_containing(rows, "w", names, "hit", exclude, either, inline=True)
            large = joins.first_containing(rows, "w", names, "hit", exclude, either, inline=False)
            assert bag(small) == bag(large), (either, exclude)


def test_components_both_ways(spark):
    names = names_of(spark, ["cart_service", "payment", "front-end"])
    parts = spark.createDataFrame([("s", c) for c in ("CartService", "payment-1", "end", "Mysql02", "zzz", "node9")], "system string, component string")
    small, large = (joins.match_components(parts, names, s, s) for s in (True, False))
    assert bag(small) == bag(large)
    got = {r.component: (r.service, r.tier) for r in small.collect()}
    assert got == {
        "CartService": ("cart_service", 1),
        "payment-1": ("payment", 2),
        "end": ("front-end", 2),
        "Mysql02": ("cart_service", 3),
        "zzz": (None, None),
        "node9": ("payment", 3),
    }


def holes(spark, n=40):
    rng = random.Random(3)
    data = [("s", e, t, rng.random() if rng.random() < 0.2 else None) for e in ("a", "b") for t in range(n)]
    df = spark.createDataFrame(data, "system string, entity string, t_idx bigint, x double")
    return df.withColumn("observed", F.col("x").isNotNull())


def test_fill_does_not_depend_on_blocks(spark):
    df, key = holes(spark), ["system", "entity"]
    whole = bag(forward_fill(df, key, ["x"], "observed", previous=["x"]))
    for block in (1, 3, 7):
        assert bag(forward_fill(df, key, ["x"], "observed", previous=["x"], block=block)) == whole


def test_previous_does_not_depend_on_blocks(spark):
    df, key = holes(spark), ["system", "entity"]
    whole = bag(with_previous(df, key, ["x"]))
    for block in (1, 4):
        assert bag(with_previous(df, key, ["x"], block=block)) == whole


def test_row_numbers_do_not_depend_on_blocks(spark):
    df = spark.createDataFrame([("s", t) for t in (5, 9, 10, 40, 41, 99)], "system string, ts bigint")
    for span in (1, 8, 1000):
        got = {r.ts: (r.i, r.n) for r in number_rows(df, ["system"], "ts", span, "i", total="n").collect()}
        assert got == {5: (0, 6), 9: (1, 6), 10: (2, 6), 40: (3, 6), 41: (4, 6), 99: (5, 6)}


def test_grid_both_ways(spark):
    steps = spark.createDataFrame([("s", t, t) for t in range(6)], "system string, ts bigint, t_idx bigint")
    members = spark.createDataFrame([("s", f"e{i}") for i in range(9)], "system string, entity string")
    cells = spark.createDataFrame([("s", 2, "e3", 1.0)], "system string, ts bigint, entity string, x double")
    small, large = (grid.dense_grid(steps, members, cells, ["entity"], s) for s in (True, False))
    assert small.count() == 54 and bag(small) == bag(large)


def test_in_range_does_not_depend_on_blocks(spark):
    points = spark.createDataFrame([("s", t) for t in range(100)], "system string, t_idx bigint")
    ranges = spark.createDataFrame([("s", 0, 10), ("s", 5, 70), ("s", 9, 9)], "system string, start bigint, stop bigint")
    want = sorted((t, a) for a, b in ((0, 10), (5, 70)) for t in range(a, b))
    for block in (1, 16, 256):
        got = joins.in_range(points, ranges, "t_idx", "start", "stop", block).select("t_idx", "start").collect()
        assert sorted(tuple(r) for r in got) == want


def test_blast_radius_takes_the_shortest_way(spark):
    edges = spark.createDataFrame(
        [("s", "a", "b"), ("s", "b", "c"), ("s", "a", "c"), ("s", "c", "a"), ("s", "c", "d")], "system string, src string, dst string"
    )
    roots = spark.createDataFrame([("s", "a")], "system string, entity string")
    got = sorted((r.node, r.depth, r.delay, round(r.impact, 3)) for r in graph.blast_radius(edges, roots).collect())
    assert got == [("b", 1, 5, 1.0), ("c", 1, 5, 1.0), ("d", 2, 10, 0.7)]
