"""Nothing is cut off: deep graphs, long rings, decimal timestamps."""

from pyspark.sql import functions as F

from faultline.functions.values import whole
from faultline.operators import graph


def test_reach_has_no_depth_limit(spark):
    edges = spark.createDataFrame([("s", f"n{i}", f"n{i + 1}") for i in range(8)] + [("s", "n8", "n0")], "system string, src string, dst string")
    roots = spark.createDataFrame([("s", "n0")], "system string, entity string")
    got = {r.node: r.depth for r in graph.blast_radius(edges, roots).collect()}
    assert got == {f"n{i}": i for i in range(1, 9)}


def test_ring_has_all_links(spark):
    nodes = spark.createDataFrame([("s", f"n{i}", i) for i in range(20)], "system string, entity string, entity_idx long")
    assert graph.ring(nodes).count() == 20


def test_decimal_times_are_truncated(spark):
    texts = ["10.0", "1.6e9", "1600000000123456789", "-3.7", "x", "NaN", "1e30", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.w for r in frame.select("i", whole(F.col("t")).alias("w")).orderBy("i").collect()]
    assert got == [10, 1600000000, 1600000000123456789, -3, None, None, None, None]
