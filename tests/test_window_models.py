"""A user's model sees exactly the rows of each window, whatever the blocks it is dealt in."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.operators import window_models

SEEN = "system string, start bigint, nodes string, edges string, context string"


def tables(spark, lengths, entities=3):
    nodes = [(s, t, n, f"e{i}", float(100 * i + t)) for s, n in lengths.items() for t in range(n) for i in range(entities)]
    edges = [(s, t, "e0", "e1", t % 3) for s, n in lengths.items() for t in range(0, n, 2)]
    context = [(s, t, t * 1.5, "x") for s, n in lengths.items() for t in range(n)]
    return (
        spark.createDataFrame(nodes, "system string, t_idx bigint, n_steps bigint, entity string, load double").repartition(5),
        spark.createDataFrame(edges, "system string, t_idx bigint, src string, dst string, calls int"),
        spark.createDataFrame(context, "system string, t_idx bigint, qps double, entity string"),
    )


def teller():
    """A model that writes down what it sees (made here, so that it travels to the workers by value)."""

    def told(window):
        show = lambda f, c: " ".join(f"{t}:{x}:{o}" for t, x, o in sorted(zip(f.t_idx, f[c], f.offset)))
        row = [window.system, window.start, show(window.nodes, "load"), show(window.edges, "calls"), show(window.context, "qps")]
        return pd.DataFrame([row], columns=["system", "start", "nodes", "edges", "context"])

    return told


def brute(lengths, size, stride, entities=3):
    out = []
    for s, n in lengths.items():
        for a in range(0, max(1, n - size), stride):
            if n - a < 4:
                continue
            steps = range(a, min(n, a + size))
            show = lambda rows: " ".join(f"{t}:{x}:{t - a}" for t, x in sorted(rows))  # noqa: E731, B023
            out.append((s, a, show([(t, float(100 * i + t)) for t in steps for i in range(entities)]), show([(t, t % 3) for t in steps if t % 2 == 0]), show([(t, t * 1.5) for t in steps])))
    return sorted(out)


@pytest.mark.parametrize("size, stride, group_rows", [(24, 12, 1), (24, 12, 200_000), (5, 2, 60), (6, 6, 40), (4, 3, 1)])
def test_every_window_is_whole(spark, size, stride, group_rows):
    lengths = {"a": 100, "b": 24, "c": 3, "d": 7, "e": 37}
    made = window_models.apply_to_windows(*tables(spark, lengths), teller(), SEEN, size, stride, group_rows)
    assert sorted(map(tuple, made.collect())) == brute(lengths, size, stride)


def test_rows_move_about_once(spark):
    nodes, edges, context = tables(spark, {"a": 2000})
    blocks = nodes.withColumn("b", window_models._blocks(600, 24, 12))
    assert blocks.count() < 1.1 * nodes.count()  # windows of 24 by 12 would send each row twice


def test_no_rows(spark):
    nodes, edges, context = tables(spark, {"a": 30})
    none = [x.where("false") for x in (nodes, edges, context)]
    assert window_models.apply_to_windows(*none, teller(), SEEN).count() == 0
    alone = window_models.apply_to_windows(nodes, edges.where("false"), context.where(F.lit(False)), teller(), SEEN)
    assert [(r.start, r.edges, r.context) for r in alone.collect()] == [(0, "", "")]
