"""Tables that were not counted as small are never broadcast, since a broadcast goes through the driver."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.llm import common, simhash, spelling, toxicity


@pytest.fixture
def plans(monkeypatch):
    """Plans of all tables that are written, where any table is too large for a broadcast."""
    seen = []
    for module in (common, simhash, spelling, toxicity):

        def cut(df, write=module.cut):
            seen.append(df._jdf.queryExecution().executedPlan().toString())
            return write(df)

        monkeypatch.setattr(module, "cut", cut)
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(toxicity, "LABEL_ROWS", -1)
    return seen


def shuffled(plans):
    return any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_salted_copies_are_not_broadcast(spark, monkeypatch, how):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    left = common.cut(spark.range(100).select((F.col("id") % 20).alias("k"), "id"))
    right = common.cut(spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("one")))
    joined = common.attach_small(left, right, ["k"], how)
    assert shuffled([joined._jdf.queryExecution().executedPlan().toString()])
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, left.join(right, ["k"], how).collect()))


def test_labels_beyond_the_limit_are_not_broadcast(spark, plans):
    docs = common.cut(spark.createDataFrame([(i, f"text {i}", "en") for i in range(60)], "doc_id long, text string, lang string"))
    labels = common.cut(spark.createDataFrame([(i, i % 4 // 2) for i in range(0, 60, 2)], "doc_id long, toxic int"))
    rows = toxicity.training_rows(docs, labels).collect()
    free = {r.doc_id for r in labels.where(~toxicity.held_out(F.col("doc_id"))).collect()}
    assert {r.doc_id for r in rows} == free and len(rows) == len(free) > 3
    assert shuffled(plans), [p for p in plans if "BroadcastHashJoin" in p]


def test_forms_beyond_the_limit_are_not_broadcast(spark, plans):
    links = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(40) if i % 10 != 9]
    roots = spelling.follow(spark.createDataFrame(links, "word string, form string")).collect()
    assert {(r.word, r.root) for r in roots} == {(w, f"w{int(w[1:]) // 10 * 10 + 9:03d}") for w, _ in links}
    assert shuffled(plans), [p for p in plans if "BroadcastHashJoin" in p]


def test_near_copies_beyond_the_limit_are_not_broadcast(spark, plans, monkeypatch):
    r = random.Random(4)
    words = [f"word{i}" for i in range(500)]
    texts = []
    for _ in range(12):
        first = r.choices(words, k=120)
        texts += [first, first, *[first[:j] + ["other"] + first[j + 1 :] for j in (3, 60, 110)]]
    table = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    kept = sorted(x.doc_id for x in simhash.keep_first(docs).collect())
    assert kept == list(range(0, 60, 5))
    assert shuffled(plans), [p for p in plans if "BroadcastHashJoin" in p]
