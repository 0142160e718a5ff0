"""Divergence of category mixes from counts alone, against softmaxes over every category."""

import math
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import score


def plain(counts):
    out = {}
    for s in {c[0] for c in counts}:
        cats = sorted({c[2] for c in counts if c[0] == s})
        keys = sorted({c[1] for c in counts if c[0] == s})
        mean = {c: sum(x[3] for x in counts if x[0] == s and x[2] == c) / len(keys) for c in cats}
        for k in keys:
            own = {x[2]: x[3] for x in counts if x[:2] == (s, k)}
            soft = lambda z: [math.exp(v - max(z)) / sum(math.exp(w - max(z)) for w in z) for v in z]
            p, q = soft([math.log(1 + own.get(c, 0)) for c in cats]), soft([math.log(1 + mean[c]) for c in cats])
            out[s, k] = sum(a * math.log(a / b) for a, b in zip(p, q))
    return out


def test_divergence_equals_the_softmaxes(spark):
    r = random.Random(1)
    counts = [(s, k, f"c{c}", r.randint(1, 50)) for s in "ab" for k in range(12) for c in range(15) if r.random() < 0.3]
    counts += [("one", 1, "c", 5), ("same", 1, "c", 2), ("same", 2, "c", 2)]
    got = score.mix_divergence(spark.createDataFrame(counts, "system string, ts int, category string, n bigint"), ["system", "ts"], 0.02).collect()
    want = plain(counts)
    assert {(x.system, x.ts): x.kl for x in got} == pytest.approx(want, abs=1e-12)
    assert all(x.kl_floored == max(x.kl, 0.02) for x in got)


def test_a_hundred_thousand_categories(spark):
    """Two hundred keys of a thousand categories each: 200,000 rows, not twenty million."""
    counts = spark.range(200_000).select(
        F.lit("s").alias("system"), (F.col("id") % 200).alias("ts"), F.concat(F.lit("c"), (F.col("id") * 7919 % 100_000)).alias("category"), (F.col("id") % 5 + 1).alias("n")
    ).groupBy("system", "ts", "category").agg(F.sum("n").alias("n"))
    found = score.mix_divergence(counts, ["system", "ts"])
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in text and found.count() == 200
    one = {x.category: x.n for x in counts.where("ts = 3").collect()}
    mean = {x.category: x.t / 200 for x in counts.groupBy("category").agg(F.sum("n").alias("t")).collect()}
    c, n, m = len(mean), sum(one.values()), sum(mean.values())
    want = sum((1 + one.get(k, 0)) / (c + n) * math.log((1 + one.get(k, 0)) / (c + n) / ((1 + v) / (c + m))) for k, v in mean.items())
    assert found.where("ts = 3").first().kl == pytest.approx(want, abs=1e-10)
