"""Names found in texts through the index of rare pieces equal the names found one by one."""

import random

from pyspark.sql import functions as F

from faultline.operators import joins


def test_index_equals_the_inline_path_on_odd_names(spark):
    r = random.Random(5)
    words = ["cart", "ca", "a", "", "Öl", "öl-", "frontend", "end", "checkout", "xx", "xxx", "xxxx", "art", "c", "ab\n"]
    names = spark.createDataFrame([("s", w, i % 7) for i, w in enumerate(words)] + [("t", "cart", 1)], "system string, name string, idx bigint")
    texts = ["".join(r.choice([*words, "-", "z"]) for _ in range(r.randint(0, 4))) for _ in range(150)] + [None, "", "x"]
    rows = spark.createDataFrame([(r.choice("stu"), w, r.choice(["cart", "xx", None])) for w in texts], "system string, w string, src string")
    for either in (False, True):
        for exclude in (None, "src"):
            one, two = (joins.first_containing(rows, "w", names, "hit", exclude, either, inline=x) for x in (True, False))
            assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())), (either, exclude)


def test_sixty_thousand_names(spark):
    r = random.Random(6)
    words = sorted({"".join(r.choice("abcdeklmnorst") for _ in range(r.randint(4, 9))) for _ in range(61_000)})[:60_000]
    names = spark.createDataFrame([("s", w, i) for i, w in enumerate(words)], "system string, name string, idx bigint")
    texts = ["-".join(r.choice([r.choice(words), "zz9"]) for _ in range(3)) for _ in range(300)] + ["none", "q-q"]
    rows = spark.createDataFrame([("s", t) for t in texts], "system string, w string")
    for either in (False, True):
        found = joins.first_containing(rows, "w", names, "hit", either=either)
        got = {x.w: x.hit for x in found.collect()}
        want = {t: next((w for w in words if w in t or (either and t in w)), None) for t in texts}
        assert got == want
    assert found.count() == len(texts) and "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_postings_are_short_where_names_share_most_pieces(spark):
    names = spark.range(5000).select(F.lit("s").alias("system"), F.format_string("service-%04d-prod", F.col("id")).alias("name"))
    texts = names.limit(200).select("system", F.concat(F.lit("pod/"), "name", F.lit("/x")).alias("text"))
    pairs = joins.containing_pairs(texts, names)
    assert pairs.count() == 200
    pieces = names.select("name", F.explode(joins.grams(F.col("name"))).alias("g"))
    rarest = pieces.groupBy("g").count().join(pieces, "g").groupBy("name").agg(F.min("count").alias("n")).agg(F.max("n")).first()[0]
    assert rarest <= 150  # a text meets lists of this length, not 5,000 names
