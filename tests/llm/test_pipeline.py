"""The pipeline and its stages on a small table with planted copies, NULL and repeated ids, against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm import common, mixing, pii, quality, queries, simhash, sql
from faultline.session import scratch_path
from test_operators import WORDS, brute_copies, brute_quality
from tokenizers import Tokenizer

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def fresh(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 9999)) for _ in range(n))


def rows():
    r = random.Random(11)
    menu = "home about contact news help"
    good = [fresh(r, r.randint(60, 140)) for _ in range(24)]
    near = good[3].split()
    near[40] = "changed"
    out = [(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(good)]
    out += [(100 + i, menu + "\n" + fresh(r, 70), "en", "s0", 1) for i in range(12)]  # a line of twelve documents
    out += [(200, good[5], "en", "s1", 1), (201, good[5], "en", None, 1), (202, " ".join(near), "en", "s0", 1)]
    out += [(None, "two words", "en", "s0", 1), (7, "two words", "en", "s1", 1), (7, fresh(r, 80), "en", "s1", 1)]
    out += [(None, fresh(r, 90), "en", "s2", 1), (None, fresh(r, 90), None, None, None), (None, None, None, None, None), (300, "", "en", "s0", 0)]
    out += [(301, "a b c " * 40, "en", "s0", 1), (302, "write to x.y@example.org " + fresh(r, 60), "en", "s1", 1)]
    return out, menu


def brute_clean(table):
    """Rows that pass the base rules, without lines in over ten different texts of their source."""
    often = {}
    for _, t, _, source, _ in table:
        for line in set((t or "").split("\n")):
            if line.split():
                often.setdefault((source, " ".join(line.lower().split())), set()).add(t)
    out = []
    for i, t, lang, source, n in table:
        words, _, _, _, repeated = brute_quality(t)
        if words < 50 or 2 * repeated > words:
            continue
        lines = t.split("\n")
        left = [x for x in lines if len(often.get((source, " ".join(x.lower().split())), ())) <= 10]
        if 5 * sum(len(x.split()) for x in left) >= words:
            out.append((i, "\n".join(left) if len(left) < len(lines) else t, lang, source, n))
    return out


def test_stages_and_run(spark):
    table, menu = rows()
    folder = scratch_path(spark, "sf")
    spark.createDataFrame(table, KIND).repartition(4).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "PII surrogates", "mixing sources to target weights", "packing"]
    kept = corpus_pipeline.STAGES[0][1](spark, docs, folder)
    assert kept.columns == docs.columns
    one = [tuple(x) for x in kept.collect()]
    assert Counter(one) == Counter(brute_clean(table)) and not any(menu in x[1] for x in one)
    assert sum(x[0] is None for x in one) == 2 and sum(x[0] == 7 for x in one) == 2
    deduped = corpus_pipeline.STAGES[1][1](spark, spark.createDataFrame(one, KIND), folder)
    two = [tuple(x) for x in deduped.collect()]
    groups = brute_copies([x[1] for x in one])
    first = {}
    for x, g in zip(one, groups):
        key = (x[0] is None, x[0] or 0)
        if g not in first or key < first[g][0]:
            first[g] = (key, x)
    assert Counter(two) == Counter(x for _, x in first.values()) and len(two) < len(one)
    three = [tuple(x) for x in corpus_pipeline.STAGES[2][1](spark, spark.createDataFrame(two, KIND), folder).collect()]
    assert Counter(x[0] for x in three) == Counter(x[0] for x in two) and not any("x.y@example.org" in x[1] for x in three)
    assert len(set(two) - set(three)) == 1
    whole = corpus_pipeline.run(spark, folder).toPandas()
    again = corpus_pipeline.run(spark, folder).toPandas()
    assert len(whole) == len(again) and (whole.groupby("sequence_id").length.sum() <= 2048).all()
    mixed = mixing.take(spark.createDataFrame(three, KIND)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    want = Counter((x.doc_id, len(tokenizer.encode(x.text, add_special_tokens=False).ids) + 1) for x in mixed)
    starts = whole[whole.start == 0]
    got = Counter((None if d != d or d is None else int(d), int(n)) for d, n in zip(starts.doc_id, starts.doc_tokens))
    assert sum(got.values()) == sum(want.values())
    assert set(got) <= {(x[0], len(tokenizer.encode(x[1], add_special_tokens=False).ids) + 1) for x in three}


def test_a_mix_with_null_and_repeated_ids_meets_its_targets(spark):
    r = random.Random(12)
    table = [(None if i % 2 else i % 7, fresh(r, r.randint(20, 200)), "en", "abc"[i % 3], 1) for i in range(60)]
    docs = spark.createDataFrame(table, KIND)
    target = {x.source: x.target for x in mixing.mix(docs.withColumn("row", F.monotonically_increasing_id()), row_col="row").join(
        docs.withColumn("row", F.monotonically_increasing_id()).select("row", "source"), "row").select("source", "target").distinct().collect()}
    took = Counter()
    times = Counter()
    for x in mixing.take(docs).collect():
        took[x.source] += len(x.text.split())
        times[tuple(x)] += 1
    longest = max(len(t[1].split()) for t in table)
    assert all(target[s] - took[s] <= longest and took[s] <= target[s] + 1 for s in "abc") and max(times.values()) <= 3


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], KIND)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0, name


def test_extra_columns_with_clashing_names(spark):
    table, _ = rows()
    docs = spark.createDataFrame([(*x, 1, 2, "a", 3.0) for x in table], KIND + ", row long, host int, kept string, copies double")
    for stage in (quality.clean, mixing.take, lambda d: pii.pseudonymise(d).select(*d.columns)):
        got = stage(docs)
        assert got.columns == docs.columns and {(x.row, x.host, x.kept, x.copies) for x in got.collect()} == {(1, 2, "a", 3.0)}


def test_which_corpus_queries_have_sql():
    assert set(sql.ORACLE_SQL) == {"op8_line_frequency", "op12_permuterm_variants", "op13_filter_interactions"}
    assert [int(q[2:].split("_")[0]) for q in queries.QUERIES] == sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


def test_rows_keep_their_names_when_read_again(spark):
    folder = scratch_path(spark, "rows")
    spark.range(100).selectExpr("id % 7 AS doc_id", "'t' AS text").repartition(5).write.parquet(folder)
    docs = spark.read.parquet(folder)
    for df in (docs, docs.where("doc_id < 5").select("text"), docs.union(docs), docs.groupBy("doc_id").count(), spark.createDataFrame([(1,)] * 4, "a int")):
        named = common.with_rows(df)
        one, two = (sorted(r["__row"] for r in named.collect()) for _ in range(2))
        assert one == two and len(set(one)) == len(one) == df.count() and named.columns == [*df.columns, "__row"]
    assert "file:" in common.with_rows(docs).first()["__row"]


def python_steps(df):
    """The most Python steps that one task of `df` runs at a time: those between two exchanges of the plan."""
    most, path = 0, []  # depth and steps of each node above
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        found = re.match(r"[\s:+\-]*(?:\*\(\d+\) )?", line).end()
        name = line[found:].split(" ")[0]
        if not name:
            continue
        depth = len(re.match(r"[\s:]*(?:[+:]- )?", line).group())
        while path and path[-1][0] >= depth:
            path.pop()
        steps = 0 if "Exchange" in name else (path[-1][1] if path else 0) + bool(re.search("Python|InPandas", name))
        most = max(most, steps)
        path.append((depth, steps))
    return most


def test_a_task_of_the_near_copies_has_one_python_worker(spark, monkeypatch):
    seen = []

    def noted(df, cut=simhash.cut):
        seen.append(python_steps(df))
        return cut(df)

    monkeypatch.setattr(simhash, "cut", noted)
    monkeypatch.setattr(common, "cut", noted)
    docs = spark.createDataFrame(rows()[0], KIND)
    assert simhash.keep_first(docs).count()
    assert len(seen) > 10 and max(seen) == 1


def test_sizes_and_prefixes_of_sets(spark):
    texts = [(i, t) for i, (_, t, *_) in enumerate(rows()[0])]
    often = np.unique(np.concatenate([simhash.shingle_set(t) for _, t in texts])[::7])
    counts = np.arange(len(often)) % 5
    want = [(i, len(s), h) for i, t in texts for s in [simhash.shingle_set(t)] for h in simhash.prefix(s, often, counts).tolist()]
    got = simhash.prefixes(spark.createDataFrame(texts, "rep long, text string"), often, counts)
    assert sorted(map(tuple, got.collect())) == sorted(want)
