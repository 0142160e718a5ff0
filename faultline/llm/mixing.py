"""Mixing sources to target weights: subset-sum budget fitting over counts of documents by length."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.llm.common import attach_small, with_rows, word_count
from faultline.session import cut

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 4
#: Words left to the exact fitting.
FIT_WORDS = 1 << 14
#: Documents of one source and length that are ranked together.
RANKED = 500


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their words come as near below `budget` as can be.

    First every length gives its share of all but `FIT_WORDS` words, rounded down; then the lengths with the largest remainders give one
    more while over `FIT_WORDS` words are open; what is left is filled by bounded-knapsack dynamic programming
    over the lengths still available, on a bit set of reachable sums. Works on the histogram, never on documents.
    """
    lengths, counts = [int(x) for x in lengths], [int(x) for x in counts]
    total = sum(n * k for n, k in zip(lengths, counts))
    if total <= budget:
        return np.array(counts)
    rough = max(0, budget - FIT_WORDS)
    take = [k * rough // total for k in counts]
    left = budget - sum(n * k for n, k in zip(lengths, take))
    rest = [(-(k * rough % total), n, i) for i, (n, k) in enumerate(zip(lengths, counts))]
    for _, n, i in sorted(rest):
        if left <= FIT_WORDS:
            break
        if 0 < n <= left and take[i] < counts[i]:
            take[i] += 1
            left -= n
    reach, steps = 1, []
    mask = (1 << (left + 1)) - 1
    for n, i in sorted((n, i) for i, n in enumerate(lengths) if 0 < n <= left and take[i] < counts[i]):
        free, k = min(counts[i] - take[i], left // n), 1
        while free:
            k = min(k, free)
            steps.append((reach, n * k, i, k))
            reach |= (reach << (n * k)) & mask
            free -= k
            k *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for before, words, i, k in reversed(steps):
        if not before >> at & 1:
            at -= words
            take[i] += k
    return np.array(take)


def _key(source: Column) -> Column:
    """Sources as keys that are never NULL and keep their order, NULL last."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), source))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(key, source_size, target) from (key, source_size): all words shared by weight, no source above its cap.

    Sources are few. In the order of cap by weight, each is held to its cap if the share left to it exceeds it;
    the others divide the rest by weight.
    """
    all_ = Window.partitionBy(F.lit(0))
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn % len(weights) + 1)
    rows = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size").cast("double") * max_repeats)
    rows = rows.withColumn("all_words", F.sum(F.col("source_size").cast("double")).over(all_)).withColumn("all_w", F.sum("w").over(all_))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), "key").rowsBetween(Window.unboundedPreceding, -1)
    cap0, w0 = (F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("cap", "w"))
    rows = rows.withColumn("held", F.col("cap") * (F.col("all_w") - w0) < F.col("w") * (F.col("all_words") - cap0))
    held = lambda c: F.sum(F.when(F.col("held"), F.col(c)).otherwise(0.0)).over(all_)
    level = (F.col("all_words") - held("cap")) / (F.col("all_w") - held("w"))
    share = F.when(F.col("held"), F.col("cap")).otherwise(F.col("w") * level)
    return rows.withColumn("target", share).select("key", "source_size", "target")


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of every document and documents with one more, for each length of one source."""
    size, budget = int(pdf.source_size.iloc[0]), math.floor(pdf.target.iloc[0] + 0.5)
    copies = min(budget // size, MAX_REPEATS) if size else 0
    extra = fit_lengths(pdf["size"].to_numpy(), pdf.n.to_numpy(), budget - copies * size) if size and copies < MAX_REPEATS else 0
    return pdf[["key", "size", "n"]].assign(copies=copies, extra=np.where(pdf["size"] > 0, extra, 0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, row_col: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (size times copies) of each row of `docs`, and `row`, the
    column that `row_col` names, if any.

    Texts are read once; afterwards only ids, sources and sizes move. The plan of a source is made from its counts
    by length. Which documents of a length get a copy more goes by a seeded hash of the id: hash buckets of about
    `RANKED` documents are taken whole in order, and only the last one of each length is ranked. Repeated rows count
    one by one; NULL source is a source, last; NULL text has size 0 and is never taken; no rows: no result.
    """
    row = [F.col(row_col).alias("row")] if row_col else []
    own = ["doc_id", *(["row"] if row_col else [])]
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), *row, _key(F.col(source_col)).alias("key"), word_count(F.col(text_col)).alias("size")))
    counts = cut(rows.groupBy("key", "size").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = cut(source_targets(sizes))
    kind = "key string, size bigint, n bigint, copies bigint, extra bigint"
    plan = cut(attach_small(counts, targets, ["key"], "inner").groupBy("key").applyInPandas(_fit_source, kind))
    h = F.xxhash64(F.lit(seed), "doc_id")
    buckets = F.ceil(F.col("n") / RANKED).cast("bigint")
    planned = attach_small(rows, plan, ["key", "size"], "inner").withColumn("h", h).withColumn("bucket", F.pmod("h", buckets))
    planned = cut(planned)
    whole = planned.groupBy("key", "size", "bucket").agg(F.count("*").alias("here"), F.first("extra").alias("extra"))
    before = F.sum("here").over(Window.partitionBy("key", "size").orderBy("bucket")) - F.col("here")
    gets = F.greatest(F.lit(0), F.least(F.col("extra") - before, F.col("here")))
    whole = cut(whole.select("key", "size", "bucket", "here", gets.alias("gets")))
    last = whole.where("gets > 0 and gets < here")
    rank = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("h", *own))
    ranked = planned.join(last, ["key", "size", "bucket"]).select(
        *own, "key", "size", "copies", (rank <= F.col("gets")).cast("bigint").alias("more")
    )
    sure = whole.where("gets = 0 or gets = here").select("key", "size", "bucket", (F.col("gets") > 0).cast("bigint").alias("more"))
    rest = attach_small(planned, sure, ["key", "size", "bucket"], "inner").select(*own, "key", "size", "copies", "more")
    both = rest.unionByName(ranked).withColumn("copies", F.col("copies") + F.col("more"))
    out = attach_small(both, targets, ["key"], "inner")
    return out.select(*own, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def take(docs: DataFrame) -> DataFrame:
    """Each row of `docs` as often as the mix takes it, with its own columns.

    Rows have a key of their own, so NULL and repeated ids are taken as the rows they are. An empty table gives no rows.
    """
    table = with_rows(docs)
    copies = mix(table, row_col="__row").where("copies > 0").select(F.col("row").alias("__row"), F.col("copies").alias("__copies"))
    times = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies")))
    return table.join(copies, "__row").withColumn("__n", times).select(*docs.columns)
