"""Filter interaction audit: five filters in all orders, counted incrementally from a stream of the corpus' files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import permutations
from math import factorial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.session import cut, scratch_path

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 2
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"#$%&*|"
COPY = 1 << FILTERS.index("E")
#: Micro-batches that the files are dealt to.
BATCHES = 4
#: Texts whose states are read and written together, on average.
BUCKET_TEXTS = 512
#: Labelled documents that may be broadcast: a long and two flags each.
LABEL_ROWS = 250_000
#: In the place of a NULL id.
NO_ID = (1 << 63) - 1

TEXT_KIND = "id bigint, has_id boolean, part string, digest binary, mask int"
FACT_KIND = "bucket bigint, digest binary, mask int, part string, good boolean, toxic boolean, low bigint, n_low bigint, n_free bigint, n bigint"
DELTA_KIND = "part string, mask int, good boolean, toxic boolean, n bigint"


def text_mask(text: bytes, code_points: int) -> int:
    """Bits of the filters A to D that a UTF-8 text fails. bytes.split cuts at exactly the white space of the rules."""
    words = text.split()
    n = len(words)
    upper = len(text) - len(text.translate(None, UPPER))
    fails = (
        n < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT_PERCENT * n,
        100 * upper > MAX_UPPER_PERCENT * code_points,
        len(text.translate(None, MARKS)) < len(text),
    )
    return sum(1 << i for i, x in enumerate(fails) if x)


def _read_texts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        masks = [text_mask(t, n) for t, n in zip(pdf.text, pdf.code_points)]
        digests = [hashlib.sha256(t).digest() for t in pdf.text]
        yield pd.DataFrame({"id": pdf.id, "has_id": pdf.has_id, "part": pdf.part, "digest": digests, "mask": masks})


def _combine(buckets: int):
    """Rows of one batch with equal text, part and labels as one: the smallest id, rows with it, rows without id, all."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        same = ["digest", "mask", "part", "good", "toxic"]
        for pdf in batches:
            if not len(pdf):
                continue
            groups = pdf.groupby(same, sort=False)
            pdf["n_low"] = ((pdf.id == groups.id.transform("min")) & pdf.has_id).astype("int64")
            pdf["n_free"] = (~pdf.has_id).astype("int64")
            pdf["n"] = 1
            out = groups.agg(low=("id", "min"), n_low=("n_low", "sum"), n_free=("n_free", "sum"), n=("n", "sum")).reset_index()
            out.insert(0, "bucket", [int.from_bytes(d[:8], "little") % buckets for d in out.digest])
            yield out

    return run


HELD = ["digest", "mask", "part", "good", "toxic", "low", "n_low"]


def _packed(held: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(held, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Move the smallest ids of the texts of one bucket, and tell the counters what changed.

    The state holds, for each text met so far, its smallest id and the rows that have it. When a smaller id arrives,
    the mask under which those rows were counted is taken back and they are counted again as copies.
    """
    facts = pd.concat(list(batches), ignore_index=True)
    held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else facts[HELD].iloc[:0]
    low = pd.concat([held[["digest", "low"]], facts[["digest", "low"]]]).groupby("digest", sort=False).low.min()
    held_first = held.low.to_numpy() == low.loc[held.digest].to_numpy()
    fact_first = facts.low.to_numpy() == low.loc[facts.digest].to_numpy()
    kind = ["part", "mask", "good", "toxic"]
    overtaken = held[~held_first]
    first = facts.n_low.where(fact_first, 0) + facts.n_free
    deltas = [
        overtaken[kind].assign(n=-overtaken.n_low),
        overtaken[kind].assign(mask=overtaken["mask"] | COPY, n=overtaken.n_low),
        facts[kind].assign(n=first),
        facts[kind].assign(mask=facts["mask"] | COPY, n=facts.n - first),
    ]
    stays = pd.concat([held[held_first], facts.loc[fact_first & (facts.n_low > 0), HELD]])
    same = [c for c in HELD if c != "n_low"]
    stays = stays.groupby(same, sort=False).n_low.sum().reset_index()[HELD]
    state.update((_packed(stays.astype({"mask": "int32"})),))
    told = pd.concat(deltas).groupby(kind, sort=False).n.sum().reset_index()
    yield told[told.n != 0].astype({"mask": "int32"})


def counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES, bucket_texts: int = BUCKET_TEXTS) -> DataFrame:
    """(part, mask, good, toxic, n): documents of the table at `path` by the filters they fail, from its stream of files.

    All files are read as available-now micro-batches, about `batches` of them. Texts are read where they lie and leave
    as digest and mask; equal ones of a task are combined, so a text in a third of all rows is a few rows per task.
    State is keyed by text, `bucket_texts` keys to a group; it lives in the state store that the session names, which for
    a large corpus should be the one on disk (spark.sql.streaming.stateStore.providerClass). Each micro-batch adds its changes to the counters in a
    folder named by its number, so one that is run again after a failure replaces its own.
    """
    kinds = spark.read.parquet(path)
    files = max(1, -(-len(kinds.inputFiles()) // batches))
    buckets = max(1, -(-kinds.count() // bucket_texts))
    glob = f"{path[:-1]}[{path[-1]}]"  # one file or a folder of them
    docs = spark.readStream.schema(kinds.schema).option("maxFilesPerTrigger", files).parquet(glob)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.col("doc_id").isNotNull().alias("has_id"),
        F.coalesce("source", F.lit("")).alias("part"),
        F.char_length(text).alias("code_points"),
        text.cast("binary").alias("text"),
    ).mapInPandas(_read_texts, TEXT_KIND)
    flags = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("to")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    flags = cut(flags.where("good OR toxic").withColumn("real", F.lit(True)))
    if flags.limit(LABEL_ROWS + 1).count() <= LABEL_ROWS:
        flags = F.broadcast(flags)
    to = F.when(F.col("has_id"), F.col("id")).otherwise(F.xxhash64("digest"))  # rows without id are spread, and match none
    rows = rows.withColumn("to", to).withColumn("real", F.col("has_id")).join(flags, ["to", "real"], "left")
    rows = rows.select("id", "has_id", "part", "digest", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    facts = rows.mapInPandas(_combine(buckets), FACT_KIND)
    changes = facts.groupBy("bucket").applyInPandasWithState(_update, DELTA_KIND, "held binary", "update", "NoTimeout")
    out = scratch_path(spark, "counters")
    spark.createDataFrame([], DELTA_KIND).write.parquet(f"{out}/change=none")

    def add(change: DataFrame, number: int) -> None:
        sums = change.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
        sums.write.mode("overwrite").parquet(f"{out}/change={number}")

    stream = changes.writeStream.foreachBatch(add).outputMode("update").trigger(availableNow=True)
    stream.option("checkpointLocation", scratch_path(spark, "stream")).start().awaitTermination()
    told = spark.read.schema(DELTA_KIND).parquet(f"{out}/*")
    return told.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")


def _kept(values: str) -> Column:
    """Array over all sets of filters: documents that fail none of the set."""
    return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(values)).otherwise(0)).cast("bigint") for s in range(1 << len(FILTERS))])


def _orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, bit of its filter, set of filters before it) for every step of every order."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(FILTERS[i] for i in order), step, f, before))
            before |= 1 << f
    return out


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, filter order and step, from counts (part, mask, good, toxic, n).

    What a step removes depends only on the set of filters before it, so each part is one row with the documents kept
    by each of the 32 sets, and the 600 steps are looked up there. Nothing but the counts is shuffled.
    """
    n = len(FILTERS)
    flags = counts.withColumns({"n_good": F.when(F.col("good"), F.col("n")).otherwise(0), "n_toxic": F.when(F.col("toxic"), F.col("n")).otherwise(0)})
    sums = flags.groupBy("part").agg(_kept("n").alias("k"), _kept("n_good").alias("g"), _kept("n_toxic").alias("t"))

    def shapley(f: int) -> Column:
        bit, total = 1 << f, F.lit(0).cast("bigint")
        for s in range(1 << n):
            if not s & bit:
                times = factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())
                total = total + (F.col("k")[s] - F.col("k")[s | bit]) * F.lit(times).cast("bigint")
        return total

    steps = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(i).alias("i"), F.lit(f).alias("f"), F.lit(s).alias("s"), F.lit(s | 1 << f).alias("e")) for o, i, f, s in _orders()]))
    rows = sums.select("part", "k", "g", "t", F.array(*[shapley(f) for f in range(n)]).alias("sh"), steps.alias("x"))
    lost = lambda a: F.get(F.col(a), F.col("x.s")) - F.get(F.col(a), F.col("x.e"))
    alone = F.element_at(F.array(*[F.lit(1 << f) for f in range(n)]), F.col("x.f") + 1)
    everything = F.lit((1 << n) - 1)
    return rows.select(
        "part",
        F.col("x.o").alias("filter_order"),
        F.col("x.i").alias("step"),
        F.get("k", F.col("x.e")).alias("kept"),
        lost("k").alias("removed"),
        (F.get("k", F.lit(0)) - F.get("k", alone) - lost("k")).alias("redundant"),
        (F.get("k", everything - alone) - F.get("k", everything)).alias("unique_fails"),
        lost("g").alias("good_lost"),
        lost("t").alias("toxic_lost"),
        F.get("sh", F.col("x.f")).alias("shapley"),
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, **options) -> DataFrame:
    """For each part (source; NULL: empty string), order of the filters and step: documents kept, removed, redundant,
    failing only this filter, good and toxic ones removed, and the filter's removals over all orders.

    Filter E removes a text that some smaller doc_id has too, wherever it stands; rows without a doc_id are no copies
    and make none; rows that repeat an id together with its text are counted one by one and aren't copies of each
    other. NULL and empty texts are one text. A document labelled more than once has every label said of it. An empty
    table gives no rows; other columns aren't read.
    """
    return interactions(counters(spark, path, labels, **options))
