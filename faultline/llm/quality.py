"""Quality rules: counts per document, and cross-document line frequency per host. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.llm.common import WORD, attach_small, with_rows
from faultline.session import cut

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is removed when more than so many distinct documents of its host have it.
LINE_LIMIT = 10
#: A document is depleted when fewer than so many percent of its words are left.
MIN_LEFT_PERCENT = 20
#: Up to so many repeated windows of a document are looked up one by one.
FEW = 16


def one_spaced(line: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))


def line_key(line: Column) -> Column:
    """Hash of a line in lower case with single spaces."""
    return F.xxhash64(F.lower(one_spaced(line)))


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def measures(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", row_col: str | None = None
) -> DataFrame:
    """One row per row of `docs`: its base counts, a hash of its text and its lines as (hash, words). A NULL text counts
    as empty. `row_col` names a column that is carried along as `row`; by default rows get a key of their own.

    Everything is computed within the row: windows of three words are hashed, sorted and compared with their
    neighbours, so no word leaves its document. Values used more than once are columns of their own, so that
    they are computed once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("t"), row.alias("row"))
    words = F.regexp_extract_all("t", F.lit(WORD), F.lit(0))
    own = ["row", "whole_text"]
    rows = rows.select(
        "doc_id",
        "host",
        "row",
        F.xxhash64("t").alias("whole_text"),
        F.transform(words, lambda x: F.xxhash64(x)).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
    )
    rows = rows.withColumn("flat", F.transform("lines", one_spaced))
    solid = F.transform("flat", lambda x: F.replace(x, F.lit(" "), F.lit("")))
    gaps = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    at = F.sequence(F.lit(0), F.size("w") - 3)
    three = F.transform(at, lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    rows = rows.select(
        "doc_id",
        "host",
        *own,
        "n_symbols",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join(solid, "")).cast("bigint").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("flat", lambda x: F.struct(F.xxhash64(F.lower(x)).alias("h"), gaps(x).cast("bigint").alias("n"))).alias("lines"),
        F.when(F.size("w") >= 3, three).otherwise(_empty("bigint")).alias("win"),
    )
    rows = rows.withColumn("ordered", F.sort_array("win"))
    twice = F.array_distinct(F.filter("ordered", lambda x, i: x == F.get("ordered", i - 1)))
    rows = rows.withColumn("twice", twice).drop("ordered")
    # positions of repeated windows: looked up where few windows repeat, else by sorting windows with their positions
    few = F.filter(F.transform("win", lambda x, i: F.when(F.array_contains("twice", x), i)), lambda x: x.isNotNull())
    placed = F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(F.size("twice") > FEW, placed).otherwise(_empty("struct<h:bigint,i:int>")))
    same = F.filter(
        "placed",
        lambda x, i: (F.get("placed", i - 1)["h"] == x["h"]) | (F.get("placed", i + 1)["h"] == x["h"]),
    )
    many = F.sort_array(F.transform(same, lambda x: x["i"]))
    none = F.size("twice") == 0
    again = F.when(none, _empty("int")).when(F.size("twice") <= FEW, few).otherwise(many)
    rows = rows.withColumn("again", again).drop("placed", "twice", "win")
    # a window covers three words, fewer where the next repeated one starts before its end
    steps = F.transform("again", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("again", i + 1) - p, F.lit(3))))
    covered = F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("bigint")
    return rows.withColumn("n_repeat_words", covered).drop("again")


def frequent_lines(measured: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """(host, no_host, h) of the lines that more than `limit` distinct documents of one host have.

    Documents are distinct if their texts differ, so exact copies of one text count once. Each document gives a line
    once; equal (host, line, text) are combined before the first shuffle, counts before the second.
    """
    lines = measured.select("host", "whole_text", F.explode(F.array_distinct(F.col("lines.h"))).alias("h"))
    docs = lines.distinct().groupBy("host", "h").agg(F.count("*").alias("n_docs"))
    often = docs.where(F.col("n_docs") > limit)
    return often.select(F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), "h")


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    limit: int = LINE_LIMIT,
    min_left_percent: int = MIN_LEFT_PERCENT,
    row_col: str | None = None,
) -> DataFrame:
    """Base counts and verdict per row of `docs`: row, doc_id, the counts, left_words, frequent (hashes), base_failed,
    kept.

    A document fails the base rules with fewer than 50 words or over half of its words in repeated windows. It is
    depleted when under `min_left_percent` of its words stand outside frequent lines. NULL host: a host of its own.
    Repeated rows are judged one by one. An empty table gives no rows.
    """
    rows = cut(measures(docs, id_col, text_col, host_col, row_col))
    often = cut(frequent_lines(rows, limit))
    lines = rows.select(
        "row", F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), F.explode("lines").alias("l")
    ).select("row", "host", "no_host", "l.h", "l.n")
    gone = attach_small(lines, often, ["host", "no_host", "h"], "inner").groupBy("row").agg(
        F.sum("n").alias("gone"), F.collect_set("h").alias("frequent")
    )
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.join(gone, "row", "left").select(
        "row",
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (100 * left >= min_left_percent * F.col("n_words"))).alias("kept"),
        left.alias("left_words"),
        F.coalesce("frequent", _empty("bigint")).alias("frequent"),
    )


def clean(docs: DataFrame, **options) -> DataFrame:
    """The kept documents with their own columns; frequent lines are taken out of the texts.

    Rows have a key of their own, so each row stands by its own text, whatever its doc_id: NULL or repeated ids are
    judged like any other. An empty table gives no rows.
    """
    table = with_rows(docs)
    verdict = judge(table, row_col="__row", **options).where("kept")
    verdict = verdict.select(F.col("row").alias("__row"), F.col("frequent").alias("__gone"))
    kept = F.filter(F.split("text", "\n"), lambda x: ~(F.array_contains("__gone", line_key(x)) & x.rlike(WORD)))
    text = F.when(F.size("__gone") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    return table.join(verdict, "__row").withColumn("text", text).select(*docs.columns)
