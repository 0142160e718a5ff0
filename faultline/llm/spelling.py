"""Spelling variants: words one edit apart by permuterm rotations, and each word's more frequent form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.llm.common import attach_small
from faultline.session import cut

MIN_LENGTH = 6
MIN_COUNT = 5
#: A form is at least so many times as frequent as the word.
TIMES = 5
#: One in so many (document, run) pairs loses a letter.
TYPO_RATE = 199
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: End of a word in its rotations; no run has it.
END = "$"


def counted_words(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo_rate: int = TYPO_RATE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(word, n): the runs of letters of whole texts, A-Z lower-cased, with the planted deletions, and their counts.

    Runs shorter than a word can't become one, so only longer runs leave the text. Counts are combined before the
    shuffle, so a frequent word is one row per task. A NULL doc_id stands as an empty text before the colon.
    """
    long_run = f"[A-Za-zÀ-ÿ]{{{min_length},}}"
    runs = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(long_run), F.lit(0)))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), runs.alias("run"))
    ascii_only = F.octet_length("run") == F.char_length("run")
    small = F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, UPPER.lower()))
    rows = rows.select("id", small.alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % typo_rate == 0, less).otherwise(F.col("run"))
    words = rows.select(word.alias("word")).where(F.char_length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """(key, letter, first, word, n): every rotation of each word with its end mark, seen in two ways.

    A rotation that starts after place i ends with letter i. Without that letter it is the key under which all words
    stand that differ there, and it is a whole rotation of the word with the letter deleted, which stands there with
    letter NULL. `first`: the letter isn't the same as the one before it; deleting either of two equal neighbours
    gives the same word, so only the first of them counts as a deletion.
    """
    size = F.char_length("word")
    at = words.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("i"))
    head, tail = F.substring("word", F.lit(1), F.col("i")), F.substring("word", F.col("i") + 2, size)
    letter = F.substring("word", F.col("i") + 1, F.lit(1))
    before = F.substring("word", F.col("i"), F.lit(1))
    edited = at.where(F.col("i") < size).select(
        F.concat(tail, F.lit(END), head).alias("key"),
        letter.alias("letter"),
        ((F.col("i") == 0) | (letter != before)).alias("first"),
        "word",
        "n",
    )
    whole = at.select(
        F.concat(F.substring("word", F.col("i") + 1, size), F.lit(END), head).alias("key"),
        F.lit(None).cast("string").alias("letter"),
        F.lit(True).alias("first"),
        "word",
        "n",
    )
    return edited.unionByName(whole)


def neighbours(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n, n_near, near, near_n) for each row of `words` (word, n; unique words): how many words are one edit
    away, and the most frequent of them (ties: smallest in code-point order), NULL where there is none.

    The rotations are sorted and scanned key by key. All words under one key are near each other, and a key holds at
    most one word for each letter of the alphabet and one whole word, so no group is large and no pair is written:
    each member takes the group's size less its own place, and its first or second word by count.
    """
    group = Window.partitionBy("key")
    ordered = group.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = F.struct("n", "word")
    seen = rotations(words).select(
        "word",
        "n",
        F.col("letter").isNull().alias("whole"),
        "first",
        F.sum(F.when(F.col("letter").isNotNull(), 1).otherwise(0)).over(ordered).alias("edited"),
        F.sum(F.when(F.col("letter").isNotNull() & F.col("first"), 1).otherwise(0)).over(ordered).alias("deleted"),
        F.sum(F.when(F.col("letter").isNull(), 1).otherwise(0)).over(ordered).alias("wholes"),
        F.first(top).over(ordered).alias("best"),
        F.nth_value(top, 2).over(ordered).alias("second"),
    )
    by_deletion = F.when(F.col("first"), F.col("wholes")).otherwise(0)
    near = F.when(F.col("whole"), F.col("deleted")).otherwise(F.col("edited") - 1 + by_deletion)
    other = F.when(F.col("best.word") == F.col("word"), F.col("second")).otherwise(F.col("best"))
    found = seen.select("word", "n", near.alias("near"), F.struct((-other["n"]).alias("n"), other["word"].alias("word")).alias("other"))
    best = F.min(F.when(F.col("other.word").isNotNull(), F.col("other")))
    per = found.groupBy("word", "n").agg(F.sum("near").alias("n_near"), best.alias("best"))
    return per.select("word", "n", "n_near", F.col("best.word").alias("near"), (-F.col("best.n")).alias("near_n"))


def follow(links: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms from each word of `links` (word, form).

    Each round doubles the steps taken. A form is at least `TIMES` as frequent as its word, so a chain has at most
    log(largest count) steps and a few rounds end it. Many words may share a form, hence the salted join.
    """
    links = cut(links.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = cut(attach_small(links, on, ["root"]).select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = found.select("word", "root")
        if not found.where("moved").limit(1).count():
            return links


def group_variants(docs: DataFrame, times: int = TIMES, **options) -> DataFrame:
    """One row per word of the texts of `docs`: word, form, root, n, n_near, form_n.

    Texts that are NULL or empty have no words; repeated rows count again; an empty table gives no rows; other columns
    aren't read. Counts of ties are decided by code-point order.
    """
    words = cut(counted_words(docs, **options))
    near = neighbours(words)
    is_form = F.col("near_n") >= times * F.col("n")
    formed = cut(near.select("word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")))
    roots = follow(formed.where("form IS NOT NULL"))
    return attach_small(formed, roots, ["word"]).select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
