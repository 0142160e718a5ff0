"""What the operators of this subpackage share: reading, size-checked joins, numpy helpers, components."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.session import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Rows a side may have to be broadcast; its rows are short keys and numbers, so this is a few MB.
BROADCAST_ROWS = 50_000
SALTS = 16
#: Texts handed to a Python worker together.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_rows(docs: DataFrame, name: str = "__row") -> DataFrame:
    """`docs` with a text that tells its rows apart and is the same whenever `docs` is read.

    Rows read from Parquet, perhaps filtered or projected, are named by file and place in it. Anything else is written
    first, since its rows may come in another order the next time.
    """
    nodes = re.findall(r"(?m)^[\s:+\-]*(\w+)", docs._jdf.queryExecution().analyzed().toString())
    if set(nodes) <= {"Relation", "Project", "Filter"}:
        try:
            place = F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
            return docs.withColumn(name, place)
        except AnalysisException:  # another kind of file, or the metadata were projected away
            pass
    return cut(docs.withColumn(name, F.monotonically_increasing_id().cast("string")))


def short_batches(docs: DataFrame) -> DataFrame:
    """`docs`, after asking the session for Arrow batches of few rows: texts can be long, and a Python worker holds a
    batch several times over. A smaller setting stays."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return docs


def attach_small(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", most: int | None = None) -> DataFrame:
    """Join `right`, unique in `keys` and made of short columns, to `left`, whose keys may be hot.

    Broadcast when counted as small (`most` rows, else `BROADCAST_ROWS`). Else both sides are salted, so that a hot key is
    met in `SALTS` tasks, and shuffled: Spark takes the copies for as small as the files of `right`, so it would broadcast them.
    """
    most = BROADCAST_ROWS if most is None else most
    if right.limit(most + 1).count() <= most:
        return left.join(F.broadcast(right), keys, how)
    salted = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def large(table: DataFrame) -> bool:
    """Whether a table in files has more rows than a broadcast may have."""
    return table.count() > BROADCAST_ROWS


def bounded(side: DataFrame, rows: int | None = None) -> DataFrame:
    """`side` of a plain join, a table in files with `rows` rows at most (counted if not given), that passes through the
    driver only if it has up to `BROADCAST_ROWS`. Spark would go by the size of the files, and short rows take little there."""
    if large(side) if rows is None else rows > BROADCAST_ROWS:
        return side.hint("merge")
    return side


def parts_for(spark: SparkSession, rows: int, per_part: int) -> int:
    """Partitions so that each holds about `per_part` rows, at least as many as the session shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))


def word_count(text: Column) -> Column:
    """Words of a text, NULL as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


# --- numpy -----------------------------------------------------------------------------------


def roots(n: int) -> np.ndarray:
    """A forest of n single nodes."""
    return np.arange(n)


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (the smallest index of each tree) after linking a[i] with b[i]."""
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return root
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


# --- connected components --------------------------------------------------------------------


def _forest(batches: Iterable) -> Iterable:
    """Replace the links of each batch by stars around the smallest node of each tree."""
    for pdf in batches:
        if not len(pdf):
            continue
        nodes, at = np.unique(np.concatenate([pdf.u.to_numpy(), pdf.v.to_numpy()]), return_inverse=True)
        half = len(pdf)
        root = unite(roots(len(nodes)), at[:half], at[half:])
        far = np.flatnonzero(root != np.arange(len(nodes)))
        yield type(pdf)({"u": nodes[far], "v": nodes[root[far]]})


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node each linked node can reach, from links (u, v) of bigint nodes.

    Rounds of large-star and small-star: every node tells its greater neighbours, then its smaller ones, of its
    smallest neighbour. Each round is a table in the shared folder. Minima are combined before the shuffle, and the
    hub of a large component is only one side of a join that adaptive execution splits. Rounds never add links, and
    the minima of many nodes are not broadcast.
    """
    kind = "u bigint, v bigint"
    edges = cut(links.select("u", "v").where("u <> v").mapInPandas(_forest, kind).distinct())
    seen, most = None, 2 * edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = cut(both.where("v > u").join(bounded(least, most), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(bounded(least, most), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.select("u", F.col("m").alias("v"))
        edges = cut(small.unionByName(own).where("u <> v").distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
