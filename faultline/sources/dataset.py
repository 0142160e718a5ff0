"""The stored window dataset: Parquet tables below one root."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.fixed_values import CONTEXT_FEATURES, EDGE_FEATURES, NODE_FEATURES
from faultline.operators.stats import apply_stats

KINDS = {
    "nodes": (("entity",), NODE_FEATURES),
    "edges": (("src", "dst"), EDGE_FEATURES),
    "context": ((), CONTEXT_FEATURES),
}


def _write_parts(root: str, name: str, rows: DataFrame, by: str) -> None:
    """Rows in a folder for each value of `by`; their columns are stored beside, since no rows leave no file to tell them."""
    rows.write.mode("overwrite").partitionBy(by).parquet(posixpath.join(root, name))
    shape = rows.select(*[c for c in rows.columns if c != by], by).schema
    rows.sparkSession.createDataFrame([], shape).write.mode("overwrite").parquet(posixpath.join(root, "columns", name))


def _read_parts(spark: SparkSession, root: str, name: str) -> DataFrame:
    shape = spark.read.parquet(posixpath.join(root, "columns", name)).schema
    return spark.read.schema(shape).parquet(posixpath.join(root, name))


def write_windows(root: str, kind: str, windowed: DataFrame) -> None:
    """Window rows, partitioned by split: a reader of one split touches only its files."""
    _write_parts(root, kind, windowed, "split")


def write_stats(root: str, kind: str, stats: DataFrame) -> None:
    stats.write.mode("overwrite").parquet(posixpath.join(root, "stats", kind))


def write_metadata(root: str, spark: SparkSession, **values: int | str) -> None:
    """Names and sizes as a one-row table."""
    row = [F.lit(v).alias(k) for k, v in values.items()]
    spark.range(1).select(*row).write.mode("overwrite").parquet(posixpath.join(root, "metadata"))


def write_names(root: str, entities: DataFrame, edges: DataFrame) -> None:
    """The service names with their positions, and the edge list."""
    entities.write.mode("overwrite").parquet(posixpath.join(root, "names", "entities"))
    edges.write.mode("overwrite").parquet(posixpath.join(root, "names", "edges"))


def write_episodes(root: str, labels: DataFrame, **kinds: DataFrame) -> None:
    """Fault episodes: labels and, by kind, rows with the normal flag, each row once, in a folder for each `episode`.

    Rows outside of every episode (NULL) are stored beside them, so the whole record can be read back.
    """
    for kind, rows in {**kinds, "labels": labels}.items():
        _write_parts(root, posixpath.join("episodes", kind), rows, "episode")


def read_split(spark: SparkSession, root: str, split: str, kind: str = "nodes") -> DataFrame:
    return _read_parts(spark, root, kind).where(F.col("split") == split)


def read_stats(spark: SparkSession, root: str, kind: str = "nodes") -> DataFrame:
    return spark.read.parquet(posixpath.join(root, "stats", kind))


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(posixpath.join(root, "metadata"))


def read_names(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Service names and edge list."""
    return tuple(spark.read.parquet(posixpath.join(root, "names", kind)) for kind in ("entities", "edges"))


def read_episode(
    spark: SparkSession, root: str, name: str | None = None, stats: DataFrame | None = None, kind: str = "nodes"
) -> tuple[DataFrame, DataFrame]:
    """Rows of one kind and labels of an episode, or of the whole record without a name; rows are normalized when stats
    are given (store raw rows then). Only the episode's own files are read."""
    rows = _read_parts(spark, root, posixpath.join("episodes", kind))
    labels = _read_parts(spark, root, posixpath.join("episodes", "labels"))
    if name is not None:
        rows, labels = rows.where(F.col("episode") == name), labels.where(F.col("episode") == name)
    if stats is not None:
        keys, features = KINDS[kind]
        rows = apply_stats(rows, stats, ["system", *keys], features)
    return rows, labels
