"""Ranking entities inside incident windows, by residual or by fused evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from faultline.fixed_values import EVIDENCE_WEIGHTS, NEVER
from faultline.operators.joins import SALTS
from faultline.operators.spans import over_windows

WINDOW_KEY = ("system", "start", "stop")


def window_means(residuals: DataFrame, windows: DataFrame, small: bool | None = None) -> DataFrame:
    """Mean residual per (window, entity); NULL for entities without any scored step.

    Windows are made distinct first: faults that share a window share the work. Two lookups per window and entity.
    """
    return over_windows(residuals, windows, small=small).select(*WINDOW_KEY, "entity", "mean_residual")


def ranked(scores: DataFrame, by: str, out: str = "rank", missing: float = -99.0) -> DataFrame:
    """Rank within each window, descending, ties by entity name. A window holds one row per entity."""
    line = Window.partitionBy(*WINDOW_KEY).orderBy(F.coalesce(by, F.lit(missing)).desc(), "entity")
    return scores.withColumn(out, F.row_number().over(line).cast("bigint"))


def rank_in_windows(residuals: DataFrame, windows: DataFrame, missing: float = -99.0, small: bool | None = None) -> DataFrame:
    return ranked(window_means(residuals, windows, small), "mean_residual", missing=missing)


def for_faults(placed: DataFrame, per_window: DataFrame) -> DataFrame:
    """Window results for each fault; faults that share a window are spread by salt."""
    asked = placed.select("fault_id", F.col("entity").alias("labelled"), *WINDOW_KEY)
    salt = F.pmod(F.xxhash64("fault_id"), F.lit(SALTS)).cast("int")
    copies = per_window.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return asked.withColumn("_salt", salt).join(copies, [*WINDOW_KEY, "_salt"]).drop("_salt")


def top_names(rankings: DataFrame, k: int = 3) -> DataFrame:
    """The k best entities of each window, as one text in rank order."""
    best = rankings.where(F.col("rank") <= k)
    names = F.transform(F.sort_array(F.collect_list(F.struct("rank", "entity"))), lambda r: r["entity"])
    return best.groupBy(*WINDOW_KEY).agg(F.array_join(names, ",").alias("top"))


def fuse_evidence(
    means: DataFrame,
    crossings: DataFrame | None,
    downstream: DataFrame,
    drift: DataFrame,
    weights: dict[str, float] = EVIDENCE_WEIGHTS,
    sentinel: int | None = None,
) -> DataFrame:
    """Weighted sum of residual, timing, topology and drift evidence per (window, entity).

    r: min-max residual (0.1 when flat). t: 1 - first / (latest first + 1), 0 without a crossing.
    p: downstream / (max + 1). d: deviation / (max + 1e-8).
    `sentinel` puts entities without a crossing into the latest first (published behaviour: 9999),
    which flattens t; by default only real crossings count. Without `crossings`, `means` has `first_idx` itself.
    """
    if crossings is not None:
        means = means.join(crossings.select(*WINDOW_KEY, "entity", "first_idx"), [*WINDOW_KEY, "entity"], "left")
    joined = (
        means.join(downstream.select("system", "entity", "n_downstream"), ["system", "entity"], "left")
        .join(drift.select("system", "entity", "deviation"), ["system", "entity"], "left")
        .withColumn("n_downstream", F.coalesce("n_downstream", F.lit(0)))
        .withColumn("deviation", F.coalesce("deviation", F.lit(0.0)))
        .withColumn("mean_residual", F.coalesce("mean_residual", F.lit(-1.0)))
    )
    group = Window.partitionBy(*WINDOW_KEY)
    low, high = F.min("mean_residual").over(group), F.max("mean_residual").over(group)
    late = F.col("first_idx") if sentinel is None else F.coalesce(F.col("first_idx"), F.lit(sentinel))
    r = F.when(high > low, (F.col("mean_residual") - low) / (high - low + 1e-8)).otherwise(F.lit(0.1))
    t = F.coalesce(1.0 - F.col("first_idx") / (F.max(late).over(group) + 1), F.lit(0.0))
    p = F.col("n_downstream") / (F.max("n_downstream").over(group) + 1)
    d = F.col("deviation") / (F.max("deviation").over(group) + 1e-8)
    parts = joined.select(
        *WINDOW_KEY, "entity", "mean_residual", r.alias("r"), t.alias("t"), p.alias("p"), d.alias("d")
    )
    total = sum((weights[c] * F.col(c) for c in ("r", "t", "p", "d")), F.lit(0.0))
    return ranked(parts.withColumn("fused", total), "fused", "fused_rank")


def published_fusion(means: DataFrame, crossings: DataFrame | None, downstream: DataFrame, drift: DataFrame) -> DataFrame:
    """`fuse_evidence` with the published sentinel."""
    return fuse_evidence(means, crossings, downstream, drift, sentinel=NEVER)
