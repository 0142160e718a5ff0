"""Evaluation of rankings against labelled faults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.functions.categories import fault_from_role
from faultline.functions.names import fault_key, key_type, reason_hit
from faultline.operators.joins import attach
from faultline.operators.rank import WINDOW_KEY


def fault_results(placed: DataFrame, rankings: DataFrame, inferred: DataFrame | None = None) -> DataFrame:
    """One row per fault: rank of the labelled service and what follows from it.

    `placed` holds the faults with their window and, when known, `time_hit`.
    """
    key = [*WINDOW_KEY, "entity"]
    # Many faults may ask for one rank: keep the ranks that are asked for, then join them salted.
    own = rankings.select(*key, "rank").join(placed.select(*key).distinct(), key, "left_semi")
    if inferred is not None:
        own = own.join(inferred, list(WINDOW_KEY), "left")
    joined = attach(placed, own, key, small=False)
    if inferred is not None:
        hit = F.coalesce(reason_hit(F.col("inferred_type"), F.coalesce("reason", F.lit(""))), F.lit(False))
        joined = joined.withColumn("reason_hit", hit)
    if "time_hit" not in joined.columns:
        joined = joined.withColumn("time_hit", F.lit(False))
    if "reason_hit" not in joined.columns:
        joined = joined.withColumn("reason_hit", F.lit(False))
    return joined.select(
        "system",
        "fault_id",
        fault_key(F.col("type"), F.col("entity")).alias("fault"),
        "entity",
        "start",
        "stop",
        "rank",
        (F.col("rank") == 1).alias("top1"),
        (F.col("rank") <= 3).alias("top3"),
        (1.0 / F.col("rank")).alias("mrr"),
        "time_hit",
        ((F.col("rank") == 1) & F.col("time_hit")).alias("ct_hit"),
        "reason_hit",
    )


def role_inference(rankings: DataFrame) -> DataFrame:
    """Fault type per window from the role of its top-ranked service."""
    total = rankings.groupBy(*WINDOW_KEY).agg(
        F.min_by("entity", "rank").alias("_top"),
        F.sum(F.coalesce("mean_residual", F.lit(0.0))).alias("_sum"),
    )
    return total.select(*WINDOW_KEY, fault_from_role(F.col("_top"), F.col("_sum")).alias("inferred_type"))


def _count(flag: str) -> Column:
    return F.count_if(F.col(flag)).cast("bigint")


def summary(results: DataFrame, by: Sequence[str] = ("system",)) -> DataFrame:
    """Counts and rates per group; one map-side combined aggregation."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return results.groupBy(*by).agg(
        F.count("*").alias("n"),
        _count("top1").alias("top1"),
        _count("top3").alias("top3"),
        F.avg("mrr").alias("mrr"),
        F.avg("rank").alias("mean_rank"),
        _count("time_hit").alias("time_hits"),
        _count("ct_hit").alias("ct_hits"),
        _count("reason_hit").alias("reason_hits"),
        rate("top1").alias("top1_rate"),
        rate("top3").alias("top3_rate"),
        rate("time_hit").alias("time_rate"),
        rate("ct_hit").alias("ct_rate"),
        rate("reason_hit").alias("reason_rate"),
    )


def by_type(results: DataFrame) -> DataFrame:
    """Top-1 per fault type, the type read back from the fault key."""
    return results.groupBy("system", key_type(F.col("fault")).alias("type")).agg(
        F.count("*").alias("n"), _count("top1").alias("top1"), F.avg(F.col("top1").cast("double")).alias("top1_rate")
    )


def type_vocabulary(faults: DataFrame) -> DataFrame:
    """Fault types by descending count, ties by name. Ordering touches one row per type."""
    counts = faults.groupBy("system", "type").agg(F.count("*").alias("n"))
    line = Window.partitionBy("system").orderBy(F.col("n").desc(), "type")
    return counts.withColumn("type_idx", (F.row_number().over(line) - 1).cast("bigint"))


def compare_rankings(residual: DataFrame, fused: DataFrame) -> DataFrame:
    """Per fault, rank by residual against rank by fused evidence, aggregated per system."""
    pair = residual.select("system", "fault_id", "rank").join(
        fused.select("system", "fault_id", F.col("rank").alias("fused_rank")), ["system", "fault_id"]
    )
    flag = lambda c: F.count_if(c).cast("bigint")
    return pair.groupBy("system").agg(
        F.count("*").alias("n"),
        flag(F.col("rank") == 1).alias("top1_residual"),
        flag(F.col("fused_rank") == 1).alias("top1_fused"),
        flag(F.col("fused_rank") < F.col("rank")).alias("improved"),
        F.avg("rank").alias("mean_rank_residual"),
        F.avg("fused_rank").alias("mean_rank_fused"),
    )


def first_faults(faults: DataFrame, k: int, per: Sequence[str] = ()) -> DataFrame:
    """The first k faults by time, overall or per episode."""
    if not per:
        return faults.orderBy("ts", "fault_id").limit(k)
    # A rank filter of this form is also applied before the shuffle, so each task sends at most k rows per group.
    line = Window.partitionBy(*per).orderBy("ts", "fault_id")
    return faults.withColumn("_r", F.row_number().over(line)).where(F.col("_r") <= k).drop("_r")
