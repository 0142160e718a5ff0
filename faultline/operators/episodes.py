"""Fault episodes: stretches of labelled time that hang together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.fixed_values import FAULT_SECONDS
from faultline.operators.blocks import positions
from faultline.operators.joins import attach, in_range
from faultline.operators.runs import beside

#: Time kept before the first and after the last fault of an episode.
MARGIN = 7200
DAY = 86_400


def fault_sessions(faults: DataFrame, duration: int = FAULT_SECONDS, margin: int = MARGIN) -> DataFrame:
    """(system, episode, start, stop) in seconds: faults whose spans, widened by `margin` on both sides, meet or touch.

    A session starts at a fault that is too far from the one before, and ends at one too far from the one after; the
    k-th start and the k-th end of a system belong together. Faults are ordered day by day, never as a whole.
    """
    times = faults.where("ts IS NOT NULL").select("system", "ts").distinct()
    reach = duration + 2 * margin
    near = beside(times, ["system"], "ts", ["ts"], DAY).select("system", "ts", F.col("_prev.ts").alias("_back"), "_next")
    starts = near.where(F.col("_back").isNull() | (F.col("ts") - F.col("_back") > reach)).select("system", F.col("ts").alias("_a"))
    ends = near.where(F.col("_next").isNull() | (F.col("_next") - F.col("ts") > reach)).select("system", F.col("ts").alias("_z"))
    both = positions(starts, ["_a"], "_k").join(positions(ends, ["_z"], "_k"), ["system", "_k"])
    return both.select(
        "system",
        F.concat_ws("-", "system", F.col("_a").cast("string")).alias("episode"),
        (F.col("_a") - margin).alias("start"),
        (F.col("_z") + duration + margin).alias("stop"),
    )


def in_episodes(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """`rows` (system, ts, ...) with their `episode`, NULL outside. Sessions don't overlap, so rows don't multiply."""
    at = rows.select("system", "ts").distinct()
    held = in_range(at, sessions.select("system", "episode", "start", "stop"), "ts", "start", "stop", block=DAY)
    return attach(rows, held.select("system", "ts", "episode"), ["system", "ts"], "left")
