"""Sliding windows: training and scoring forms, padding, labels, splits, merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from faultline.fixed_values import FAULT_SECONDS, MIN_WINDOW_STEPS, SCORE_STRIDE, TRAIN_STRIDE, WINDOW
from faultline.operators.blocks import positions
from faultline.operators.joins import fault_steps


def _start_limit(size: int, form: str) -> Column:
    """First start that is too late."""
    room = F.col("n_steps") - size
    return F.greatest(F.lit(1), room) if form == "score" else room


def sliding_windows(rows: DataFrame, size: int = WINDOW, stride: int = TRAIN_STRIDE, form: str = "train") -> DataFrame:
    """Send each step to every window that holds it; adds `window_start` and `offset`.

    Starts are 0, stride, 2 * stride and so on. The training form takes starts below T - size, so the
    last full window is left out. The scoring form takes starts below max(1, T - size), so T = size
    gives one window, and drops windows of fewer than four steps.
    Rows carry `t_idx` and `n_steps`; there is no join and no shuffle.
    """
    t = F.col("t_idx")
    first = F.greatest(F.ceil((t - size + 1) / stride), F.lit(0)).cast("bigint")
    last = F.floor(t / stride).cast("bigint")
    starts = F.when(first <= last, F.transform(F.sequence(first, last), lambda k: k * stride))
    out = rows.withColumn("window_start", F.explode(starts)).where(F.col("window_start") < _start_limit(size, form))
    if form == "score":
        out = out.where(F.col("n_steps") - F.col("window_start") >= MIN_WINDOW_STEPS)
    return out.withColumn("offset", F.col("t_idx") - F.col("window_start"))


def latest_window(size: int = WINDOW, stride: int = SCORE_STRIDE) -> Column:
    """Start of the latest scoring window in which the step has a predecessor, NULL if there is none.

    Same result as building the windows and taking the largest start, but a row expression.
    """
    t = F.col("t_idx")
    last = F.ceil(_start_limit(size, "score") / stride) - 1
    start = (F.least(F.floor((t - 1) / stride), last) * stride).cast("bigint")
    return F.when((t >= 1) & (t - start < size) & (F.col("n_steps") - start >= MIN_WINDOW_STEPS), start)


def pad_windows(windowed: DataFrame, features: Sequence[str], size: int = WINDOW) -> DataFrame:
    """Zero rows up to `size` offsets for windows cut short by the end of the series.

    The last step's row unrolls into the missing offsets.
    """
    at_end = (F.col("t_idx") == F.col("n_steps") - 1) & (F.col("offset") < size - 1)
    own = F.array(F.col("offset"))
    places = F.when(at_end, F.sequence(F.col("offset"), F.lit(size - 1).cast("bigint"))).otherwise(own)
    out = windowed.withColumn("_own", F.col("offset")).withColumn("offset", F.explode(places))
    real = F.col("_own") == F.col("offset")
    kept = [c for c in windowed.columns if c not in features and c != "t_idx"]
    return out.select(
        *kept,
        F.when(real, F.col("t_idx")).alias("t_idx"),
        *[F.when(real, F.col(f)).otherwise(F.lit(0.0)).alias(f) for f in features],
    )


def label_windows(steps: DataFrame, size: int = WINDOW, stride: int = TRAIN_STRIDE) -> DataFrame:
    """One row per training window: normal only if every step is normal."""
    rows = sliding_windows(steps.select("system", "ts", "t_idx", "n_steps", "is_normal"), size, stride)
    return rows.groupBy("system", "window_start").agg(
        F.bool_and("is_normal").alias("all_normal"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count("*").alias("n_rows"),
    )


def split_windows(labelled: DataFrame, size: int = WINDOW) -> DataFrame:
    """Abnormal windows are fault windows; every fifth stretch of starts is validation; the rest trains.

    Windows overlap, so neighbours can share steps across splits.
    """
    fifth = F.floor(F.col("window_start") / size) % 5 == 0
    return labelled.withColumn(
        "split", F.when(~F.col("all_normal"), "fault").when(fifth, "val").otherwise("train")
    )


def window_faults(
    steps: DataFrame, faults: DataFrame, size: int = WINDOW, stride: int = TRAIN_STRIDE, duration: int = FAULT_SECONDS
) -> DataFrame:
    """Which faults are active in which windows: the fault covers one of the window's steps."""
    met = fault_steps(
        steps.select("system", "ts", "t_idx", "n_steps"), faults.select("system", "ts", "fault_id"), duration
    )
    return sliding_windows(met, size, stride).select("system", "window_start", "fault_id").distinct()


def first_windows(split: DataFrame, k: int, which: str = "val") -> DataFrame:
    """The first k windows of one split per system."""
    chosen = split.where(F.col("split") == which)
    return positions(chosen, ["window_start"], "window_rank").where(F.col("window_rank") < k)


def nested_windows(windowed: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per (window, entity) holding its steps as an ordered array; a window bounds the array."""
    step = F.struct("offset", *features)
    return windowed.groupBy("system", "window_start", "entity").agg(F.sort_array(F.collect_list(step)).alias("steps"))


def merge_scores(scored: DataFrame, cells: DataFrame) -> DataFrame:
    """One residual per cell out of overlapping windows: the latest-starting window wins.

    A window never scores its own first step. Cells no window scored stay NULL.
    """
    best = (
        scored.where(F.col("offset") >= 1)
        .groupBy("system", "entity", "t_idx")
        .agg(F.max_by("residual", "window_start").alias("residual"), F.max("window_start").alias("window_start"))
    )
    return cells.join(best, ["system", "entity", "t_idx"], "left")
