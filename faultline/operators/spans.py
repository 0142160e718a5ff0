"""Aggregates over intervals of a series by running sums and a next-hot index.

A window is answered by two rows of each entity, its first and its last step, however long it is. The rows carry
what was summed before and up to them, and the next step above a threshold. Both are made block by block, so no
task holds a whole series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.operators.blocks import BLOCK
from faultline.operators.joins import attach

#: Values from here on are summed as doubles, apart from the others, whose sums are exact.
LARGE = 1e9
EXACT = "decimal(28,18)"


def _total(frame) -> Column:
    """Running totals over a window frame: rows, scored rows, exact sum of the ordinary values, count and sum of large ones."""
    sums = [
        F.sum("_rows").over(frame).alias("rows"),
        F.sum("_n").over(frame).alias("n"),
        F.sum("_exact").over(frame).alias("exact"),
        F.sum("_far").over(frame).alias("far"),
        F.sum("_large").over(frame).alias("large"),
    ]
    zero = F.struct(
        F.lit(0).cast("bigint").alias("rows"),
        F.lit(0).cast("bigint").alias("n"),
        F.lit(0).cast("decimal(38,18)").alias("exact"),
        F.lit(0).cast("bigint").alias("far"),
        F.lit(0.0).alias("large"),
    )
    return F.when(F.count(F.lit(1)).over(frame) > 0, F.struct(*sums)).otherwise(zero)


def _plus(a: Column, b: Column) -> Column:
    """Totals of two parts. Exact sums stay below the limit of the type: values below `LARGE`, 10 ** 11 of them."""
    exact = (a["exact"] + b["exact"]).cast("decimal(38,18)")
    others = [(a[c] + b[c]).alias(c) for c in ("rows", "n", "far", "large")]
    return F.struct(others[0], others[1], exact.alias("exact"), others[2], others[3])


def series_index(
    residuals: DataFrame, levels: DataFrame | None = None, sums: bool = True, block: int = BLOCK, small: bool | None = None
) -> DataFrame:
    """(system, entity, t_idx) with `before` and `upto`, totals of the steps before and up to this one, and, with
    `levels` (system, level), `next_hot`, the first step from here on whose residual exceeds the level.

    `residuals` holds one row per step of each entity, NULL where there is no score. One shuffle by (entity, block);
    each block passes one row on, and only these are ordered as a series.
    """
    home = ["system", "entity", "_blk"]
    rows = residuals.select("system", "entity", "t_idx", "residual", F.floor(F.col("t_idx") / block).alias("_blk"))
    if levels is not None:
        rows = attach(rows, levels.select("system", "level"), ["system"], "left", small)
        rows = rows.withColumn("_hot", F.when(F.col("residual") > F.col("level"), F.col("t_idx")))
    if sums:
        far = F.abs("residual") >= LARGE
        rows = rows.withColumns(
            {
                "_rows": F.lit(1).cast("bigint"),
                "_n": F.col("residual").isNotNull().cast("bigint"),
                "_exact": F.coalesce(F.when(~far, F.col("residual").cast(EXACT)), F.lit(0).cast(EXACT)),
                "_far": F.coalesce(far, F.lit(False)).cast("bigint"),
                "_large": F.coalesce(F.when(far, F.col("residual")), F.lit(0.0)),
            }
        )
    parts, line = [], Window.partitionBy("system", "entity").orderBy("_blk")
    inside, back = Window.partitionBy(*home).orderBy("t_idx"), Window.partitionBy(*home).orderBy(F.desc("t_idx"))
    made = ["system", "entity", "_blk", "t_idx"]
    if sums:
        parts += [F.sum(c).alias(c) for c in ("_rows", "_n", "_exact", "_far", "_large")]
        made += [
            _total(inside.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
            _total(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
        ]
    if levels is not None:
        parts.append(F.min("_hot").alias("_first"))
        made.append(F.last("_hot", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)).alias("_next"))
    ends = rows.groupBy(*home).agg(*parts)
    carried = []
    if sums:
        carried.append(_total(line.rowsBetween(Window.unboundedPreceding, -1)).alias("_base"))
    if levels is not None:
        later = Window.partitionBy("system", "entity").orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1)
        carried.append(F.last("_first", ignorenulls=True).over(later).alias("_later"))
    joined = rows.select(*made).join(ends.select(*home, *carried), home)
    out = []
    if sums:
        out += [_plus(F.col("_base"), F.col(c)).alias(n) for c, n in (("_before", "before"), ("_upto", "upto"))]
    if levels is not None:
        out.append(F.coalesce("_next", "_later").alias("next_hot"))
    return joined.select("system", "entity", "t_idx", *out)


def level_of(base: DataFrame, k: float) -> DataFrame:
    """(system, level): mu + k sigma."""
    return base.select("system", (F.col("mu") + k * F.col("sigma")).alias("level"))


def over_windows(
    residuals: DataFrame,
    windows: DataFrame,
    levels: DataFrame | None = None,
    sums: bool = True,
    block: int = BLOCK,
    small: bool | None = None,
) -> DataFrame:
    """(system, start, stop, entity) for each distinct window and each entity, with `mean_residual` and `n_rows` of the
    steps in [start, stop), and with `levels` `first_idx`, the first step above the level.

    Windows are clipped to the series. Joined rows: two per window and entity. `small`: whether the systems were counted
    as few.
    """
    key = ["system", "start", "stop"]
    ends = residuals.groupBy("system").agg((F.max("t_idx") + 1).alias("_n"))
    asked = attach(windows.select(*key).distinct(), ends, ["system"], small=small)
    first, last = F.greatest(F.col("start"), F.lit(0)), F.least(F.col("stop"), F.col("_n")) - 1
    edges = F.array(F.struct(F.lit(True).alias("opens"), first.alias("t_idx")), F.struct(F.lit(False).alias("opens"), last.alias("t_idx")))
    edges = asked.where(first <= last).select(*key, F.explode(edges).alias("e")).select(*key, "e.opens", "e.t_idx")
    met = edges.join(series_index(residuals, levels, sums, block, small), ["system", "t_idx"])
    parts = []
    if sums:
        parts += [F.max(F.when(F.col("opens"), F.col("before"))).alias("_a"), F.max(F.when(~F.col("opens"), F.col("upto"))).alias("_b")]
    if levels is not None:
        parts.append(F.max(F.when(F.col("opens"), F.col("next_hot"))).alias("_hot"))
    found = met.groupBy(*key, "entity").agg(*parts)
    out = []
    if sums:
        less = lambda c: F.col("_b")[c] - F.col("_a")[c]
        total = less("exact").cast("double") + F.when(less("far") > 0, less("large")).otherwise(0.0)
        out += [F.when(less("n") > 0, total / less("n")).alias("mean_residual"), less("rows").alias("n_rows")]
    if levels is not None:
        out.append(F.when(F.col("_hot") < F.col("stop"), F.col("_hot")).alias("first_idx"))
    return found.select(*key, "entity", *out)


def first_hot_of(
    residuals: DataFrame, asked: DataFrame, levels: DataFrame, start: str, stop: str, block: int = BLOCK, small: bool | None = None
) -> DataFrame:
    """`asked` (system, entity, start, stop under the given names) with `first_idx`, one lookup each; NULL without one."""
    index = series_index(residuals, levels, sums=False, block=block, small=small)
    index = index.select("system", "entity", F.col("t_idx").alias(start), "next_hot")
    met = asked.join(index, ["system", "entity", start], "left")
    return met.withColumn("first_idx", F.when(F.col("next_hot") < F.col(stop), F.col("next_hot"))).drop("next_hot")


def first_covering(intervals: DataFrame) -> DataFrame:
    """(system, t_idx, start, stop): for each step inside some interval the first one by start, then stop, that holds it."""
    steps = intervals.where("start < stop").select("system", "start", "stop", F.explode(F.sequence("start", F.col("stop") - 1)).alias("t_idx"))
    return steps.groupBy("system", "t_idx").agg(F.min(F.struct("start", "stop")).alias("_i")).select("system", "t_idx", "_i.start", "_i.stop")
