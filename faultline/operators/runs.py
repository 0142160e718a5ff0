"""The filled grid as runs: each observed cell holds until the next one, so only observed cells are kept.

A run [t_idx, next_idx) stands for that many equal cells. Statistics and fits weigh it by the steps in it that count,
and the dense rows come into being where they are asked for (`unrolled`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from faultline.fixed_values import NODE_FEATURES, STD_FLOOR
from faultline.operators.blocks import BLOCK
from faultline.operators.joins import attach, spread
from faultline.operators.stats import by_feature


def beside(rows: DataFrame, keys: Sequence[str], order: str, kept: Sequence[str], block: int) -> DataFrame:
    """Add `_prev` (struct of `kept` of the row before) and `_next` (`order` of the row after) within each key.

    Blocks of `block` units of `order` are ordered on their own; one row per occupied block is ordered as a whole.
    """
    home = [*keys, "_blk"]
    cut_up = rows.withColumn("_blk", F.floor(F.col(order) / block)).withColumn("_own", F.struct(*kept))
    ends = cut_up.groupBy(*home).agg(F.min(order).alias("_low"), F.max_by("_own", order).alias("_end"))
    line, inside = Window.partitionBy(*keys).orderBy("_blk"), Window.partitionBy(*home).orderBy(order)
    around = ends.select(*home, F.lag("_end").over(line).alias("_before"), F.lead("_low").over(line).alias("_after"))
    seen = cut_up.withColumns({"_p": F.lag("_own").over(inside), "_n": F.lead(order).over(inside)}).join(around, home)
    return seen.select(*rows.columns, F.coalesce("_p", "_before").alias("_prev"), F.coalesce("_n", "_after").alias("_next"))


def cell_runs(
    cells: DataFrame,
    steps: DataFrame,
    members: DataFrame,
    features: Sequence[str] = NODE_FEATURES,
    on: Sequence[str] = ("entity",),
    block: int = BLOCK,
    small: bool | None = None,
) -> DataFrame:
    """Runs of the forward-filled grid: (system, *on, t_idx, next_idx, n_steps, observed, features, prev_ features).

    One run per observed cell (NULL values as 0), and one of zeros from step 0 for a member that isn't observed there.
    `prev_` columns are the values of the run before, NULL for a member's first run. Members that are never observed
    have one run; cells at no step or of no member are left out. `small`: whether `members` was counted as small.
    """
    on = list(on)
    keys = ["system", *on]
    values = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]
    placed = attach(cells.select(*keys, "ts", *features), steps.select("system", "ts", "t_idx"), ["system", "ts"])
    placed = attach(placed, members.select(*keys), keys, "left_semi", small).select(*keys, "t_idx", F.lit(True).alias("observed"), *values)
    begun = placed.where("t_idx = 0").select(*keys)
    idle = members.select(*keys).join(begun, keys, "left_anti").join(steps.select("system").distinct(), "system", "left_semi")
    zero = [F.lit(0.0).alias(f) for f in features]
    rows = placed.unionByName(idle.select(*keys, F.lit(0).cast("bigint").alias("t_idx"), F.lit(False).alias("observed"), *zero))
    axis = steps.groupBy("system").agg(F.max("n_steps").alias("n_steps"))
    seen = attach(beside(rows, keys, "t_idx", features, block), axis, ["system"], small=small)
    return seen.select(
        *keys,
        "t_idx",
        F.coalesce("_next", "n_steps").alias("next_idx"),
        "n_steps",
        "observed",
        *features,
        *[F.col("_prev")[f].alias("prev_" + f) for f in features],
    )


def step_counts(steps: DataFrame, use: str = "use_step", block: int = BLOCK) -> DataFrame:
    """(system, t_idx, used, upto): whether a step counts, and how many do up to and with it."""
    home = ["system", "_blk"]
    rows = steps.select("system", "t_idx", F.col(use).cast("bigint").alias("used"), F.floor(F.col("t_idx") / block).alias("_blk"))
    ends = rows.groupBy(*home).agg(F.sum("used").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("system").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*home, F.coalesce(before, F.lit(0)).alias("_base"))
    inside = F.sum("used").over(Window.partitionBy(*home).orderBy("t_idx").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_in", inside).join(ends, home).select("system", "t_idx", "used", (F.col("_base") + F.col("_in")).alias("upto"))


def weighted(runs: DataFrame, counts: DataFrame, small: bool | None = None) -> DataFrame:
    """Add `w`, the steps of the run that count, and `u`, 1 if its first one does."""
    at = counts.select("system", "t_idx", F.col("used").alias("u"), F.col("upto").alias("_a"))
    to = counts.select("system", F.col("t_idx").alias("_last"), F.col("upto").alias("_b"))
    met = attach(runs, at, ["system", "t_idx"], small=small).withColumn("_last", F.col("next_idx") - 1)
    met = attach(met, to, ["system", "_last"], small=small)
    return met.withColumn("w", F.col("_b") - F.col("_a") + F.col("u")).drop("_a", "_b", "_last")


def fit_runs(
    weighed: DataFrame, keys: Sequence[str], features: Sequence[str] = NODE_FEATURES, small: bool | None = None
) -> DataFrame:
    """What `score.fit_step` gives on the dense rows, from runs: mean, std, alpha, beta, sigma per key and feature.

    Inside a run a step equals the one before, at its start the pair is (value of the run before, value). Means come
    first, then sums about them, so nothing cancels; a constant regressor is told by its bounds. Without any pair that
    counts (the only normal step is the first) there are mean and std, but no line: its columns are NULL.
    """
    keys = list(keys)
    long = by_feature(weighed, [*keys, "w", "u", "t_idx"], features, ["prev_" + f for f in features])
    first = F.when(F.col("r").isNotNull(), F.col("u")).otherwise(F.lit(0))
    long = long.withColumns({"_f": first, "_i": F.col("w") - F.col("u"), "_r": F.coalesce("r", F.lit(0.0))})
    some = lambda weight, c: F.when(F.col(weight) > 0, F.col(c))
    means = long.groupBy(*keys, "feature").agg(
        F.sum("w").alias("_w"),
        (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"),
        F.sum(F.col("_f") + F.col("_i")).alias("_n"),
        F.try_divide(F.sum(F.col("_f") * F.col("_r") + F.col("_i") * F.col("x")), F.sum(F.col("_f") + F.col("_i"))).alias("_mr"),
        F.try_divide(F.sum((F.col("_f") + F.col("_i")) * F.col("x")), F.sum(F.col("_f") + F.col("_i"))).alias("_mx"),
        F.min(F.least(some("_f", "_r"), some("_i", "x"))).alias("_low"),
        F.max(F.greatest(some("_f", "_r"), some("_i", "x"))).alias("_high"),
    )
    met = attach(long, means, [*keys, "feature"], small=small)
    x, r = F.col("x") - F.col("_mx"), F.col("_r") - F.col("_mr")
    inner = F.col("x") - F.col("_mr")
    sums = met.groupBy(*keys, "feature").agg(
        *[F.first(c).alias(c) for c in ("_w", "mean", "_n", "_mr", "_mx", "_low", "_high")],
        F.sum(F.col("w") * F.pow(F.col("x") - F.col("mean"), F.lit(2.0))).alias("_dev"),
        F.sum(F.col("_f") * r * r + F.col("_i") * inner * inner).alias("_srr"),
        F.sum(F.col("_f") * r * x + F.col("_i") * inner * x).alias("_srx"),
        F.sum((F.col("_f") + F.col("_i")) * x * x).alias("_sxx"),
    )
    std = F.sqrt(F.col("_dev") / F.col("_w")) + STD_FLOOR
    slope = F.when((F.col("_high") > F.col("_low")) & (F.col("_srr") > 0), F.col("_srx") / F.col("_srr")).otherwise(0.0)
    rest = F.greatest(F.try_divide(F.col("_sxx") - F.col("_b") * F.col("_srx"), F.col("_n")), F.lit(0.0))
    paired = F.col("_n") > 0
    level = F.col("_mx") - F.col("_b") * F.col("_mr")
    return sums.withColumns({"std": std, "_b": slope}).select(
        *keys,
        "feature",
        "mean",
        "std",
        ((level + F.col("_b") * F.col("mean") - F.col("mean")) / F.col("std")).alias("alpha"),
        F.when(paired, F.col("_b")).alias("beta"),
        F.when(paired, F.sqrt(rest) / F.col("std")).alias("sigma"),
    )


def unrolled(runs: DataFrame, steps: DataFrame, kept: Sequence[str], block: int = BLOCK) -> DataFrame:
    """The dense rows of runs: one per step, with the step's columns, `kept` of its run, and `begins` at its first step.

    Long runs are cut at block borders and dealt to all tasks before they grow.
    """
    pieces = F.explode(F.sequence(F.floor(F.col("t_idx") / block), F.floor((F.col("next_idx") - 1) / block)))
    cut_up = spread(runs.select("system", *kept, F.col("t_idx").alias("_t"), "next_idx", pieces.alias("_p")), "system", *kept, "_t", "_p")
    ends = F.sequence(F.greatest(F.col("_t"), F.col("_p") * block), F.least(F.col("next_idx"), (F.col("_p") + 1) * block) - 1)
    rows = cut_up.select("system", *kept, "_t", F.explode(ends).alias("t_idx"))
    rows = rows.withColumn("begins", F.col("t_idx") == F.col("_t")).drop("_t")
    return attach(rows, steps, ["system", "t_idx"])
