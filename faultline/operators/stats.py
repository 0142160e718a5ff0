"""Normalization statistics and baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from faultline.fixed_values import NODE_FEATURES, STD_FLOOR
from faultline.functions.values import or_zero
from faultline.operators.joins import attach


def by_feature(
    rows: DataFrame, kept: Sequence[str], features: Sequence[str], regressors: Sequence[str] | None = None
) -> DataFrame:
    """One row per (row, feature) with its value `x` and, if asked, its regressor `r`.

    Aggregating this form is faster than one wide aggregation over all features: the generated code
    stays small enough to be compiled, and the unrolled rows never leave the task.
    """
    cells = []
    for i, f in enumerate(features):
        parts = [F.lit(f).alias("feature"), F.col(f).alias("x")]
        if regressors is not None:
            parts.append(F.col(regressors[i]).alias("r"))
        cells.append(F.struct(*parts))
    return rows.select(*kept, F.inline(F.array(*cells)))


def pack(table: DataFrame, keys: Sequence[str], features: Sequence[str], fields: Sequence[str], out: str) -> DataFrame:
    """Per key, an array of one struct per feature in feature order (as many entries as features)."""
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    entries = F.sort_array(F.collect_list(F.struct(place.alias("at"), *fields)))
    return table.groupBy(*keys).agg(entries.alias(out))


def normal_stats(
    filled: DataFrame, keys: Sequence[str], features: Sequence[str] = NODE_FEATURES, normal: str = "is_normal"
) -> DataFrame:
    """Mean and population deviation per key and feature over normal steps, over all steps if none is normal."""
    good = F.when(F.col(normal), F.col("x"))
    return by_feature(filled, [*keys, normal], features).groupBy(*keys, "feature").agg(
        F.coalesce(F.avg(good), F.avg("x")).alias("mean"),
        (F.coalesce(F.stddev_pop(good), F.stddev_pop("x")) + STD_FLOOR).alias("std"),
    )


def pooled_stats(filled: DataFrame, features: Sequence[str] = NODE_FEATURES, keys: Sequence[str] = ("system",)) -> DataFrame:
    """Mean and deviation per feature pooled over time and entities; the floor is added to both."""
    return by_feature(filled, keys, features).groupBy(*keys, "feature").agg(
        (F.avg("x") + STD_FLOOR).alias("mean"), (F.stddev_pop("x") + STD_FLOOR).alias("std")
    )


def apply_stats(
    filled: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    features: Sequence[str] = NODE_FEATURES,
    small: bool | None = None,
) -> DataFrame:
    """(x - mean) / std per key and feature; missing becomes 0."""
    joined = attach(filled, pack(stats, keys, features, ["mean", "std"], "_stats"), keys, small=small)
    kept = [c for c in filled.columns if c not in features]

    def scaled(i: int, f: str) -> Column:
        entry = F.col("_stats")[i]
        return or_zero((F.col(f) - entry["mean"]) / entry["std"]).alias(f)

    return joined.select(*kept, *[scaled(i, f) for i, f in enumerate(features)])


def stored_stats(stats: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """Stats as (system, kind, key, feature, mean, std), the form that is stored."""
    label = F.concat_ws(">", *[F.col(k) for k in keys])
    return stats.select("system", F.lit(kind).alias("kind"), label.alias("key"), "feature", "mean", "std")


def baseline(residuals: DataFrame) -> DataFrame:
    """Mean and deviation of the scored residuals: one row per system."""
    return residuals.groupBy("system").agg(
        F.avg("residual").alias("mu"), F.stddev_pop("residual").alias("sigma"), F.count("residual").alias("n")
    )
