"""Scoring: conditional mean and deviation, negative log-likelihood, drift, user models."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from faultline.fixed_values import (
    EDGE_WEIGHT,
    FREE_BITS,
    KL_WEIGHT,
    LOG_SIGMA_RANGE,
    NODE_FEATURES,
    SIGMA_FLOOR,
    STD_FLOOR,
)
from faultline.operators.joins import attach
from faultline.operators.stats import by_feature, pack

TINY = 1e-300


def _line(y: Column, x: Column) -> tuple[Column, Column, Column]:
    """Aggregates of a least-squares line: intercept, slope, deviation of the errors.

    With a constant regressor the line is flat at the mean.
    """
    slope = F.coalesce(F.regr_slope(y, x), F.lit(0.0))
    intercept = F.regr_avgy(y, x) - slope * F.regr_avgx(y, x)
    rest = F.regr_syy(y, x) - slope * F.regr_sxy(y, x)
    sigma = F.sqrt(F.greatest(rest / F.regr_count(y, x), F.lit(0.0)))
    return intercept, slope, sigma


def fit_line(
    rows: DataFrame, keys: Sequence[str], features: Sequence[str], regressor: str, use: str = "use_step"
) -> DataFrame:
    """Per key and feature, the line of the feature on one regressor; rows come normalized."""
    long = by_feature(rows, [*keys, use], features, [regressor] * len(features))
    a, b, s = _line(F.when(F.col(use), F.col("x")), F.when(F.col(use), F.col("r")))
    return long.groupBy(*keys, "feature").agg(
        F.first(F.lit(0.0)).alias("mean"),
        F.first(F.lit(1.0)).alias("std"),
        a.alias("alpha"),
        b.alias("beta"),
        s.alias("sigma"),
    )


def fit_step(
    rows: DataFrame, keys: Sequence[str], features: Sequence[str] = NODE_FEATURES, use: str = "use_step"
) -> DataFrame:
    """Normalization stats and the one-step line of normalized values, from raw values in one pass.

    A line survives an affine change of units: with x = m + s z the slope stays, the intercept becomes
    (a + b m - m) / s and the deviation sigma / s. So the data is aggregated once instead of twice.
    """
    long = by_feature(rows, [*keys, use], features, ["prev_" + f for f in features])
    x = F.when(F.col(use), F.col("x"))
    mean, std = F.avg(x), F.stddev_pop(x) + STD_FLOOR
    a, b, s = _line(x, F.when(F.col(use), F.col("r")))
    return long.groupBy(*keys, "feature").agg(
        mean.alias("mean"),
        std.alias("std"),
        ((a + b * mean - mean) / std).alias("alpha"),
        b.alias("beta"),
        (s / std).alias("sigma"),
    )


def log_sigma(sigma: Column) -> Column:
    low, high = LOG_SIGMA_RANGE
    return F.least(F.greatest(F.ln(F.greatest(sigma, F.lit(TINY))), F.lit(low)), F.lit(high))


def nll(x: Column, mu: Column, sigma: Column) -> Column:
    """Gaussian negative log-likelihood with a floor on the deviation (the floor is not in the log term)."""
    ls = log_sigma(sigma)
    s = F.exp(ls) + SIGMA_FLOOR
    return F.pow(x - mu, F.lit(2.0)) / (2.0 * s * s) + ls + 0.5 * math.log(2 * math.pi)


def scoring_form(fit: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """A fit folded into what a row needs: NLL of feature i is level_i + curve_i * error_i ** 2.

    Logarithms and exponentials are taken once per (key, feature), not once per row.
    """
    s = F.exp(log_sigma(F.col("sigma"))) + SIGMA_FLOOR
    folded = fit.select(
        *keys,
        "feature",
        "mean",
        (F.col("std") * F.col("alpha")).alias("shift"),
        "beta",
        (1.0 / (2.0 * s * s * F.col("std") * F.col("std"))).alias("curve"),
        (1.0 / (F.col("std") * F.col("std"))).alias("scale"),
        (log_sigma(F.col("sigma")) + 0.5 * math.log(2 * math.pi)).alias("level"),
    )
    return pack(folded, keys, features, ["mean", "shift", "beta", "curve", "scale", "level"], "_fit")


def _mean(columns: Iterable[Column]) -> Column:
    columns = list(columns)
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total / len(columns)


def _errors(features: Sequence[str], regressors: Sequence[str]) -> list[tuple[Column, Column]]:
    """(fit entry, prediction error in the feature's own units) per feature."""
    out = []
    for i, (f, r) in enumerate(zip(features, regressors)):
        entry = F.col("_fit")[i]
        out.append((entry, (F.col(f) - entry["mean"]) - entry["shift"] - entry["beta"] * (F.col(r) - entry["mean"])))
    return out


def score_rows(
    rows: DataFrame,
    fit: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    regressors: Sequence[str],
    small: bool | None = None,
) -> DataFrame:
    """Per row, the NLL averaged over features; NULL where a regressor is NULL (first step)."""
    joined = attach(rows, scoring_form(fit, keys, features), keys, small=small)
    parts = [k["level"] + k["curve"] * e * e for k, e in _errors(features, regressors)]
    return joined.withColumn("residual", _mean(parts)).drop("_fit")


def step_residuals(
    rows: DataFrame, fit: DataFrame, keys: Sequence[str], features: Sequence[str] = NODE_FEATURES, small: bool | None = None
) -> DataFrame:
    """`score_rows` for the one-step predictor, on raw values with `prev_` columns."""
    return score_rows(rows, fit, keys, features, ["prev_" + f for f in features], small)


def run_residuals(
    runs: DataFrame, fit: DataFrame, keys: Sequence[str], features: Sequence[str] = NODE_FEATURES, small: bool | None = None
) -> DataFrame:
    """Runs with `at_start`, the residual of their first step (NULL for a member's first), and `inside`, that of the others.

    Both are NULL for a member without a line.
    """
    joined = attach(runs, scoring_form(fit, keys, features), keys, small=small)
    of = lambda regressors: _mean([k["level"] + k["curve"] * e * e for k, e in _errors(features, regressors)])
    return joined.withColumns({"at_start": of(["prev_" + f for f in features]), "inside": of(features)}).drop("_fit")


def run_nll(scored: DataFrame) -> DataFrame:
    """`overall_nll` from scored runs: the inside residual counts once for each step after the first."""
    more = F.when(F.col("inside").isNotNull(), F.col("next_idx") - F.col("t_idx") - 1).otherwise(0)
    total = F.coalesce("at_start", F.lit(0.0)) + F.when(more > 0, more * F.col("inside")).otherwise(0.0)
    n = F.sum(F.col("at_start").isNotNull().cast("bigint") + more)
    return scored.groupBy("system").agg(F.try_divide(F.sum(total), n).alias("nll"), n.alias("n"))


def overall_nll(residuals: DataFrame) -> DataFrame:
    """Mean NLL over everything scored (each residual already averages the same number of features)."""
    return residuals.groupBy("system").agg(F.avg("residual").alias("nll"), F.count("residual").alias("n"))


def edge_error(rows: DataFrame, fit: DataFrame, keys: Sequence[str], features: Sequence[str], small: bool | None = None) -> DataFrame:
    """Mean squared one-step error of edge features, in normalized units; edges without a line have none."""
    lines = fit.where("alpha IS NOT NULL")
    joined = attach(rows, scoring_form(lines, keys, features), keys, small=small)
    parts = [k["scale"] * e * e for k, e in _errors(features, ["prev_" + f for f in features])]
    return joined.select("system", _mean(parts).alias("_e")).groupBy("system").agg(
        F.avg("_e").alias("edge_mse"), F.count("_e").alias("n")
    )


# --- category mixes --------------------------------------------------------------------------


def mix_divergence(counts: DataFrame, keys: Sequence[str], free_bits: float = FREE_BITS) -> DataFrame:
    """KL of each key's softmax over categories from that of the mean mix, floored at `free_bits`, from counts alone.

    `counts` holds (keys with the system, category, n), a row where n > 0. The logit of a category is ln(1 + n), that of
    the mean mix ln(1 + mean n over the keys of the system), so softmax shares are (1 + n) over a sum. Categories that a
    key lacks all have share 1 over that sum: together they are one term, made of the system's sum of mean logits less
    those of the key's own categories. No row and no array holds categories that a key hasn't.
    """
    keys = list(keys)
    axes = counts.select(*keys).distinct().groupBy("system").agg(F.count("*").alias("_keys"))
    totals = attach(counts.groupBy("system", "category").agg(F.sum("n").alias("_total")), axes, ["system"])
    base = totals.select("system", "category", F.ln(1.0 + F.col("_total") / F.col("_keys")).alias("_b"), (F.col("_total") / F.col("_keys")).alias("_m"))
    whole = base.groupBy("system").agg(F.count("*").alias("_c"), F.sum("_b").alias("_all_b"), F.sum("_m").alias("_all_m"))
    met = attach(counts.select(*keys, "category", "n"), base.select("system", "category", "_b"), ["system", "category"])
    own = met.groupBy(*keys).agg(
        F.sum("n").alias("_n"),
        F.sum((1.0 + F.col("n")) * (F.ln(1.0 + F.col("n")) - F.col("_b"))).alias("_own"),
        F.sum("_b").alias("_own_b"),
    )
    joined = attach(own, whole, ["system"])
    total = F.col("_c") + F.col("_n")
    lacking = F.col("_all_b") - F.col("_own_b")
    kl = F.ln((F.col("_c") + F.col("_all_m")) / total) + (F.col("_own") - lacking) / total
    return joined.select(*keys, kl.alias("kl")).withColumn("kl_floored", F.greatest(F.col("kl"), F.lit(free_bits)))


def mix_concentration(counts: DataFrame, key: str = "entity", small: bool | None = None) -> DataFrame:
    """Distance of each key's category entropy from the uniform one, log of the number of categories."""
    classes = counts.groupBy("system").agg(F.count_distinct("category").alias("_c"))
    totals = counts.groupBy("system", key).agg(F.sum("n").alias("_t"))
    shares = counts.join(totals, ["system", key]).withColumn("_p", F.col("n") / F.col("_t"))
    entropy = shares.groupBy("system", key).agg((-F.sum(F.col("_p") * F.ln(F.col("_p") + 1e-8))).alias("entropy"))
    return attach(entropy, classes, ["system"], small=small).select(
        "system", key, "entropy", F.abs(F.col("entropy") - F.ln("_c")).alias("deviation")
    )


def objective(nll_row: DataFrame, edge_row: DataFrame, kl_row: DataFrame) -> DataFrame:
    """Weighted fit report: NLL + 0.3 edge error + 0.1 divergence, one row per system; what is missing stays NULL."""
    joined = nll_row.select("system", F.col("nll").alias("metric_loss")).join(
        edge_row.select("system", F.col("edge_mse").alias("edge_loss")), "system", "left"
    ).join(kl_row.select("system", F.col("kl").alias("kl_loss")), "system", "left")
    total = F.col("metric_loss") + EDGE_WEIGHT * F.col("edge_loss") + KL_WEIGHT * F.col("kl_loss")
    return joined.withColumn("total_loss", total)


# --- user models -----------------------------------------------------------------------------


def apply_model(windowed: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a user's function on every (window, entity); a group holds at most one window of steps."""
    return windowed.groupBy("system", "window_start", "entity").applyInPandas(model, schema)


def mean_step_change(steps: pd.DataFrame) -> pd.DataFrame:
    """Example model: mean absolute change of load from step to step."""
    ordered = steps.sort_values("t_idx")
    head = ordered[["system", "window_start", "entity"]].iloc[:1].copy()
    head["score"] = float(ordered["workload_ops"].diff().abs().mean())
    return head
