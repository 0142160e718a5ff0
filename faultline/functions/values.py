"""Values: parsing, units, missing data, alternatives."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from faultline.fixed_values import (
    LATENCY_COLUMNS,
    NODE_FEATURES,
    P99_FROM_LATENCY,
    SUCCESS_COLUMNS,
    WORKLOAD_COLUMNS,
)


def number(text: Column) -> Column:
    """A finite number, or NULL: bad text, NaN and infinities all count as missing."""
    x = text.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def whole(text: Column) -> Column:
    """A whole number: as it is written, else a finite decimal without its fraction, else NULL."""
    return F.coalesce(text.try_cast("bigint"), number(text).try_cast("bigint"))


def log_scale(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def or_zero(x: Column) -> Column:
    """Missing to zero."""
    return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0))


def seconds_to_ms(x: Column) -> Column:
    return x * 1000.0


def ns_to_seconds(x: Column) -> Column:
    """Floor to whole seconds (also below zero)."""
    return F.floor((x - F.pmod(x, F.lit(1_000_000_000))) / 1_000_000_000).cast("bigint")


def ns_to_ms(x: Column) -> Column:
    return x / 1_000_000.0


def ms_to_seconds(x: Column) -> Column:
    """Truncate towards zero."""
    return (x / 1000).cast("bigint")


def first_existing(df: DataFrame, names: Iterable[str], default: float | None) -> Column:
    """The first of `names` that is a column; the default only if none exists."""
    for name in names:
        if name in df.columns:
            return F.col(name).try_cast("double")
    return F.lit(default).cast("double")


def service_features(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The eight features out of a service-level file that has only rate, success and latency."""
    rate = first_existing(df, *WORKLOAD_COLUMNS)
    success = first_existing(df, *SUCCESS_COLUMNS)
    latency = first_existing(df, *LATENCY_COLUMNS)
    known = {
        "latency_p90_ms": or_zero(latency),
        "latency_p99_ms": or_zero(latency * P99_FROM_LATENCY),
        "workload_ops": or_zero(rate),
        "success_rate": or_zero(success),
    }
    return df.select(*keys, *[known.get(f, F.lit(0.0)).alias(f) for f in NODE_FEATURES])


def fit_features(df: DataFrame, keys: Sequence[str], have: Sequence[str], drop_rest: bool = False) -> DataFrame:
    """Pad a feature list to the eight standard slots, in order. More than eight are an error unless `drop_rest` is
    given, which cuts the list."""
    if len(have) > len(NODE_FEATURES) and not drop_rest:
        raise ValueError(f"no slots for {', '.join(have[len(NODE_FEATURES):])}; drop_rest=True leaves them out")
    slots = list(have)[: len(NODE_FEATURES)]
    padded = [or_zero(F.col(c)) for c in slots]
    padded += [F.lit(0.0)] * (len(NODE_FEATURES) - len(slots))
    return df.select(*keys, *[c.alias(f) for c, f in zip(padded, NODE_FEATURES)])


def pod_features(df: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """Pod columns to the eight features in standard units.

    With `strict`, a row with any unreadable number contributes none of its features.
    """
    raw = {c: number(F.col(c)) for c in ("cpu", "mem", "net_rx", "net_tx", "p90_s", "p99_s", "ops", "success")}
    made = {
        "cpu_rate": raw["cpu"],
        "memory_rate": raw["mem"],
        "net_rx_bytes": log_scale(raw["net_rx"]),
        "net_tx_bytes": log_scale(raw["net_tx"]),
        "latency_p90_ms": seconds_to_ms(raw["p90_s"]),
        "latency_p99_ms": seconds_to_ms(raw["p99_s"]),
        "workload_ops": raw["ops"],
        "success_rate": raw["success"],
    }
    # greatest() skips NULL, so a missing counter must not turn into log1p(0).
    for feature, source in (("net_rx_bytes", "net_rx"), ("net_tx_bytes", "net_tx")):
        made[feature] = F.when(raw[source].isNotNull(), made[feature])
    if strict:
        complete = ~F.greatest(*[c.isNull().cast("int") for c in raw.values()]).cast("boolean")
        made = {f: F.when(complete, c) for f, c in made.items()}
    return df.select(*keys, *[c.alias(f) for f, c in made.items()])
