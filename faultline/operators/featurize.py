"""Aggregations from raw telemetry to features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from faultline.fixed_values import ENTRY_SERVICE, KPI_SLOTS, NODE_FEATURES
from faultline.functions.categories import (
    failed_call,
    kpi_category,
    log_severity,
    severity_class,
    severity_weight,
)
from faultline.functions.names import service_of
from faultline.functions.values import ns_to_ms, ns_to_seconds, pod_features
from faultline.operators.grid import dense_grid
from faultline.operators.blocks import positions
from faultline.operators.joins import asof_step, attach, first_containing, fits, spread


def service_means(pods: DataFrame, strict_denominator: bool = False) -> DataFrame:
    """Pod rows to service x time means of the eight features.

    The plain form averages what could be read. With `strict_denominator` every row of the cell
    counts, and a row with an unreadable number adds nothing to the sums.
    """
    rows = pod_features(pods, ["system", "ts", "entity"], strict=strict_denominator)
    if strict_denominator:
        means = [(F.coalesce(F.sum(f), F.lit(0.0)) / F.count("*")).alias(f) for f in NODE_FEATURES]
    else:
        means = [F.avg(f).alias(f) for f in NODE_FEATURES]
    return rows.groupBy("system", "ts", "entity").agg(*means)


def workload_context(
    filled: DataFrame, rules: dict[str, Column] | None = None, keys: Sequence[str] = ("system", "ts", "t_idx")
) -> DataFrame:
    """Total load, mean success and number of active services per step of a filled grid.

    `rules` names each count of services and says which are active; by default those with a load above 0.1.
    """
    if rules is None:
        rules = {"active_services": F.col("workload_ops") > 0.1}
    return filled.groupBy(*keys).agg(
        F.sum("workload_ops").alias("total_qps"),
        F.avg("success_rate").alias("avg_success_rate"),
        *[F.count_if(active).cast("bigint").alias(name) for name, active in rules.items()],
    )


def any_feature_active(features: Sequence[str] = NODE_FEATURES) -> Column:
    """Alternative activity rule: the absolute features add up to more than 0.01."""
    total = F.lit(0.0)
    for f in features:
        total = total + F.abs(F.col(f))
    return total > 0.01


# --- calls -----------------------------------------------------------------------------------


def resolve_calls(spans: DataFrame, names: DataFrame, entry: str = ENTRY_SERVICE) -> DataFrame:
    """Caller and callee of each span.

    The callee is the first known service named in the operation other than the caller. An unresolved
    root span of a service other than the entry service is a call to the entry service; anything else
    unresolved is dropped.
    """
    read = spans.withColumn("src", service_of(F.col("pod"))).withColumn("op", F.lower("operation"))
    named = first_containing(read.where(F.col("op").isNotNull()), "op", names, "named", exclude="src", repeated=True)
    fallback = F.when((F.col("parent") == "root") & (F.col("src") != entry), F.lit(entry))
    return named.withColumn("dst", F.coalesce(F.col("named"), fallback)).where(F.col("dst").isNotNull())


def timed_calls(spans: DataFrame, steps: DataFrame) -> DataFrame:
    """Spans with their start in seconds, assigned to the last step at or before it."""
    return asof_step(spans.withColumn("ts", ns_to_seconds(F.col("start_ns"))), steps)


def call_features(calls: DataFrame) -> DataFrame:
    """Calls to edge x step features."""
    timed = calls.withColumn("ms", ns_to_ms(F.col("duration_ns"))).withColumn("bad", failed_call(F.col("op")))
    return timed.groupBy("system", F.col("step_ts").alias("ts"), "src", "dst").agg(
        F.count("*").cast("double").alias("call_count"),
        (F.count_if("bad") / F.count("*")).alias("error_rate"),
        F.avg("ms").alias("avg_latency_ms"),
        F.max("ms").alias("max_latency_ms"),
    )


def edge_features(
    spans: DataFrame,
    steps: DataFrame,
    names: DataFrame,
    edges: DataFrame,
    entry: str = ENTRY_SERVICE,
    small: bool | None = None,
    edges_small: bool | None = None,
) -> DataFrame:
    """Spans to features of the edges that the dependency graph knows; names and edges are counted each by themselves."""
    resolved = resolve_calls(spans, names, entry)
    known = attach(resolved, edges.select("system", "src", "dst").distinct(), ["system", "src", "dst"], "left_semi", edges_small)
    return call_features(timed_calls(known, steps))


# --- KPIs ------------------------------------------------------------------------------------


def categorised(kpis: DataFrame) -> DataFrame:
    return kpis.withColumn("category", kpi_category(F.col("kpi_name"))).where(F.col("category").isNotNull())


def kpi_wide(kpis: DataFrame, own_count: bool = False, categories: Sequence[str] = tuple(KPI_SLOTS)) -> DataFrame:
    """Long KPI rows to one column per category.

    A cell is the category's sum over the number of samples of all categories in that entity and step;
    `own_count` divides by the category's own samples instead.
    """
    rows = categorised(kpis)
    if own_count:
        cells = [F.avg(F.when(F.col("category") == c, F.col("value"))) for c in categories]
    else:
        cells = [F.sum(F.when(F.col("category") == c, F.col("value"))) / F.count("*") for c in categories]
    return rows.groupBy("system", "ts", "entity").agg(
        *[F.coalesce(x, F.lit(0.0)).alias(c) for x, c in zip(cells, categories)]
    )


def slot_features(wide: DataFrame) -> DataFrame:
    """Category columns to feature slots; categories of one slot are added."""
    sums = []
    for slot, feature in enumerate(NODE_FEATURES):
        total = F.lit(0.0)
        for category, home in KPI_SLOTS.items():
            if home == slot and category in wide.columns:
                total = total + F.col(category)
        sums.append(total.alias(feature))
    return wide.select("system", "ts", "entity", *sums)


def name_order_slots(kpis: DataFrame, drop_rest: bool = False) -> DataFrame:
    """The other slot rule: the categories that occur, in name order; the first eight fill the slots.

    Categories beyond have slot NULL, so that it shows what the features leave out; `drop_rest` leaves them away.
    """
    found = positions(categorised(kpis).select("system", "category").distinct(), ["category"], "slot")
    if drop_rest:
        return found.where(F.col("slot") < len(NODE_FEATURES))
    return found.withColumn("slot", F.when(F.col("slot") < len(NODE_FEATURES), F.col("slot")))


# --- logs ------------------------------------------------------------------------------------


def read_logs(logs: DataFrame, names: DataFrame) -> DataFrame:
    """Log lines with second, service and severity; lines of unknown services are dropped."""
    read = logs.select(
        "system",
        ns_to_seconds(F.col("time_ns")).alias("ts"),
        F.lower("pod").alias("pod"),
        log_severity(F.col("log")).alias("severity"),
    )
    found = first_containing(read, "pod", names, "entity")
    return found.where(F.col("entity").isNotNull())


def log_windows(lines: DataFrame, seconds: int = 60, small: bool | None = None) -> DataFrame:
    """Log counts per tumbling window anchored at each system's first line (occupied cells only).

    `small` says that the number of systems was counted as small (a counted service list implies it).
    """
    # Count per second first: everything after works on sums, never on lines.
    kind = severity_class(F.col("severity"))
    per_second = lines.groupBy("system", "entity", "ts").agg(
        F.count("*").alias("total"),
        F.count_if(kind == "error").alias("errors"),
        F.count_if(kind == "warn").alias("warns"),
        F.sum(severity_weight(F.col("severity"))).alias("severity_sum"),
    )
    start = per_second.groupBy("system").agg(F.min("ts").alias("_t0"))
    slot = F.floor((F.col("ts") - F.col("_t0")) / seconds).cast("bigint")
    placed = attach(per_second, start, ["system"], small=small).withColumn("w", slot)
    return placed.groupBy("system", "w", "entity").agg(
        *[F.sum(c).alias(c) for c in ("total", "errors", "warns", "severity_sum")]
    )


def log_grid(lines: DataFrame, members: DataFrame, seconds: int = 60, small: bool | None = None) -> DataFrame:
    """Log windows on the full window x service grid, zeros where nothing was logged."""
    if small is None:
        small = fits(members)
    cells = log_windows(lines, seconds, small)
    reach = cells.groupBy("system").agg(F.max("w").alias("_w"))
    # Lay out blocks of slots first and spread them, so a long axis is not unrolled by one task.
    width = F.lit(4096).cast("bigint")
    zero = F.lit(0).cast("bigint")
    blocks = reach.select("system", "_w", F.explode(F.sequence(zero, F.floor(F.col("_w") / width))).alias("_b"))
    slots = spread(blocks, "system", "_b").select(
        "system",
        F.explode(F.sequence(F.col("_b") * width, F.least((F.col("_b") + 1) * width - 1, F.col("_w")))).alias("ts"),
    )
    grid = dense_grid(slots, members, cells.withColumnRenamed("w", "ts"), ["entity"], small)
    counts = ("total", "errors", "warns", "severity_sum")
    return grid.select(
        "system", F.col("ts").alias("w"), "entity", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counts]
    )


def log_step_counts(lines: DataFrame, steps: DataFrame) -> DataFrame:
    """Log lines per entity and as-of step; lines after the last step count for it."""
    per_second = lines.groupBy("system", "entity", "ts").agg(F.count("*").alias("n"))
    placed = asof_step(per_second, steps, after_last="keep")
    return placed.groupBy("system", F.col("step_ts").alias("ts"), "entity").agg(F.sum("n").alias("n_logs"))


# --- mixes -----------------------------------------------------------------------------------


def category_counts(rows: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    return rows.groupBy(*keys, F.col(category).alias("category")).agg(F.count("*").alias("n"))
