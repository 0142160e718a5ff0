"""Log windows on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.functions.categories import severity_class, severity_weight


def stream_log_windows(lines: DataFrame, seconds: int = 60, late: str = "5 minutes", anchor: int = 0) -> DataFrame:
    """Counts per service and tumbling window, emitted once the watermark has passed the window.

    `lines` has (system, entity, severity, ts in epoch seconds); windows start at `anchor` modulo their
    width, so a batch anchored at its first line and a stream agree.
    """
    kind = severity_class(F.col("severity"))
    timed = lines.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    window = F.window("at", f"{seconds} seconds", startTime=f"{anchor % seconds} seconds")
    counted = timed.groupBy(window.alias("window"), "system", "entity").agg(
        F.count("*").alias("total"),
        F.count_if(kind == "error").alias("errors"),
        F.count_if(kind == "warn").alias("warns"),
        F.sum(severity_weight(F.col("severity"))).alias("severity_sum"),
    )
    start = F.unix_seconds(F.col("window.start"))
    return counted.select(
        "system", start.alias("window_start"), "entity", "total", "errors", "warns", "severity_sum"
    )
