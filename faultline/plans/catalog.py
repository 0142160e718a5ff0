"""All registered queries and the flagship run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.operators import rank
from faultline.plans import feature_queries, field_queries, join_queries, source_queries  # noqa: F401
from faultline.plans.registry import shaped
from faultline.plans.views import Tables


def ranked_intervals(t: Tables) -> DataFrame:
    """Raw pod metrics to anomaly intervals and the services ranked inside each."""
    return rank.rank_in_windows(t.residuals, t.intervals)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(ranked_intervals(Tables(spark, sf_dir)))
