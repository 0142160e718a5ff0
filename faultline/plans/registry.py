"""Registry of queries: name -> (Spark callable, DuckDB text)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, ShortType

from faultline.plans.oracle_views import statement
from faultline.plans.views import Tables

DIGITS = 6


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}


def shaped(df: DataFrame) -> DataFrame:
    """Doubles rounded, integers as BIGINT, so both engines print the same values."""
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, (DoubleType, FloatType)):
            c = F.round(c, DIGITS)
        elif isinstance(field.dataType, (IntegerType, ShortType)):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, rounded: str = "", whole: str = ""):
    """Register a query; `rounded` and `whole` list the oracle's double and integer columns."""

    def add(fn: Callable[[Tables], DataFrame]):
        oracle = statement(sql, rounded.split(), whole.split()) if sql else None
        QUERIES[name] = Query(fn, oracle)
        return fn

    return add


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: shaped(fn(Tables(spark, sf_dir)))

    return {name: bind(q.run) for name, q in QUERIES.items()}


def oracle_texts() -> dict[str, str]:
    return {name: q.oracle for name, q in QUERIES.items() if q.oracle}
