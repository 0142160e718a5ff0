"""Categories: KPI names, log severity, failed calls, fault types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from faultline.fixed_values import (
    DEFAULT_ROLE_FAULT,
    DEFAULT_SEVERITY,
    DIMENSION_FAULTS,
    ERROR_SEVERITIES,
    FAILED_CALL_WORDS,
    FEATURE_COUNT,
    KPI_PATTERNS,
    KPI_SLOTS,
    ROLE_FAULTS,
    SEVERITY_WEIGHTS,
    UNKNOWN_FAULT,
    WARN_SEVERITY,
)


def _chain(rules: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda acc, rule: acc.when(*rule), rules[1:], F.when(*rules[0]))


def kpi_category(name: Column) -> Column:
    """First matching category, NULL when none matches."""
    return _chain([(name.rlike("(?i)" + pattern), F.lit(cat)) for cat, pattern in KPI_PATTERNS])


def kpi_slot(category: Column) -> Column:
    return _chain([(category == cat, F.lit(slot).cast("bigint")) for cat, slot in KPI_SLOTS.items()])


def failed_call(operation: Column) -> Column:
    return F.lower(operation).rlike("|".join(FAILED_CALL_WORDS))


def log_severity(line: Column) -> Column:
    """Severity inside the JSON text held by field `log`; "info" when anything is missing or broken."""
    inner = F.get_json_object(line, "$.log")
    return F.coalesce(F.lower(F.get_json_object(inner, "$.severity")), F.lit(DEFAULT_SEVERITY))


def severity_class(severity: Column) -> Column:
    return (
        F.when(severity.isin(*ERROR_SEVERITIES), "error").when(severity == WARN_SEVERITY, "warn").otherwise("other")
    )


def severity_weight(severity: Column) -> Column:
    rules = [(severity == s, F.lit(w).cast("bigint")) for s, w in SEVERITY_WEIGHTS.items()]
    return _chain(rules).otherwise(F.lit(1).cast("bigint"))


def fault_from_role(service: Column, residual_sum: Column) -> Column:
    """Fault type from the role of the top-ranked service; unknown when there is no residual at all."""
    low = F.lower(service)
    rules = [(F.coalesce(residual_sum, F.lit(0.0)) == 0.0, F.lit(UNKNOWN_FAULT))]
    rules += [(low.rlike("|".join(words)), F.lit(kind)) for words, kind in ROLE_FAULTS]
    return _chain(rules).otherwise(F.lit(DEFAULT_ROLE_FAULT))


def fault_from_dimension(index: Column) -> Column:
    """Fault type from the most deviant feature's index."""
    slot = index % FEATURE_COUNT
    return _chain([(slot == i, F.lit(kind)) for i, kind in DIMENSION_FAULTS.items()]).otherwise(F.lit(UNKNOWN_FAULT))


def most_deviant(features: list[str]) -> Column:
    """Index of the feature with the largest absolute value, first on ties (row expression)."""
    sizes = F.array(*[F.abs(F.col(f)) for f in features])
    return (F.array_position(sizes, F.array_max(sizes)) - 1).cast("bigint")
