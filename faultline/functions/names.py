"""Names: pods to services, graph endpoints, fault keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from faultline.fixed_values import KNOWN_SERVICES


def service_of(pod: Column, known: tuple[str, ...] = KNOWN_SERVICES) -> Column:
    """Service of a pod: a known prefix, else the name without its last two dash parts."""
    low = F.lower(pod)
    generic = F.regexp_replace(low, "(-[^-]*){1,2}$", "")
    rules = [(low.startswith(name), F.lit(name)) for name in known]
    chain = reduce(lambda acc, rule: acc.when(*rule), rules[1:], F.when(*rules[0]))
    return chain.otherwise(generic)


def strip_replica(name: Column) -> Column:
    """Drop the last dash part, if there is one."""
    return F.regexp_replace(name, "-[^-]*$", "")


def pod_base(path: Column) -> Column:
    """Pod of a metric file path; two dash parts go only when there are at least two dashes."""
    base = F.regexp_extract(path, "([^/=]+)_metric[.]csv", 1)
    return F.when(
        F.length(base) - F.length(F.replace(base, F.lit("-"))) >= 2,
        F.regexp_replace(base, "(-[^-]*){2}$", ""),
    ).otherwise(base)


def clean_endpoint(name: Column) -> Column:
    return F.lower(F.trim(name))


def is_address(name: Column) -> Column:
    """An IP-like target: starts with a digit or has two or more dots."""
    dots = F.length(name) - F.length(F.replace(name, F.lit(".")))
    return name.rlike("^[0-9]") | (dots >= 2)


def squash(name: Column) -> Column:
    """Lower case without underscores, dashes and spaces."""
    return F.translate(F.lower(name), "_- ", "")


def fault_key(kind: Column, service: Column) -> Column:
    return F.concat_ws("@", kind, service)


def key_type(key: Column) -> Column:
    return F.split(key, "@")[0]


def reason_hit(inferred: Column, reason: Column) -> Column:
    """The inferred type, underscores as spaces, occurs in the labelled reason."""
    plain = lambda c: F.lower(F.replace(c, F.lit("_"), F.lit(" ")))
    return F.contains(plain(reason), plain(inferred))
