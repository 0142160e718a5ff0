"""Projections, filters and scalar functions (P), and the single-table reports of sort and limit (T)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.fixed_values import NODE_FEATURES
from faultline.functions import categories, names, values
from faultline.operators import evaluate, featurize, graph, grid, rank
from faultline.plans.oracle_views import (
    F8,
    SEVERITY,
    SEV_CLASS,
    SEV_WEIGHT,
    each,
    role_sql,
    service_sql,
)
from faultline.plans.registry import query
from faultline.plans.views import Tables

ALL8 = " ".join(F8)

# Pods in the shapes that the name rules tell apart.
VARIED_SQL = """SELECT system, event_id, CASE k % 5 WHEN 0 THEN 'Frontend-' || user_id || '-' || event_id
    WHEN 1 THEN 'ts-order-service-' || user_id || '-' || event_id WHEN 2 THEN 'svc3-' || event_id
    WHEN 3 THEN 'Standalone' ELSE pod END AS pod FROM ev"""


def varied_pods(t: Tables) -> DataFrame:
    k = F.col("k") % 5
    return t.events.select(
        "system",
        "event_id",
        F.when(k == 0, F.concat_ws("-", F.lit("Frontend"), "user_id", "event_id"))
        .when(k == 1, F.concat_ws("-", F.lit("ts-order-service"), "user_id", "event_id"))
        .when(k == 2, F.concat_ws("-", F.lit("svc3"), "event_id"))
        .when(k == 3, "Standalone")
        .otherwise(F.col("pod"))
        .alias("pod"),
    )


@query("p1_service_of_pod", f"SELECT event_id, pod, {service_sql('pod')} AS service FROM ({VARIED_SQL})")
def p1(t):
    return varied_pods(t).select("event_id", "pod", names.service_of(F.col("pod")).alias("service"))


@query("p2_strip_replica", f"SELECT event_id, regexp_replace(pod, '-[^-]*$', '') AS name FROM ({VARIED_SQL})")
def p2(t):
    return varied_pods(t).select("event_id", names.strip_replica(F.col("pod")).alias("name"))


@query("p4_clean_endpoints", "SELECT src, dst, pos FROM edges", whole="pos")
def p4(t):
    return graph.clean_dependencies(t.deps).select("src", "dst", "pos")


@query(
    "p5_parse_or_skip",
    "SELECT pod, ts, try_cast(CASE WHEN event_id % 97 = 0 THEN 'bad' ELSE CAST(cpu AS VARCHAR) END AS DOUBLE) AS cpu FROM pods"
    " WHERE event_id % 97 <> 0",
    rounded="cpu",
)
def p5(t):
    return t.text_pods.select("pod", "ts", values.number(F.col("cpu")).alias("cpu")).where(F.col("cpu").isNotNull())


@query(
    "p6_log_scale",
    "SELECT pod, ln(1 + greatest(net_rx - 20000, 0)) AS rx, ln(1 + greatest(net_tx, 0)) AS tx FROM pods",
    rounded="rx tx",
)
def p6(t):
    return t.pods.select(
        "pod", values.log_scale(F.col("net_rx") - 20000).alias("rx"), values.log_scale(F.col("net_tx")).alias("tx")
    )


@query(
    "p7_units",
    """SELECT s.pod, start_ns // 1000000000 AS start_s, duration_ns / 1000000 AS duration_ms, p90_s * 1000 AS p90_ms,
       CAST(trunc((start_ns // 1000000) / 1000) AS BIGINT) AS from_ms FROM spans s JOIN pods p USING (pod)""",
    rounded="duration_ms p90_ms",
    whole="start_s",
)
def p7(t):
    both = t.events.select(
        "pod",
        (F.col("us") * 1000).alias("start_ns"),
        F.round(F.col("value") * 1_000_000).cast("bigint").alias("duration_ns"),
        (F.col("value") / 1000).alias("p90_s"),
    )
    return both.select(
        "pod",
        values.ns_to_seconds(F.col("start_ns")).alias("start_s"),
        values.ns_to_ms(F.col("duration_ns")).alias("duration_ms"),
        values.seconds_to_ms(F.col("p90_s")).alias("p90_ms"),
        values.ms_to_seconds(F.floor(F.col("start_ns") / 1_000_000)).alias("from_ms"),
    )


@query("p8_failed_call", "SELECT pod, operation, regexp_matches(lower(operation), 'error|fail|exception') AS failed FROM spans")
def p8(t):
    return t.spans.select("pod", "operation", categories.failed_call(F.col("operation")).alias("failed"))


@query("p9_kpi_category", "SELECT ts, entity, kpi_name, category, value FROM cat", rounded="value")
def p9(t):
    return featurize.categorised(t.kpis).select("ts", "entity", "kpi_name", "category", "value")


@query("p10_log_severity", f"SELECT pod, {SEVERITY} AS severity FROM logs")
def p10(t):
    return t.logs.select("pod", categories.log_severity(F.col("log")).alias("severity"))


@query(
    "p11_severity_weight",
    f"SELECT pod, severity, {SEV_CLASS} AS class, {SEV_WEIGHT} AS weight FROM (SELECT pod, {SEVERITY} AS severity FROM logs)",
    whole="weight",
)
def p11(t):
    read = t.logs.select("pod", categories.log_severity(F.col("log")).alias("severity"))
    severity = F.col("severity")
    return read.select(
        "pod",
        "severity",
        categories.severity_class(severity).alias("class"),
        categories.severity_weight(severity).alias("weight"),
    )


@query(
    "p12_feature_alternatives",
    """SELECT pod, ts, 0.0::DOUBLE AS cpu_rate, 0.0::DOUBLE AS memory_rate, 0.0::DOUBLE AS net_rx_bytes, 0.0::DOUBLE AS net_tx_bytes,
       cpu AS latency_p90_ms, cpu * 1.5::DOUBLE AS latency_p99_ms, ops AS workload_ops, 100.0::DOUBLE AS success_rate FROM pods""",
    rounded=ALL8,
)
def p12(t):
    """Names of the second kind of metric file; it has no success column, so the default applies."""
    file = t.pods.select("pod", "ts", F.col("ops").alias("num"), F.col("cpu").alias("avg_time"))
    return values.service_features(file, ["pod", "ts"])


@query("p13_kpi_slots", f"SELECT ts, entity, {each('$f')} FROM slots", rounded=ALL8)
def p13(t):
    return featurize.slot_features(featurize.kpi_wide(t.kpis)).drop("system")


@query(
    "p13_name_order_slots",
    "SELECT category, CASE WHEN slot < 8 THEN slot END AS slot FROM (SELECT category, dense_rank() OVER (ORDER BY category) - 1 AS slot FROM (SELECT DISTINCT category FROM cat))",
    whole="slot",
)
def p13_by_name(t):
    return featurize.name_order_slots(t.kpis).select("category", "slot")


@query(
    "p14_squash_names",
    "SELECT event_id, lower(replace(replace(replace(pod, '_', ''), '-', ''), ' ', '')) AS name"
    " FROM (SELECT event_id, event_type || '_' || pod || ' ' || upper(svc) AS pod FROM ev)",
)
def p14(t):
    text = F.concat(F.col("event_type"), F.lit("_"), F.col("pod"), F.lit(" "), F.upper("svc"))
    return t.events.select("event_id", names.squash(text).alias("name"))


ROLE_NAMES = (
    "frontend", "paymentservice", "cartservice", "mysql-01", "emailservice",
    "ts-gateway", "checkoutservice", "redis", "shippingservice", "ts-route",
)


@query(
    "p15_fault_from_role",
    f"""SELECT start, stop, role, {role_sql('role', 'total')} AS inferred_type
        FROM (SELECT start, stop, arg_min(([{', '.join(repr(n) for n in ROLE_NAMES)}])[CAST(substr(entity, 4) AS BIGINT) + 1], rank) AS role,
                     sum(mean_residual) AS total FROM peakranks GROUP BY start, stop)""",
    whole="start stop",
)
def p15(t):
    """Role of the top-ranked service of each incident window; svcN plays the N-th role."""
    role = F.get(F.array(*[F.lit(n) for n in ROLE_NAMES]), F.substring("entity", 4, 10).cast("int"))
    top = t.peak_ranks.groupBy("start", "stop").agg(
        F.min_by(role, "rank").alias("role"), F.sum("mean_residual").alias("total")
    )
    kind = categories.fault_from_role(F.col("role"), F.col("total"))
    return top.select("start", "stop", "role", kind.alias("inferred_type"))


@query(
    "p16_fault_from_dimension",
    f"""SELECT entity, t_idx, dimension, CASE dimension % 8 WHEN 0 THEN 'high_cpu' WHEN 1 THEN 'high_memory' WHEN 2 THEN 'network_delay'
              WHEN 3 THEN 'network_delay' WHEN 4 THEN 'disk_io' ELSE 'unknown' END AS inferred_type
        FROM (SELECT entity, t_idx, list_position(z, list_max(z)) - 1 AS dimension
              FROM (SELECT entity, t_idx, [{each('abs(round($f, 5))')}] AS z FROM norm))""",
    whole="t_idx dimension",
)
def p16(t):
    """Features that are multiples of each other tie, so deviations are compared at five decimals."""
    z = t.normalized.select("entity", "t_idx", *[F.round(f, 5).alias(f) for f in NODE_FEATURES])
    found = z.withColumn("dimension", categories.most_deviant(list(NODE_FEATURES)))
    return found.select(
        "entity", "t_idx", "dimension", categories.fault_from_dimension(F.col("dimension")).alias("inferred_type")
    )


@query(
    "p17_reason_match",
    """SELECT fault_id, reason, inferred, contains(reason, replace(inferred, '_', ' ')) AS hit
       FROM (SELECT *, CASE k % 8 WHEN 0 THEN 'high_cpu' WHEN 1 THEN 'high_memory' WHEN 2 THEN 'network_delay' WHEN 3 THEN 'network_delay'
                       WHEN 4 THEN 'disk_io' ELSE 'unknown' END AS inferred FROM faults)""",
)
def p17(t):
    guess = t.faults.withColumn("inferred", categories.fault_from_dimension(F.col("k")))
    return guess.select("fault_id", "reason", "inferred", names.reason_hit(F.col("inferred"), F.col("reason")).alias("hit"))


@query("p18_fault_key", "SELECT fault_id, type || '@' || entity AS fault, type AS back FROM faults")
def p18(t):
    keyed = t.faults.withColumn("fault", names.fault_key(F.col("type"), F.col("entity")))
    return keyed.select("fault_id", "fault", names.key_type(F.col("fault")).alias("back"))


@query(
    "p19_missing_to_zero",
    "SELECT pod, CASE WHEN event_id % 89 = 0 OR event_id % 97 = 0 THEN 0.0 ELSE cpu END AS cpu FROM pods",
    rounded="cpu",
)
def p19(t):
    """NaN and unreadable numbers both end as zero."""
    number = F.element_at(F.split("pod", "-"), -1).cast("bigint")
    mixed = F.when(number % 89 == 0, F.lit(float("nan"))).otherwise(F.col("cpu").try_cast("double"))
    return t.text_pods.select("pod", values.or_zero(mixed).alias("cpu"))


@query(
    "p20_fixed_feature_space",
    f"SELECT ts, entity, {', '.join(f'{c} AS {f}' for c, f in zip(('cpu', 'disk_io', 'mem', 'net_rx', 'net_tx', 'sessions'), F8))},"
    f" 0.0::DOUBLE AS {F8[6]}, 0.0::DOUBLE AS {F8[7]} FROM wide",
    rounded=ALL8,
)
def p20(t):
    have = sorted({"cpu", "mem", "net_rx", "net_tx", "disk_io", "sessions"})
    return values.fit_features(featurize.kpi_wide(t.kpis), ["ts", "entity"], have)


@query(
    "p20_padded_entities",
    "SELECT entity, entity_idx FROM ents UNION ALL SELECT 'pad' || i, i FROM (SELECT unnest(range((SELECT count(*) FROM ents), 14)) AS i)",
    whole="entity_idx",
)
def p20_pad(t):
    return grid.with_padding(t.entities, 14).select("entity", "entity_idx")


# --- sort, limit, top-k ----------------------------------------------------------------------


@query(
    "t1_top_entities",
    """SELECT f.fault_id, x.top FROM peakf f JOIN (SELECT start, stop, string_agg(entity, ',' ORDER BY rank) AS top
       FROM peakranks WHERE rank <= 3 GROUP BY start, stop) x USING (start, stop)""",
)
def t1(t):
    return rank.for_faults(t.peak_faults, rank.top_names(t.peak_ranks, 3)).select("fault_id", "top")


@query("t2_first_faults", "SELECT fault_id, ts, entity, type FROM faults ORDER BY ts, fault_id LIMIT 20", whole="ts")
def t2(t):
    return evaluate.first_faults(t.faults, 20).select("fault_id", "ts", "entity", "type")


@query(
    "t2_first_faults_per_episode",
    "SELECT fault_id, ts, episode FROM (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY ts, fault_id) AS r"
    " FROM (SELECT *, ts // 86400 AS episode FROM faults)) WHERE r <= 10",
    whole="ts episode",
)
def t2_per(t):
    daily = t.faults.withColumn("episode", F.floor(F.col("ts") / 86_400))
    return evaluate.first_faults(daily, 10, ["system", "episode"]).select("fault_id", "ts", "episode")


@query("t3_sorted_entities", "SELECT system, entity, entity_idx FROM ents ORDER BY entity", whole="entity_idx")
def t3(t):
    return grid.entities(t.pods).orderBy("system", "entity")


@query("t4_first_windows", "SELECT window_start, window_rank FROM basew", whole="window_start window_rank")
def t4(t):
    return t.first_val_windows.select("window_start", "window_rank")


@query(
    "t5_first_steps",
    "SELECT ts, entity, kpi_name, value FROM kpis WHERE ts IN (SELECT DISTINCT ts FROM kpis ORDER BY ts LIMIT 500)",
    rounded="value",
    whole="ts",
)
def t5(t):
    return grid.first_steps(t.kpis, 500).select("ts", "entity", "kpi_name", "value")
