"""Joins (J), set operations (U) and graph operators (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.fixed_values import HOP_DECAY, HOP_DELAY, NODE_FEATURES
from faultline.operators import detect, featurize, graph, grid, joins, rank, spans
from faultline.plans.field_queries import VARIED_SQL, varied_pods
from faultline.plans.oracle_views import F8, each, service_sql
from faultline.plans.registry import query
from faultline.plans.views import ENTRY, named
from faultline.functions.names import service_of
from faultline.functions.values import ns_to_seconds

ALL8 = " ".join(F8)


@query(
    "j1_dense_grid",
    f"SELECT ts, t_idx, entity, observed, {each('$f')} FROM grid",
    rounded=ALL8,
    whole="ts t_idx",
)
def j1(t):
    return t.grid.select("ts", "t_idx", "entity", "observed", *NODE_FEATURES)


@query(
    "j2_known_services",
    f"SELECT event_id, entity FROM (SELECT event_id, {service_sql('pod')} AS entity FROM ({VARIED_SQL})) SEMI JOIN ents USING (entity)",
)
def j2(t):
    rows = varied_pods(t).withColumn("entity", service_of(F.col("pod")))
    return joins.keep_known(rows, t.entities, ["system", "entity"], t.small).select("event_id", "entity")


@query(
    "j3_encode_edges",
    """SELECT g.pos, g.src, g.dst, a.entity_idx AS src_idx, b.entity_idx AS dst_idx FROM edges g
       JOIN ents a ON a.entity = g.src JOIN ents b ON b.entity = g.dst""",
    whole="pos src_idx dst_idx",
)
def j3(t):
    return joins.encode_edges(t.edges, t.entities, t.small).select("pos", "src", "dst", "src_idx", "dst_idx")


@query(
    "j4_asof_spans",
    """SELECT c.pod, c.sec AS ts, s.ts AS step_ts FROM (SELECT *, start_ns // 1000000000 AS sec FROM spans) c
       ASOF JOIN bare_steps s ON c.sec >= s.ts WHERE c.sec <= (SELECT max(ts) FROM bare_steps)""",
    whole="ts step_ts",
)
def j4(t):
    return featurize.timed_calls(t.spans, t.bare_steps).select("pod", "ts", "step_ts")


@query(
    "j4_asof_logs",
    """SELECT c.pod, c.sec AS ts, s.ts AS step_ts FROM (SELECT *, time_ns // 1000000000 AS sec FROM logs) c
       ASOF JOIN bare_steps s ON c.sec >= s.ts""",
    whole="ts step_ts",
)
def j4_logs(t):
    lines = t.logs.select("system", "pod", ns_to_seconds(F.col("time_ns")).alias("ts"))
    return joins.asof_step(lines, t.bare_steps, after_last="keep").select("pod", "ts", "step_ts")


@query("j5_named_callee", "SELECT pod, op, named FROM named")
def j5(t):
    read = t.spans.select("system", "pod", service_of(F.col("pod")).alias("src"), F.lower("operation").alias("op"))
    return joins.first_containing(read, "op", t.names, "named", exclude="src").select("pod", "op", "named")


@query("j6_callee_fallback", "SELECT pod, parent, src, dst FROM calls")
def j6(t):
    return featurize.resolve_calls(t.spans, t.names, ENTRY).select("pod", "parent", "src", "dst")


@query("j7_known_calls", "SELECT pod, src, dst FROM known_calls")
def j7(t):
    calls = featurize.resolve_calls(t.spans, t.names, ENTRY)
    return joins.keep_known(calls, t.edges, ["system", "src", "dst"], t.edges_small).select("pod", "src", "dst")


@query("j8_log_service", "SELECT pod, ts, severity, entity FROM lines_l WHERE entity IS NOT NULL", whole="ts")
def j8(t):
    return featurize.read_logs(t.logs, t.names).select("pod", "ts", "severity", "entity")


@query(
    "j9_either_direction",
    """SELECT event_id, word, (SELECT min(entity) FROM ents e WHERE contains(word, e.entity) OR contains(e.entity, word)) AS matched
       FROM (SELECT event_id, CASE k % 3 WHEN 0 THEN pod WHEN 1 THEN 'vc' || (k % 10) ELSE 'node-' || k END AS word FROM ev)""",
)
def j9(t):
    k = F.col("k")
    word = (
        F.when(k % 3 == 0, F.col("pod"))
        .when(k % 3 == 1, F.concat(F.lit("vc"), (k % 10).cast("string")))
        .otherwise(F.concat(F.lit("node-"), k.cast("string")))
    )
    rows = t.events.select("system", "event_id", word.alias("word"))
    return joins.first_containing(rows, "word", t.names, "matched", either=True).select(
        "event_id", "word", "matched"
    )


@query(
    "j10_component_tiers",
    """SELECT event_id, component, coalesce(s1, s2, s3) AS service, CASE WHEN s1 IS NOT NULL THEN 1 WHEN s2 IS NOT NULL THEN 2 WHEN s3 IS NOT NULL THEN 3 END AS tier
       FROM (SELECT *, (SELECT min(entity) FROM ents e WHERE e.entity = part) AS s1,
                    (SELECT min(entity) FROM ents e WHERE contains(part, e.entity) OR contains(e.entity, part)) AS s2,
                    (SELECT entity FROM ents e WHERE entity_idx = slot) AS s3
             FROM (SELECT *, CASE WHEN contains(part, 'mysql') THEN 0 WHEN contains(part, 'redis') THEN 1 WHEN contains(part, 'tomcat') THEN 2
                             WHEN contains(part, 'apache') THEN 3 WHEN contains(part, 'mg') THEN 4 WHEN contains(part, 'docker') THEN 5
                             WHEN contains(part, 'java') THEN 6 WHEN contains(part, 'node') THEN 7 END % (SELECT count(*) FROM ents) AS slot
                   FROM (SELECT event_id, component, replace(replace(lower(component), '_', ''), '-', '') AS part
                         FROM (SELECT event_id, CASE k % 5 WHEN 0 THEN 'SVC_' || (k % 10) WHEN 1 THEN svc || '-1' WHEN 2 THEN 'Mysql0' || (k % 7)
                                      WHEN 3 THEN 'docker_' || (k % 7) ELSE 'unknown' END AS component FROM ev))))""",
    whole="tier",
)
def j10(t):
    k = F.col("k")
    component = (
        F.when(k % 5 == 0, F.concat(F.lit("SVC_"), (k % 10).cast("string")))
        .when(k % 5 == 1, F.concat(F.col("svc"), F.lit("-1")))
        .when(k % 5 == 2, F.concat(F.lit("Mysql0"), (k % 7).cast("string")))
        .when(k % 5 == 3, F.concat(F.lit("docker_"), (k % 7).cast("string")))
        .otherwise("unknown")
    )
    parts = t.events.select("system", "event_id", component.alias("component"))
    return joins.match_components(parts, t.names, t.small).drop("system")


@query(
    "j11_present_edges",
    """SELECT 'events' AS system, src, dst, false AS stand_in FROM edges WHERE src IN (SELECT entity FROM ents) AND dst IN (SELECT entity FROM ents)
       UNION ALL SELECT 'bare', entity, lead(entity) OVER (ORDER BY entity), true FROM ents
       QUALIFY lead(entity) OVER (ORDER BY entity) IS NOT NULL""",
)
def j11(t):
    """A second system with the same services and no edges gets the chain."""
    bare = t.entities.withColumn("system", named("bare", "entity"))
    return graph.present_edges(t.edges, t.entities.unionByName(bare), t.small)


@query(
    "j12_normal_mask",
    """SELECT ts, t_idx, is_normal, NOT EXISTS (SELECT 1 FROM faults f WHERE m.ts >= f.ts AND m.ts < f.ts + 7200) AS is_normal_long FROM marked m""",
    whole="ts t_idx",
)
def j12(t):
    short = joins.mark_normal(t.bare_steps, t.faults)
    return joins.mark_normal(short, t.faults, 7200, "is_normal_long").select("ts", "t_idx", "is_normal", "is_normal_long")


@query("j13_apply_stats", f"SELECT t_idx, entity, {each('$f')} FROM norm", rounded=ALL8, whole="t_idx")
def j13(t):
    return t.normalized.select("t_idx", "entity", *NODE_FEATURES)


@query(
    "j14_reported_rows",
    """SELECT f.fault_id, f.start, f.stop, r.entity, avg(r.residual) AS mean_residual, count(*) AS n_steps_in FROM repf f
       JOIN res r ON r.system = f.system AND r.t_idx >= f.start AND r.t_idx < f.stop GROUP BY f.fault_id, f.start, f.stop, r.entity""",
    rounded="mean_residual",
    whole="start stop n_steps_in",
)
def j14(t):
    windows = t.reported_faults.select("system", "start", "stop").distinct()
    means = spans.over_windows(t.residuals, windows, small=t.small).withColumnRenamed("n_rows", "n_steps_in")
    return rank.for_faults(t.reported_faults, means).select(
        "fault_id", "start", "stop", "entity", "mean_residual", "n_steps_in"
    )


@query("j15_detected_window", "SELECT fault_id, entity, start, stop, chosen_by FROM detf", whole="start stop")
def j15(t):
    return t.detected_faults.select("fault_id", "entity", "start", "stop", "chosen_by")


@query(
    "j16_peak_windows",
    """SELECT f.fault_id, p.peak_idx, w.a AS before, greatest(p.peak_idx - w.a, 0) AS start, least(p.peak_idx + w.b, p.n_steps) AS stop
       FROM faults f JOIN peaks_e p USING (system, entity) JOIN (VALUES (10, 10), (5, 10), (3, 5)) w(a, b) ON true WHERE p.n_scored >= 5""",
    whole="peak_idx before start stop",
)
def j16(t):
    out = None
    for before, after in ((10, 10), (5, 10), (3, 5)):
        placed = detect.peak_windows(t.faults, t.entity_peaks, before, after, t.small)
        part = placed.select("fault_id", "peak_idx", F.lit(before).alias("before"), "start", "stop")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "j17_gather_ends",
    """SELECT a.ts, g.src, g.dst, a.workload_ops AS src_workload_ops, a.success_rate AS src_success_rate,
              b.workload_ops AS dst_workload_ops, b.success_rate AS dst_success_rate
       FROM (SELECT DISTINCT src, dst FROM edges) g JOIN filled a ON a.entity = g.src JOIN filled b ON b.entity = g.dst AND b.ts = a.ts""",
    rounded="src_workload_ops src_success_rate dst_workload_ops dst_success_rate",
    whole="ts",
)
def j17(t):
    return graph.gather_ends(t.edges, t.filled, ["workload_ops", "success_rate"], t.edges_small).drop("system")


@query(
    "j18_known_start",
    """SELECT fault_id, start_idx, CASE WHEN least(n_steps, lo + 24) - lo < 24 THEN greatest(least(n_steps, lo + 24) - 24, 0) ELSE lo END AS start,
              least(n_steps, lo + 24) AS stop
       FROM (SELECT f.fault_id, s.t_idx AS start_idx, s.n_steps, greatest(s.t_idx - 12, 0) AS lo FROM faults f ASOF JOIN bare_steps s ON f.ts >= s.ts
             WHERE f.ts <= (SELECT max(ts) FROM bare_steps))""",
    whole="start_idx start stop",
)
def j18(t):
    return detect.known_start_windows(t.faults, t.steps).select("fault_id", "start_idx", "start", "stop")


# --- set operations --------------------------------------------------------------------------


@query(
    "u1_stack_datasets",
    f"SELECT 'pods' AS dataset, ts, entity, {each('$f')} FROM cells UNION ALL SELECT 'kpis', ts, entity, {each('$f')} FROM slots",
    rounded=ALL8,
    whole="ts",
)
def u1(t):
    kpis = featurize.slot_features(featurize.kpi_wide(t.kpis))
    return grid.stack([t.cells, kpis], "dataset", ["pods", "kpis"]).drop("system")


@query("u2_union_entities", "SELECT system, entity FROM pods UNION SELECT system, entity FROM cat UNION SELECT 'events', src FROM edges")
def u2(t):
    callers = t.edges.select("system", F.col("src").alias("entity"))
    return grid.union_entities([t.pods, featurize.categorised(t.kpis), callers])


@query(
    "u3_pooled_residuals",
    "SELECT window_start, t_idx, entity, residual FROM baseres",
    rounded="residual",
    whole="window_start t_idx",
)
def u3(t):
    return t.base_residuals.select("window_start", "t_idx", "entity", "residual")


# --- graph -----------------------------------------------------------------------------------


@query(
    "g1_edge_list",
    """SELECT g.pos, g.src, g.dst, a.idx AS src_idx, b.idx AS dst_idx FROM edges g JOIN nodes a ON a.entity = g.src JOIN nodes b ON b.entity = g.dst""".replace(
        "nodes",
        "(SELECT entity, row_number() OVER (ORDER BY min(place)) - 1 AS idx FROM (SELECT src AS entity, pos * 2 AS place FROM edges UNION ALL SELECT dst, pos * 2 + 1 FROM edges) GROUP BY entity)",
    ),
    whole="pos src_idx dst_idx",
)
def g1(t):
    nodes = graph.graph_nodes(t.edges)
    return joins.encode_edges(t.edges, nodes, t.edges_small).select("pos", "src", "dst", "src_idx", "dst_idx")


@query(
    "g2_stand_in_graph",
    """SELECT 'ring' AS shape, a.entity AS src, b.entity AS dst, 1.0::DOUBLE AS avg_latency_ms FROM ents a JOIN ents b
          ON b.entity_idx = (a.entity_idx + 1) % (SELECT count(*) FROM ents) WHERE a.entity_idx < 14
       UNION ALL SELECT 'chain', a.entity, b.entity, 1.0::DOUBLE FROM ents a JOIN ents b ON b.entity_idx = a.entity_idx + 1""",
    rounded="avg_latency_ms",
)
def g2(t):
    parts = [f.withColumn("shape", F.lit(n)) for n, f in (("ring", graph.ring(t.entities)), ("chain", graph.chain(t.entities)))]
    return parts[0].unionByName(parts[1]).select("shape", "src", "dst", "avg_latency_ms")


@query(
    "g3_blast_radius",
    f"""SELECT root, node, depth, depth * {HOP_DELAY} AS delay, pow({HOP_DECAY}, depth - 1) AS impact
        FROM (SELECT root, node, min(depth) AS depth FROM reach GROUP BY root, node) WHERE depth > 0""".replace(
        "FROM reach",
        "FROM (WITH RECURSIVE walk AS (SELECT DISTINCT entity AS root, entity AS node, 0 AS depth FROM faults UNION"
        " SELECT w.root, g.dst, w.depth + 1 FROM walk w JOIN edges g ON g.src = w.node WHERE w.depth < (SELECT count(DISTINCT src) + count(DISTINCT dst) FROM edges)) SELECT * FROM walk)",
    ),
    rounded="impact",
    whole="depth delay",
)
def g3(t):
    """Services that a fault on a labelled service is expected to reach."""
    return graph.blast_radius(t.edges, t.faults.select("system", "entity")).drop("system")


@query(
    "g4_neighbour_weights",
    """SELECT ts, src, dst, e / (sum(e) OVER (PARTITION BY ts, dst) + 1e-8) AS weight
       FROM (SELECT ts, src, dst, exp(s - max(s) OVER (PARTITION BY ts, dst)) AS e
             FROM (SELECT ts, src, dst, CASE WHEN call_count - 10 * error_rate >= 0 THEN call_count - 10 * error_rate ELSE 0.2::DOUBLE * (call_count - 10 * error_rate) END AS s FROM edge_cells))""",
    rounded="weight",
    whole="ts",
)
def g4(t):
    """Score: calls, less ten for every error share; negative scores are flattened."""
    score = F.col("call_count") - 10 * F.col("error_rate")
    return graph.neighbour_weights(t.edge_cells, score).select("ts", "src", "dst", "weight")


@query(
    "g5_upstream_pressure",
    """SELECT w.ts, w.dst AS entity, sum(w.weight * f.workload_ops) AS pressure FROM
       (SELECT ts, src, dst, e / (sum(e) OVER (PARTITION BY ts, dst) + 1e-8) AS weight
        FROM (SELECT ts, src, dst, exp(call_count - max(call_count) OVER (PARTITION BY ts, dst)) AS e FROM edge_grid)) w
       JOIN filled f ON f.ts = w.ts AND f.entity = w.src GROUP BY w.ts, w.dst""",
    rounded="pressure",
    whole="ts",
)
def g5(t):
    weighted = graph.neighbour_weights(t.edge_grid, F.col("call_count"))
    return graph.upstream_pressure(weighted, t.filled, "workload_ops").drop("system")
