"""DuckDB text of the derived tables, so that each query can be checked from scratch.

Each entry is one common table expression; `statement` adds the ones a query needs.
"""

from __future__ import annotations

import re

from faultline.fixed_values import (
    CONTEXT_FEATURES,
    EDGE_FEATURES,
    FAULT_SECONDS,
    KNOWN_SERVICES,
    KPI_PATTERNS,
    KPI_SLOTS,
    NODE_FEATURES,
    ROLE_FAULTS,
)
from faultline.plans.views import FAULT_TYPES, KPI_NAMES, SEVERE

F8 = NODE_FEATURES
F4 = EDGE_FEATURES


def each(template: str, features=F8, sep: str = ", ") -> str:
    """Repeat a fragment for every feature; `$f` is the feature."""
    return sep.join(template.replace("$f", f) for f in features)


def service_sql(pod: str) -> str:
    known = " ".join(f"WHEN starts_with(lower({pod}), '{n}') THEN '{n}'" for n in KNOWN_SERVICES)
    return f"CASE {known} ELSE regexp_replace(lower({pod}), '(-[^-]*){{1,2}}$', '') END"


def category_sql(name: str) -> str:
    rules = " ".join(f"WHEN regexp_matches({name}, '{p}', 'i') THEN '{c}'" for c, p in KPI_PATTERNS)
    return f"CASE {rules} END"


def role_sql(service: str, total: str) -> str:
    rules = " ".join(f"WHEN regexp_matches(lower({service}), '{'|'.join(w)}') THEN '{k}'" for w, k in ROLE_FAULTS)
    return f"CASE WHEN coalesce({total}, 0) = 0 THEN 'unknown' {rules} ELSE 'cpu_contention' END"


def nll_sql(x: str, mu: str, sigma: str) -> str:
    ls = f"least(greatest(ln(greatest({sigma}, 1e-300)), -5.0), 5.0)"
    s = f"(exp({ls}) + 1e-4)"
    return f"(pow({x} - ({mu}), 2) / (2 * {s} * {s}) + {ls} + 0.5 * ln(2 * pi()))"


def mean_sql(parts: list[str]) -> str:
    return "(" + " + ".join(parts) + f") / {len(parts)}"


def slope_sql(x: str) -> str:
    """Slope of `$f` on a regressor, 0 for a constant regressor."""
    return f"CASE WHEN regr_sxx($f, {x}) > 0 THEN regr_slope($f, {x}) ELSE 0 END"


def rank_sql(src: str, by: str = "coalesce(mean_residual, -99)", out: str = "rank") -> str:
    return (
        f"SELECT *, row_number() OVER (PARTITION BY system, start, stop ORDER BY {by} DESC, entity) AS {out} FROM {src}"
    )


SEVERITY = "coalesce(lower(CASE WHEN log LIKE '{%' THEN json_extract_string(json_extract_string(log, '$.log'), '$.severity') END), 'info')"
SEV_CLASS = "CASE WHEN severity IN ('error','critical','fatal') THEN 'error' WHEN severity = 'warn' THEN 'warn' ELSE 'other' END"
SEV_WEIGHT = "CASE WHEN severity IN ('error','critical','fatal') THEN 3 WHEN severity = 'warn' THEN 2 ELSE 1 END"

_types = ", ".join(f"'{t}'" for t in FAULT_TYPES)
_kpis = " ".join(f"WHEN {i + 1} THEN '{n}'" for i, n in enumerate(KPI_NAMES))

VIEWS: dict[str, str] = {
    # --- raw telemetry
    "ev": """
        SELECT 'events' AS system, event_id, user_id, event_type, value,
               CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k,
               CAST(epoch_us(ts) AS BIGINT) AS us, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS sec,
               'svc' || (user_id % 10) AS svc, 'svc' || (user_id % 10) || '-' || user_id || '-' || event_id AS pod
        FROM events""",
    "pods": f"""
        SELECT system, sec - sec % 3600 AS ts, pod, {service_sql('pod')} AS entity, event_id,
               value AS cpu, CAST(k AS DOUBLE) AS mem, value * 1000 AS net_rx, CAST(k AS DOUBLE) * 1000 AS net_tx,
               value / 1000 AS p90_s, 1.5::DOUBLE * (value / 1000) AS p99_s, CAST(k AS DOUBLE) / 10 AS ops,
               CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END AS success
        FROM ev""",
    "spans": """
        SELECT system, us * 1000 AS start_ns, CAST(round(value * 1000000) AS BIGINT) AS duration_ns, pod, svc,
               CASE WHEN k % 5 = 0 THEN event_type ELSE event_type || '/svc' || (k % 10) END AS operation,
               CASE WHEN k % 7 = 0 THEN 'root' ELSE 'p' END AS parent
        FROM ev""",
    "logs": """
        SELECT system, us * 1000 AS time_ns, pod,
               CASE WHEN event_id % 50 = 0 THEN 'not json'
                    WHEN event_type = 'purchase' THEN '{"log": "{\\"message\\": \\"ok\\"}"}'
                    ELSE '{"log": "{\\"severity\\": \\"' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'INFO'
                         WHEN 'click' THEN 'warn' WHEN 'signup' THEN 'warning' END || '\\"}"}' END AS log
        FROM ev""",
    "kpis": f"""
        SELECT 'kpis' AS system, CAST(epoch_us(l_shipdate) // 1000000 AS BIGINT) AS ts, 'c' || (l_suppkey % 10) AS entity,
               CASE l_linenumber {_kpis} ELSE 'Unmapped' END AS kpi_name, l_quantity AS value,
               l_orderkey, l_linenumber
        FROM lineitem""",
    "deps": f"""
        SELECT 'events' AS system, ' Svc' || a AS source, 'SVC' || b || ' ' AS target, pos
        FROM (SELECT a, b, row_number() OVER (ORDER BY n DESC, a, b) - 1 AS pos
              FROM (SELECT CAST(l_suppkey % 10 AS VARCHAR) AS a, CAST(l_partkey % 10 AS VARCHAR) AS b, count(*) AS n
                    FROM lineitem WHERE l_suppkey % 10 <> l_partkey % 10 GROUP BY 1, 2))
        UNION ALL
        SELECT 'events', 'svc0', '10.0.0.' || n_nationkey, n_nationkey + 100 FROM nation""",
    "faults": f"""
        SELECT system, event_id AS fault_id, sec AS ts, svc AS entity, k, ([{_types}])[k % 5 + 1] AS type,
               replace(([{_types}])[k % 5 + 1], '_', ' ') AS reason, svc || '-1' AS component
        FROM ev WHERE event_type = 'error' AND value >= {SEVERE}""",
    # --- dimensions
    "ents": "SELECT system, entity, row_number() OVER (ORDER BY entity) - 1 AS entity_idx FROM (SELECT DISTINCT system, entity FROM pods)",
    "edges": """
        SELECT system, lower(trim(source)) AS src, lower(trim(target)) AS dst, pos FROM deps
        WHERE NOT (regexp_matches(lower(trim(target)), '^[0-9]') OR length(target) - length(replace(target, '.', '')) >= 2)""",
    "bare_steps": """
        SELECT system, ts, row_number() OVER (ORDER BY ts) - 1 AS t_idx, count(*) OVER () AS n_steps
        FROM (SELECT DISTINCT system, ts FROM pods)""",
    "marked": f"""
        SELECT s.*, NOT EXISTS (SELECT 1 FROM faults f WHERE s.ts >= f.ts AND s.ts < f.ts + {FAULT_SECONDS}) AS is_normal
        FROM bare_steps s""",
    "steps": "SELECT *, is_normal OR NOT bool_or(is_normal) OVER () AS use_step FROM marked",
    # --- features
    "cells": """
        SELECT system, ts, entity, avg(cpu) AS cpu_rate, avg(mem) AS memory_rate, avg(ln(1 + greatest(net_rx, 0))) AS net_rx_bytes,
               avg(ln(1 + greatest(net_tx, 0))) AS net_tx_bytes, avg(p90_s * 1000) AS latency_p90_ms,
               avg(p99_s * 1000) AS latency_p99_ms, avg(ops) AS workload_ops, avg(success) AS success_rate
        FROM pods GROUP BY ALL""",
    "grid": f"""
        SELECT s.*, e.entity, c.ts IS NOT NULL AS observed, {each('c.$f')}
        FROM steps s JOIN ents e USING (system) LEFT JOIN cells c ON c.system = s.system AND c.ts = s.ts AND c.entity = e.entity""",
    "filled": f"""
        SELECT system, ts, t_idx, n_steps, is_normal, use_step, entity, observed,
               {each('coalesce(last_value($f IGNORE NULLS) OVER w, 0) AS $f')}
        FROM grid WINDOW w AS (PARTITION BY system, entity ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "context": """
        SELECT system, ts, t_idx, sum(workload_ops) AS total_qps, avg(success_rate) AS avg_success_rate,
               count(*) FILTER (WHERE workload_ops > 0.1) AS active_services FROM filled GROUP BY ALL""",
    "ctx_norm": f"""
        SELECT c.ts, c.t_idx, c.is_normal, {each('(c.$f - s.mean_$f) / s.std_$f AS $f', CONTEXT_FEATURES)}
        FROM (SELECT x.*, n.is_normal FROM context x JOIN marked n USING (system, ts)) c JOIN
             (SELECT {each('coalesce(avg($f) FILTER (WHERE is_normal), avg($f)) AS mean_$f', CONTEXT_FEATURES)},
                     {each('coalesce(stddev_pop($f) FILTER (WHERE is_normal), stddev_pop($f)) + 1e-6 AS std_$f', CONTEXT_FEATURES)}
              FROM context x JOIN marked n USING (system, ts)) s ON true""",
    "stats": f"""
        SELECT system, entity,
               {each('coalesce(avg($f) FILTER (WHERE is_normal), avg($f)) AS mean_$f')},
               {each('coalesce(stddev_pop($f) FILTER (WHERE is_normal), stddev_pop($f)) + 1e-6 AS std_$f')}
        FROM filled GROUP BY ALL""",
    "norm": f"""
        SELECT f.system, f.ts, f.t_idx, f.n_steps, f.is_normal, f.use_step, f.entity, f.observed,
               {each('(f.$f - s.mean_$f) / s.std_$f AS $f')}
        FROM filled f JOIN stats s USING (system, entity)""",
    "pairs": f"""
        SELECT *, {each('lag($f) OVER w AS prev_$f')} FROM norm WINDOW w AS (PARTITION BY system, entity ORDER BY t_idx)""",
    "lines": f"""
        SELECT system, entity, {each(slope_sql('prev_$f') + ' AS beta_$f')},
               {each('avg($f) - (' + slope_sql('prev_$f') + ') * avg(prev_$f) AS alpha_$f')}
        FROM pairs WHERE use_step AND t_idx > 0 GROUP BY ALL""",
    "sigmas": f"""
        SELECT p.system, p.entity, {each('sqrt(avg(pow(p.$f - l.alpha_$f - l.beta_$f * p.prev_$f, 2))) AS sigma_$f')}
        FROM pairs p JOIN lines l USING (system, entity) WHERE use_step AND t_idx > 0 GROUP BY ALL""",
    "rawres": f"""
        SELECT p.system, p.ts, p.t_idx, p.n_steps, p.is_normal, p.entity,
               {mean_sql([nll_sql(f'p.{f}', f'l.alpha_{f} + l.beta_{f} * p.prev_{f}', f's.sigma_{f}') for f in F8])} AS residual
        FROM pairs p JOIN lines l USING (system, entity) JOIN sigmas s USING (system, entity)""",
    "score_starts": """
        SELECT DISTINCT system, k * 12 AS window_start, n_steps
        FROM (SELECT system, n_steps, unnest(range(0, n_steps // 12 + 1)) AS k FROM (SELECT DISTINCT system, n_steps FROM bare_steps))
        WHERE k * 12 < greatest(1, n_steps - 24) AND least(n_steps, k * 12 + 24) - k * 12 >= 4""",
    "res": """
        SELECT r.* EXCLUDE (residual), CASE WHEN EXISTS (
                 SELECT 1 FROM score_starts w WHERE r.t_idx > w.window_start AND r.t_idx < w.window_start + 24) THEN r.residual END AS residual
        FROM rawres r""",
    "overall": "SELECT system, avg(residual) AS mu, stddev_pop(residual) AS sigma, count(residual) AS n FROM res GROUP BY ALL",
    # --- windows
    "train_starts": """
        SELECT system, k * 6 AS window_start, n_steps
        FROM (SELECT system, n_steps, unnest(range(0, n_steps // 6 + 1)) AS k FROM (SELECT DISTINCT system, n_steps FROM bare_steps))
        WHERE k * 6 < n_steps - 24""",
    "labels_w": """
        SELECT w.system, w.window_start, bool_and(s.is_normal) AS all_normal, min(s.ts) AS first_ts, max(s.ts) AS last_ts, count(*) AS n_rows
        FROM train_starts w JOIN steps s ON s.system = w.system AND s.t_idx >= w.window_start AND s.t_idx < w.window_start + 24
        GROUP BY ALL""",
    "splits": """
        SELECT *, CASE WHEN NOT all_normal THEN 'fault' WHEN (window_start // 24) % 5 = 0 THEN 'val' ELSE 'train' END AS split
        FROM labels_w""",
    "basew": """
        SELECT * FROM (SELECT system, window_start, row_number() OVER (ORDER BY window_start) - 1 AS window_rank
                       FROM splits WHERE split = 'val') WHERE window_rank < 5""",
    "baseres": """
        SELECT r.system, b.window_start, r.t_idx, r.entity, r.residual FROM res r JOIN (SELECT * FROM splits WHERE split = 'val') b
          ON r.t_idx >= b.window_start AND r.t_idx < b.window_start + 24 WHERE r.residual IS NOT NULL""",
    "base": """
        SELECT o.system, coalesce(v.mu, o.mu) AS mu, coalesce(v.sigma, o.sigma) AS sigma, coalesce(v.n, o.n) AS n
        FROM overall o LEFT JOIN (SELECT system, avg(residual) AS mu, stddev_pop(residual) AS sigma, count(*) AS n
                                  FROM baseres GROUP BY ALL) v USING (system)""",
    # --- detection
    "peaks_t": "SELECT system, t_idx, max(residual) AS peak, any_value(n_steps) AS n_steps FROM res GROUP BY system, t_idx",
    "intervals": """
        SELECT system, first_hot, run_length, greatest(first_hot - 20, 0) AS start,
               CASE WHEN first_hot + run_length = n_steps THEN n_steps ELSE least(first_hot + run_length + 5, n_steps) END AS stop
        FROM (SELECT system, min(t_idx) AS first_hot, count(*) AS run_length, any_value(n_steps) AS n_steps
              FROM (SELECT p.*, t_idx - row_number() OVER (ORDER BY t_idx) AS run
                    FROM peaks_t p JOIN base b USING (system) WHERE peak > mu + 3 * sigma)
              GROUP BY system, run)
        WHERE run_length >= 3""",
    "peaks_e": """
        SELECT system, entity, arg_max(t_idx, (residual, -t_idx)) AS peak_idx, max(residual) AS peak, count(*) AS n_scored,
               any_value(n_steps) AS n_steps FROM res WHERE residual IS NOT NULL GROUP BY system, entity""",
    "peakf": """
        SELECT f.*, p.peak_idx, p.n_steps, greatest(p.peak_idx - 5, 0) AS start, least(p.peak_idx + 10, p.n_steps) AS stop
        FROM faults f JOIN peaks_e p USING (system, entity) WHERE n_scored >= 5""",
    "repf": """
        SELECT *, greatest(report_idx - 15, 0) AS start, least(report_idx + 25, n_steps) AS stop
        FROM (SELECT f.*, a.n_steps, CAST(trunc((f.ts - a.t0) / 3600) AS BIGINT) AS report_idx
              FROM faults f JOIN (SELECT system, min(ts) AS t0, max(n_steps) AS n_steps FROM steps GROUP BY ALL) a USING (system))
        WHERE greatest(report_idx - 15, 0) < least(report_idx + 25, n_steps)""",
    "detf": """
        SELECT f.*, a.n_steps, coalesce(o.start, i.start, a.n_steps // 3) AS start,
               coalesce(o.stop, i.stop, least(a.n_steps, a.n_steps // 3 + 30)) AS stop,
               CASE WHEN o.start IS NOT NULL THEN 'own' WHEN i.start IS NOT NULL THEN 'first' ELSE 'middle' END AS chosen_by
        FROM faults f
        JOIN (SELECT system, max(n_steps) AS n_steps FROM steps GROUP BY ALL) a USING (system)
        LEFT JOIN (SELECT r.system, r.entity, min(i.start) AS start, arg_min(i.stop, i.start) AS stop
                   FROM res r JOIN base b USING (system) JOIN intervals i ON i.system = r.system AND r.t_idx >= i.start AND r.t_idx < i.stop
                   WHERE r.residual > mu + sigma GROUP BY r.system, r.entity) o ON o.system = f.system AND o.entity = f.entity
        LEFT JOIN (SELECT system, min(start) AS start, arg_min(stop, start) AS stop FROM intervals GROUP BY system) i ON i.system = f.system""",
    "peakmeans": """
        SELECT w.system, w.start, w.stop, r.entity, avg(r.residual) AS mean_residual
        FROM (SELECT DISTINCT system, start, stop FROM peakf) w
        JOIN res r ON r.system = w.system AND r.t_idx >= w.start AND r.t_idx < w.stop GROUP BY ALL""",
    "peakranks": rank_sql("peakmeans"),
    "peakcross": """
        SELECT w.system, w.start, w.stop, r.entity, min(r.t_idx) FILTER (WHERE r.residual > o.mu + 2 * o.sigma) AS first_idx
        FROM (SELECT DISTINCT system, start, stop FROM peakf) w JOIN overall o USING (system)
        JOIN res r ON r.system = w.system AND r.t_idx >= w.start AND r.t_idx < w.stop AND r.t_idx < w.start + 30
        GROUP BY w.system, w.start, w.stop, r.entity""",
    "downs": """
        SELECT e.system, e.entity, count(DISTINCT g.dst) AS n_downstream FROM ents e
        LEFT JOIN edges g ON g.system = e.system AND g.src = e.entity GROUP BY e.system, e.entity""",
    "mixe": "SELECT system, svc AS entity, event_type AS category, count(*) AS n FROM ev GROUP BY ALL",
    "mixt": "SELECT system, sec - sec % 3600 AS ts, event_type AS category, count(*) AS n FROM ev GROUP BY ALL",
    "drift": """
        SELECT system, entity, entropy, abs(entropy - ln((SELECT count(DISTINCT category) FROM mixe))) AS deviation
        FROM (SELECT system, entity, -sum(p * ln(p + 1e-8)) AS entropy
              FROM (SELECT system, entity, n / sum(n) OVER (PARTITION BY system, entity) AS p FROM mixe) GROUP BY system, entity)""",
    "evidence": """
        SELECT system, start, stop, entity, mean_residual,
               CASE WHEN hi > lo THEN (mean_residual - lo) / (hi - lo + 1e-8) ELSE 0.1 END AS r,
               coalesce(1 - first_idx / (late + 1), 0) AS t, n_downstream / (most + 1) AS p, deviation / (far + 1e-8) AS d
        FROM (SELECT *, min(mean_residual) OVER w AS lo, max(mean_residual) OVER w AS hi, max(first_idx) OVER w AS late,
                     max(n_downstream) OVER w AS most, max(deviation) OVER w AS far
              FROM (SELECT m.system, m.start, m.stop, m.entity, coalesce(m.mean_residual, -1) AS mean_residual, c.first_idx,
                           d.n_downstream, coalesce(x.deviation, 0) AS deviation
                    FROM peakmeans m LEFT JOIN peakcross c USING (system, start, stop, entity)
                    LEFT JOIN downs d USING (system, entity) LEFT JOIN drift x USING (system, entity))
              WINDOW w AS (PARTITION BY system, start, stop))""",
    "fused": rank_sql(
        "(SELECT *, 0.40 * r + 0.15 * t + 0.15 * p + 0.30 * d AS fused FROM evidence)", by="fused", out="fused_rank"
    ),
    "roles": f"""
        SELECT system, start, stop, {role_sql('top', 'total')} AS inferred_type
        FROM (SELECT system, start, stop, arg_min(entity, rank) AS top, sum(coalesce(mean_residual, 0)) AS total FROM peakranks GROUP BY ALL)""",
    "peakhits": """
        SELECT f.fault_id, coalesce(abs(min(r.t_idx) FILTER (WHERE r.residual > o.mu + 2 * o.sigma) - any_value(f.peak_idx)) <= 5, false) AS time_hit
        FROM peakf f JOIN overall o USING (system)
        LEFT JOIN res r ON r.system = f.system AND r.entity = f.entity
             AND r.t_idx >= greatest(f.start - 5, 0) AND r.t_idx < least(f.stop + 5, f.n_steps)
        GROUP BY f.fault_id""",
    "results": """
        SELECT f.system, f.fault_id, f.type || '@' || f.entity AS fault, f.type, f.entity, f.start, f.stop, r.rank, r.rank = 1 AS top1,
               r.rank <= 3 AS top3, 1.0::DOUBLE / r.rank AS mrr, h.time_hit, r.rank = 1 AND h.time_hit AS ct_hit,
               contains(f.reason, replace(i.inferred_type, '_', ' ')) AS reason_hit
        FROM peakf f JOIN peakranks r USING (system, start, stop, entity) JOIN peakhits h USING (fault_id)
        JOIN roles i USING (system, start, stop)""",
    # --- calls
    "named": """
        SELECT s.*, lower(s.operation) AS op, (SELECT min(e.entity) FROM ents e WHERE e.entity <> s.svc AND contains(lower(s.operation), e.entity)) AS named
        FROM spans s""",
    "calls": """
        SELECT *, svc AS src, dst FROM (SELECT *, coalesce(named, CASE WHEN parent = 'root' AND svc <> 'svc0' THEN 'svc0' END) AS dst FROM named)
        WHERE dst IS NOT NULL""",
    "known_calls": "SELECT c.* FROM calls c SEMI JOIN edges e ON e.src = c.src AND e.dst = c.dst",
    "timed": """
        SELECT c.*, s.ts AS step_ts FROM (SELECT *, start_ns // 1000000000 AS sec FROM known_calls) c ASOF JOIN bare_steps s ON c.sec >= s.ts
        WHERE c.sec <= (SELECT max(ts) FROM bare_steps)""",
    "edge_cells": """
        SELECT system, step_ts AS ts, src, dst, CAST(count(*) AS DOUBLE) AS call_count,
               count(*) FILTER (WHERE regexp_matches(op, 'error|fail|exception')) / count(*) AS error_rate,
               avg(duration_ns / 1000000) AS avg_latency_ms, max(duration_ns / 1000000) AS max_latency_ms
        FROM timed GROUP BY system, step_ts, src, dst""",
    "edge_grid": f"""
        SELECT s.*, e.src, e.dst, c.ts IS NOT NULL AS observed, {each('coalesce(c.$f, 0) AS $f', F4)}
        FROM steps s JOIN (SELECT DISTINCT system, src, dst FROM edges) e USING (system)
        LEFT JOIN edge_cells c ON c.system = s.system AND c.ts = s.ts AND c.src = e.src AND c.dst = e.dst""",
    "edge_norm": f"""
        SELECT g.system, g.ts, g.t_idx, g.is_normal, g.use_step, g.src, g.dst, {each('(g.$f - s.mean_$f) / s.std_$f AS $f', F4)}
        FROM edge_grid g JOIN (SELECT system, src, dst, {each('avg($f) FILTER (WHERE use_step) AS mean_$f', F4)},
                                      {each('stddev_pop($f) FILTER (WHERE use_step) + 1e-6 AS std_$f', F4)}
                               FROM edge_grid GROUP BY ALL) s USING (system, src, dst)""",
    "edge_pairs": f"""
        SELECT *, {each('lag($f) OVER w AS prev_$f', F4)} FROM edge_norm
        WINDOW w AS (PARTITION BY system, src, dst ORDER BY t_idx)""",
    "edge_err": f"""
        SELECT p.system, avg({mean_sql([f'pow(p.{f} - (l.alpha_{f} + l.beta_{f} * p.prev_{f}), 2)' for f in F4])}) AS edge_mse,
               count(*) FILTER (WHERE t_idx > 0) AS n
        FROM edge_pairs p JOIN (SELECT system, src, dst, {each(slope_sql('prev_$f') + ' AS beta_$f', F4)},
                                       {each('avg($f) - (' + slope_sql('prev_$f') + ') * avg(prev_$f) AS alpha_$f', F4)}
                                FROM edge_pairs WHERE use_step AND t_idx > 0 GROUP BY ALL) l USING (system, src, dst)
        GROUP BY p.system""",
    # --- mixes
    "mixlogits": """
        SELECT a.system, a.ts, b.category, ln(1 + coalesce(m.n, 0)) AS post_logit, b.prior_logit
        FROM (SELECT DISTINCT system, ts FROM mixt) a
        JOIN (SELECT system, category, ln(1 + sum(n) / (SELECT count(DISTINCT ts) FROM mixt)) AS prior_logit FROM mixt GROUP BY ALL) b USING (system)
        LEFT JOIN mixt m ON m.system = a.system AND m.ts = a.ts AND m.category = b.category""",
    "mixkl": """
        SELECT system, ts, sum(p * (ln(p) - ln(q))) AS kl
        FROM (SELECT system, ts, exp(post_logit) / sum(exp(post_logit)) OVER w AS p, exp(prior_logit) / sum(exp(prior_logit)) OVER w AS q
              FROM mixlogits WINDOW w AS (PARTITION BY system, ts)) GROUP BY ALL""",
    # --- logs
    "lines_l": f"""
        SELECT system, time_ns // 1000000000 AS ts, pod, severity, (SELECT min(e.entity) FROM ents e WHERE contains(lower(pod), e.entity)) AS entity
        FROM (SELECT *, {SEVERITY} AS severity FROM logs)""",
    # --- kpis
    "cat": f"SELECT *, {category_sql('kpi_name')} AS category FROM kpis WHERE {category_sql('kpi_name')} IS NOT NULL",
    "wide": f"""
        SELECT system, ts, entity, {', '.join(f"coalesce(sum(value) FILTER (WHERE category = '{c}'), 0) / count(*) AS {c}" for c in KPI_SLOTS)}
        FROM cat GROUP BY ALL""",
    "slots": "SELECT system, ts, entity, "
    + ", ".join(
        f"{' + '.join([c for c, s in KPI_SLOTS.items() if s == i] or ['0.0::DOUBLE'])} AS {f}" for i, f in enumerate(F8)
    )
    + " FROM wide",
}


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"\b[a-z_0-9]+\b", re.sub(r"'[^']*'", "''", sql)))
    return [name for name in VIEWS if name in words]


# Tables whose CTE is read several times are computed once.
_ONCE = {"filled", "norm", "pairs", "rawres", "res", "edge_grid", "edge_norm", "edge_pairs", "steps", "peakmeans", "peakranks", "mixt"}


def statement(sql: str, rounded: tuple[str, ...] | list[str] = (), whole: tuple[str, ...] | list[str] = ()) -> str:
    """Complete SQL: the CTEs it needs in order, doubles rounded to 6 places, counts as BIGINT."""
    wanted: set[str] = set()
    todo = _needs(sql)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += [n for n in _needs(VIEWS[name]) if n != name]
    parts = [
        f"{name} AS {'MATERIALIZED ' if name in _ONCE else ''}({text.strip()})" for name, text in VIEWS.items() if name in wanted
    ]
    shaped = [f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in rounded] + [f"CAST({c} AS BIGINT) AS {c}" for c in whole]
    body = f"SELECT * REPLACE ({', '.join(shaped)}) FROM ({sql.strip()})" if shaped else sql.strip()
    head = f"WITH RECURSIVE {', '.join(parts)} " if parts else ""
    return head + body
