"""Aggregations (A), window operators (W, R) and scoring (M)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from faultline.fixed_values import EDGE_FEATURES, NODE_FEATURES, WINDOW
from faultline.operators import detect, evaluate, featurize, grid, rank, score, stats, window_models, windows
from faultline.operators.blocks import forward_fill, with_previous
from faultline.operators.joins import attach
from faultline.plans.oracle_views import F4, F8, SEV_CLASS, SEV_WEIGHT, VIEWS, each, mean_sql, nll_sql, rank_sql, slope_sql
from faultline.plans.registry import query
from faultline.plans.views import Tables
from faultline.session import cut

ALL8 = " ".join(F8)
ALL4 = " ".join(F4)
LOG_COUNTS = ("total", "errors", "warns", "severity_sum")

# --- aggregations ----------------------------------------------------------------------------


@query(
    "a1_service_means",
    """SELECT ts, entity, coalesce(sum(cpu) FILTER (WHERE event_id % 97 <> 0), 0) / count(*) AS cpu_rate,
              coalesce(sum(mem) FILTER (WHERE event_id % 97 <> 0), 0) / count(*) AS memory_rate,
              coalesce(sum(ln(1 + net_rx)) FILTER (WHERE event_id % 97 <> 0), 0) / count(*) AS net_rx_bytes,
              coalesce(sum(ln(1 + net_tx)) FILTER (WHERE event_id % 97 <> 0), 0) / count(*) AS net_tx_bytes,
              coalesce(sum(p90_s * 1000) FILTER (WHERE event_id % 97 <> 0), 0) / count(*) AS latency_p90_ms,
              coalesce(sum(p99_s * 1000) FILTER (WHERE event_id % 97 <> 0), 0) / count(*) AS latency_p99_ms,
              coalesce(sum(ops) FILTER (WHERE event_id % 97 <> 0), 0) / count(*) AS workload_ops,
              coalesce(sum(success) FILTER (WHERE event_id % 97 <> 0), 0) / count(*) AS success_rate
       FROM pods GROUP BY ts, entity""",
    rounded=ALL8,
    whole="ts",
)
def a1(t):
    """Published denominator: unreadable rows count but add nothing."""
    return featurize.service_means(t.text_pods, strict_denominator=True).drop("system")


@query("a1_service_averages", f"SELECT ts, entity, {each('$f')} FROM cells", rounded=ALL8, whole="ts")
def a1_avg(t):
    return t.cells.drop("system")


@query("a2_edge_features", f"SELECT ts, src, dst, {each('$f', F4)} FROM edge_cells", rounded=ALL4, whole="ts")
def a2(t):
    return t.edge_cells.drop("system")


@query(
    "a3_workload_context",
    f"""SELECT c.ts, c.total_qps, c.avg_success_rate, c.active_services, x.any_load, x.any_feature
        FROM context c JOIN (SELECT ts, count(*) FILTER (WHERE workload_ops > 0) AS any_load,
             count(*) FILTER (WHERE {each('abs($f)', sep=' + ')} > 0.01) AS any_feature FROM filled GROUP BY ts) x USING (ts)""",
    rounded="total_qps avg_success_rate",
    whole="ts active_services any_load any_feature",
)
def a3(t):
    """The three activity rules side by side."""
    load = F.col("workload_ops")
    rules = {"active_services": load > 0.1, "any_load": load > 0, "any_feature": featurize.any_feature_active()}
    return featurize.workload_context(t.filled, rules, keys=("system", "ts")).drop("system")


@query(
    "a4_kpi_wide",
    "SELECT ts, entity, cpu, mem, net_rx, net_tx, disk_io, sessions FROM wide",
    rounded="cpu mem net_rx net_tx disk_io sessions",
    whole="ts",
)
def a4(t):
    return featurize.kpi_wide(t.kpis).select("ts", "entity", "cpu", "mem", "net_rx", "net_tx", "disk_io", "sessions")


@query(
    "a4_kpi_wide_own_count",
    "SELECT ts, entity, "
    + ", ".join(f"coalesce(avg(value) FILTER (WHERE category = '{c}'), 0) AS {c}" for c in ("cpu", "mem", "net_rx", "net_tx", "disk_io", "sessions"))
    + " FROM cat GROUP BY ts, entity",
    rounded="cpu mem net_rx net_tx disk_io sessions",
    whole="ts",
)
def a4_own(t):
    wide = featurize.kpi_wide(t.kpis, own_count=True)
    return wide.select("ts", "entity", "cpu", "mem", "net_rx", "net_tx", "disk_io", "sessions")


@query(
    "a5_log_windows",
    f"""SELECT w.w, e.entity, {', '.join(f'coalesce(c.{x}, 0) AS {x}' for x in LOG_COUNTS)}
        FROM (SELECT unnest(range((SELECT (max(ts) - min(ts)) // 60 + 1 FROM lines_l WHERE entity IS NOT NULL))) AS w) w CROSS JOIN ents e
        LEFT JOIN (SELECT (ts - (SELECT min(ts) FROM lines_l WHERE entity IS NOT NULL)) // 60 AS w, entity, count(*) AS total,
                          count(*) FILTER (WHERE {SEV_CLASS} = 'error') AS errors, count(*) FILTER (WHERE {SEV_CLASS} = 'warn') AS warns,
                          sum({SEV_WEIGHT}) AS severity_sum FROM lines_l WHERE entity IS NOT NULL GROUP BY ALL) c
          ON c.w = w.w AND c.entity = e.entity""",
    whole="w total errors warns severity_sum",
)
def a5(t):
    lines = featurize.read_logs(t.logs, t.names)
    return featurize.log_grid(lines, t.entities, small=t.small).drop("system")


@query(
    "a6_log_step_counts",
    """SELECT s.ts, l.entity, count(*) AS n_logs FROM (SELECT * FROM lines_l WHERE entity IS NOT NULL) l
       ASOF JOIN bare_steps s ON l.ts >= s.ts GROUP BY s.ts, l.entity""",
    whole="ts n_logs",
)
def a6(t):
    lines = featurize.read_logs(t.logs, t.names)
    return featurize.log_step_counts(lines, t.bare_steps).drop("system")


@query(
    "a7_distinct_members",
    """SELECT DISTINCT 'service' AS kind, entity AS member FROM pods UNION ALL SELECT DISTINCT 'step', CAST(ts AS VARCHAR) FROM pods
       UNION ALL SELECT DISTINCT 'container', entity FROM kpis UNION ALL SELECT DISTINCT 'category', category FROM cat""",
)
def a7(t):
    parts = (
        ("service", t.pods, "entity"),
        ("step", t.pods, "ts"),
        ("container", t.kpis, "entity"),
        ("category", featurize.categorised(t.kpis), "category"),
    )
    out = None
    for kind, rows, column in parts:
        part = rows.select(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("member"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


@query(
    "a8_normal_stats",
    " UNION ALL ".join(f"SELECT 'node' AS kind, entity AS key, '{f}' AS feature, mean_{f} AS mean, std_{f} AS std FROM stats" for f in F8),
    rounded="mean std",
)
def a8(t):
    return stats.stored_stats(t.stats, ["entity"], "node").drop("system")


@query(
    "a9_pooled_stats",
    " UNION ALL ".join(f"SELECT '{f}' AS feature, avg({f}) + 1e-6 AS mean, stddev_pop({f}) + 1e-6 AS std FROM filled" for f in F8),
    rounded="mean std",
)
def a9(t):
    return stats.pooled_stats(t.filled).select("feature", "mean", "std")


@query(
    "a10_entity_peaks",
    "SELECT entity, peak_idx, peak, n_scored FROM peaks_e",
    rounded="peak",
    whole="peak_idx n_scored",
)
def a10(t):
    return detect.entity_peaks(t.residual_rows).select("entity", "peak_idx", "peak", "n_scored")


@query(
    "a11_baseline",
    """SELECT 'validation' AS kind, mu, sigma, mu + 3 * sigma AS threshold, n FROM base
       UNION ALL SELECT 'episode', mu, sigma, mu + 2 * sigma, n FROM overall""",
    rounded="mu sigma threshold",
    whole="n",
)
def a11(t):
    val = t.base.select(F.lit("validation").alias("kind"), "mu", "sigma", (F.col("mu") + 3 * F.col("sigma")).alias("threshold"), "n")
    whole = t.overall.select(F.lit("episode").alias("kind"), "mu", "sigma", (F.col("mu") + 2 * F.col("sigma")).alias("threshold"), "n")
    return val.unionByName(whole)


@query(
    "a12_window_means",
    "SELECT start, stop, entity, coalesce(mean_residual, -99) AS mean_residual FROM peakmeans",
    rounded="mean_residual",
    whole="start stop",
)
def a12(t):
    means = rank.window_means(t.residuals, t.peak_faults, t.small)
    return means.select("start", "stop", "entity", F.coalesce("mean_residual", F.lit(-99.0)).alias("mean_residual"))


@query("a13_step_peaks", "SELECT t_idx, peak FROM peaks_t", rounded="peak", whole="t_idx")
def a13(t):
    return detect.step_peaks(t.residual_rows).select("t_idx", "peak")


@query("a14_downstream", "SELECT entity, n_downstream FROM downs", whole="n_downstream")
def a14(t):
    return t.downstream.select("entity", "n_downstream")


_FLAGS = ("top1", "top3", "time_hit", "ct_hit", "reason_hit")


@query(
    "a15_summary",
    """SELECT system, count(*) AS n, count(*) FILTER (WHERE top1) AS top1, count(*) FILTER (WHERE top3) AS top3, avg(mrr) AS mrr, avg(rank) AS mean_rank,
              count(*) FILTER (WHERE time_hit) AS time_hits, count(*) FILTER (WHERE ct_hit) AS ct_hits, count(*) FILTER (WHERE reason_hit) AS reason_hits,
              avg(CAST(top1 AS INT)) AS top1_rate, avg(CAST(top3 AS INT)) AS top3_rate, avg(CAST(time_hit AS INT)) AS time_rate,
              avg(CAST(ct_hit AS INT)) AS ct_rate, avg(CAST(reason_hit AS INT)) AS reason_rate FROM results GROUP BY system""",
    rounded="mrr mean_rank top1_rate top3_rate time_rate ct_rate reason_rate",
    whole="n top1 top3 time_hits ct_hits reason_hits",
)
def a15(t):
    return evaluate.summary(t.results)


@query(
    "a16_by_type",
    """SELECT type, count(*) AS n, count(*) FILTER (WHERE top1) AS top1, avg(CAST(top1 AS INT)) AS top1_rate FROM results GROUP BY type""",
    rounded="top1_rate",
    whole="n top1",
)
def a16(t):
    return evaluate.by_type(t.results).drop("system")


@query(
    "a17_type_vocabulary",
    "SELECT type, n, row_number() OVER (ORDER BY n DESC, type) - 1 AS type_idx FROM (SELECT type, count(*) AS n FROM faults GROUP BY type)",
    whole="n type_idx",
)
def a17(t):
    return evaluate.type_vocabulary(t.faults).drop("system")


@query(
    "a18_compare_rankings",
    """SELECT count(*) AS n, count(*) FILTER (WHERE r.rank = 1) AS top1_residual, count(*) FILTER (WHERE u.fused_rank = 1) AS top1_fused,
              count(*) FILTER (WHERE u.fused_rank < r.rank) AS improved, avg(r.rank) AS mean_rank_residual, avg(u.fused_rank) AS mean_rank_fused
       FROM peakf f JOIN peakranks r USING (system, start, stop, entity) JOIN fused u USING (system, start, stop, entity)""",
    rounded="mean_rank_residual mean_rank_fused",
    whole="n top1_residual top1_fused improved",
)
def a18(t):
    key = ["system", "start", "stop", "entity"]
    ask = t.peak_faults.select("fault_id", *key)
    by_residual = attach(ask, t.peak_ranks.select(*key, "rank"), key, small=False)
    by_fusion = attach(ask, t.fused.select(*key, F.col("fused_rank").alias("rank")), key, small=False)
    compared = evaluate.compare_rankings(by_residual, by_fusion)
    counts = ["n", "top1_residual", "top1_fused", "improved"]
    return t.axis.select("system").join(compared, "system", "left").fillna(0, counts).drop("system")


# Calls into each service as the regressor of its features; the fit is kept, only the input changes.
_CALLS = "(SELECT ts, dst AS entity, sum(call_count) AS calls FROM edge_grid GROUP BY ts, dst)"


@query(
    "a19_input_ablation",
    f"""WITH x AS (SELECT n.*, coalesce(c.calls, 0) AS actual, t_idx // 24 AS win, t_idx % 24 AS pos FROM norm n LEFT JOIN {_CALLS} c USING (ts, entity)),
        l AS (SELECT entity, {each(slope_sql('actual') + ' AS beta_$f')}, {each('avg($f) - (' + slope_sql('actual') + ') * avg(actual) AS alpha_$f')}
              FROM x WHERE use_step GROUP BY entity),
        s AS (SELECT entity, {each('sqrt(avg(pow(x.$f - l.alpha_$f - l.beta_$f * x.actual, 2))) AS sigma_$f')} FROM x JOIN l USING (entity) WHERE use_step GROUP BY entity),
        v AS (SELECT 'actual' AS variant, x.*, actual AS input FROM x UNION ALL
              SELECT 'static', x.*, avg(actual) OVER (PARTITION BY entity, pos) FROM x UNION ALL SELECT 'none', x.*, 0.0 FROM x),
        r AS (SELECT variant, win, {mean_sql([nll_sql(f'v.{f}', f'l.alpha_{f} + l.beta_{f} * v.input', f's.sigma_{f}') for f in F8])} AS residual
              FROM v JOIN l USING (entity) JOIN s USING (entity)),
        q AS (SELECT variant, avg(m) AS mean_nll, stddev_pop(m) AS std_nll FROM (SELECT variant, win, avg(residual) AS m FROM r GROUP BY ALL) GROUP BY variant)
        SELECT variant, mean_nll, std_nll, 100 * (mean_nll - b) / abs(b) AS change_pct FROM q, (SELECT mean_nll AS b FROM q WHERE variant = 'actual')""",
    rounded="mean_nll std_nll change_pct",
)
def a19(t):
    """Fit quality with the actual call input, its mean over windows at the same offset, and none."""
    calls = t.edge_grid.groupBy("system", "ts", F.col("dst").alias("entity")).agg(F.sum("call_count").alias("actual"))
    fed = t.normalized.join(calls, ["system", "ts", "entity"], "left").withColumn("actual", F.coalesce("actual", F.lit(0.0)))
    fed = cut(fed.withColumn("_pos", F.col("t_idx") % WINDOW).withColumn("_win", F.floor(F.col("t_idx") / WINDOW)))
    fit = score.fit_line(fed, ["system", "entity"], NODE_FEATURES, "actual")
    means = fed.groupBy("system", "entity", "_pos").agg(F.avg("actual").alias("static"))
    fed = attach(fed, means, ["system", "entity", "_pos"])
    inputs = F.array(
        F.struct(F.lit("actual").alias("variant"), F.col("actual").alias("input")),
        F.struct(F.lit("static").alias("variant"), F.col("static").alias("input")),
        F.struct(F.lit("none").alias("variant"), F.lit(0.0).alias("input")),
    )
    varied = fed.select("*", F.inline(inputs))
    scored = score.score_rows(
        varied, fit, ["system", "entity"], NODE_FEATURES, ["input"] * len(NODE_FEATURES), small=t.small
    )
    per_window = scored.groupBy("system", "variant", "_win").agg(F.avg("residual").alias("m"))
    means = per_window.groupBy("system", "variant").agg(F.avg("m").alias("mean_nll"), F.stddev_pop("m").alias("std_nll"))
    own = F.max(F.when(F.col("variant") == "actual", F.col("mean_nll"))).over(Window.partitionBy("system"))
    change = 100 * (F.col("mean_nll") - F.col("_b")) / F.abs("_b")
    return means.withColumn("_b", own).select("variant", "mean_nll", "std_nll", change.alias("change_pct"))


@query(
    "a20_dataset_counts",
    """SELECT 'windows_' || split AS item, count(*) AS n FROM splits GROUP BY split UNION ALL SELECT 'steps', count(*) FROM marked
       UNION ALL SELECT 'normal_steps', count(*) FROM marked WHERE is_normal
       UNION ALL SELECT 'logs', count(*) FROM lines_l UNION ALL SELECT 'error_logs', count(*) FROM lines_l WHERE severity IN ('error', 'critical', 'fatal')""",
    whole="n",
)
def a20(t):
    lines = featurize.read_logs(t.logs, t.names)
    parts = [
        t.splits.groupBy(F.concat(F.lit("windows_"), F.col("split")).alias("item")).agg(F.count("*").alias("n")),
        t.steps.agg(F.count("*").alias("n")).select(F.lit("steps").alias("item"), "n"),
        t.steps.agg(F.count_if("is_normal").alias("n")).select(F.lit("normal_steps").alias("item"), "n"),
        lines.agg(F.count("*").alias("n")).select(F.lit("logs").alias("item"), "n"),
        lines.agg(F.count_if(F.col("severity").isin("error", "critical", "fatal")).alias("n")).select(
            F.lit("error_logs").alias("item"), "n"
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "a21_fit_quality",
    "SELECT entity, avg(residual) AS mean_residual, count(residual) AS n FROM res GROUP BY entity",
    rounded="mean_residual",
    whole="n",
)
def a21(t):
    return t.residual_rows.groupBy("entity").agg(F.avg("residual").alias("mean_residual"), F.count("residual").alias("n"))


# --- window operators ------------------------------------------------------------------------


@query("w1_forward_fill", f"SELECT t_idx, entity, observed, {each('$f')} FROM filled", rounded=ALL8, whole="t_idx")
def w1(t):
    return t.filled.select("t_idx", "entity", "observed", *NODE_FEATURES)


@query(
    "w1_filled_residuals",
    """SELECT t_idx, entity, coalesce(last_value(residual IGNORE NULLS) OVER (PARTITION BY entity ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS residual
       FROM res""",
    rounded="residual",
    whole="t_idx",
)
def w1_residuals(t):
    rows = t.residuals.withColumn("scored", F.col("residual").isNotNull())
    return forward_fill(rows, ["system", "entity"], ["residual"], "scored").select("t_idx", "entity", "residual")


@query("w2_time_index", "SELECT ts, t_idx, n_steps FROM bare_steps", whole="ts t_idx n_steps")
def w2(t):
    return grid.time_steps(t.pods).select("ts", "t_idx", "n_steps")


@query(
    "w3_training_windows",
    """SELECT w.window_start, f.t_idx - w.window_start AS "offset", f.entity, f.cpu_rate FROM train_starts w
       JOIN filled f ON f.t_idx >= w.window_start AND f.t_idx < w.window_start + 24""",
    rounded="cpu_rate",
    whole='window_start "offset"',
)
def w3(t):
    return windows.sliding_windows(t.filled).select("window_start", "offset", "entity", "cpu_rate")


@query(
    "w4_scoring_windows",
    """SELECT w.window_start, f.t_idx - w.window_start AS "offset", f.entity, f.cpu_rate FROM score_starts w
       JOIN filled f ON f.t_idx >= w.window_start AND f.t_idx < w.window_start + 24""",
    rounded="cpu_rate",
    whole='window_start "offset"',
)
def w4(t):
    rows = windows.sliding_windows(t.filled, stride=12, form="score")
    return rows.select("window_start", "offset", "entity", "cpu_rate")


@query(
    "w5_padded_windows",
    """SELECT o."offset", e.entity, coalesce(f.cpu_rate, 0) AS cpu_rate, coalesce(f.workload_ops, 0) AS workload_ops
       FROM (SELECT unnest(range((SELECT max(n_steps) + 24 FROM bare_steps))) AS "offset") o CROSS JOIN ents e
       LEFT JOIN filled f ON f.t_idx = o."offset" AND f.entity = e.entity""",
    rounded="cpu_rate workload_ops",
    whole='"offset"',
)
def w5(t):
    """One window, a training window longer than the series, so all steps are in it and its end is padding."""
    size = t.axis.agg(F.max("n_steps")).first()[0] + WINDOW
    rows = windows.sliding_windows(t.filled, size=size, stride=size, form="score")
    return windows.pad_windows(rows, NODE_FEATURES, size).select("offset", "entity", "cpu_rate", "workload_ops")


@query("w6_window_labels", "SELECT window_start, all_normal, first_ts, last_ts FROM labels_w", whole="window_start first_ts last_ts")
def w6(t):
    return windows.label_windows(t.steps).select("window_start", "all_normal", "first_ts", "last_ts")


@query("w7_window_splits", "SELECT window_start, split FROM splits", whole="window_start")
def w7(t):
    return t.splits.select("window_start", "split")


@query(
    "w8_window_faults",
    """SELECT DISTINCT w.window_start, f.fault_id FROM train_starts w JOIN steps s ON s.t_idx >= w.window_start AND s.t_idx < w.window_start + 24
       JOIN faults f ON s.ts >= f.ts AND s.ts < f.ts + 600""",
    whole="window_start",
)
def w8(t):
    return windows.window_faults(t.steps, t.faults).select("window_start", "fault_id")


@query(
    "w9_next_step_pairs",
    """SELECT t_idx, entity, cpu_rate, lag(cpu_rate) OVER w AS prev_cpu_rate, workload_ops, lag(workload_ops) OVER w AS prev_workload_ops
       FROM filled WINDOW w AS (PARTITION BY entity ORDER BY t_idx)""",
    rounded="cpu_rate prev_cpu_rate workload_ops prev_workload_ops",
    whole="t_idx",
)
def w9(t):
    cols = ["cpu_rate", "workload_ops"]
    rows = t.filled.select("system", "t_idx", "entity", *cols)
    return with_previous(rows, ["system", "entity"], cols).drop("system")


@query(
    "w10_merged_scores",
    """SELECT r.t_idx, r.entity, max(w.window_start) AS window_start,
              arg_max(r.residual / (r.t_idx - w.window_start), w.window_start) AS residual
       FROM rawres r LEFT JOIN score_starts w ON r.t_idx > w.window_start AND r.t_idx < w.window_start + 24 GROUP BY r.t_idx, r.entity""",
    rounded="residual",
    whole="t_idx window_start",
)
def w10(t):
    """Scores that differ between windows: the residual over its distance from the window's start."""
    scored = windows.sliding_windows(t.raw_residuals, stride=12, form="score").where(F.col("offset") >= 1)
    scored = scored.withColumn("residual", F.col("residual") / F.col("offset"))
    cells = t.raw_residuals.select("system", "entity", "t_idx")
    return windows.merge_scores(scored, cells).drop("system")


@query(
    "w11_first_crossings",
    "SELECT start, stop, entity, coalesce(first_idx, 9999) AS first_idx FROM peakcross",
    whole="start stop first_idx",
)
def w11(t):
    rows = detect.window_crossings(t.residuals, t.peak_faults, t.overall, k=2.0, small=t.small)
    return rows.select("start", "stop", "entity", F.coalesce("first_idx", F.lit(9999)).alias("first_idx"))


@query(
    "w12_earliest",
    """SELECT start, stop, entity, coalesce(first_idx, 9999) AS first_idx,
              coalesce(first_idx, 9999) <= min(coalesce(first_idx, 9999)) OVER (PARTITION BY start, stop) AS is_earliest FROM peakcross""",
    whole="start stop first_idx",
)
def w12(t):
    rows = detect.window_crossings(t.residuals, t.peak_faults, t.overall, k=2.0, small=t.small)
    return detect.earliest(rows).drop("system")


@query(
    "w13_anomaly_intervals",
    "SELECT first_hot, run_length, start, stop FROM intervals",
    whole="first_hot run_length start stop",
)
def w13(t):
    return t.intervals.select("first_hot", "run_length", "start", "stop")


def _hit_sql(faults: str, k: int, lo: str, hi: str, base: str, test: str) -> str:
    return f"""SELECT fault_id, first_idx, coalesce({test}, false) AS time_hit FROM (
        SELECT f.fault_id, any_value(f.start) AS start, any_value(f.stop) AS stop, any_value(f.mark) AS mark,
               min(r.t_idx) FILTER (WHERE r.residual > b.mu + {k} * b.sigma) AS first_idx
        FROM {faults} f JOIN {base} b USING (system) LEFT JOIN res r ON r.system = f.system AND r.entity = f.entity
             AND r.t_idx >= greatest({lo}, 0) AND r.t_idx < least({hi}, f.n_steps) GROUP BY f.fault_id)"""


@query(
    "w14_time_hits",
    "SELECT 'any' AS rule, * FROM ("
    + _hit_sql("(SELECT *, 0 AS mark FROM detf)", 3, "f.start", "f.stop", "base", "first_idx IS NOT NULL")
    + ") UNION ALL SELECT 'peak', * FROM ("
    + _hit_sql("(SELECT *, peak_idx AS mark FROM peakf)", 2, "f.start - 5", "f.stop + 5", "overall", "abs(first_idx - mark) <= 5")
    + ") UNION ALL SELECT 'report', * FROM ("
    + _hit_sql(
        "(SELECT *, report_idx AS mark FROM repf)", 2, "f.mark - 5", "f.mark + 10", "base", "first_idx >= mark AND first_idx < mark + 10"
    )
    + ")",
    whole="first_idx",
)
def w14(t):
    asked = (
        ("any", t.detected_faults, t.base),
        ("peak", t.peak_faults, t.overall),
        ("report", t.reported_faults, t.base),
    )
    out = None
    for rule, placed, base in asked:
        hits = detect.time_hits(placed, t.residuals, base, rule, t.small)
        part = hits.select(F.lit(rule).alias("rule"), "fault_id", "first_idx", "time_hit")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "r1_residual_ranking",
    """SELECT f.fault_id, r.entity, r.mean_residual, r.rank, r.entity = f.entity AS is_labelled FROM peakf f JOIN peakranks r USING (system, start, stop)""".replace(
        "r.entity, r.mean", "r.entity AS entity, r.mean"
    ),
    rounded="mean_residual",
    whole="rank",
)
def r1(t):
    return rank.for_faults(t.peak_faults, t.peak_ranks).select(
        "fault_id", "entity", "mean_residual", "rank", (F.col("entity") == F.col("labelled")).alias("is_labelled")
    )


@query(
    "r2_fused_ranking",
    "SELECT start, stop, entity, r, t, p, d, fused, fused_rank FROM fused",
    rounded="r t p d fused",
    whole="start stop fused_rank",
)
def r2(t):
    return t.fused.drop("system", "mean_residual")


_SENTINEL = VIEWS["evidence"].replace("max(first_idx) OVER w", "max(coalesce(first_idx, 9999)) OVER w")


@query(
    "r2_published_fusion",
    "SELECT start, stop, entity, r, t, p, d, fused, fused_rank FROM ("
    + rank_sql(f"(SELECT *, 0.40 * r + 0.15 * t + 0.15 * p + 0.30 * d AS fused FROM ({_SENTINEL}))", by="fused", out="fused_rank")
    + ")",
    rounded="r t p d fused",
    whole="start stop fused_rank",
)
def r2_published(t):
    """An entity without a crossing puts 9999 into the latest first crossing."""
    return t.fusion(rank.published_fusion).drop("system", "mean_residual")


# --- scoring ---------------------------------------------------------------------------------


@query(
    "m1_one_step_fit",
    " UNION ALL ".join(
        f"SELECT l.entity, '{f}' AS feature, alpha_{f} AS alpha, beta_{f} AS beta, sigma_{f} AS sigma FROM lines l JOIN sigmas s USING (entity)"
        for f in F8
    ),
    rounded="alpha beta sigma",
)
def m1(t):
    return t.fit.where("alpha IS NOT NULL").select("entity", "feature", "alpha", "beta", "sigma")


@query(
    "m2_workload_residuals",
    f"""WITH x AS (SELECT n.*, c.total_qps FROM norm n JOIN context c USING (ts)),
        l AS (SELECT entity, {each(slope_sql('total_qps') + ' AS beta_$f')}, {each('avg($f) - (' + slope_sql('total_qps') + ') * avg(total_qps) AS alpha_$f')}
              FROM x WHERE use_step GROUP BY entity),
        s AS (SELECT entity, {each('sqrt(avg(pow(x.$f - l.alpha_$f - l.beta_$f * x.total_qps, 2))) AS sigma_$f')} FROM x JOIN l USING (entity) WHERE use_step GROUP BY entity)
        SELECT x.t_idx, x.entity, {mean_sql([nll_sql(f'x.{f}', f'l.alpha_{f} + l.beta_{f} * x.total_qps', f's.sigma_{f}') for f in F8])} AS residual
        FROM x JOIN l USING (entity) JOIN s USING (entity)""",
    rounded="residual",
    whole="t_idx",
)
def m2(t):
    """Prediction from the total load alone; the entity's own past never enters."""
    load = featurize.workload_context(t.filled, keys=("system", "ts")).select("system", "ts", "total_qps")
    rows = cut(t.normalized.join(load, ["system", "ts"]))
    fit = score.fit_line(rows, ["system", "entity"], NODE_FEATURES, "total_qps")
    scored = score.score_rows(rows, fit, ["system", "entity"], NODE_FEATURES, ["total_qps"] * 8, small=t.small)
    return scored.select("t_idx", "entity", "residual")


@query("m3_node_residuals", "SELECT t_idx, entity, residual FROM res", rounded="residual", whole="t_idx")
def m3(t):
    return t.residual_rows.select("t_idx", "entity", "residual")


@query("m4_overall_nll", "SELECT avg(residual) AS nll, count(residual) AS n FROM rawres", rounded="nll", whole="n")
def m4(t):
    return score.run_nll(t.scored_runs).drop("system")


def _edge_pairs(t: Tables):
    return with_previous(t.edge_grid, ["system", "src", "dst"], EDGE_FEATURES)


@query("m5_edge_error", "SELECT edge_mse, n FROM edge_err", rounded="edge_mse", whole="n")
def m5(t):
    return _edge_error(t).drop("system")


def _edge_error(t: Tables):
    key = ["system", "src", "dst"]
    pairs = _edge_pairs(t)
    fit = score.fit_step(pairs, key, EDGE_FEATURES)
    return score.edge_error(pairs, fit, key, EDGE_FEATURES, t.edges_small)


@query(
    "m6_mix_divergence",
    "SELECT ts, kl, greatest(kl, 0.05) AS kl_floored FROM mixkl",
    rounded="kl kl_floored",
    whole="ts",
)
def m6(t):
    """Drift of each step's event mix from the mean mix."""
    return score.mix_divergence(t.step_mix, ["system", "ts"], free_bits=0.05).drop("system")


@query("m7_mix_concentration", "SELECT entity, entropy, deviation FROM drift", rounded="entropy deviation")
def m7(t):
    return t.drift.drop("system")


@query(
    "m8_objective",
    """SELECT metric_loss, edge_loss, kl_loss, metric_loss + 0.3 * edge_loss + 0.1 * kl_loss AS total_loss
       FROM (SELECT (SELECT avg(residual) FROM rawres) AS metric_loss, (SELECT edge_mse FROM edge_err) AS edge_loss,
                    (SELECT avg(greatest(kl, 1.0)) FROM mixkl) AS kl_loss)""",
    rounded="metric_loss edge_loss kl_loss total_loss",
)
def m8(t):
    divergence = score.mix_divergence(t.step_mix, ["system", "ts"])
    kl = divergence.groupBy("system").agg(F.avg("kl_floored").alias("kl"))
    return score.objective(score.run_nll(t.scored_runs), _edge_error(t), kl).drop("system")


@query(
    "m9_user_model",
    """SELECT window_start, entity, avg(change) AS score FROM (
         SELECT w.window_start, f.entity, abs(f.workload_ops - lag(f.workload_ops) OVER (PARTITION BY w.window_start, f.entity ORDER BY f.t_idx)) AS change
         FROM score_starts w JOIN filled f ON f.t_idx >= w.window_start AND f.t_idx < w.window_start + 24) GROUP BY window_start, entity""",
    rounded="score",
    whole="window_start",
)
def m9(t):
    """A user's pandas function over every scoring window."""
    rows = windows.sliding_windows(t.filled, stride=12, form="score").select(
        "system", "window_start", "entity", "t_idx", "workload_ops"
    )
    schema = "system string, window_start bigint, entity string, score double"
    return score.apply_model(rows, score.mean_step_change, schema).drop("system")


@query(
    "m9_window_model",
    """WITH carried AS (SELECT e.t_idx, e.dst AS entity, sum(e.call_count * s.workload_ops / (1 + c.total_qps)) AS v
         FROM edge_grid e JOIN filled s ON s.t_idx = e.t_idx AND s.entity = e.src JOIN context c ON c.t_idx = e.t_idx GROUP BY ALL)
       SELECT w.window_start, f.entity, avg(coalesce(c.v, 0)) AS score
       FROM score_starts w JOIN filled f ON f.t_idx >= w.window_start AND f.t_idx < w.window_start + 24
       LEFT JOIN carried c ON c.t_idx = f.t_idx AND c.entity = f.entity GROUP BY w.window_start, f.entity""",
    rounded="score",
    whole="window_start",
)
def m9_window(t):
    """A user's function over whole windows: each entity's score takes its neighbours' values, calls and the context."""
    nodes = t.filled.select("system", "t_idx", "n_steps", "entity", "workload_ops")
    edges = t.edge_grid.select("system", "t_idx", "src", "dst", "call_count")
    context = t.step_context.select("system", "t_idx", "total_qps")
    made = window_models.apply_to_windows(nodes, edges, context, window_models.neighbour_load, window_models.SCORE_KIND)
    return made.drop("system")
