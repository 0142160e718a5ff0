"""File sources and sinks (S), and the end-to-end runs.

Each source query writes files of its kind from the whole tables below the shared folder and reads them back.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, Window, functions as F

from faultline.fixed_values import CONTEXT_FEATURES
from faultline.operators import graph
from faultline.plans import runs
from faultline.plans.oracle_views import F4, F8, each, rank_sql, role_sql
from faultline.plans.registry import query
from faultline.plans.views import SYSTEM, Tables
from faultline.session import scratch_path
from faultline.sources import dataset, files

ALL8 = " ".join(F8)
ALL4 = " ".join(F4)
ALL3 = " ".join(CONTEXT_FEATURES)


def _metric_dir(t: Tables, decimal_time: bool = False) -> str:
    """Metric files, one entry per service, in the published column positions."""
    root = scratch_path(t.spark, "metrics")
    place = {1: "ts", 2: "pod", 4: "cpu", 6: "mem", 9: "net_rx", 10: "net_tx", 11: "p90_s", 15: "p99_s", 17: "ops", 18: "success"}
    columns = [
        F.col(place[i]).alias(f"m{i}_{place[i]}") if i in place else F.lit("x").alias(f"m{i}") for i in range(files.METRIC_COLUMNS)
    ]
    pods = t.text_pods
    if decimal_time:  # such as 1.7040672E9 and a fraction that is cut off
        pods = pods.withColumn("ts", (F.col("ts") + 0.75).cast("string"))
    rows = pods.select(*columns, F.concat(F.col("entity"), F.lit("-0-0_metric.csv")).alias("entry"))
    files.write_by_name(rows, root, "entry")
    return root


@query(
    "s1_metric_files",
    """SELECT ts, pod, CASE WHEN event_id % 97 = 0 THEN 'bad' ELSE CAST(cpu AS VARCHAR) END AS cpu, entity FROM pods""",
    whole="ts",
)
def s1(t):
    return files.metric_files(t.spark, _metric_dir(t), SYSTEM).select("ts", "pod", "cpu", "entity")


@query(
    "s1_metric_files_float_time",
    """SELECT ts, pod, CASE WHEN event_id % 97 = 0 THEN 'bad' ELSE CAST(cpu AS VARCHAR) END AS cpu, entity FROM pods""",
    whole="ts",
)
def s1_float(t):
    return files.metric_files(t.spark, _metric_dir(t, decimal_time=True), SYSTEM).select("ts", "pod", "cpu", "entity")


@query("p3_pod_of_file", "SELECT entity AS file_pod, count(*) AS n FROM pods GROUP BY entity", whole="n")
def p3(t):
    rows = files.metric_files(t.spark, _metric_dir(t), SYSTEM)
    return rows.groupBy("file_pod").agg(F.count("*").alias("n"))


@query("s2_trace_files", "SELECT start_ns, duration_ns, pod, operation, parent FROM spans", whole="start_ns duration_ns")
def s2(t):
    root = scratch_path(t.spark, "traces")
    rows = t.spans.select(
        F.col("start_ns").alias("StartTimeUnixNano"),
        F.col("duration_ns").alias("Duration"),
        F.col("pod").alias("PodName"),
        F.col("operation").alias("OperationName"),
        F.col("parent").alias("ParentID"),
        F.concat(F.substring_index("pod", "-", 1), F.lit("_trace.csv")).alias("entry"),
    )
    files.write_by_name(rows, root, "entry")
    return files.trace_files(t.spark, root, SYSTEM).drop("system")


@query("s2_trace_files_mixed_headers", "SELECT start_ns, duration_ns, pod, operation, parent FROM spans", whole="start_ns duration_ns")
def s2_mixed(t):
    """Two groups of files that hold their columns in different orders."""
    root = scratch_path(t.spark, "traces")
    rows = t.spans.select(
        F.col("start_ns").alias("StartTimeUnixNano"),
        F.col("duration_ns").alias("Duration"),
        F.col("pod").alias("PodName"),
        F.col("operation").alias("OperationName"),
        F.col("parent").alias("ParentID"),
        F.concat(F.substring_index("pod", "-", 1), F.lit("_trace.csv")).alias("entry"),
    )
    odd = F.pmod(F.xxhash64("PodName"), F.lit(2)) == 1
    files.write_by_name(rows.where(odd), f"{root}/odd", "entry")
    files.write_by_name(rows.where(~odd).select(*reversed(rows.columns)), f"{root}/even", "entry")
    return files.trace_files(t.spark, f"{root}/*", SYSTEM).drop("system")


@query("s3_log_files", "SELECT time_ns, pod, log FROM logs", whole="time_ns")
def s3(t):
    root = scratch_path(t.spark, "logs")
    rows = t.logs.select(
        F.col("time_ns").alias("TimeUnixNano"),
        F.col("pod").alias("PodName"),
        F.col("log").alias("Log"),
        F.concat(F.substring_index("pod", "-", 1), F.lit(".csv")).alias("entry"),
    )
    files.write_by_name(rows, root, "entry", escape='"')
    return files.log_files(t.spark, root, SYSTEM).drop("system")


def _dependencies(t: Tables) -> DataFrame:
    """Edges from a list of several files, written by ranges of the place."""
    root = scratch_path(t.spark, "dependency")
    t.deps.repartitionByRange(4, "pos").sortWithinPartitions("pos").select("source", "target").write.option("header", True).csv(root)
    return graph.clean_dependencies(files.dependency_file(t.spark, root, SYSTEM))


@query("s4_dependency_file", "SELECT src, dst, row_number() OVER (ORDER BY pos) AS nth FROM edges", whole="nth")
def s4(t):
    nth = F.row_number().over(Window.partitionBy("system").orderBy("pos"))
    return _dependencies(t).select("src", "dst", nth.alias("nth"))


@query(
    "g1_from_file",
    """SELECT entity, row_number() OVER (ORDER BY min(place)) - 1 AS entity_idx
       FROM (SELECT src AS entity, pos * 2 AS place FROM edges UNION ALL SELECT dst, pos * 2 + 1 FROM edges) GROUP BY entity""",
    whole="entity_idx",
)
def g1_from_file(t):
    return graph.graph_nodes(_dependencies(t)).drop("system")


@query(
    "s5_fault_file",
    "SELECT CAST(ts % 86400 // 3600 AS VARCHAR) AS hour, ts, component AS pod, type, CASE WHEN true THEN entity END AS entity FROM faults",
    whole="ts",
)
def s5(t):
    """One JSON object per line, each mapping an hour to a list of faults."""
    root = scratch_path(t.spark, "faults")
    hour = F.floor(F.col("ts") % 86_400 / 3600).cast("string")
    entry = F.struct(
        F.col("ts").cast("string").alias("inject_time"),
        F.col("ts").alias("inject_timestamp"),
        F.col("component").alias("inject_pod"),
        F.col("type").alias("inject_type"),
    )
    t.faults.select(F.to_json(F.create_map(hour, F.array(entry))).alias("value")).write.text(root)
    return files.fault_file(t.spark, root, SYSTEM, lines=True).select("hour", "ts", "pod", "type", "entity")


@query(
    "s5_one_object",
    "SELECT CAST(ts % 86400 // 3600 AS VARCHAR) AS hour, ts, component AS pod, type, CASE WHEN true THEN entity END AS entity FROM faults",
    whole="ts",
)
def s5_one_object(t):
    """The published form: one file that is one object, each hour with all its faults."""
    root = scratch_path(t.spark, "faults")
    hour = F.floor(F.col("ts") % 86_400 / 3600).cast("string")
    pod, ts = F.col("component").alias("inject_pod"), F.col("ts")
    entry = F.to_json(F.struct(ts.cast("string").alias("inject_time"), ts.alias("inject_timestamp"), pod, F.col("type").alias("inject_type")))
    rows = t.faults.select(hour.alias("hour"), "fault_id", entry.alias("entry"))
    turn = F.row_number().over(Window.partitionBy("hour").orderBy("fault_id"))
    begins = F.when(turn == 1, F.concat(F.lit('"'), "hour", F.lit('": ['))).otherwise(F.lit(""))
    last = turn == F.count("*").over(Window.partitionBy("hour"))
    text = rows.select("hour", turn.alias("turn"), F.concat(begins, "entry", F.when(last, "],").otherwise(",")).alias("value"))
    frame = t.spark.createDataFrame([("", 0, "{"), ("~", 0, '"none": []}')], "hour string, turn int, value string")
    text.unionByName(frame).coalesce(1).sortWithinPartitions("hour", "turn").select("value").write.text(root)
    return files.fault_file(t.spark, root, SYSTEM).select("hour", "ts", "pod", "type", "entity")


@query(
    "s6_record_file",
    "SELECT component, reason, CAST(ts AS DOUBLE) AS timestamp, 'pod' AS level FROM faults",
    rounded="timestamp",
)
def s6(t):
    root = scratch_path(t.spark, "records")
    rows = t.faults.select("component", "reason", F.col("ts").alias("timestamp"))
    rows.write.option("header", True).csv(root)
    return files.record_file(t.spark, root, SYSTEM).drop("system")


@query("s7_kpi_file", "SELECT ts, entity, kpi_name, value FROM kpis", rounded="value", whole="ts")
def s7(t):
    root = scratch_path(t.spark, "kpis")
    rows = t.kpis.select(F.col("ts").alias("timestamp"), F.col("entity").alias("cmdb_id"), "kpi_name", "value")
    rows.write.option("header", True).csv(root)
    return files.kpi_file(t.spark, root, "kpis").drop("system")


def _service_dir(t: Tables) -> str:
    """Day directories: even days of one kind of file, odd days of the other."""
    root = scratch_path(t.spark, "services")
    day = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd")
    rows = t.cells.select(
        "ts", "entity", "workload_ops", "success_rate", "latency_p90_ms", F.floor(F.col("ts") / 86_400).alias("_d"), day.alias("day")
    )
    first = rows.where(F.col("_d") % 2 == 0).select(
        F.col("ts").alias("timestamp"),
        F.col("entity").alias("service"),
        F.col("workload_ops").alias("rr"),
        F.col("success_rate").alias("sr"),
        F.col("latency_p90_ms").alias("mrt"),
        "day",
    )
    second = rows.where(F.col("_d") % 2 == 1).select(
        (F.col("ts") * 1000).alias("startTime"),
        F.col("entity").alias("tc"),
        F.col("workload_ops").alias("num"),
        F.col("success_rate").alias("succee_rate"),
        F.col("latency_p90_ms").alias("avg_time"),
        "day",
    )
    telemetry = posixpath.join(root, "telemetry")
    for part, name in ((first, "metric_service.csv"), (second, "metric_app.csv")):
        staged = scratch_path(t.spark, "staged")
        files.write_by_name(part, staged, "day", below=f"metric/{name}")
        files.merge_entries(t.spark, staged, telemetry)
    return root


@query(
    "s8_service_metrics",
    f"SELECT strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, ts, entity, {each('x.$f')}".replace("x.cpu_rate", "0.0::DOUBLE AS cpu_rate")
    .replace("x.memory_rate", "0.0::DOUBLE AS memory_rate")
    .replace("x.net_rx_bytes", "0.0::DOUBLE AS net_rx_bytes")
    .replace("x.net_tx_bytes", "0.0::DOUBLE AS net_tx_bytes")
    .replace("x.latency_p99_ms", "x.latency_p90_ms * 1.5::DOUBLE AS latency_p99_ms")
    + " FROM cells x",
    rounded=ALL8,
    whole="ts",
)
def s8(t):
    return files.service_metric_files(t.spark, _service_dir(t), SYSTEM).drop("system")


@query(
    "s9_first_days",
    "SELECT strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n FROM cells WHERE ts // 86400 < (SELECT min(ts) // 86400 + 5 FROM cells) GROUP BY 1",
    whole="n",
)
def s9(t):
    """Rows of the first five day directories; the other directories are never read."""
    rows = files.service_metric_files(t.spark, _service_dir(t), SYSTEM, max_days=5)
    return rows.groupBy("day").agg(F.count("*").alias("n"))


@query(
    "s10_window_dataset",
    f"""SELECT s.split, count(DISTINCT s.window_start) AS n_windows, count(*) AS n_rows, {each('avg(abs(n.$f)) AS $f')}
        FROM splits s JOIN norm n ON n.t_idx >= s.window_start AND n.t_idx < s.window_start + 24 WHERE s.split <> 'fault' GROUP BY s.split""",
    rounded=ALL8,
    whole="n_windows n_rows",
)
def s10(t):
    return _window_means(t, "nodes")


@query(
    "s11_read_split",
    """SELECT s.window_start, n.t_idx - s.window_start AS "offset", n.entity, n.cpu_rate, n.success_rate
       FROM splits s JOIN norm n ON n.t_idx >= s.window_start AND n.t_idx < s.window_start + 24 WHERE s.split = 'val'""",
    rounded="cpu_rate success_rate",
    whole='window_start "offset"',
)
def s11(t):
    root = runs.build_dataset(t)
    return dataset.read_split(t.spark, root, "val").select("window_start", "offset", "entity", "cpu_rate", "success_rate")


_WINDOWED = """SELECT s.split, count(DISTINCT s.window_start) AS n_windows, count(*) AS n_rows, {means}
    FROM splits s JOIN {rows} n ON n.t_idx >= s.window_start AND n.t_idx < s.window_start + 24 WHERE s.split <> 'fault' GROUP BY s.split"""


def _window_means(t: Tables, kind: str) -> DataFrame:
    root = runs.build_dataset(t)
    rows = dataset.read_split(t.spark, root, "train", kind).unionByName(dataset.read_split(t.spark, root, "val", kind))
    return rows.groupBy("split").agg(
        F.count_distinct("window_start").alias("n_windows"),
        F.count("*").alias("n_rows"),
        *[F.avg(F.abs(f)).alias(f) for f in dataset.KINDS[kind][1]],
    )


@query(
    "s10_edges",
    _WINDOWED.format(rows="edge_norm", means=each("avg(abs(n.$f)) AS $f", F4)),
    rounded=ALL4,
    whole="n_windows n_rows",
)
def s10_edges(t):
    return _window_means(t, "edges")


@query(
    "s10_context",
    _WINDOWED.format(rows="ctx_norm", means=each("avg(abs(n.$f)) AS $f", CONTEXT_FEATURES)),
    rounded=ALL3,
    whole="n_windows n_rows",
)
def s10_context(t):
    return _window_means(t, "context")


def _episode(t: Tables, kind: str) -> DataFrame:
    root = runs.build_dataset(t)
    return dataset.read_episode(t.spark, root, None, dataset.read_stats(t.spark, root, kind), kind)[0]


@query("s11_episode_edges", f"SELECT t_idx, is_normal, src, dst, {each('$f', F4)} FROM edge_norm", rounded=ALL4, whole="t_idx")
def s11_episode_edges(t):
    return _episode(t, "edges").select("t_idx", "is_normal", "src", "dst", *F4)


@query("s11_episode_context", f"SELECT t_idx, is_normal, {each('$f', CONTEXT_FEATURES)} FROM ctx_norm", rounded=ALL3, whole="t_idx")
def s11_episode_context(t):
    return _episode(t, "context").select("t_idx", "is_normal", *CONTEXT_FEATURES)


@query("s11_read_episode", f"SELECT t_idx, is_normal, entity, {each('$f')} FROM norm", rounded=ALL8, whole="t_idx")
def s11_episode(t):
    return _episode(t, "nodes").select("t_idx", "is_normal", "entity", *F8)


@query(
    "s11_episodes",
    """WITH f AS (SELECT DISTINCT system, ts FROM faults),
        marked AS (SELECT *, coalesce(ts - lag(ts) OVER w > 600 + 2 * 7200, true) AS begins FROM f WINDOW w AS (PARTITION BY system ORDER BY ts)),
        numbered AS (SELECT *, count(*) FILTER (begins) OVER (PARTITION BY system ORDER BY ts) AS k FROM marked),
        e AS (SELECT system, system || '-' || min(ts) AS episode, min(ts) - 7200 AS start, max(ts) + 600 + 7200 AS stop FROM numbered GROUP BY system, k),
        s AS (SELECT e.episode, count(*) AS n_steps_in, count(*) FILTER (NOT m.is_normal) AS n_abnormal, min(m.ts) AS first_ts, max(m.ts) AS last_ts
              FROM e JOIN marked_steps m ON m.system = e.system AND m.ts >= e.start AND m.ts < e.stop GROUP BY e.episode)
       SELECT e.episode, s.n_steps_in, s.n_abnormal, s.first_ts, s.last_ts, s.n_steps_in * (SELECT count(*) FROM ents) AS n_nodes,
         s.n_steps_in * (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM edges)) AS n_edges,
         (SELECT count(*) FROM faults l WHERE l.ts >= e.start AND l.ts < e.stop) AS n_labels
       FROM e JOIN s USING (episode)""".replace("marked_steps", "steps"),
    whole="n_steps_in n_abnormal first_ts last_ts n_nodes n_edges n_labels",
)
def s11_episodes(t):
    """Every stored episode: its steps, mask, nodes, edges and labels, as read back."""
    root = runs.build_dataset(t)
    rows = {k: dataset.read_episode(t.spark, root, kind=k)[0].where("episode IS NOT NULL") for k in ("nodes", "edges", "context")}
    labels = dataset.read_episode(t.spark, root)[1].where("episode IS NOT NULL")
    steps = rows["context"].groupBy("episode").agg(
        F.count("*").alias("n_steps_in"), F.count_if(~F.col("is_normal")).alias("n_abnormal"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    for name, part in (("n_nodes", rows["nodes"]), ("n_edges", rows["edges"]), ("n_labels", labels)):
        steps = steps.join(part.groupBy("episode").agg(F.count("*").alias(name)), "episode")
    return steps


# --- end-to-end runs -------------------------------------------------------------------------

_RATES = "mrr mean_rank top1_rate top3_rate time_rate ct_rate reason_rate"
_COUNTS = "n top1 top3 time_hits ct_hits reason_hits"


def _summary_sql(faults: str, base: str, k: int, lo: str, hi: str, test: str) -> str:
    return f"""WITH f AS (SELECT * FROM {faults}),
        m AS (SELECT w.system, w.start, w.stop, r.entity, avg(r.residual) AS mean_residual FROM (SELECT DISTINCT system, start, stop FROM f) w
              JOIN res r ON r.system = w.system AND r.t_idx >= w.start AND r.t_idx < w.stop GROUP BY ALL),
        k AS ({rank_sql('m')}),
        i AS (SELECT system, start, stop, {role_sql('top', 'total')} AS inferred_type FROM
              (SELECT system, start, stop, arg_min(entity, rank) AS top, sum(coalesce(mean_residual, 0)) AS total FROM k GROUP BY ALL)),
        h AS (SELECT fault_id, coalesce({test}, false) AS time_hit FROM (SELECT f.fault_id, any_value(f.mark) AS mark,
                     min(r.t_idx) FILTER (WHERE r.residual > b.mu + {k} * b.sigma) AS first_idx
              FROM f JOIN {base} b USING (system) LEFT JOIN res r ON r.system = f.system AND r.entity = f.entity
                   AND r.t_idx >= greatest({lo}, 0) AND r.t_idx < least({hi}, f.n_steps) GROUP BY f.fault_id)),
        z AS (SELECT f.system, k.rank, h.time_hit, contains(f.reason, replace(i.inferred_type, '_', ' ')) AS reason_hit
              FROM f JOIN k USING (system, start, stop, entity) JOIN i USING (system, start, stop) JOIN h USING (fault_id))
        SELECT system, count(*) AS n, count(*) FILTER (WHERE rank = 1) AS top1, count(*) FILTER (WHERE rank <= 3) AS top3, avg(1.0::DOUBLE / rank) AS mrr,
               avg(rank) AS mean_rank, count(*) FILTER (WHERE time_hit) AS time_hits, count(*) FILTER (WHERE time_hit AND rank = 1) AS ct_hits,
               count(*) FILTER (WHERE reason_hit) AS reason_hits, avg(CAST(rank = 1 AS INT)) AS top1_rate, avg(CAST(rank <= 3 AS INT)) AS top3_rate,
               avg(CAST(time_hit AS INT)) AS time_rate, avg(CAST(time_hit AND rank = 1 AS INT)) AS ct_rate, avg(CAST(reason_hit AS INT)) AS reason_rate
        FROM z GROUP BY system"""


@query(
    "e2_evaluate_reported",
    _summary_sql(
        "(SELECT *, report_idx AS mark FROM repf)", "base", 2, "f.mark - 5", "f.mark + 10", "first_idx >= mark AND first_idx < mark + 10"
    ),
    rounded=_RATES,
    whole=_COUNTS,
)
def e2(t):
    return runs.evaluate_reported(t)


@query(
    "e3_evaluate_detected",
    _summary_sql("(SELECT *, 0 AS mark FROM detf)", "base", 3, "f.start", "f.stop", "first_idx IS NOT NULL"),
    rounded=_RATES,
    whole=_COUNTS,
)
def e3(t):
    return runs.evaluate_detected(t)


@query(
    "e3_ranked_intervals",
    "SELECT start, stop, entity, mean_residual, rank FROM ("
    + rank_sql(
        """(SELECT w.system, w.start, w.stop, r.entity, avg(r.residual) AS mean_residual FROM intervals w
            JOIN res r ON r.system = w.system AND r.t_idx >= w.start AND r.t_idx < w.stop GROUP BY ALL)"""
    )
    + ")",
    rounded="mean_residual",
    whole="start stop rank",
)
def e3_intervals(t):
    from faultline.plans.catalog import ranked_intervals

    return ranked_intervals(t).drop("system")
