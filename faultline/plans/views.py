"""Telemetry-shaped views over the given tables, and the tables derived from them step by step."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from faultline.fixed_values import EDGE_FEATURES, FAULT_SECONDS, NODE_FEATURES
from faultline.functions.names import service_of
from faultline.operators import detect, episodes, evaluate, featurize, graph, grid, joins, rank, runs, score, spans, stats, windows
from faultline.session import cut

SYSTEM = "events"
CADENCE = 3600
SEVERE = 150.0
ENTRY = "svc0"
PEAK_BEFORE, PEAK_AFTER = 5, 10
FIRST_WINDOWS = 5
FAULT_TYPES = ("cpu_contention", "cpu_consumed", "network_delay", "exception", "return")
KPI_NAMES = (
    "OSLinux-CPU_CPUCpuUtil",
    "Memory_MemPercent",
    "NetworkRxBytes",
    "NetworkTxBytes",
    "Disk_io",
    "Session_used",
)


def micros(ts: Column) -> Column:
    """Epoch microseconds of a wall-clock timestamp (sessions run in UTC)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz"))


def named(system: str, key: str) -> Column:
    """System of a row that has its key.

    A plain literal would be folded out of every join and window on the system, leaving nested loops
    and single partitions.
    """
    return F.when(F.col(key).isNotNull(), system).alias("system")


class Tables:
    """Lazily composed tables of one data directory.

    Attributes are plain DataFrames built on first use. Only dimension-sized tables and tables with
    several consumers are written to the shared folder (`cut`).
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # --- raw telemetry -----------------------------------------------------------------------

    @cached_property
    def events(self) -> DataFrame:
        us = micros(F.col("ts"))
        service = F.concat(F.lit("svc"), (F.col("user_id") % 10).cast("string"))
        return self.read("events").select(
            named(SYSTEM, "event_id"),
            "event_id",
            "user_id",
            "event_type",
            "value",
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
            us.alias("us"),
            F.floor(us / 1_000_000).alias("sec"),
            service.alias("svc"),
            F.concat_ws("-", service, "user_id", "event_id").alias("pod"),
        )

    @cached_property
    def pods(self) -> DataFrame:
        k = F.col("k").cast("double")
        return self.events.select(
            "system",
            (F.col("sec") - F.col("sec") % CADENCE).alias("ts"),
            "pod",
            service_of(F.col("pod")).alias("entity"),
            F.col("value").alias("cpu"),
            k.alias("mem"),
            (F.col("value") * 1000).alias("net_rx"),
            (k * 1000).alias("net_tx"),
            (F.col("value") / 1000).alias("p90_s"),
            (1.5 * (F.col("value") / 1000)).alias("p99_s"),
            (k / 10).alias("ops"),
            F.when(F.col("event_type") == "error", 0.0).otherwise(100.0).alias("success"),
        )

    @cached_property
    def text_pods(self) -> DataFrame:
        """Pods as read from files: every number is text, and some cpu values are unreadable."""
        bad = F.element_at(F.split("pod", "-"), -1).cast("bigint") % 97 == 0
        numbers = ("cpu", "mem", "net_rx", "net_tx", "p90_s", "p99_s", "ops", "success")
        text = [F.col(c).cast("string").alias(c) for c in numbers]
        text[0] = F.when(bad, "bad").otherwise(F.col("cpu").cast("string")).alias("cpu")
        return self.pods.select("system", "ts", "pod", "entity", *text)

    @cached_property
    def spans(self) -> DataFrame:
        k = F.col("k")
        named = F.concat(F.col("event_type"), F.lit("/svc"), (k % 10).cast("string"))
        return self.events.select(
            "system",
            (F.col("us") * 1000).alias("start_ns"),
            F.round(F.col("value") * 1_000_000).cast("bigint").alias("duration_ns"),
            "pod",
            F.when(k % 5 == 0, F.col("event_type")).otherwise(named).alias("operation"),
            F.when(k % 7 == 0, "root").otherwise("p").alias("parent"),
        )

    @cached_property
    def logs(self) -> DataFrame:
        word = (
            F.when(F.col("event_type") == "error", "ERROR")
            .when(F.col("event_type") == "view", "INFO")
            .when(F.col("event_type") == "click", "warn")
            .when(F.col("event_type") == "signup", "warning")
        )
        line = F.when(F.col("event_id") % 50 == 0, F.lit("not json")).when(
            word.isNull(), F.lit('{"log": "{\\"message\\": \\"ok\\"}"}')
        )
        full = F.concat(F.lit('{"log": "{\\"severity\\": \\"'), word, F.lit('\\"}"}'))
        return self.events.select("system", (F.col("us") * 1000).alias("time_ns"), "pod", line.otherwise(full).alias("log"))

    @cached_property
    def kpis(self) -> DataFrame:
        names = F.array(*[F.lit(n) for n in KPI_NAMES])
        return self.read("lineitem").select(
            named("kpis", "l_orderkey"),
            F.floor(micros(F.col("l_shipdate")) / 1_000_000).alias("ts"),
            F.concat(F.lit("c"), (F.col("l_suppkey") % 10).cast("string")).alias("entity"),
            F.coalesce(F.get(names, F.col("l_linenumber") - 1), F.lit("Unmapped")).alias("kpi_name"),
            F.col("l_quantity").alias("value"),
        )

    @cached_property
    def deps(self) -> DataFrame:
        """All supplier/part pairs as calls, most frequent first, plus one address row per nation."""
        pair = self.read("lineitem").select(
            (F.col("l_suppkey") % 10).cast("string").alias("a"), (F.col("l_partkey") % 10).cast("string").alias("b")
        )
        counts = pair.where(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
        top = counts.withColumn("system", F.lit(SYSTEM))
        line = Window.partitionBy("system").orderBy(F.col("n").desc(), "a", "b")
        named = top.select(
            "system",
            F.concat(F.lit(" Svc"), "a").alias("source"),
            F.concat(F.lit("SVC"), "b", F.lit(" ")).alias("target"),
            (F.row_number().over(line) - 1).cast("bigint").alias("pos"),
        )
        addresses = self.read("nation").select(
            F.lit(SYSTEM).alias("system"),
            F.lit(ENTRY).alias("source"),
            F.concat(F.lit("10.0.0."), F.col("n_nationkey").cast("string")).alias("target"),
            (F.col("n_nationkey") + 100).cast("bigint").alias("pos"),
        )
        return named.unionByName(addresses)

    @cached_property
    def faults(self) -> DataFrame:
        """Labelled faults: the error events of at least `SEVERE` value."""
        kind = F.get(F.array(*[F.lit(t) for t in FAULT_TYPES]), F.col("k") % 5)
        return self.events.where((F.col("event_type") == "error") & (F.col("value") >= SEVERE)).select(
            "system",
            F.col("event_id").alias("fault_id"),
            F.col("sec").alias("ts"),
            F.col("svc").alias("entity"),
            kind.alias("type"),
            F.replace(kind, F.lit("_"), F.lit(" ")).alias("reason"),
            F.concat("svc", F.lit("-1")).alias("component"),
            "k",
        )

    # --- dimensions --------------------------------------------------------------------------

    @cached_property
    def cells(self) -> DataFrame:
        """Service x step means: the only full pass over the raw metrics; dimensions come from here too."""
        return cut(featurize.service_means(self.pods))

    @cached_property
    def entities(self) -> DataFrame:
        return cut(grid.entities(self.cells))

    @cached_property
    def small(self) -> bool:
        """Whether the entity dimension was counted as small; per-entity and per-system tables follow."""
        return joins.fits(self.entities)

    @cached_property
    def names(self) -> DataFrame:
        return self.entities.select("system", F.col("entity").alias("name"), F.col("entity_idx").alias("idx"))

    @cached_property
    def edges(self) -> DataFrame:
        return cut(graph.clean_dependencies(self.deps))

    @cached_property
    def edges_small(self) -> bool:
        return joins.fits(self.edges)

    @cached_property
    def steps(self) -> DataFrame:
        marked = joins.mark_normal(grid.time_steps(self.cells), self.faults, FAULT_SECONDS)
        return cut(joins.usable_steps(marked, self.small))

    @cached_property
    def bare_steps(self) -> DataFrame:
        return self.steps.select("system", "ts", "t_idx", "n_steps")

    @cached_property
    def sessions(self) -> DataFrame:
        """Fault episodes by their time; written once."""
        return cut(episodes.fault_sessions(self.faults, FAULT_SECONDS))

    # --- features ----------------------------------------------------------------------------

    @cached_property
    def grid(self) -> DataFrame:
        return grid.dense_grid(self.steps, self.entities, self.cells, ["entity"], self.small)

    @cached_property
    def paired(self) -> DataFrame:
        """Filled grid with the previous step's values; written once, since statistics, fits and scores read it."""
        return cut(grid.fill_grid(self.grid, previous=True))

    @cached_property
    def filled(self) -> DataFrame:
        return self.paired.drop(*["prev_" + f for f in NODE_FEATURES])

    @cached_property
    def context(self) -> DataFrame:
        return featurize.workload_context(self.filled)

    @cached_property
    def step_context(self) -> DataFrame:
        """The same with what windows and statistics need of a step; one row per step, written once."""
        return cut(featurize.workload_context(self.filled, keys=("system", "ts", "t_idx", "n_steps", "is_normal")))

    @cached_property
    def edge_cells(self) -> DataFrame:
        return featurize.edge_features(self.spans, self.bare_steps, self.names, self.edges, ENTRY, self.small, self.edges_small)

    @cached_property
    def edge_grid(self) -> DataFrame:
        """Edges x steps; written once, since statistics, fits and errors each read it."""
        members = self.edges.select("system", "src", "dst").distinct()
        dense = grid.dense_grid(self.steps, members, self.edge_cells, ["src", "dst"], self.edges_small)
        return cut(grid.zero_fill(dense, EDGE_FEATURES))

    @cached_property
    def runs(self) -> DataFrame:
        """The filled grid as runs of observed cells, with the steps that count in each; written once."""
        made = runs.cell_runs(self.cells, self.steps, self.entities, small=self.small)
        return cut(runs.weighted(made, runs.step_counts(self.steps), joins.fits(self.steps)))

    @cached_property
    def stats(self) -> DataFrame:
        return self.fit.select("system", "entity", "feature", "mean", "std")

    @cached_property
    def normalized(self) -> DataFrame:
        return stats.apply_stats(self.filled, self.stats, ["system", "entity"], small=self.small)

    # --- scores ------------------------------------------------------------------------------

    @cached_property
    def fit(self) -> DataFrame:
        return runs.fit_runs(self.runs, ["system", "entity"], small=self.small)

    @cached_property
    def scored_runs(self) -> DataFrame:
        return score.run_residuals(self.runs, self.fit, ["system", "entity"], small=self.small)

    @cached_property
    def raw_residuals(self) -> DataFrame:
        """Residual of every (step, entity) that has a line; NULL at the first step. Here runs become dense rows."""
        steps = self.steps.select("system", "ts", "t_idx", "n_steps", "is_normal")
        rows = runs.unrolled(self.scored_runs.where("inside IS NOT NULL"), steps, ["entity", "at_start", "inside"])
        residual = F.when(F.col("begins"), F.col("at_start")).otherwise(F.col("inside"))
        return rows.select("system", "ts", "t_idx", "n_steps", "is_normal", "entity", residual.alias("residual"))

    @cached_property
    def residual_rows(self) -> DataFrame:
        """Residuals where some scoring window covers the step, NULL elsewhere."""
        covered = windows.latest_window().isNotNull()
        return self.raw_residuals.withColumn("residual", F.when(covered, F.col("residual")))

    @cached_property
    def residuals(self) -> DataFrame:
        """The same, written once: detection, ranking and evaluation all read it."""
        return cut(self.residual_rows)

    @cached_property
    def overall(self) -> DataFrame:
        """Baseline over the whole episode."""
        return stats.baseline(self.residuals)

    @cached_property
    def splits(self) -> DataFrame:
        return windows.split_windows(windows.label_windows(self.steps))

    @cached_property
    def first_val_windows(self) -> DataFrame:
        return windows.first_windows(self.splits, FIRST_WINDOWS)

    @cached_property
    def base_residuals(self) -> DataFrame:
        """Scored residuals pooled over all validation windows."""
        rows = windows.sliding_windows(self.residuals)
        chosen = self.splits.where(F.col("split") == "val").select("system", "window_start")
        kept = joins.attach(rows, chosen, ["system", "window_start"], "left_semi")
        return kept.where(F.col("residual").isNotNull())

    @cached_property
    def base(self) -> DataFrame:
        """Baseline from validation windows, from the whole episode where there is none."""
        val = stats.baseline(self.base_residuals).select(
            "system", F.col("mu").alias("_m"), F.col("sigma").alias("_s"), F.col("n").alias("_n")
        )
        return self.overall.join(val, "system", "left").select(
            "system",
            F.coalesce("_m", "mu").alias("mu"),
            F.coalesce("_s", "sigma").alias("sigma"),
            F.coalesce("_n", "n").alias("n"),
        )

    # --- detection and ranking ---------------------------------------------------------------

    @cached_property
    def step_peaks(self) -> DataFrame:
        return detect.step_peaks(self.residuals)

    @cached_property
    def intervals(self) -> DataFrame:
        """Sustained intervals above mu + 3 sigma of the baseline."""
        return detect.anomaly_intervals(self.step_peaks, self.base, small=self.small)

    @cached_property
    def entity_peaks(self) -> DataFrame:
        return detect.entity_peaks(self.residuals)

    @cached_property
    def peak_faults(self) -> DataFrame:
        return detect.peak_windows(self.faults, self.entity_peaks, PEAK_BEFORE, PEAK_AFTER, self.small)

    @cached_property
    def reported_faults(self) -> DataFrame:
        return detect.reported_windows(self.faults, self.steps, CADENCE, small=self.small)

    @cached_property
    def axis(self) -> DataFrame:
        return self.steps.groupBy("system").agg(F.max("n_steps").alias("n_steps"))

    @cached_property
    def detected_faults(self) -> DataFrame:
        return detect.detected_windows(
            self.faults, self.intervals, self.residuals, self.base, self.axis, self.small
        )

    @cached_property
    def peak_ranks(self) -> DataFrame:
        return rank.rank_in_windows(self.residuals, self.peak_faults, small=self.small)

    @cached_property
    def downstream(self) -> DataFrame:
        return graph.downstream_counts(self.edges, self.entities)

    @cached_property
    def type_counts(self) -> DataFrame:
        return featurize.category_counts(self.events.withColumn("entity", F.col("svc")), ["system", "entity"], "event_type")

    @cached_property
    def step_mix(self) -> DataFrame:
        hours = self.events.withColumn("ts", F.col("sec") - F.col("sec") % CADENCE)
        return featurize.category_counts(hours, ["system", "ts"], "event_type")

    @cached_property
    def drift(self) -> DataFrame:
        return score.mix_concentration(self.type_counts, small=self.small)

    def fusion(self, how=rank.fuse_evidence) -> DataFrame:
        seen = spans.over_windows(self.residuals, self.peak_faults, spans.level_of(self.overall, 2.0), small=self.small)
        return how(seen, None, self.downstream, self.drift)

    @cached_property
    def fused(self) -> DataFrame:
        return self.fusion()

    @cached_property
    def results(self) -> DataFrame:
        """One row per fault, window around the labelled service's peak."""
        hits = detect.time_hits(self.peak_faults, self.residuals, self.overall, "peak", self.small)
        return evaluate.fault_results(hits, self.peak_ranks, evaluate.role_inference(self.peak_ranks))
