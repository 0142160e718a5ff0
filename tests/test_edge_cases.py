"""Hand-made cases with known answers."""

from pyspark.sql import functions as F

from faultline.functions.categories import kpi_category, log_severity, severity_class, severity_weight
from faultline.functions.names import pod_base, service_of, strip_replica
from faultline.functions.values import number, or_zero
from faultline.operators import detect, grid, joins, rank, score, stats, windows
from faultline.operators.blocks import forward_fill


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def series(spark, values, entity="a", n=None, column="x"):
    data = [("s", entity, i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, f"system string, entity string, t_idx bigint, {column} double")
    return df.withColumn("n_steps", F.lit(n or len(values)).cast("bigint"))


def test_service_names(spark):
    pods = spark.createDataFrame(
        [("a-b",), ("a",), ("ts-order-service-1-2",), ("Frontend-579b9bff58-t2dbm",), ("cartservice2-x-y",)], "p string"
    )
    got = [r[0] for r in pods.select(service_of(F.col("p"))).collect()]
    assert got == ["a", "a", "ts-order-service", "frontend", "cartservice"]
    assert [r[0] for r in pods.select(strip_replica(F.col("p"))).collect()][:2] == ["a", "a"]


def test_pod_of_file_needs_two_dashes(spark):
    paths = spark.createDataFrame([("/m/a-b-c-d_metric.csv",), ("/m/a-b_metric.csv",)], "p string")
    assert [r[0] for r in paths.select(pod_base(F.col("p"))).collect()] == ["a-b", "a-b"]


def test_numbers(spark):
    text = spark.createDataFrame([("1.5",), ("bad",), ("NaN",), ("Infinity",), (None,)], "x string")
    assert [r[0] for r in text.select(number(F.col("x"))).collect()] == [1.5, None, None, None, None]
    nan = spark.createDataFrame([(float("nan"),), (None,), (2.0,)], "x double")
    assert [r[0] for r in nan.select(or_zero(F.col("x"))).collect()] == [0.0, 0.0, 2.0]


def test_severity(spark):
    lines = spark.createDataFrame(
        [
            ('{"log": "{\\"severity\\": \\"WARNING\\"}"}',),
            ('{"log": "{\\"severity\\": \\"Fatal\\"}"}',),
            ('{"log": "plain"}',),
            ("{broken",),
            ('{"other": 1}',),
        ],
        "line string",
    )
    read = lines.select(log_severity(F.col("line")).alias("s"))
    got = [tuple(r) for r in read.select("s", severity_class(F.col("s")), severity_weight(F.col("s"))).collect()]
    assert got == [("warning", "other", 1), ("fatal", "error", 3), ("info", "other", 1), ("info", "other", 1), ("info", "other", 1)]


def test_kpi_categories_take_the_first_match(spark):
    names = ["OSLinux-CPU_CPUCpuUtil", "JVM_Memory_Heap", "jvm-cpu", "Disk_io", "Mysql-Innodb_rows", "zzz", "ThreadUsed_pct"]
    df = spark.createDataFrame([(n,) for n in names], "k string")
    assert [r[0] for r in df.select(kpi_category(F.col("k"))).collect()] == [
        "cpu", "jvm_mem", "jvm_cpu", "disk_io", "mysql_io", None, "threads",
    ]


def test_fill_is_zero_before_the_first_observation(spark):
    df = series(spark, [None, None, None, 5.0, None]).withColumn("observed", F.col("x").isNotNull())
    got = rows(forward_fill(df, ["system", "entity"], ["x"], "observed", previous=["x"]), "t_idx", "x", "prev_x")
    assert got == [(0, 0.0, None), (1, 0.0, 0.0), (2, 0.0, 0.0), (3, 5.0, 0.0), (4, 5.0, 5.0)]


def test_window_counts_at_the_boundary(spark):
    df = series(spark, [float(i) for i in range(24)])
    assert windows.sliding_windows(df, 24, 6).count() == 0
    scored = windows.sliding_windows(df, 24, 12, form="score")
    assert scored.select("window_start").distinct().count() == 1 and scored.count() == 24
    assert windows.sliding_windows(series(spark, [1.0, 2.0, 3.0]), 24, 12, form="score").count() == 0


def test_sliding_windows_equal_the_loop(spark):
    for n in (25, 30, 49, 73):
        for stride in (3, 6, 12, 24, 30):
            df = series(spark, [0.0] * n)
            for form, limit in (("train", n - 24), ("score", max(1, n - 24))):
                want = {(s, t) for s in range(0, limit, stride) for t in range(s, min(n, s + 24))}
                got = {tuple(r) for r in windows.sliding_windows(df, 24, stride, form).select("window_start", "t_idx").collect()}
                assert got == want, (n, stride, form)


def test_latest_window_equals_merged_windows(spark):
    for n, stride in ((24, 12), (30, 12), (50, 24), (61, 8), (10, 12)):
        df = series(spark, [1.0] * n, column="residual")
        scored = windows.sliding_windows(df, 24, stride, "score")
        merged = windows.merge_scores(scored, df.select("system", "entity", "t_idx"))
        direct = df.withColumn("window_start", windows.latest_window(24, stride))
        chosen = lambda df: {tuple(r) for r in df.select("t_idx", "window_start").collect()}
        assert chosen(merged) == chosen(direct)


def test_padding(spark):
    df = series(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    padded = windows.pad_windows(windows.sliding_windows(df, 8, 8, "score"), ["x"], 8)
    assert rows(padded, "offset", "x") == [(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0), (4, 5.0), (5, 0.0), (6, 0.0), (7, 0.0)]


def intervals(spark, values, **kw):
    peaks = series(spark, values, column="peak").drop("entity")
    base = spark.createDataFrame([("s", 0.0, 1.0)], "system string, mu double, sigma double")
    return rows(detect.anomaly_intervals(peaks, base, **kw), "first_hot", "run_length", "start", "stop")


def test_interval_lengths(spark):
    assert intervals(spark, [0.0] * 5 + [9.0] * 2 + [0.0] * 10) == []
    assert intervals(spark, [0.0] * 25 + [9.0] * 3 + [0.0] * 10) == [(25, 3, 5, 33)]
    assert intervals(spark, [0.0] * 25 + [9.0] * 3) == [(25, 3, 5, 28)]
    assert intervals(spark, [9.0] * 3 + [None] + [9.0] * 4 + [0.0]) == [(0, 3, 0, 8), (4, 4, 0, 9)]


def test_equal_means_are_ranked_by_name(spark):
    df = series(spark, [1.0, 1.0], "b", column="residual").unionByName(series(spark, [1.0, 1.0], "a", column="residual"))
    df = df.unionByName(series(spark, [None, None], "c", column="residual"))
    asked = spark.createDataFrame([("s", 0, 2)], "system string, start bigint, stop bigint")
    assert rows(rank.rank_in_windows(df, asked), "rank", "entity") == [(1, "a"), (2, "b"), (3, "c")]


def test_normal_mask_bounds(spark):
    steps = spark.createDataFrame([("s", t) for t in (0, 999, 1000, 1599, 1600)], "system string, ts bigint")
    faults = spark.createDataFrame([("s", 1000)], "system string, ts bigint")
    assert rows(joins.mark_normal(steps, faults), "ts", "is_normal") == [
        (0, True), (999, True), (1000, False), (1599, False), (1600, True),
    ]


def test_stats_use_all_steps_when_none_is_normal(spark):
    df = series(spark, [1.0, 3.0]).withColumn("is_normal", F.lit(False))
    got = stats.normal_stats(df, ["system", "entity"], ["x"]).first()
    assert (got["mean"], round(got["std"], 9)) == (2.0, 1.000001)


def test_asof_drops_outside(spark):
    steps = spark.createDataFrame([("s", t) for t in (100, 200, 90_000)], "system string, ts bigint")
    events = spark.createDataFrame([("s", t) for t in (99, 100, 199, 200, 50_000, 89_999, 90_000, 90_001)], "system string, ts bigint")
    spans = rows(joins.asof_step(events, steps), "ts", "step_ts")
    assert spans == [(100, 100), (199, 100), (200, 200), (50_000, 200), (89_999, 200), (90_000, 90_000)]
    logs = rows(joins.asof_step(events, steps, after_last="keep"), "ts", "step_ts")
    assert logs == spans + [(90_001, 90_000)]
    narrow = rows(joins.asof_step(events, steps, span=7), "ts", "step_ts")
    assert narrow == spans


def test_nobody_crosses(spark):
    df = series(spark, [0.0, 0.0], "a", column="residual").unionByName(series(spark, [0.0, None], "b", column="residual"))
    asked = spark.createDataFrame([("s", 0, 2)], "system string, start bigint, stop bigint")
    base = spark.createDataFrame([("s", 0.0, 1.0)], "system string, mu double, sigma double")
    got = rows(detect.earliest(detect.window_crossings(df, asked, base)), "entity", "first_idx", "is_earliest")
    assert got == [("a", 9999, True), ("b", 9999, True)]


def test_perfect_line_hits_the_deviation_floor(spark):
    df = series(spark, [1.0, 2.0, 4.0, 8.0, 16.0]).withColumn("use_step", F.lit(True))
    paired = df.withColumn("prev_x", F.when(F.col("t_idx") > 0, F.col("x") / 2))
    fit = score.fit_step(paired, ["system", "entity"], ["x"])
    out = score.step_residuals(paired, fit, ["system", "entity"], ["x"])
    got = {r.t_idx: r.residual for r in out.collect()}
    assert got[0] is None and all(abs(got[t] - (-5.0 + 0.9189385332)) < 1e-6 for t in (1, 2, 3, 4))


def test_known_start_window_shifts_left_at_the_end(spark):
    steps = spark.createDataFrame([("s", t * 10, t, 30) for t in range(30)], "system string, ts bigint, t_idx bigint, n_steps bigint")
    faults = spark.createDataFrame([(1, "s", 285), (2, "s", 0), (3, "s", 150)], "fault_id int, system string, ts bigint")
    got = rows(detect.known_start_windows(faults, steps), "fault_id", "start", "stop")
    assert got == [(1, 6, 30), (2, 0, 24), (3, 3, 27)]
