"""Stream results equal batch results."""

from pyspark.sql import functions as F

from faultline.operators import detect, featurize
from faultline.streaming.intervals import stream_intervals
from faultline.streaming.logs import stream_log_windows


def drain(stream, name, spark, tmp_path):
    run = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    run.awaitTermination(120)
    return spark.table(name)


def test_log_windows(spark, tmp_path):
    data = [("s", e, ts, sev) for ts in range(1000, 1600, 7) for e, sev in (("a", "error"), ("b", "warn"), ("b", "info"))]
    lines = spark.createDataFrame(data, "system string, entity string, ts bigint, severity string")
    source = str(tmp_path / "lines")
    lines.unionByName(lines.limit(1).withColumn("ts", F.lit(90_000).cast("bigint"))).write.parquet(source)
    stream = spark.readStream.schema(lines.schema).parquet(source)
    got = drain(stream_log_windows(stream, anchor=1000), "log_windows", spark, tmp_path)
    batch = featurize.log_windows(lines, small=True).withColumn("window_start", F.col("w") * 60 + 1000)
    cols = ["window_start", "entity", "total", "errors", "warns", "severity_sum"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))


def test_intervals(spark, tmp_path):
    values = [0, 0, 9, 9, 9, 0, 9, 9, 0, 9, 9, 9, 9, 0, 0]
    rows = [("s", i, float(v)) for i, v in enumerate(values)]
    peaks = spark.createDataFrame(rows, "system string, t_idx bigint, peak double").coalesce(1)
    source = str(tmp_path / "peaks")
    for lo, hi in ((0, 4), (4, 11), (11, 15)):
        peaks.where((F.col("t_idx") >= lo) & (F.col("t_idx") < hi)).write.mode("append").parquet(source)
    stream = spark.readStream.schema(peaks.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = drain(stream_intervals(stream, 3.0), "intervals_out", spark, tmp_path)
    base = spark.createDataFrame([("s", 0.0, 1.0)], "system string, mu double, sigma double")
    batch = detect.anomaly_intervals(peaks.withColumn("n_steps", F.lit(1000).cast("bigint")), base, small=True)
    cols = ["first_hot", "run_length", "start", "stop"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))
