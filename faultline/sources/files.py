"""Telemetry files: metric, trace, log, KPI, dependency and fault files to DataFrames.

Every scan is one Spark job over all files of one kind of header; the driver only handles paths and column names.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from faultline.fixed_values import METRIC_POSITIONS, SERVICE_COLUMNS, SERVICE_METRIC_FILES, TIME_COLUMNS
from faultline.functions.names import pod_base, service_of
from faultline.functions.values import number, ms_to_seconds, service_features, whole
from faultline.operators.joins import attach
from faultline.session import cut

METRIC_COLUMNS = 20
FAULT_RECORD = "struct<inject_time: string, inject_timestamp: string, inject_pod: string, inject_type: string>"
FAULT_ENTRY = f"map<string, array<{FAULT_RECORD}>>"


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a glob on any file system Spark can read, in name order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(path)
    return sorted(str(s.getPath()) for s in found) if found is not None else []


def read_csv(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    """CSV with a header, every column as text; a schema reads by position."""
    reader = spark.read.option("header", True)
    if schema:
        reader = reader.schema(schema)
    return reader.csv(paths)


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The files at or below a path, without markers and hidden ones, in name order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    names = []
    while found.hasNext():
        name = str(found.next().getPath())
        if not posixpath.basename(name).startswith(("_", ".")):
            names.append(name)
    return sorted(names)


def header_of(spark: SparkSession, path: str) -> str | None:
    """First line of a text file, compressed or not; None if it is empty."""
    at, conf = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()
    stream = at.getFileSystem(conf).open(at)
    try:
        codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
        text = spark._jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8")
        return spark._jvm.java.io.BufferedReader(text).readLine()
    finally:
        stream.close()


def read_by_header(
    spark: SparkSession, paths: str | list[str], pick: Callable[[DataFrame], DataFrame | None], **options: str
) -> DataFrame:
    """`pick` of the rows of each distinct header, put together: a scan binds all its files to one column order.

    `pick` selects by name and may return None for a header it has no use for. Files without a line are passed over.
    """
    files = [f for p in ([paths] if isinstance(paths, str) else paths) for f in data_files(spark, p)]
    kinds: dict[str, list[str]] = {}
    with ThreadPoolExecutor(16) as pool:
        for path, header in zip(files, pool.map(lambda f: header_of(spark, f), files)):
            if header:
                kinds.setdefault(header, []).append(path)
    out = None
    for same in kinds.values():
        part = pick(spark.read.options(header=True, **options).csv(same))
        if part is not None:
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError(f"no file with usable columns at {paths}")
    return out


def text_column(raw: DataFrame, name: str) -> Column:
    """A column by name, NULL where this header lacks it."""
    return F.col(name) if name.lower() in map(str.lower, raw.columns) else F.lit(None).cast("string")


def metric_files(spark: SparkSession, directory: str, system: str) -> DataFrame:
    """All `*_metric.csv` of a directory, columns taken by position, values still text."""
    schema = ", ".join(f"c{i} string" for i in range(METRIC_COLUMNS))
    raw = read_csv(spark, posixpath.join(directory, "*_metric.csv"), schema)
    named = {name: F.col(f"c{at}") for name, at in METRIC_POSITIONS.items()}
    rows = raw.select(
        F.lit(system).alias("system"),
        whole(named.pop("ts")).alias("ts"),
        named.pop("pod").alias("pod"),
        *[c.alias(name) for name, c in named.items()],
        pod_base(F.col("_metadata.file_path")).alias("file_pod"),
    )
    return rows.where(F.col("ts").isNotNull() & F.col("pod").isNotNull()).withColumn("entity", service_of(F.col("pod")))


def trace_files(spark: SparkSession, directory: str, system: str, max_files: int | None = None) -> DataFrame:
    """`*_trace.csv` of a directory, optionally only the first files in name order."""
    paths = list_paths(spark, posixpath.join(directory, "*_trace.csv"))[:max_files]

    def pick(raw: DataFrame) -> DataFrame:
        return raw.select(
            F.lit(system).alias("system"),
            whole(text_column(raw, "StartTimeUnixNano")).alias("start_ns"),
            whole(text_column(raw, "Duration")).alias("duration_ns"),
            F.coalesce(text_column(raw, "PodName"), F.lit("")).alias("pod"),
            text_column(raw, "OperationName").alias("operation"),
            F.coalesce(text_column(raw, "ParentID"), F.lit("")).alias("parent"),
        )

    rows = read_by_header(spark, paths, pick)
    return rows.where(F.col("start_ns").isNotNull() & F.col("duration_ns").isNotNull() & F.col("operation").isNotNull())


def log_files(spark: SparkSession, directory: str, system: str, max_files: int | None = None) -> DataFrame:
    """Log `*.csv` of a directory; JSON inside the text keeps its quotes."""
    paths = list_paths(spark, posixpath.join(directory, "*.csv"))[:max_files]

    def pick(raw: DataFrame) -> DataFrame:
        return raw.select(
            F.lit(system).alias("system"),
            whole(text_column(raw, "TimeUnixNano")).alias("time_ns"),
            text_column(raw, "PodName").alias("pod"),
            text_column(raw, "Log").alias("log"),
        )

    rows = read_by_header(spark, paths, pick, escape='"')
    return rows.where(F.col("time_ns").isNotNull() & F.col("pod").isNotNull())


def dependency_file(spark: SparkSession, path: str, system: str) -> DataFrame:
    """Two-column dependency list with the row's place: files in name order, rows as they stand in their file.

    `pos` grows along the list, with gaps. Ids within a task follow the rows of a file's split but not the order of
    files, so each split is first given its own turn; there is one row for each split to order.
    """
    raw = read_csv(spark, path, "source string, target string")
    here = raw.select(
        "source", "target", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"),
        F.monotonically_increasing_id().alias("_id"),
    )
    places = here.select("_file", "_from").distinct()
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_file", "_from")) - 1
    placed = attach(here, places.select("_file", "_from", turn.cast("bigint").alias("_turn")), ["_file", "_from"])
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select(
        F.lit(system).alias("system"), "source", "target", (F.shiftleft("_turn", 33) + within).alias("pos")
    )


#: Records of one file over which the hour is carried in one task.
HOUR_BLOCK = 4096
#: In a chunk of a fault object: the names of the arrays begun before the record, the last of them kept, and the record.
FAULT_CHUNK = r'(?s)^(?:[\s\],]*"((?:[^"\\]|\\.)*)"\s*:\s*\[)*[\s\],]*(\{.*)$'


def _before(rows: DataFrame, **parts: Column) -> DataFrame:
    """Add for each named column its sum over all earlier rows of the file.

    Rows are in order of (_from, _id). Each range of bytes is summed on its own; one row per range is ordered as a file.
    """
    home = ["_file", "_from"]
    rows = rows.withColumns({"_p_" + k: v.cast("bigint") for k, v in parts.items()})
    ranges = rows.groupBy(*home).agg(*[F.sum("_p_" + k).alias("_s_" + k) for k in parts])
    line = Window.partitionBy("_file").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    carry = ranges.select(*home, *[F.coalesce(F.sum("_s_" + k).over(line), F.lit(0)).alias("_c_" + k) for k in parts])
    inside = Window.partitionBy(*home).orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = {k: F.coalesce(F.sum("_p_" + k).over(inside), F.lit(0)) for k in parts}
    met = rows.withColumns(sums).join(carry, home)
    return met.withColumns({k: F.col(k) + F.col("_c_" + k) for k in parts}).drop(*[x + k for k in parts for x in ("_p_", "_c_")])


def object_chunks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(_file, turn, text): the text of JSON files that hold one object of arrays of records, one row per record with
    what stands before it.

    A file is read in byte ranges by several tasks, cut at closing braces. Whether a brace is inside a string follows
    from the quotes before it, and how deep it is from the braces before it outside strings; both are counted per range
    and added up over ranges. A record ends where a closing brace leads back to the depth of the whole object.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    rows = raw.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_from"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    rows = cut(rows)  # read once, with fixed row ids
    bare = F.regexp_replace("value", r"\\.", "")  # without escapes, each quote opens or closes a string
    quoted = _before(rows.withColumn("_bare", bare), quotes=F.length(bare) - F.length(F.replace(bare, F.lit('"'))))
    pieces = F.split("_bare", '"')
    outside = F.array_join(F.filter(pieces, lambda x, i: (i + F.col("quotes")) % 2 == 0), "")
    open_ends = (F.size(pieces) - 1 + F.col("quotes")) % 2 == 0
    opened = F.length(outside) - F.length(F.replace(outside, F.lit("{")))
    braces = quoted.withColumn("_delta", opened - open_ends.cast("int")).withColumn("_real", open_ends)
    deep = _before(braces, depth=F.col("_delta"))
    done = F.col("_real") & (F.col("depth") + F.col("_delta") == 1)
    placed = _before(deep, turn=done)
    parts = F.sort_array(F.collect_list(F.struct("_from", "_id", "value")))
    return placed.groupBy("_file", "turn").agg(F.array_join(F.transform(parts, lambda x: F.concat(x["value"], F.lit("}"))), "").alias("text"))


def fault_file(spark: SparkSession, path: str | list[str], system: str, lines: bool = False) -> DataFrame:
    """JSON object hour -> list of faults, flattened; with `lines`, one such object per line.

    A file of one object is split between tasks (`object_chunks`), and each record is parsed on its own; the hour is
    that of the nearest earlier record that begins an array. An empty file or object has no faults.
    """
    if lines:
        hours = spark.read.text(path).select(F.explode(F.from_json("value", FAULT_ENTRY)).alias("hour", "entries"))
        faults = hours.select("hour", F.inline("entries"))
    else:
        first = F.when(F.col("turn") == 0, F.regexp_replace("text", r"^\s*\{", "")).otherwise(F.col("text"))
        chunks = object_chunks(spark, path).select("_file", "turn", first.alias("text"))
        name, body = F.regexp_extract("text", FAULT_CHUNK, 1), F.regexp_extract("text", FAULT_CHUNK, 2)
        begins = F.when(F.col("text").rlike(r'^[\s\],]*"'), F.get_json_object(F.concat(F.lit('{"k":"'), name, F.lit('"}')), "$.k"))
        found = chunks.select("_file", "turn", begins.alias("hour"), body.alias("body")).where("body <> ''")
        placed = found.withColumn("_block", F.floor(F.col("turn") / HOUR_BLOCK))
        ends = placed.groupBy("_file", "_block").agg(F.max_by("hour", F.when(F.col("hour").isNotNull(), F.col("turn"))).alias("_end"))
        line = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        carry = ends.select("_file", "_block", F.last("_end", ignorenulls=True).over(line).alias("_carry"))
        inside = Window.partitionBy("_file", "_block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
        met = placed.withColumn("_own", F.last("hour", ignorenulls=True).over(inside)).join(carry, ["_file", "_block"])
        faults = met.select(F.coalesce("_own", "_carry").alias("hour"), F.from_json("body", FAULT_RECORD).alias("_f")).select("hour", "_f.*")
    return faults.select(
        F.lit(system).alias("system"),
        "hour",
        "inject_time",
        whole(F.col("inject_timestamp")).alias("ts"),
        F.col("inject_pod").alias("pod"),
        F.col("inject_type").alias("type"),
        service_of(F.col("inject_pod")).alias("entity"),
    )


def record_file(spark: SparkSession, path: str, system: str) -> DataFrame:
    """Fault records; the level is "pod" when the file has no such column."""
    raw = read_csv(spark, path)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in raw.columns else F.lit("")
    level = F.col("level") if "level" in raw.columns else F.lit("pod")
    return raw.select(
        F.lit(system).alias("system"),
        text("component").alias("component"),
        text("reason").alias("reason"),
        number(F.col("timestamp")).alias("timestamp"),
        level.alias("level"),
    )


def kpi_file(spark: SparkSession, path: str | list[str], system: str) -> DataFrame:
    """Long KPI file; column names in any letter case, falling back to position."""


    def pick(raw: DataFrame) -> DataFrame:
        def column(names: tuple[str, ...], fallback: str) -> Column:
            return F.col(next((c for c in raw.columns if c.lower() in names), fallback))

        return raw.select(
            F.lit(system).alias("system"),
            whole(column(("timestamp",), raw.columns[0])).alias("ts"),
            column(("cmdb_id",), raw.columns[1]).alias("entity"),
            column(("kpi_name", "name"), raw.columns[2]).alias("kpi_name"),
            number(column(("value",), raw.columns[-1])).alias("value"),
        )

    return read_by_header(spark, path, pick)


def day_directories(spark: SparkSession, telemetry: str, max_days: int | None = None) -> list[str]:
    """Names of the day directories (they start with "20"), sorted, the first `max_days`."""
    return [posixpath.basename(p) for p in list_paths(spark, posixpath.join(telemetry, "20*"))][:max_days]


def service_metric_files(spark: SparkSession, data_dir: str, system: str, max_days: int | None = None) -> DataFrame:
    """Service-level metrics of several days as the eight features.

    Each day has one of two kinds of file. Column names are looked up in each header, and files of one header are
    read by one job. `day` stays a column, so seams between days can be told.
    """
    telemetry = posixpath.join(data_dir, "telemetry")
    paths = []
    for day in day_directories(spark, telemetry, max_days):
        for name in SERVICE_METRIC_FILES:
            path = posixpath.join(telemetry, day, "metric", name)
            if list_paths(spark, path):
                paths.append(path)
                break
    if not paths:
        raise FileNotFoundError(f"no service metric files below {telemetry}")
    return read_by_header(spark, paths, lambda raw: _service_rows(raw, system))


def _service_rows(raw: DataFrame, system: str) -> DataFrame | None:
    service = next((c for c in SERVICE_COLUMNS if c in raw.columns), None)
    time = next((c for c in TIME_COLUMNS if c in raw.columns), None)
    if service is None or time is None:
        return None
    seconds = ms_to_seconds(number(F.col(time))) if time == "startTime" else whole(F.col(time))
    keyed = raw.withColumns(
        {
            "system": F.lit(system),
            "day": F.regexp_extract("_metadata.file_path", "/(20[^/]*)/metric/", 1),
            "ts": seconds,
            "entity": F.col(service),
        }
    )
    return service_features(keyed.where(F.col("ts").isNotNull()), ["system", "day", "ts", "entity"])


# --- writing ---------------------------------------------------------------------------------


def write_by_name(df: DataFrame, root: str, column: str, below: str = "", escape: str | None = None) -> None:
    """Write CSV below `root`, one entry per value of `column`, named by the value alone.

    `below` is a path added under each entry. The data is written by one job; the driver then only
    renames entries.
    """
    writer = df.write.partitionBy(column).option("header", True)
    if escape:
        writer = writer.option("escape", escape)
    writer.csv(root)
    spark = df.sparkSession
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in list_paths(spark, posixpath.join(root, f"{column}=*")):
        name = posixpath.basename(found).split("=", 1)[1]
        target = posixpath.join(root, name, below) if below else posixpath.join(root, name)
        to = spark._jvm.org.apache.hadoop.fs.Path(target)
        system.mkdirs(to.getParent())
        system.rename(spark._jvm.org.apache.hadoop.fs.Path(found), to)


def merge_entries(spark: SparkSession, staged: str, root: str) -> None:
    """Move every entry of `staged` below `root`; contents stay where the file system has them."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(base)
    for found in list_paths(spark, posixpath.join(staged, "20*")):
        system.rename(
            spark._jvm.org.apache.hadoop.fs.Path(found),
            spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(root, posixpath.basename(found))),
        )
