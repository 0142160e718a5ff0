"""Ordered operators over long series, done block by block.

A plain window over (system, entity) puts a whole series into one task. Here every series is cut into
blocks; only one summary row per block is ordered as a whole, and rows meet their block's summary
through an equality join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from faultline.session import cut

BLOCK = 4096
#: Rows that are ordered in one task where positions are given out.
PART_ROWS = 1 << 20


def number_rows(
    df: DataFrame, keys: Sequence[str], order: str, span: int, out: str, total: str | None = None
) -> DataFrame:
    """0-based position of each row within its key, by a unique integer `order` column.

    `span` is the width of a block in units of `order`, so a block holds at most `span` rows.
    """
    keys = list(keys)
    home = keys + ["_blk"]
    laid = df.withColumn("_blk", F.floor(F.col(order) / span))
    sizes = laid.groupBy(*home).agg(F.count("*").alias("_n"))
    line = Window.partitionBy(*keys).orderBy("_blk")
    before = F.coalesce(F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*home, before.alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"))
    inside = F.row_number().over(Window.partitionBy(*home).orderBy(order))
    placed = laid.withColumn("_pos", inside).join(offsets, home)
    extra = [F.col("_all").alias(total)] if total else []
    return placed.select(*df.columns, (F.col("_pos") - 1 + F.col("_before")).cast("bigint").alias(out), *extra)


def positions(df: DataFrame, order: Sequence[str], out: str, per_part: int = PART_ROWS) -> DataFrame:
    """0-based position of each row within its system by unique `order` columns, whatever their type.

    Rows are dealt to sampled ranges of (system, order), `per_part` to each, and written in them; a position is the
    place within the range and system, plus what the system's rows in earlier ranges count. Only the first system of
    a range can have such rows, so the driver adds up one row per range. Fewer rows than one range holds are sorted in
    one task. No system is ever gathered.
    """
    parts = -(-df.count() // per_part)
    line = ["system", *order]
    if parts <= 1:
        place = F.row_number().over(Window.partitionBy("system").orderBy(*order)) - 1
        return df.repartition(1).withColumn(out, place.cast("bigint"))
    dealt = df.repartitionByRange(parts, *line).withColumn("_part", F.spark_partition_id())
    held = cut(dealt)
    inside = Window.partitionBy("_part", "system").orderBy(*order)
    sizes = held.groupBy("_part", "system").agg(F.count("*").alias("n"))
    ends = sizes.groupBy("_part").agg(F.min(F.struct("system", "n")).alias("head"), F.max(F.struct("system", "n")).alias("tail"))
    carries, open_, count = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        before = count if r.head.system == open_ else 0
        carries.append((r["_part"], r.head.system, before))
        count = r.tail.n + (before if r.tail.system == r.head.system else 0)
        open_ = r.tail.system
    carry = df.sparkSession.createDataFrame(carries, "_part int, system string, _before bigint")
    placed = held.withColumn("_in", F.row_number().over(inside) - 1).join(F.broadcast(carry), ["_part", "system"], "left")
    return placed.select(*df.columns, (F.col("_in") + F.coalesce("_before", F.lit(0))).cast("bigint").alias(out))


def forward_fill(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    observed: str,
    order: str = "t_idx",
    previous: Sequence[str] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Replace unobserved cells by the last observed one of the same key, 0 before the first.

    A cell is filled as a whole: where the boolean `observed` is true its values are kept (NULL as 0).
    For every column in `previous`, `prev_<column>` is the filled value one step earlier (NULL at the
    first step); it comes out of the same sort.
    """
    keys = list(keys)
    home = keys + ["_blk"]
    cell = F.struct(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols])
    laid = df.withColumn("_blk", F.floor(F.col(order) / block)).withColumn("_cell", F.when(F.col(observed), cell))
    ends = laid.groupBy(*home).agg(F.max_by("_cell", F.when(F.col(observed), F.col(order))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*home, F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    inside = Window.partitionBy(*home).orderBy(order)
    zero = F.struct(*[F.lit(0.0).alias(c) for c in cols])
    entering = F.coalesce(F.col("_carry"), zero)
    filled = laid.join(carry, home, "left").withColumn(
        "_cell", F.coalesce(F.last("_cell", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), entering)
    )
    back = []
    if previous:
        earlier = F.coalesce(F.lag("_cell").over(inside), F.when(F.col("_blk") > 0, entering))
        filled = filled.withColumn("_prev", earlier)
        back = [F.col("_prev")[c].alias("prev_" + c) for c in previous]
    kept = [c for c in df.columns if c not in cols]
    return filled.select(*kept, *[F.col("_cell")[c].alias(c) for c in cols], *back)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    order: str = "t_idx",
    block: int = BLOCK,
) -> DataFrame:
    """Add `prev_<column>`: the value one step earlier on a gapless 0-based index.

    The last row of each block is also sent to the next block, which is all a lag of one needs.
    """
    keys = list(keys)
    home = F.floor(F.col(order) / block)
    targets = F.when((F.col(order) + 1) % block == 0, F.array(home, home + 1)).otherwise(F.array(home))
    sent = df.withColumn("_home", home).withColumn("_blk", F.explode(targets))
    line = Window.partitionBy(*keys, "_blk").orderBy(order)
    lagged = sent.select("*", *[F.lag(c).over(line).alias("prev_" + c) for c in cols])
    return lagged.where(F.col("_home") == F.col("_blk")).drop("_home", "_blk")
