"""Dimensions and the dense time x entity grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from faultline.fixed_values import NODE_FEATURES
from faultline.operators.blocks import forward_fill, number_rows, positions
from faultline.operators.joins import BROADCAST_ROWS, attach, fits, spread

STEP_SPAN = 86_400 * 7
#: Members that travel in one array beside a step.
PACK_MEMBERS = 2048


def entities(rows: DataFrame) -> DataFrame:
    """Distinct entities with a position by name; the order only breaks ties."""
    return positions(rows.select("system", "entity").distinct(), ["entity"], "entity_idx")


def time_steps(rows: DataFrame, span: int = STEP_SPAN) -> DataFrame:
    """Distinct time steps per system with their dense index and the step count."""
    times = rows.select("system", "ts").distinct()
    return number_rows(times, ["system"], "ts", span, out="t_idx", total="n_steps")


def dense_grid(
    steps: DataFrame, members: DataFrame, cells: DataFrame, on: Sequence[str], small: bool | None = None
) -> DataFrame:
    """Every step x every member, joined with the observed cells; `observed` marks the ones with rows.

    `on` names the member columns (an entity, or both ends of an edge). Members are packed into arrays
    and exploded next to each step, so the grid grows from an equality join on the system. Arrays hold about
    `PACK_MEMBERS` members each, however many there are. Steps are a short table that grows by the number of members,
    so they are spread over all tasks first.
    """
    on = list(on)
    most = members.groupBy("system").count().agg(F.max("count")).first()[0] or 0
    packs = max(1, -(-most // PACK_MEMBERS))
    if small is None:
        small = most <= BROADCAST_ROWS and fits(members)
    pack = F.pmod(F.xxhash64(*on), F.lit(packs)).cast("int")
    packed = members.groupBy("system", pack.alias("_pack")).agg(F.collect_list(F.struct(*on)).alias("_members"))
    tiles = steps.withColumn("_pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
    grid = attach(spread(tiles, "system", "ts"), packed, ["system", "_pack"], small=small).select(
        *steps.columns, F.inline("_members")
    )
    seen = cells.withColumn("observed", F.lit(True))
    return grid.join(seen, ["system", "ts", *on], "left").withColumn(
        "observed", F.coalesce("observed", F.lit(False))
    )


def fill_grid(
    grid: DataFrame,
    on: Sequence[str] = ("entity",),
    features: Sequence[str] = NODE_FEATURES,
    previous: bool = False,
) -> DataFrame:
    """Forward fill along time; optionally with the previous step's values beside the current ones."""
    return forward_fill(
        grid, ["system", *on], features, "observed", previous=features if previous else ()
    )


def zero_fill(grid: DataFrame, features: Sequence[str]) -> DataFrame:
    """Absent cells are zero."""
    return grid.select(
        *[c for c in grid.columns if c not in features], *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in features]
    )


def first_steps(rows: DataFrame, k: int) -> DataFrame:
    """Rows of the first k distinct time steps of each system."""
    early = positions(rows.select("system", "ts").distinct(), ["ts"], "_at").where(F.col("_at") < k).select("system", "ts")
    return rows.join(early, ["system", "ts"], "left_semi")


def with_padding(members: DataFrame, wanted: int, prefix: str = "pad") -> DataFrame:
    """Add padding entities up to `wanted` per system, numbered after the real ones."""
    line = F.explode(F.when(F.col("_n") < wanted, F.sequence(F.col("_n"), F.lit(wanted - 1))))
    gaps = members.groupBy("system").agg(F.count("*").alias("_n")).select("system", line.alias("entity_idx"))
    pads = gaps.select(
        "system", F.concat(F.lit(prefix), F.col("entity_idx").cast("string")).alias("entity"), "entity_idx"
    )
    return members.select("system", "entity", "entity_idx").unionByName(pads)


def stack(parts: Sequence[DataFrame], key: str, labels: Sequence[str]) -> DataFrame:
    """Concatenate days or datasets along time, keeping which one each row came from."""
    tagged = [p.withColumn(key, F.lit(label)) for p, label in zip(parts, labels)]
    out = tagged[0]
    for part in tagged[1:]:
        out = out.unionByName(part)
    return out


def union_entities(parts: Sequence[DataFrame]) -> DataFrame:
    """Distinct entities over several days."""
    out = parts[0].select("system", "entity")
    for part in parts[1:]:
        out = out.unionByName(part.select("system", "entity"))
    return out.distinct()
