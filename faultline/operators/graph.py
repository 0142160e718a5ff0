"""Dependency graph operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.fixed_values import HOP_DECAY, HOP_DELAY, LEAK_SLOPE
from faultline.functions.names import clean_endpoint, is_address
from faultline.operators.blocks import positions
from faultline.operators.joins import attach
from faultline.session import cut


def clean_dependencies(deps: DataFrame) -> DataFrame:
    """Lower-cased, trimmed endpoints; rows whose target is an address are dropped."""
    cleaned = deps.withColumn("src", clean_endpoint(F.col("source"))).withColumn("dst", clean_endpoint(F.col("target")))
    return cleaned.where(~is_address(F.col("dst"))).drop("source", "target")


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Nodes in order of first appearance (source before target of the same row)."""
    ends = F.array(
        F.struct(F.col("src").alias("entity"), (F.col("pos") * 2).alias("_at")),
        F.struct(F.col("dst").alias("entity"), (F.col("pos") * 2 + 1).alias("_at")),
    )
    seen = edges.select("system", F.inline(ends)).groupBy("system", "entity").agg(F.min("_at").alias("_at"))
    return positions(seen, ["_at"], "entity_idx").drop("_at")


def ring(nodes: DataFrame, cap: int | None = None) -> DataFrame:
    """Stand-in ring e -> e + 1 mod N with default edge features, capped by `cap`."""
    sized = nodes.groupBy("system").agg(F.count("*").alias("_n"))
    here = nodes.join(sized, "system")
    nxt = nodes.select("system", F.col("entity").alias("dst"), F.col("entity_idx").alias("_to"))
    linked = here.withColumn("_to", (F.col("entity_idx") + 1) % F.col("_n")).join(nxt, ["system", "_to"])
    if cap is not None:
        linked = linked.where(F.col("entity_idx") < cap)
    return _defaults(linked.select("system", F.col("entity").alias("src"), "dst", F.col("entity_idx").alias("pos")))


def chain(nodes: DataFrame) -> DataFrame:
    """Stand-in chain i -> i + 1 with default edge features."""
    nxt = nodes.select("system", F.col("entity").alias("dst"), (F.col("entity_idx") - 1).alias("entity_idx"))
    linked = nodes.join(nxt, ["system", "entity_idx"])
    return _defaults(linked.select("system", F.col("entity").alias("src"), "dst", F.col("entity_idx").alias("pos")))


def _defaults(edges: DataFrame) -> DataFrame:
    return edges.select(
        "*",
        F.lit(0.0).alias("call_count"),
        F.lit(0.0).alias("error_rate"),
        F.lit(1.0).alias("avg_latency_ms"),
        F.lit(0.0).alias("max_latency_ms"),
    )


def present_edges(edges: DataFrame, members: DataFrame, small: bool | None = None) -> DataFrame:
    """Edges between present services; a system where none remains gets the chain of its services."""
    known = members.select("system", "entity")
    kept = attach(edges, known.withColumnRenamed("entity", "src"), ["system", "src"], "left_semi", small)
    kept = attach(kept, known.withColumnRenamed("entity", "dst"), ["system", "dst"], "left_semi", small)
    kept = kept.select("system", "src", "dst", F.lit(False).alias("stand_in"))
    bare = members.join(kept.select("system").distinct(), "system", "left_anti")
    made = chain(bare).select("system", "src", "dst", F.lit(True).alias("stand_in"))
    return kept.unionByName(made)


def downstream_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct direct callees per node, 0 when it calls nobody."""
    counts = edges.groupBy("system", F.col("src").alias("entity")).agg(F.count_distinct("dst").alias("_n"))
    return nodes.select("system", "entity").join(counts, ["system", "entity"], "left").select(
        "system", "entity", F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_downstream")
    )


def blast_radius(
    edges: DataFrame, roots: DataFrame, max_depth: int | None = None, intensity: float = 1.0, small: bool | None = None
) -> DataFrame:
    """Services reached from each root, with shortest depth, expected delay and decayed impact.

    One join per hop over the frontier only; each hop's reach is written to the shared folder, so
    lineage does not grow with depth. Without `max_depth` it goes on until nothing new is reached.
    """
    links = cut(edges.select("system", "src", "dst").where(F.col("src") != F.col("dst")).distinct())
    frontier = cut(roots.select("system", F.col("entity").alias("root"), F.col("entity").alias("node")).distinct())
    visited = frontier
    found = []
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        hop = links.select("system", F.col("src").alias("node"), F.col("dst").alias("_next"))
        reached = frontier.join(hop, ["system", "node"]).select("system", "root", F.col("_next").alias("node")).distinct()
        frontier = cut(reached.join(visited, ["system", "root", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        found.append(frontier.withColumn("depth", F.lit(depth).cast("bigint")))
        visited = visited.unionByName(frontier)
    if not found:
        found = [frontier.withColumn("depth", F.lit(0).cast("bigint")).where(F.lit(False))]
    out = reduce(DataFrame.unionByName, found)
    return out.withColumn("delay", F.col("depth") * HOP_DELAY).withColumn(
        "impact", F.pow(F.lit(HOP_DECAY), F.col("depth") - 1) * intensity
    )


def gather_ends(
    edges: DataFrame, rows: DataFrame, features: Sequence[str], small: bool | None = None
) -> DataFrame:
    """Per edge and step, the features of both ends side by side."""
    links = edges.select("system", "src", "dst").distinct()
    start = rows.select("system", "ts", F.col("entity").alias("src"), *[F.col(f).alias("src_" + f) for f in features])
    end = rows.select("system", "ts", F.col("entity").alias("dst"), *[F.col(f).alias("dst_" + f) for f in features])
    return attach(start, links, ["system", "src"], small=small).join(end, ["system", "ts", "dst"])


def leaky(x: Column) -> Column:
    return F.when(x >= 0, x).otherwise(LEAK_SLOPE * x)


def neighbour_weights(rows: DataFrame, score: Column) -> DataFrame:
    """Softmax of an edge score over the edges that enter the same service at the same step."""
    group = Window.partitionBy("system", "ts", "dst")
    step = rows.withColumn("_s", leaky(score)).withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(group)))
    return step.withColumn("weight", F.col("_e") / (F.sum("_e").over(group) + 1e-8)).drop("_s", "_e")


def upstream_pressure(weighted: DataFrame, features: DataFrame, feature: str) -> DataFrame:
    """Weighted sum of the callers' feature per service and step."""
    start = features.select("system", "ts", F.col("entity").alias("src"), F.col(feature).alias("_x"))
    joined = weighted.join(start, ["system", "ts", "src"])
    return joined.groupBy("system", "ts", F.col("dst").alias("entity")).agg(
        F.sum(F.col("weight") * F.col("_x")).alias("pressure")
    )
