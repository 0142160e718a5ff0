"""A user's model over whole windows: every entity of a window, its edges and its context, together in one call."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from faultline.fixed_values import MIN_WINDOW_STEPS, SCORE_STRIDE, WINDOW

#: Rows of nodes that a task holds together, about.
GROUP_ROWS = 200_000


@dataclass(frozen=True)
class WindowData:
    """One window: rows of its steps, in order of time. `offset` counts steps from `start`."""

    system: str
    start: int
    nodes: pd.DataFrame
    edges: pd.DataFrame
    context: pd.DataFrame


Model = Callable[[WindowData], pd.DataFrame]


def _blocks(width: int, size: int, stride: int) -> Column:
    """The blocks of windows whose steps hold this one: its own, and those before into which windows reach."""
    first = F.greatest(F.ceil((F.col("t_idx") - (size - stride) - width + 1) / width), F.lit(0)).cast("bigint")
    return F.explode(F.sequence(first, F.floor(F.col("t_idx") / width).cast("bigint")))


def _slices(frame: pd.DataFrame, starts: np.ndarray, size: int) -> Iterator[pd.DataFrame]:
    """The rows of each window, by binary search in rows sorted by time."""
    frame = frame.sort_values("t_idx", kind="stable")
    at = frame.t_idx.to_numpy()
    for start, low, high in zip(starts, np.searchsorted(at, starts), np.searchsorted(at, starts + size)):
        part = frame.iloc[low:high]
        yield part.assign(offset=part.t_idx.to_numpy() - start)


def apply_to_windows(
    nodes: DataFrame,
    edges: DataFrame,
    context: DataFrame,
    model: Model,
    schema: str,
    size: int = WINDOW,
    stride: int = SCORE_STRIDE,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """What `model` returns for every scoring window, as rows of `schema`.

    `nodes` (system, t_idx, n_steps, entity, ...), `edges` (system, t_idx, src, dst, ...) and `context` (system, t_idx,
    ...) are cut into blocks of successive windows. A block's rows, and the few after it into which its windows reach,
    meet in one group, and the windows are cut out inside, so rows move once instead of once per window. A block has
    as many windows as keep it near `group_rows` node rows; one window is the least. Windows start at 0, stride,
    2 * stride and so on below max(1, T - size), and need four steps.
    """
    most = nodes.where("t_idx = 0").groupBy("system").count().agg(F.max("count")).first()[0] or 1
    width = max(-(-size // stride), group_rows // (stride * most)) * stride
    both = lambda rows: rows.withColumn("_block", _blocks(width, size, stride))
    shared = [c for c in context.columns if c not in ("system", "t_idx")]
    own = [c for c in nodes.columns if c not in ("system", "t_idx")]
    kinds = dict(nodes.dtypes)
    rest = [F.lit(None).cast(kinds[c]).alias("n_" + c) for c in own]
    laid = nodes.select("system", "t_idx", F.lit(True).alias("is_node"), *[F.col(c).alias("n_" + c) for c in own])
    laid = laid.unionByName(context.select("system", "t_idx", F.lit(False).alias("is_node"), *rest, *[F.col(c).alias("c_" + c) for c in shared]), allowMissingColumns=True)
    left, right = both(laid), both(edges)

    def run(key, rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        system, block = key
        inner = rows.loc[rows.is_node, ["system", "t_idx", *["n_" + c for c in own]]].rename(columns={"n_" + c: c for c in own})
        outer = rows.loc[~rows.is_node, ["system", "t_idx", *["c_" + c for c in shared]]].rename(columns={"c_" + c: c for c in shared})
        if not len(inner):
            return empty
        n = int(inner.n_steps.iloc[0])
        starts = np.arange(block * width, (block + 1) * width, stride)
        starts = starts[(starts < max(1, n - size)) & (n - starts >= MIN_WINDOW_STEPS)]
        parts = zip(starts.tolist(), *(_slices(f, starts, size) for f in (inner, links.drop(columns="_block"), outer)))
        made = [model(WindowData(system, start, a, b, c)) for start, a, b, c in parts]
        return pd.concat(made, ignore_index=True) if made else empty

    empty = pd.DataFrame(columns=[f.split()[0] for f in schema.split(",")])
    return left.groupBy("system", "_block").cogroup(right.groupBy("system", "_block")).applyInPandas(run, schema)


def neighbour_load(window: WindowData) -> pd.DataFrame:
    """Example model: what calls into an entity carry, the callers' load times the calls, per request of the whole
    system, averaged over the window's steps."""
    load = window.nodes[["t_idx", "entity", "workload_ops"]]
    calls = window.edges[["t_idx", "src", "dst", "call_count"]].merge(load.rename(columns={"entity": "src"}), on=["t_idx", "src"])
    calls = calls.merge(window.context[["t_idx", "total_qps"]], on="t_idx")
    calls["carried"] = calls.call_count * calls.workload_ops / (1.0 + calls.total_qps)
    carried = calls.groupby("dst").carried.sum()
    names = np.sort(window.nodes.entity.unique())
    steps = window.nodes.t_idx.nunique()
    score = carried.reindex(names).fillna(0.0).to_numpy() / steps
    return pd.DataFrame({"system": window.system, "window_start": window.start, "entity": names, "score": score})


SCORE_KIND = "system string, window_start bigint, entity string, score double"
