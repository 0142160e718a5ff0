"""End-to-end runs: build a dataset, evaluate around peaks, evaluate inside detected intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.fixed_values import CONTEXT_FEATURES, EDGE_FEATURES, NODE_FEATURES, TRAIN_STRIDE, WINDOW
from faultline.operators import detect, episodes, evaluate, rank, stats, windows
from faultline.operators.joins import attach, fits
from faultline.plans.views import Tables
from faultline.session import cut, scratch_path
from faultline.sources import dataset


def build_dataset(t: Tables, root: str | None = None, size: int = WINDOW, stride: int = TRAIN_STRIDE) -> str:
    """Normalize, cut into windows, split, and write; returns the root."""
    root = root or scratch_path(t.spark, "dataset")
    splits = windows.split_windows(windows.label_windows(t.steps, size, stride), size).select(
        "system", "window_start", "split"
    )
    few = fits(splits)
    edge_key = ["system", "src", "dst"]
    edge_stats = stats.normal_stats(t.edge_grid, edge_key, EDGE_FEATURES)
    edges = stats.apply_stats(t.edge_grid, edge_stats, edge_key, EDGE_FEATURES, t.edges_small)
    context_stats = stats.normal_stats(t.step_context, ["system"], CONTEXT_FEATURES)
    context = stats.apply_stats(t.step_context, context_stats, ["system"], CONTEXT_FEATURES)
    for kind, rows in (("nodes", t.normalized), ("edges", edges), ("context", context)):
        keys, features = dataset.KINDS[kind]
        cut_up = attach(windows.sliding_windows(rows, size, stride), splits, ["system", "window_start"], small=few)
        kept = cut_up.where(F.col("split") != "fault").select(
            "split", "system", "window_start", "offset", "t_idx", *keys, *features
        )
        dataset.write_windows(root, kind, kept)
    dataset.write_stats(root, "nodes", t.stats)
    dataset.write_stats(root, "edges", edge_stats)
    dataset.write_stats(root, "context", context_stats)
    dataset.write_names(root, t.entities, t.edges)
    # An episode is stored as measured; a reader normalizes it once, with the stored stats.
    step = ["system", "ts", "t_idx", "n_steps", "is_normal"]
    own = cut(episodes.in_episodes(t.steps.select("system", "ts"), t.sessions))
    placed = lambda rows: attach(rows, own, ["system", "ts"], "left")
    dataset.write_episodes(
        root,
        episodes.in_episodes(t.faults, t.sessions),
        nodes=placed(t.filled.select(*step, "entity", *NODE_FEATURES)),
        edges=placed(t.edge_grid.select(*step, "src", "dst", *EDGE_FEATURES)),
        context=placed(t.step_context),
    )
    dataset.write_metadata(root, t.spark, window_size=size, stride=stride, node_features=",".join(NODE_FEATURES))
    return root


def evaluate_peaks(t: Tables) -> DataFrame:
    """Summary with each fault's window around the labelled service's peak."""
    return evaluate.summary(t.results)


def evaluate_detected(t: Tables) -> DataFrame:
    """Summary with each fault's window taken from the detected intervals."""
    placed = detect.time_hits(t.detected_faults, t.residuals, t.base, "any", t.small)
    rankings = rank.rank_in_windows(t.residuals, t.detected_faults, small=t.small)
    return evaluate.summary(evaluate.fault_results(placed, rankings, evaluate.role_inference(rankings)))


def evaluate_reported(t: Tables) -> DataFrame:
    """Summary with each fault's window around its reported time."""
    placed = detect.time_hits(t.reported_faults, t.residuals, t.base, "report", t.small)
    rankings = rank.rank_in_windows(t.residuals, t.reported_faults, small=t.small)
    return evaluate.summary(evaluate.fault_results(placed, rankings, evaluate.role_inference(rankings)))
