"""Sustained anomaly intervals on a stream of step peaks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from faultline.fixed_values import LOOKBACK, SUSTAIN, TAIL

OUTPUT = "system string, first_hot bigint, run_length bigint, start bigint, stop bigint"
STATE = "first_hot bigint, last_hot bigint"


def stream_intervals(
    peaks: DataFrame, threshold: float, sustain: int = SUSTAIN, lookback: int = LOOKBACK, tail: int = TAIL
) -> DataFrame:
    """Intervals of at least `sustain` steps above `threshold`, emitted when the run has ended.

    `peaks` has (system, t_idx, peak) in step order from batch to batch. State is two numbers per system.
    The end is not clamped, since a stream has no last step.
    """

    def runs(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last = state.get if state.exists else (None, None)
        steps = pd.concat(list(batches)).sort_values("t_idx")
        done = []

        def close() -> None:
            if first is not None and last - first + 1 >= sustain:
                done.append((key[0], first, last - first + 1, max(first - lookback, 0), last + 1 + tail))

        for t, peak in zip(steps["t_idx"].tolist(), steps["peak"].tolist()):
            hot = peak is not None and peak > threshold
            if hot and first is not None and t == last + 1:
                last = t
            else:
                if hot or first is not None:
                    close()
                first, last = (t, t) if hot else (None, None)
        if first is None:
            state.remove()
        else:
            state.update((first, last))
        yield pd.DataFrame(done, columns=["system", "first_hot", "run_length", "start", "stop"])

    return peaks.select("system", "t_idx", "peak").groupBy("system").applyInPandasWithState(
        runs, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
    )
