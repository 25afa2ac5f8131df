"""Count windows over a stream: the same windows as the batch operator, as samples arrive."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_windows(stream: DataFrame, by: str, order: list[str], value: str, win: int, stride: int) -> DataFrame:
    """(by, k, mean, energy) of each complete window of a trial; state is the last, at most win, samples.

    Within a micro-batch samples are sorted by the columns ``order``. A sample that comes before one
    of an earlier micro-batch raises, as it would shift every later window without a word.
    """
    kind = stream.schema[by].dataType.simpleString()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, held, last = state.get if state.exists else (0, [], "")
        rows = pd.concat(list(parts)).sort_values(order)
        begins, ends = (_place(rows[order].iloc[i]) for i in (0, -1))
        if last and begins < tuple(json.loads(last)):
            raise ValueError(f"trial {key[0]}: a sample at {begins} came after {last}; order the source or raise the watermark")
        new = rows[value].to_numpy(np.float64)
        x = np.r_[np.array(held, np.float64), new]
        first, total = seen - len(held), seen + len(new)  # index of x[0]; samples so far
        out = []
        k = max(0, -(-(seen - win + 1) // stride))
        while k * stride + win <= total:
            w = x[k * stride - first : k * stride - first + win]
            out.append((key[0], k, float(w.mean()), float(np.abs(w).mean())))
            k += 1
        keep = max(0, min(len(x), total - k * stride))
        state.update((int(total), x[len(x) - keep :].tolist(), json.dumps(ends)))
        yield pd.DataFrame(out, columns=[by, "k", "mean", "energy"])

    return stream.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, k long, mean double, energy double", "seen long, held array<double>, last string", "append", GroupStateTimeout.NoTimeout)


def _place(row: pd.Series) -> tuple[int, ...]:
    """Times in nanoseconds and numbers, so that places compare as they sort and can be kept as text."""
    return tuple(int(x.value) if isinstance(x, pd.Timestamp) else int(x) for x in row)


def alarms(windows: DataFrame, threshold: float, score: str = "energy") -> DataFrame:
    """Windows strictly above the threshold."""
    return windows.where(F.col(score) > threshold)
