"""Filters over continuous signals: median, zero-phase low-pass, resampling, gravity.

The median is a window function. The other filters run over chunks of a trial with as many
neighbouring samples on both sides as reach a chunk's own ones, so no group grows with its trial;
samples are numbered from 0 without gaps in a trial (``windows.indexed`` does so).
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def median3(samples: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """Median of each sample and its neighbours, edge samples repeated."""
    w = Window.partitionBy(by).orderBy("i")
    a, c = F.coalesce(F.lag(value).over(w), F.col(value)), F.coalesce(F.lead(value).over(w), F.col(value))
    b = F.col(value)
    return samples.withColumn(out, F.greatest(F.least(a, b), F.least(F.greatest(a, b), c)))


def butterworth_sections(cutoff: float, fs: float, order: int = 3) -> np.ndarray:
    """Second-order sections of a digital low-pass (bilinear transform, pre-warped)."""
    if not 0 < cutoff < fs / 2:
        raise ValueError("cutoff must lie below half the rate")
    warped = 2 * fs * np.tan(np.pi * cutoff / fs)
    poles = warped * np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    z = (2 * fs + poles) / (2 * fs - poles)
    sections = [[1.0, 2.0, 1.0, 1.0, -2 * p.real, abs(p) ** 2] for p in z if p.imag > 1e-12]
    sections += [[1.0, 1.0, 0.0, 1.0, -p.real, 0.0] for p in z if abs(p.imag) <= 1e-12]
    out = np.array(sections)
    for s in out:  # unit gain at rest
        s[:3] *= s[3:].sum() / s[:3].sum()
    return out


def memory(sections: np.ndarray) -> int:
    """Samples after which a filter has forgotten its state, to within rounding."""
    slowest = max(np.sqrt(abs(a2)) if a2 else abs(a1) for *_, a1, a2 in sections)
    return max(64, int(np.ceil(np.log(1e-15) / np.log(slowest))))


def _run_sections(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Blocks of a long signal are rows that run side by side, each from as far back as the filter remembers."""
    back = memory(sections)
    if len(x) <= 2 * back:
        rows, back = np.asarray(x, np.float64)[None], 0
    else:  # what comes before the signal is its first sample for ever
        n = -(-len(x) // back)
        rows = np.lib.stride_tricks.sliding_window_view(np.r_[np.full(back, x[0]), x, np.full(n * back - len(x), x[-1])], 2 * back)[::back]
    y = np.array(rows.T, np.float64, order="C")
    for b0, b1, b2, _, a1, a2 in sections:
        # State of a section that has seen its first sample for ever.
        z1, z2 = y[0] * (1 - b0), y[0] * (b2 - a2)
        for i, v in enumerate(y):
            o = b0 * v + z1
            z1, z2 = b1 * v - a1 * o + z2, b2 * v - a2 * o
            y[i] = o
    return y[back:].T.ravel()[: len(x)]


def low_pass(x: np.ndarray, cutoff: float, fs: float, order: int = 3) -> np.ndarray:
    """Forward and backward, with point-reflected ends."""
    sections = butterworth_sections(cutoff, fs, order)
    pad = min(3 * (2 * order + 1), len(x) - 1)
    if pad > 0:
        x = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]
    y = _run_sections(sections, _run_sections(sections, x)[::-1])[::-1]
    return y[pad : len(y) - pad] if pad > 0 else y


def _ratio(fs_in: float, fs_out: float) -> tuple[int, int]:
    up, down = round(1000 * fs_out), round(1000 * fs_in)
    return up // gcd(up, down), down // gcd(up, down)


def resample_array(x: np.ndarray, fs_in: float, fs_out: float, lead: int = 0, first: int = 0, own: int | None = None) -> np.ndarray:
    """Rational resampling by a Kaiser-windowed sinc, edges padded with zeros.

    Of a piece of a longer signal: ``lead`` samples come before number ``first`` of the whole, and the
    result is of the ``own`` samples from there on.
    """
    up, down = _ratio(fs_in, fs_out)
    x, own = np.asarray(x, np.float64), len(x) - lead if own is None else own
    if up == down:
        return x[lead : lead + own]
    half = 10 * max(up, down)
    t = np.arange(-half, half + 1)
    h = np.sinc(t / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    h = np.r_[h * (up / h.sum()), 0.0]  # the last entry is for taps beyond the window
    taps = np.arange(2 * half // up + 1)
    padded = np.r_[np.zeros(len(taps)), x, np.zeros(len(taps))]
    js, parts = np.arange(-(-first * up // down), -(-(first + own) * up // down)), []
    for at in np.array_split(js * down, max(1, len(js) * len(taps) >> 20)):  # about a million products at a time
        low = -((half - at) // up)  # first sample under the window
        i = low[:, None] + taps
        h_at = at[:, None] - i * up + half
        place = np.clip(i - first + lead + len(taps), 0, len(padded) - 1)
        parts.append((padded[place] * h[np.where(h_at < 0, -1, h_at)]).sum(1))
    return np.concatenate(parts)


#: Samples of a chunk; it is longer where a filter reaches further.
CHUNK = 1 << 16


def _by_chunk(samples: DataFrame, by: str, value: str, schema: str, reach: int, chunk: int, f) -> DataFrame:
    """``f(x, lead, first, own)`` for each chunk: x are its samples and ``reach`` more on either side, if there are any;
    ``own`` of them count, after ``lead`` others, and the first is number ``first`` of the trial. f gives the columns, i among them.
    """
    size = max(chunk, reach)
    names = [c.split(" ")[0] for c in schema.split(", ")]
    at, inside = F.expr(f"i div {size}"), F.col("i") % size
    near = F.array(at, F.when((inside < reach) & (at > 0), at - 1), F.when(inside >= size - reach, at + 1))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        i, first = part["i"].to_numpy(), int(key[1]) * size
        lead, end = np.searchsorted(i, [first, first + size])
        if lead == end:  # only the end of the chunk before
            return pd.DataFrame({c: [] for c in names})
        cols = f(part[value].to_numpy(np.float64), int(lead), first, int(end - lead))
        return pd.DataFrame({by: [key[0]] * len(cols["i"]), **cols})[names]

    rows = samples.select(by, "i", value, F.explode(F.filter(near, lambda c: c.isNotNull())).alias("_chunk"))
    return rows.groupBy(by, "_chunk").applyInPandas(run, schema)


def _kind(samples: DataFrame, by: str) -> str:
    return samples.schema[by].dataType.simpleString()


def resample(samples: DataFrame, by: str, value: str, fs_in: float, fs_out: float, chunk: int = CHUNK) -> DataFrame:
    up, down = _ratio(fs_in, fs_out)

    def run(x: np.ndarray, lead: int, first: int, own: int) -> dict[str, np.ndarray]:
        y = resample_array(x, fs_in, fs_out, lead, first, own)
        return {"i": -(-first * up // down) + np.arange(len(y)), value: y}

    return _by_chunk(samples, by, value, f"{by} {_kind(samples, by)}, i long, {value} double", 10 * max(up, down) // up + 1, chunk, run)


def median3_array(x: np.ndarray) -> np.ndarray:
    p = np.r_[x[:1], x, x[-1:]]
    return np.median(np.stack([p[:-2], p[1:-1], p[2:]]), 0)


def denoise(samples: DataFrame, by: str, value: str, fs: float, chunk: int = CHUNK) -> DataFrame:
    """Median of three for signals over three samples; 20 Hz low-pass for rates over 40 Hz."""
    reach = memory(butterworth_sections(20.0, fs)) if fs > 40 else 3

    def run(x: np.ndarray, lead: int, first: int, own: int) -> dict[str, np.ndarray]:
        y = median3_array(x) if len(x) > 3 else x
        y = low_pass(y, 20.0, fs) if fs > 40 else y
        return {"i": first + np.arange(own), value: y[lead : lead + own]}

    return _by_chunk(samples, by, value, f"{by} {_kind(samples, by)}, i long, {value} double", reach + 1, chunk, run)


def gravity_split(samples: DataFrame, by: str, value: str, fs: float, cutoff: float = 0.3, chunk: int = CHUNK) -> DataFrame:
    """Slow part (gravity) and the rest (body)."""
    if fs <= 2 * cutoff:
        raise ValueError("rate too low for the cutoff")

    def run(x: np.ndarray, lead: int, first: int, own: int) -> dict[str, np.ndarray]:
        g, own_x = low_pass(x, cutoff, fs)[lead : lead + own], x[lead : lead + own]
        return {"i": first + np.arange(own), "gravity": g, "body": own_x - g}

    return _by_chunk(samples, by, value, f"{by} {_kind(samples, by)}, i long, gravity double, body double", memory(butterworth_sections(cutoff, fs)), chunk, run)
