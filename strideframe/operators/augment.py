"""Augmentation of windows X (array of samples, each acc_x..z, gyr_x..z), driven by hashes of the window's key.

Draws depend on seed, key and copy only: any partitioning gives the same windows.
Order: rotate, scale, warp, drop channels, jitter; a zero strength leaves a step out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays


def uniform(seed: int, *parts: Column) -> Column:
    """A draw from [0, 1) that the arguments fix."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def normal(seed: int, *parts: Column) -> Column:
    a, b = F.greatest(uniform(seed, F.lit("a"), *parts), F.lit(1e-300)), uniform(seed, F.lit("b"), *parts)
    return F.sqrt(-2 * F.log(a)) * F.cos(2 * 3.141592653589793 * b)


def _stepped(x: Column) -> Column:
    """The value behind a generator: later filters and steps refer to it instead of repeating its expression."""
    return F.explode_outer(F.array(x))


def rotate_windows(windows: DataFrame, key: list[str], max_deg: float, seed: int, x: str = "X") -> DataFrame:
    if not 0 <= max_deg <= 360:
        raise ValueError("angle out of range")
    k = [F.col(c) for c in key]
    g = [normal(seed, F.lit(c), *k) for c in ("x", "y", "z")]
    out = windows.withColumn("_g", F.array(*g)).withColumn("_n", F.sqrt(F.aggregate("_g", F.lit(0.0), lambda a, v: a + v * v)))
    axis = [F.when(F.col("_n") > 1e-12, F.col("_g")[i] / F.col("_n")).otherwise(float(i == 0)) for i in range(3)]
    r = arrays.rotation(*axis, uniform(seed, F.lit("angle"), *k) * (max_deg * 3.141592653589793 / 180))
    out = out.withColumn("_r", F.array(*[c for row in r for c in row]))
    m = [[F.col("_r")[3 * i + j] for j in range(3)] for i in range(3)]
    turn = lambda s: F.array(*arrays.rotate(m, s[0], s[1], s[2]), *arrays.rotate(m, s[3], s[4], s[5])).cast("array<float>")
    return out.withColumn(x, _stepped(F.transform(x, turn))).drop("_g", "_n", "_r")


def scale_windows(windows: DataFrame, key: list[str], sigma: float, seed: int, channels: int = 6, x: str = "X") -> DataFrame:
    k = [F.col(c) for c in key]
    gains = F.array(*[1 + sigma * normal(seed, F.lit(c), *k) for c in range(channels)])
    out = windows.withColumn("_gain", gains)
    return out.withColumn(x, _stepped(F.transform(x, lambda s: arrays.scale(s, F.col("_gain")).cast("array<float>")))).drop("_gain")


def warp_windows(windows: DataFrame, key: list[str], max_ratio: float, seed: int, channels: int = 6, x: str = "X") -> DataFrame:
    win = F.size(x)
    centre = (win - 1) / 2
    out = windows.withColumn("_ratio", 1 + (2 * uniform(seed, F.lit("warp"), *[F.col(c) for c in key]) - 1) * max_ratio)

    def at(t: Column) -> Column:
        src = F.least(F.greatest((t - centre) * F.col("_ratio") + centre, F.lit(0.0)), (win - 1).cast("double"))
        low = F.floor(src).cast("int")
        a, b = F.element_at(x, low + 1), F.element_at(x, F.least(low + 1, win - 1) + 1)
        return F.zip_with(a, b, lambda p, q: (p + (q - p) * (src - low)).cast("float"))

    return out.withColumn(x, _stepped(F.transform(F.sequence(F.lit(0), win - 1), at))).drop("_ratio")


def drop_channels(windows: DataFrame, key: list[str], p: float, seed: int, channels: int = 6, x: str = "X") -> DataFrame:
    k = [F.col(c) for c in key]
    draws = F.array(*[uniform(seed, F.lit("drop"), F.lit(c), *k) for c in range(channels)])
    revive = F.floor(uniform(seed, F.lit("revive"), *k) * channels).cast("int")
    out = windows.withColumns({"_d": draws, "_v": revive})
    return out.withColumn(x, _stepped(F.transform(x, lambda s: arrays.channel_dropout(s, F.col("_d"), p, F.col("_v")).cast("array<float>")))).drop("_d", "_v")


def jitter_windows(windows: DataFrame, key: list[str], sigma: float, seed: int, x: str = "X") -> DataFrame:
    k = [F.col(c) for c in key]
    noisy = lambda s, t: F.transform(s, lambda v, c: (v + sigma * normal(seed, F.lit("jit"), t, c, *k)).cast("float"))
    return windows.withColumn(x, _stepped(F.transform(x, noisy)))


def shake_windows(windows: DataFrame, key: list[str], sigma: float = 3.0, seed: int = 42, x: str = "X") -> DataFrame:
    """Stress: strong noise on every value."""
    return jitter_windows(windows, key, sigma, seed, x)


def impact_windows(windows: DataFrame, key: list[str], sigma: float = 8.0, width: int = 8, margin: int = 20, seed: int = 42, x: str = "X") -> DataFrame:
    """Stress: noise on ``width`` samples from one that is ``margin`` or more from either end (short windows: from ``margin``)."""
    k = [F.col(c) for c in key]
    room = F.greatest(F.size(x) - 2 * margin, F.lit(1))
    out = windows.withColumn("_from", margin + F.floor(uniform(seed, F.lit("impact"), *k) * room).cast("int"))
    loud = lambda s, t: F.transform(s, lambda v, c: (v + sigma * normal(seed, F.lit("hit"), t, c, *k)).cast("float"))
    hit = lambda s, t: F.when((t >= F.col("_from")) & (t < F.col("_from") + width), loud(s, t)).otherwise(s)
    return out.withColumn(x, _stepped(F.transform(x, hit))).drop("_from")


def freeze_windows(windows: DataFrame, key: list[str], sigma: float = 0.02, seed: int = 42, x: str = "X") -> DataFrame:
    """Stress: the first sample throughout, with little noise."""
    k = [F.col(c) for c in key]
    still = lambda s, t: F.transform(F.element_at(x, 1), lambda v, c: (v + sigma * normal(seed, F.lit("still"), t, c, *k)).cast("float"))
    return windows.withColumn(x, _stepped(F.transform(x, still)))


def augmenter(rotation_deg: float = 0, scale_sigma: float = 0, warp_ratio: float = 0, dropout_p: float = 0, jitter_sigma: float = 0, seed: int = 42):
    """A function for ``DataFrame.transform``: the steps that have a strength, in order."""

    def apply(windows: DataFrame, *key: str) -> DataFrame:
        cols = list(key) or ["window_id"]
        steps = ((rotation_deg, rotate_windows), (scale_sigma, scale_windows), (warp_ratio, warp_windows), (dropout_p, drop_channels), (jitter_sigma, jitter_windows))
        for i, (strength, step) in enumerate(steps):
            if strength:
                windows = step(windows, cols, strength, seed + i)
        return windows

    return apply


def expand_augmented(windows: DataFrame, times: int, key: str, total: int, apply) -> DataFrame:
    """The windows and ``times`` augmented copies; copy 0 is untouched."""
    from .splits import expand

    copies = expand(windows, times, key, total)
    return copies.where("copy = 0").unionByName(apply(copies.where("copy > 0"), key, "copy"))
