"""Array and scalar expressions: entropy, softmax, rotation, warp, quantisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def adc_to_units(raw: Column, full_scale: float, bits: int) -> Column:
    if bits <= 0:
        raise ValueError("bits must be positive")
    return raw.cast("double") * F.lit(2.0 * full_scale) / F.lit(float(2**bits))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(values: Column) -> Column:
    e = F.transform(values, lambda x: F.exp(x.cast("double") - F.array_max(values).cast("double")))
    return F.transform(e, lambda x: x / _sum(e))


def entropy(probs: Column, k: int, eps: float = 1e-9, renormalise: bool = True) -> Column:
    """Shannon entropy over ln k; probabilities are clipped and, unless the old form is wanted, rescaled."""
    if k < 2:
        raise ValueError("entropy needs at least two classes")
    p = F.transform(probs, lambda x: F.least(F.greatest(x, F.lit(eps)), F.lit(1.0)))
    total = _sum(p) if renormalise else F.lit(1.0)
    return -_sum(F.transform(p, lambda x: x / total * F.log(x / total))) / F.log(F.lit(float(k)))


def quadratic_form(x: Column, mean: list[float], precision: list[list[float]]) -> Column:
    """sqrt(max(0, d' P d)) for d = x - mean, as one expression; meant for small widths."""
    d = [x[i].cast("double") - F.lit(float(m)) for i, m in enumerate(mean)]
    total = F.lit(0.0)
    for i, row in enumerate(precision):
        for j, p in enumerate(row):
            total = total + d[i] * F.lit(float(p)) * d[j]
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def rotation(ux: Column, uy: Column, uz: Column, angle: Column) -> list[list[Column]]:
    """Rows of the rotation matrix about a unit axis."""
    c, s = F.cos(angle), F.sin(angle)
    v = 1 - c
    return [
        [c + ux * ux * v, ux * uy * v - uz * s, ux * uz * v + uy * s],
        [uy * ux * v + uz * s, c + uy * uy * v, uy * uz * v - ux * s],
        [uz * ux * v - uy * s, uz * uy * v + ux * s, c + uz * uz * v],
    ]


def rotate(r: list[list[Column]], x: Column, y: Column, z: Column) -> list[Column]:
    return [row[0] * x + row[1] * y + row[2] * z for row in r]


def time_warp(x: Column, win: int, ratio: Column) -> Column:
    """Resample a window about its centre by linear interpolation, ends held."""
    centre = (win - 1) / 2

    def at(t: Column) -> Column:
        src = F.least(F.greatest((t - centre) * ratio + centre, F.lit(0.0)), F.lit(float(win - 1)))
        low = F.floor(src).cast("int")
        high = F.least(low + 1, F.lit(win - 1))
        a, b = F.element_at(x, low + 1), F.element_at(x, high + 1)
        return a + (b - a) * (src - low)

    return F.transform(F.sequence(F.lit(0), F.lit(win - 1)), at)


def scale(values: Column, gains: Column) -> Column:
    return F.zip_with(values, gains, lambda a, g: a * g)


def channel_dropout(values: Column, draws: Column, p: float, revive: Column) -> Column:
    """Zero channels whose draw is below p; if that is all, the channel ``revive`` (from 0) stays."""
    if not 0 <= p < 1:
        raise ValueError("p must be within [0, 1)")
    all_gone = F.forall(draws, lambda u: u < p)
    keep = F.transform(draws, lambda u, i: F.when(all_gone, (i == revive).cast("double")).otherwise((u >= p).cast("double")))
    return F.zip_with(values, keep, lambda a, k: a * k)


def quantise(x: Column, step: float, zero: int) -> Column:
    """Affine int8, half to even."""
    return F.least(F.greatest(F.rint(x / F.lit(float(step)) + zero), F.lit(-128.0)), F.lit(127.0)).cast("int")


def dequantise(q: Column, step: float, zero: int) -> Column:
    return (q - zero) * F.lit(float(step)) if step else q.cast("double")


def dequantised(x: Column, step: Column) -> Column:
    """What is left of x after symmetric int8 with a step that is a column; 0 where the step is 0."""
    level = F.least(F.greatest(F.rint(x / step), F.lit(-127.0)), F.lit(127.0))
    return F.when(step > 0, level * step).otherwise(0.0)
