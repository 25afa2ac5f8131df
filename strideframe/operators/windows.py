"""Sample-count windows over continuous signals, and labels by event overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def indexed(rows: DataFrame, by: str, *order: str, per: int | None = None) -> DataFrame:
    """Add ``i``, the sample's index (from 0) within its trial; samples of no trial (null) get none.

    Samples are counted by trial and range of ``order``; a sample's index is its place in the range
    and what the trial has in earlier ranges. A trial of any length is so sorted in many tasks.
    """
    parts = rows.withColumn("_range", ranges.place(rows, *order, per=per))
    counts = parts.groupBy(by, "_range").agg(F.count("*").alias("_n"))
    inside = F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order))
    out = parts.withColumn("_at", inside).join(ranges.starts(counts, [by], "_n"), [by, "_range"], "left")
    return out.withColumn("i", F.col("_at") - 1 + F.col("b__n")).select(*rows.columns, "i")


def n_windows(n: Column, win: int, stride: int) -> Column:
    """Complete windows in a signal of n samples."""
    if win <= 0 or stride <= 0:
        raise ValueError("win and stride must be positive")
    return F.when(n < win, F.lit(0)).otherwise(F.floor((n - win) / stride) + 1).cast("long")


def window_bounds(trials: DataFrame, n: str, win: int, stride: int) -> DataFrame:
    """One row for each window of each trial: k, start, end (half open)."""
    m = n_windows(F.col(n), win, stride)
    out = trials.where(m > 0).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), m - 1)))
    return out.withColumns({"start": F.col("k") * stride, "end": F.col("k") * stride + win})


def assigned(samples: DataFrame, win: int, stride: int) -> DataFrame:
    """Each sample once for every window k that holds it."""
    if win <= 0 or stride <= 0:
        raise ValueError("win and stride must be positive")
    low = F.greatest(F.ceil((F.col("i") - (win - 1)) / stride), F.lit(0)).cast("long")
    high = F.floor(F.col("i") / stride).cast("long")
    return samples.where(low <= high).withColumn("k", F.explode(F.sequence(low, high)))


def sliding_windows(samples: DataFrame, by: str, win: int, stride: int, *aggs: Column) -> DataFrame:
    """Aggregates of every complete window; the tail that fills no window is dropped."""
    grouped = assigned(samples, win, stride).groupBy(by, "k").agg(F.count("*").alias("n"), *aggs)
    return grouped.where(F.col("n") == win).drop("n")


def mean_in_order(value: Column, order: str = "i") -> Column:
    """Aggregate: mean of a window's values added up one by one in sample order, without nulls.

    ``avg`` adds in the order in which rows arrive, so equal windows may differ in the last bit and fall on
    both sides of a threshold that is one of them.
    """
    held = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.cast("double").alias("v")))))
    total = F.aggregate(held, F.lit(0.0), lambda acc, x: acc + x["v"])
    return F.when(F.size(held) > 0, total / F.size(held))


def window_arrays(samples: DataFrame, by: str, channels: list[str], win: int, stride: int) -> DataFrame:
    """Complete windows with X, an array of samples, each an array of channels (floats)."""
    x = F.struct("i", F.array(*[F.col(c).cast("float") for c in channels]).alias("x"))
    got = sliding_windows(samples, by, win, stride, F.array_sort(F.collect_list(x)).alias("s"))
    return got.select(by, "k", (F.col("k") * stride).alias("start"), (F.col("k") * stride + win).alias("end"), F.transform("s", lambda s: s["x"]).alias("X"))


def overlap_fraction(start: Column, end: Column, ev_start: Column, ev_end: Column, relative_to: str = "window") -> Column:
    """Share of the window, or of the event, that the two half-open spans have in common."""
    if relative_to not in ("window", "event"):
        raise ValueError(f"unknown normaliser {relative_to!r}")
    width = end - start if relative_to == "window" else ev_end - ev_start
    shared = F.greatest(F.least(end, ev_end) - F.greatest(start, ev_start), F.lit(0))
    bad = F.raise_error(F.lit("event ends before it starts")).cast("double")
    return F.when(ev_end < ev_start, bad).otherwise(shared / F.greatest(width, F.lit(1)))


def label_by_overlap(fraction: Column, positive_min: float = 0.8, negative_max: float = 0.0) -> Column:
    """0, 1 or -1 (ambiguous); a fraction that meets both bounds is negative."""
    if not 0 <= negative_max <= positive_min <= 1:
        raise ValueError("need 0 <= negative_max <= positive_min <= 1")
    return F.when(fraction <= negative_max, 0).when(fraction >= positive_min, 1).otherwise(-1)


def interval_pairs(windows: DataFrame, spans: DataFrame, by: str, cell: int, start: str = "start", end: str = "end", ev_start: str = "ev_start", ev_end: str = "ev_end") -> DataFrame:
    """Every window with every span of its trial that has a sample in common with it (half-open bounds; columns of both).

    Both go into the cells of ``cell`` samples that they touch and meet by trial and cell, so a trial of
    any length is many keys; a pair is kept in the first cell that it shares. Take a cell of about a
    window's width. Spans or windows that hold no sample, or lack a bound, meet nothing.
    """
    if cell <= 0:
        raise ValueError("cell must be positive")
    both = (set(windows.columns) & set(spans.columns)) - {by}
    if both:
        raise ValueError(f"columns on both sides: {sorted(both)}")

    def celled(rows: DataFrame, low: str, high: str, name: str) -> DataFrame:
        first, last = (F.floor(x / cell).cast("long") for x in (F.col(low), F.col(high) - 1))
        full = rows.where(F.col(low) < F.col(high))
        return full.withColumn(name, first).withColumn("_cell", F.explode(F.sequence(first, last)))

    met = celled(windows, start, end, "_w").join(celled(spans, ev_start, ev_end, "_s"), [by, "_cell"])
    shared = (F.col(start) < F.col(ev_end)) & (F.col(ev_start) < F.col(end))
    return met.where(shared & (F.col("_cell") == F.greatest("_w", "_s"))).drop("_cell", "_w", "_s")


def label_by_spans(windows: DataFrame, spans: DataFrame, by: str, k: str = "k", cell: int = 128, positive_min: float = 0.8, negative_max: float = 0.0, relative_to: str = "event") -> DataFrame:
    """``by``, k, n_spans, fraction, label of every window against all spans (ev_start, ev_end) of its trial.

    The span that the window has the largest fraction of decides; a window that touches no span has
    fraction 0 and is kept. Windows and their pairs meet in one aggregation by window.
    """
    label = label_by_overlap(F.col("fraction"), positive_min, negative_max)
    own = spans.select(by, "ev_start", F.when(F.col("ev_end") < F.col("ev_start"), F.raise_error(F.lit("event ends before it starts")).cast("long")).otherwise(F.col("ev_end")).alias("ev_end"))
    pairs = interval_pairs(windows.select(by, k, "start", "end"), own, by, cell)
    each = pairs.select(by, k, F.lit(1).cast("long").alias("n"), overlap_fraction(F.col("start"), F.col("end"), F.col("ev_start"), F.col("ev_end"), relative_to).alias("f"))
    alone = windows.select(by, k, F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("f"))
    found = each.unionByName(alone).groupBy(by, k).agg(F.sum("n").alias("n_spans"), F.max("f").alias("fraction"))
    return found.withColumn("label", label)
