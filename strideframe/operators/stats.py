"""Channel statistics, frozen normalisation, comparison of corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def melted(rows: DataFrame, channels: list[str], *keep: str) -> DataFrame:
    """(keep, channel, v): one row for each channel value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("v")) for c in channels])).alias("p")
    return rows.select(*keep, pairs).select(*keep, "p.channel", "p.v")


def channel_stats(rows: DataFrame, channels: list[str], *by: str, eps: float = 1e-6) -> DataFrame:
    """Population mean and deviation (plus eps, after the root) of each channel."""
    return melted(rows, channels, *by).groupBy(*by, "channel").agg(F.avg("v").alias("mean"), (F.stddev_pop("v") + eps).alias("std"))


def normalised(x: Column, mean: float, std: float) -> Column:
    if not std > 0:
        raise ValueError("std must be positive")
    return (x - F.lit(float(mean))) / F.lit(float(std))


def normalise(rows: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Replace each channel by its z-score under frozen statistics."""
    return rows.withColumns({c: normalised(F.col(c), m, s) for c, (m, s) in stats.items()})


def normalise_windows(windows: DataFrame, mean: list[float], std: list[float], x: str = "X") -> DataFrame:
    """The same for an array-of-samples column; arithmetic in 32 bits."""
    if len(mean) != len(std) or min(std) <= 0:
        raise ValueError("mean and std need equal lengths and positive deviations")
    m, s = (F.array(*[F.lit(float(v)).cast("float") for v in a]) for a in (mean, std))
    fix = lambda row: F.zip_with(F.zip_with(row, m, lambda a, b: (a - b).cast("float")), s, lambda a, b: (a / b).cast("float"))
    return windows.withColumn(x, F.transform(x, fix))


def harmonisation(rows: DataFrame, dataset: str, channels: list[str]) -> DataFrame:
    """Each channel's largest deviation of a corpus over the smallest; below 3 is fine."""
    per = melted(rows, channels, dataset).groupBy(dataset, "channel").agg(F.stddev_pop("v").alias("sd"))
    return per.groupBy("channel").agg((F.max("sd") / F.greatest(F.min("sd"), F.lit(1e-9))).alias("ratio")).withColumn("ok", F.col("ratio") < 3.0)


def magnitude(*axes: Column) -> Column:
    total = F.lit(0.0)
    for a in axes:
        total = total + a.cast("double") * a.cast("double")
    return F.sqrt(total)


def class_middle(rows: DataFrame, label: str, key: str, bins: int = 1024) -> DataFrame:
    """label, key of the row in the middle of each class (place n div 2 by an integer key); null labels and keys are left out.

    Counts of key ranges find the range that holds the middle; only its rows are sorted, so no class is sorted as a whole.
    """
    known = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(label, key)
    low, high = known.agg(F.min(key), F.max(key)).first()
    if low is None:
        return known
    ranged = known.withColumn("_bin", F.floor((F.col(key) - low) / ((high - low) // bins + 1)))
    by = Window.partitionBy(label)
    counts = ranged.groupBy(label, "_bin").agg(F.count("*").alias("_n"))
    place = F.floor(F.sum("_n").over(by) / 2)
    below = F.sum("_n").over(by.orderBy("_bin")) - F.col("_n")
    chosen = counts.select(label, "_bin", "_n", (place - below).alias("_at")).where((F.col("_at") >= 0) & (F.col("_at") < F.col("_n"))).drop("_n")
    near = ranged.join(chosen, [label, "_bin"])
    return near.withColumn("_r", F.row_number().over(by.orderBy(key)) - 1).where("_r = _at").select(label, key)


def impact_index(samples: DataFrame, by: str, size: Column) -> DataFrame:
    """Index of each trial's largest value; the first of equals."""
    return samples.groupBy(by).agg(F.max_by("i", F.struct(size, -F.col("i"))).alias("impact"))
