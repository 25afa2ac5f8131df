"""Sink of a split: its rows by part, with the frozen statistics that normalise them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import melted


def write_split(rows: DataFrame, path: str, channels: list[str], label: str, split: str = "split", eps: float = 1e-6) -> None:
    """Rows below ``path``/rows, a folder a part; ``path``/statistics and ``path``/classes beside them.

    Only the parts that ``rows`` holds are replaced, so a run again, whole or for one part, leaves the same
    tables. Mean and deviation (plus eps) of each channel come from the part train alone, and are written
    only if it is among the rows; classes are the labels of all parts that are written with them.
    """
    out = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(split)
    out.parquet(f"{path}/rows")
    train = rows.where(F.col(split) == "train")
    if not train.isEmpty():
        figures = melted(train, channels).groupBy("channel").agg(F.avg("v").alias("mean"), (F.stddev_pop("v") + eps).alias("std"))
        figures.write.mode("overwrite").parquet(f"{path}/statistics")
    classes = rows.groupBy(split, F.col(label).alias("class")).agg(F.count("*").alias("n"))
    classes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(split).parquet(f"{path}/classes")


def read_split(spark: SparkSession, path: str, part: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{path}/rows")
    return rows if part is None else rows.where(F.col("split") == part)  # prunes to one folder


def read_statistics(spark: SparkSession, path: str) -> dict[str, tuple[float, float]]:
    """channel -> (mean, std): a row a channel."""
    return {r["channel"]: (r["mean"], r["std"]) for r in spark.read.parquet(f"{path}/statistics").collect()}
