"""Novelty scores: covariance, Mahalanobis distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Partial sums that one task merges.
FAN_IN = 1024
_SUMS = "part long, n long, mean array<double>, m2 array<double>"


def _batch(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *[pa.array([r[i].ravel().tolist() for r in rows], pa.list_(pa.float64())) for i in (2, 3)]]
    return pa.RecordBatch.from_arrays(cols, names=["part", "n", "mean", "m2"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's rows about its first row: d squared numbers, whatever the rows."""
    n, s, ss, origin = 0, None, None, None
    for b in batches:
        if not b.num_rows:
            continue
        x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
        if s is None:
            origin, s, ss = x[0].copy(), np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)
        y = x - origin
        n, s, ss = n + len(x), s + y.sum(0), ss + y.T @ y
    if n:
        mean = s / n
        yield _batch([(TaskContext.get().partitionId(), n, mean + origin, ss - n * np.outer(mean, mean))])


def _merged(parts: pd.DataFrame) -> pd.DataFrame:
    parts = parts.sort_values("part")
    n, mean, m2 = 0, np.zeros(0), np.zeros((0, 0))
    for k, mu, c in zip(parts["n"].tolist(), parts["mean"], parts["m2"], strict=True):
        mu, c = np.array(mu), np.array(c).reshape(len(mu), -1)
        if not n:
            n, mean, m2 = k, mu, c
            continue
        d = mu - mean
        m2 = m2 + c + np.outer(d, d) * n * k / (n + k)
        mean, n = mean + d * k / (n + k), n + k
    return pd.DataFrame({"part": [int(parts["part"].iloc[0])], "n": [n], "mean": [mean.tolist()], "m2": [m2.ravel().tolist()]})


def moments(rows: DataFrame, vector: str) -> DataFrame:
    """n, mean, m2 (sums of products about the means, row by row): one row, none without vectors.

    Each task gives its own sums, which other tasks merge, ``FAN_IN`` at a time; no more than that meets in one.
    """
    out = rows.where(F.col(vector).isNotNull()).select(vector).mapInArrow(_partial, _SUMS)
    for level in (1, 4):  # a stage has far fewer tasks than FAN_IN squared: the last level is one group
        out = out.groupBy(F.floor(F.col("part") / FAN_IN**level)).applyInPandas(_merged, _SUMS)
    return out.drop("part")


def covariance_pairs(rows: DataFrame, vector: str, shrinkage: float = 1e-3) -> DataFrame:
    """(i, j, cov): sample covariance of every pair of components, ridge on the diagonal; none below two rows."""
    flat = moments(rows, vector).where("n > 1").select("n", F.size("mean").alias("d"), F.posexplode("m2").alias("at", "v"))
    i, j = F.floor(F.col("at") / F.col("d")).cast("int"), (F.col("at") % F.col("d")).cast("int")
    return flat.select(i.alias("i"), j.alias("j"), (F.col("v") / (F.col("n") - 1) + F.when(i == j, shrinkage).otherwise(0.0)).alias("cov"))


@dataclass
class Mahalanobis:
    mean: np.ndarray
    precision: np.ndarray
    cholesky: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame, vector: str, shrinkage: float = 1e-3) -> Mahalanobis:
        found = moments(rows, vector).first()  # d squared numbers
        n, mean = (found["n"], np.array(found["mean"])) if found else (0, np.zeros(0))
        if n <= len(mean):
            raise ValueError("covariance is singular: need more rows than components")
        m2 = np.array(found["m2"]).reshape(len(mean), -1)
        precision = np.linalg.inv(m2 / (n - 1) + shrinkage * np.eye(len(mean)))
        return cls(mean, precision, np.linalg.cholesky(precision))

    def score(self, rows: DataFrame, vector: str, out: str = "distance") -> DataFrame:
        mean, precision = self.mean, self.precision

        @F.pandas_udf("double")
        def distance(v: pd.Series) -> pd.Series:
            d = np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, len(mean)))
            if d.shape[1:] != mean.shape:
                raise ValueError("vectors are not as wide as the model")
            d = d - mean
            return pd.Series(np.sqrt(np.maximum(np.einsum("ni,ij,nj->n", d, precision, d), 0)))

        return rows.withColumn(out, distance(vector))
