"""Exact top-k by inner product: distributed histogram selection.

Every candidate is scored against every query, in blocks. Rounds of score
histograms, ever finer, locate each query's k-th highest score; then candidates
at or above it are kept and ties at it go to the smaller id. No score is
shuffled before the k-th value is known, only counts.

Vectors are turned into floor(1024 * x), x as double. Vectors that are null or
hold null or non-finite components take no part, nor do rows without id; vectors
are compared only with those of the same length (empty ones score 0). A query is
never matched with rows of its own id. Repeated rows are candidates each; of rows
that repeat a query's id the smallest vector asks. Scores beyond 2^62 either way are
held there. With fewer than k candidates all are returned; no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .common import materialise, shared_dir

#: Queries a block; bits that one round of histograms resolves.
BLOCK = 256
BITS = 9
SCALE = 1024.0
LOW, HIGH = -(1 << 62), (1 << 62)


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v: array of longs, for the vectors that take part."""
    x = F.transform(F.col(embedding), lambda e: e.cast("double"))
    fine = F.col(embedding).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return vectors.where(fine & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * SCALE).cast("long")).alias("v"))


def _matrix(col: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    offs = col.offsets.to_numpy()
    at = offs[rows][:, None] + np.arange(dim)
    return col.values.to_numpy()[at]


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the rows of a batch, one pair for each vector length."""
    col, ids = batch.column("v"), batch.column("vec_id").to_numpy()
    dims = np.diff(col.offsets.to_numpy())
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        yield ids[rows], _matrix(col, rows, int(dim))


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products (queries x rows), exact in 64 bits; by floating point where that is exact."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    if bound < 2**53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    if bound < 2**62:
        return queries @ rows.T
    return np.clip(queries.astype(object) @ rows.T.astype(object), LOW + 1, HIGH).astype(np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that ``is_query`` selects by their vec_id."""
    spark = vectors.sparkSession
    rows, home = quantised(vectors), f"{shared_dir(spark)}-topk"
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))

    # Blocks of queries of one length, each a file that every executor can map.
    lens = asked.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, e: F.greatest(a, F.abs(e.cast("double"))))).alias("top"))
    slot = F.pmod(F.xxhash64("vec_id"), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("long"))

    def save(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        dim, slot = int(part["dim"].iloc[0]), int(part["slot"].iloc[0])
        name = f"{dim}-{slot}"
        ids = part["vec_id"].to_numpy(np.int64)
        v = np.array(part["v"].tolist(), np.int64).reshape(len(part), dim)
        store.put_arrays(f"{home}/q-{name}", ids=ids, v=v)
        return pd.DataFrame({"dim": [dim], "name": [name]})

    saved = asked.join(F.broadcast(lens), "dim").withColumn("slot", slot).groupBy("dim", "slot").applyInPandas(save, "dim int, name string")
    # One short name for each block of queries; the scores a query can reach bound the first histogram.
    blocks = sorted((r["dim"], r["name"]) for r in saved.collect())
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    reach = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, e: F.greatest(a, F.abs(e.cast("double")))))).first()[0]
    widest = max(1.0, reach * reach * max(1, max(d for d, _ in blocks)))
    shift = max(0, int(np.ceil(np.log2(widest + 1))) + 1 - BITS)

    def run(stage: int, shift: int, last: bool):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for b in batches:
                for ids, m in _by_dim(b):
                    held.setdefault(m.shape[1], []).append((ids, m))
                    if sum(len(i) for i, _ in held[m.shape[1]]) >= 16384:
                        yield from block(m.shape[1], held.pop(m.shape[1]))
            for dim in list(held):
                yield from block(dim, held.pop(dim))

        def block(dim: int, parts: list) -> Iterator[pa.RecordBatch]:
            ids, m = np.concatenate([i for i, _ in parts]), np.concatenate([x for _, x in parts])
            for d, name in blocks:
                if d != dim:
                    continue
                q = store.arrays(f"{home}/q-{name}")
                floor = store.arrays(f"{home}/t{stage - 1}-{name}")["floor"] if stage else np.full(len(q["ids"]), LOW)
                s = _scores(np.asarray(q["v"]), m)
                yield from (hits if last else counts)(np.asarray(q["ids"]), s, np.asarray(floor), ids, name)

        def counts(qids, s, floor, ids, name) -> Iterator[pa.RecordBatch]:
            s = s >> shift
            s[s < (floor >> shift)[:, None]] = LOW
            s[qids[:, None] == ids[None, :]] = LOW
            out = []
            for r in range(len(qids)):  # bins below the k-th highest of these rows cannot hold the k-th of all
                v = s[r]
                if len(v) > k:
                    v = v[v >= np.partition(v, len(v) - k)[len(v) - k]]
                bins, n = np.unique(v[v > LOW], return_counts=True)
                out.append((np.full(len(bins), qids[r]), bins, n))
            q, bins, n = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(q), pa.string()), pa.array(q), pa.array(bins), pa.array(n)], names=["name", "query_id", "bin", "n"])

        def hits(qids, s, floor, ids, name) -> Iterator[pa.RecordBatch]:
            s[qids[:, None] == ids[None, :]] = LOW
            out = []
            for r in range(len(qids)):
                at = np.flatnonzero((s[r] >= floor[r]) & (s[r] > LOW))
                at = at[np.lexsort((ids[at], -s[r][at]))][:k]  # the best k of these rows, ties by id
                out.append((np.full(len(at), qids[r]), ids[at], s[r][at]))
            q, i, v = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(v)], names=["query_id", "vec_id", "score"])

        return scan

    def chooser(stage: int, shift: int):
        def choose(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            q = store.arrays(f"{home}/q-{key[0]}")
            part = part.sort_values(["query_id", "bin"], ascending=[True, False])
            reached = part[part.groupby("query_id")["n"].cumsum() >= k].groupby("query_id")["bin"].first()
            # With fewer than k candidates every one is wanted.
            floor = np.array([int(reached[i]) << shift if i in reached.index else LOW + 1 for i in np.asarray(q["ids"]).tolist()], np.int64)
            store.put_arrays(f"{home}/t{stage}-{key[0]}", floor=floor)
            return pd.DataFrame({"name": [key[0]]})

        return choose

    stage = 0
    while True:
        found = rows.mapInArrow(run(stage, shift, False), "name string, query_id long, bin long, n long")
        summed = found.groupBy("name", "query_id", "bin").agg(F.sum("n").alias("n"))

        done = {r["name"] for r in summed.groupBy("name").applyInPandas(chooser(stage, shift), "name string").collect()}
        for d, name in blocks:
            if name not in done:  # its queries have no candidate at all
                n = len(store.arrays(f"{home}/q-{name}")["ids"])
                store.put_arrays(f"{home}/t{stage}-{name}", floor=np.full(n, LOW + 1))
        if not shift:
            break
        stage, shift = stage + 1, max(0, shift - BITS)
    near = rows.mapInArrow(run(stage + 1, 0, True), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return materialise(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "topk")
