"""Approximate nearest neighbours: a hierarchical navigable small-world graph a shard, results of all shards merged.

Equal vectors are one node, which stands for the smallest ids of its rows (as many as any
answer can hold), so copies neither crowd a graph nor get lost. Nodes are dealt to shards of
bounded size by a hash of their smallest id, those of like length together, so that one huge
vector does not blur the others of its graph; a shard's graph is written once, as flat
arrays, and searched by blocks of queries. Every row is indexed; what a graph finds is
scored anew, in double precision on the original vectors.

Nearness is the largest inner product. Vectors that are null, all zero, empty, or hold null
or non-finite components take no part, nor do rows without id; vectors are compared only
with those of the same length. A query is never matched with rows of its own id; of rows
that repeat a query's id the smallest vector asks. Repeated rows are candidates each. With
fewer than k candidates all that are found are returned; no rows give none. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hnsw, store
from .common import materialise, shared_dir

#: Nodes of a shard, about; queries of a block.
SHARD = 8192
BLOCK = 512
#: Parts in which the ids of one vector are thinned before they meet.
SALT = 32


def taking_part(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v: array of doubles, for the vectors that take part."""
    x = F.transform(F.col(embedding), lambda e: e.cast("double"))
    fine = F.col(embedding).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(x, lambda e: e != 0)
    return vectors.where(fine & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("v"))


def nodes(rows: DataFrame, k: int) -> DataFrame:
    """v, node (smallest id), members: array of (id, times) of its k + 1 smallest ids."""
    ids = rows.groupBy("v", "vec_id").agg(F.count("*").alias("times")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALT)))
    for by in (("v", "salt"), ("v",)):  # a vector that many rows share is thinned in parts first
        ids = ids.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return ids.groupBy("v").agg(F.min("vec_id").alias("node"), F.array_sort(F.collect_list(F.struct("vec_id", "times"))).alias("members"))  # k + 1 at most


def banded(rows: DataFrame) -> DataFrame:
    """``rows`` with band, the power of 4 next to the length of v."""
    rows = rows.withColumn("top", F.array_max(F.transform("v", lambda e: F.abs(e))))  # a column, so that no lambda computes it anew
    scaled = F.aggregate("v", F.lit(0.0), lambda a, e: a + (e / F.col("top")) * (e / F.col("top")))
    return rows.withColumn("band", F.rint(F.log2("top") / 2 + F.log2(scaled) / 4).cast("int")).drop("top")


@lru_cache(maxsize=4)
def _graph(uri: str) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    g = store.arrays(uri)
    return g, [g[f"links{i}"] for i in range(int(g["levels"][0]))]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, ef: int = hnsw.SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that ``is_query`` selects by their vec_id."""
    spark, none = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    rows, home = taking_part(vectors), f"{shared_dir(vectors.sparkSession)}-ann"
    index = materialise(banded(nodes(rows, k).withColumn("dim", F.size("v"))), "ann-nodes")
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    # One row for each number of components (and power of 4 of the length).
    shards = {(r["dim"], r["band"]): -(-r["n"] // SHARD) for r in index.groupBy("dim", "band").agg(F.count("*").alias("n")).collect()}
    blocks = {(r["dim"],): -(-r["n"] // BLOCK) for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not shards or not blocks:
        return spark.createDataFrame([], none)

    def dealt(table: DataFrame, id_: str, parts: dict[tuple, int], *key: str) -> DataFrame:
        n = F.lit(1)
        for value, many in parts.items():
            if many > 1:
                n = F.when(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(key, value, strict=True)]), many).otherwise(n)
        out = table.withColumn("part", F.pmod(F.xxhash64(id_), n.cast("long")))
        return out.repartition(min(10_000, sum(parts.values())), *key, "part")

    def save_graph(part: pd.DataFrame) -> pd.DataFrame:
        dim, power, shard = (int(part[c].iloc[0]) for c in ("dim", "band", "part"))
        order, levels = hnsw.order_and_sizes(part["node"].to_numpy(np.int64))
        part = part.iloc[order]
        v = np.array(part["v"].tolist(), np.float64).reshape(len(part), dim)
        x = hnsw.lifted(v)
        links = hnsw.build(x, levels)
        members = part["members"].tolist()
        flat = np.array([(m["vec_id"], m["times"]) for own in members for m in own], np.int64).reshape(-1, 2)
        offs = np.cumsum([0, *map(len, members)])
        store.put_arrays(f"{home}/g-{dim}-{power}-{shard}", v=v, x=x, ids=flat[:, 0], times=flat[:, 1], offs=offs, levels=np.array([len(links)]), **{f"links{i}": a for i, a in enumerate(links)})
        return pd.DataFrame({"nodes": [len(part)]})

    def save_block(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        dim, block = int(part["dim"].iloc[0]), int(part["part"].iloc[0])
        store.put_arrays(f"{home}/q-{dim}-{block}", ids=part["vec_id"].to_numpy(np.int64), v=np.array(part["v"].tolist(), np.float64).reshape(len(part), dim))
        return pd.DataFrame({"nodes": [len(part)]})

    for table, id_, parts, key, save in ((index, "node", shards, ("dim", "band"), save_graph), (asked, "vec_id", blocks, ("dim",), save_block)):
        dealt(table, id_, parts, *key).groupBy(*key, "part").applyInPandas(save, "nodes long").agg(F.sum("nodes")).collect()

    def run(dim: int, names: list[tuple[int, int]], n_blocks: int):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for pair in b.column("id").to_pylist():
                    shard, block = divmod(pair, n_blocks)
                    for power, many in names:
                        if shard < many:
                            yield one(f"{home}/g-{dim}-{power}-{shard}", f"{home}/q-{dim}-{block}")
                            break
                        shard -= many

        def one(graph: str, block: str) -> pa.RecordBatch:
            out = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
            if store.exists(graph) and store.exists(block):  # a hash may leave a part empty
                (g, links), asks = _graph(graph), store.arrays(block)
                out = best(g, links, np.asarray(asks["ids"]), np.asarray(asks["v"]))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["query_id", "vec_id", "score"])

        def best(g: dict, links: list, qids: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
            found, sims = hnsw.search(g["x"], links, hnsw.asking(q), max(ef, k + 1))
            r, c = np.nonzero(sims > -np.inf)
            node = found[r, c]
            score = np.einsum("nd,nd->n", q[r], g["v"][node])
            n = g["offs"][node + 1] - g["offs"][node]
            at = np.repeat(g["offs"][node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            r, ids, score, times = np.repeat(r, n), g["ids"][at], np.repeat(score, n), np.minimum(g["times"][at], k)
            other = ids != qids[r]
            r, ids, score, times = (np.repeat(x[other], times[other]) for x in (r, ids, score, times))
            order = np.lexsort((ids, -score, r))
            r, ids, score = r[order], ids[order], score[order]
            first = np.searchsorted(r, r)  # the best k of this shard
            keep = np.arange(len(r)) - first < k
            return [qids[r[keep]], ids[keep], score[keep]]

        return scan

    pairs = []
    for (dim,), n_blocks in blocks.items():
        names = [(power, many) for (d, power), many in sorted(shards.items()) if d == dim]
        n = sum(many for _, many in names) * n_blocks
        pairs.append(spark.range(0, n, 1, min(n, 10_000)).mapInArrow(run(dim, names, n_blocks), "query_id long, vec_id long, score double"))
    near = pairs[0]
    for p in pairs[1:]:
        near = near.unionByName(p)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return materialise(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "ann")
