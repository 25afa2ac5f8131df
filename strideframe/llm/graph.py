"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is a handful of joins and grouped minima; nothing is collected but a
count and a checksum. Minima are written before they are joined back, so that the
join has plain exchanges on both sides and AQE can split a node of any degree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, materialise, narrowed, release


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


#: Rows (two longs) of a task.
EACH = 250_000


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) for every id in ``links`` (a, b: long); no links: no rows.

    Self-links, repeats and both directions are allowed; rows with a null end are ignored.
    ``links`` is read twice and must be deterministic.
    """
    with compact(links.sparkSession):
        return _components(links)


def _components(links: DataFrame) -> DataFrame:
    pairs = links.where(F.col("a") != F.col("b"))
    edges = materialise(narrowed(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), pairs.count(), EACH), "edges")
    state = _state(edges)
    while state[0]:
        rows = 2 * state[0]  # no table of a round has more
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(narrowed(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), rows, EACH), "least")
        large = materialise(narrowed(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), rows, EACH), "large")
        release(least)
        least = materialise(narrowed(large.groupBy("u").agg(F.min("v").alias("m")), rows, EACH), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialise(narrowed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), rows, EACH), "edges")
        for old in (edges, large, least):
            release(old)
        edges, before = new, state
        state = _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
