"""Sorted tables in the shared folder that map-side code searches by memory map.

A table is cut by key range; all rows of a key are in one segment. The driver
holds one first key and one place for each segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed, store
from .common import begin, shared_dir

ROWS = 1_000_000


@lru_cache(maxsize=512)
def _segment(uri: str) -> dict[str, np.ndarray]:
    return store.arrays(uri)


class Lookup:
    def __init__(self, segments: list[tuple[int, str]]):
        self.segments = sorted(segments)
        self.firsts = np.array([s[0] for s in self.segments], np.int64)

    def ranges(self, keys: np.ndarray) -> Iterator[tuple[int, dict[str, np.ndarray], int, int]]:
        """(position in ``keys``, segment, lo, hi) for every key that has rows."""
        at = np.searchsorted(self.firsts, keys, "right") - 1
        for s in np.unique(at[at >= 0]):
            rows, seg = np.flatnonzero(at == s), _segment(self.segments[s][1])
            lo, hi = np.searchsorted(seg["key"], keys[rows]), np.searchsorted(seg["key"], keys[rows], "right")
            for i, a, b in zip(rows[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                yield i, seg, a, b

    def first(self, keys: np.ndarray, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
        """(found, values of the columns ``names`` in the first row of each key; 0 where there is none)."""
        found, out = np.zeros(len(keys), bool), [np.zeros(len(keys), np.int64) for _ in names]
        order = np.argsort(keys)  # rising keys stay close together in a segment
        rising = keys[order]
        edges = np.r_[np.searchsorted(rising, self.firsts), len(keys)]
        for s in np.flatnonzero(np.diff(edges)):
            rows, want, seg = order[edges[s] : edges[s + 1]], rising[edges[s] : edges[s + 1]], _segment(self.segments[s][1])
            i = np.minimum(np.searchsorted(seg["key"], want), len(seg["key"]) - 1)
            hit = seg["key"][i] == want
            found[rows[hit]] = True
            for o, n in zip(out, names, strict=True):
                o[rows[hit]] = seg[n][i[hit]]
        return found, out


def save(rows: DataFrame, *order: str, count: int | None = None) -> Lookup:
    """Write ``rows`` (key and other columns, all long), sorted by key, then ``order``."""
    home, names = shared_dir(rows.sparkSession) + "-lookup", rows.columns
    n = max(1, -(-(rows.count() if count is None else count) // ROWS))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(c).to_numpy() for c in names] for b in batches if b.num_rows]
        if got:
            cols = dict(zip(names, (np.concatenate(x) for x in zip(*got, strict=True)), strict=True))
            first = int(cols["key"][0])
            store.put_arrays(f"{home}/{first}", **cols)
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([f"{home}/{first}"])], names=["first", "uri"])

    parts = rows.repartitionByRange(n, "key").sortWithinPartitions("key", *order).mapInArrow(write, "first long, uri string").collect()
    return Lookup([(r["first"], r["uri"]) for r in parts])


def among(rows: DataFrame, column: str, ids: Lookup, inside: bool = True) -> DataFrame:
    """The rows whose ``column`` (cast to long) is a key of ``ids``, or else those where it is none (null never is). No row leaves its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("text")
        for b in batches:
            key = b.column(b.num_columns - 1)
            found, _ = ids.first(pc.fill_null(key, 0).to_numpy())
            found &= key.is_valid().to_numpy(zero_copy_only=False)
            yield b.select(list(range(b.num_columns - 1))).filter(pa.array(found == inside))

    return rows.select("*", F.col(column).cast("long").alias("key of rows")).mapInArrow(run, rows.schema)


def _written(uri: str, **cols: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(cols["key"]):
        store.put_arrays(uri, **cols)
        yield pa.RecordBatch.from_arrays([pa.array(cols["key"][:1]), pa.array([uri])], names=["first", "uri"])


def repeated(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], parts: int) -> Lookup:
    """key, n of the keys (evenly spread longs) that ``keys_of`` gives more than once in all batches of ``rows``; a part is a segment."""
    home, splits = shared_dir(rows.sparkSession) + "-lookup", packed.evenly(parts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("text")
        held, size = [], 0
        for b in batches:
            for keys in keys_of(b):
                held.append(keys)
                size += len(keys)
                if size >= packed.FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        n = n.astype(np.uint32)
        for part, at, to in packed.pieces(key, splits):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([key[at:to].tobytes()]), pa.array([n[at:to].tobytes()])], names=["part", "keys", "counts"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("text")
        key, n = packed.summed(batches)
        key, n = key[n > 1], n[n > 1]
        yield from _written(f"{home}/{int(key[0]) if len(key) else 0}", key=key, n=n)

    dealt = rows.mapInArrow(deal, "part int, keys binary, counts binary").repartitionById(parts, F.col("part")).select("keys", "counts")
    return Lookup([(r["first"], r["uri"]) for r in dealt.mapInArrow(save, "first long, uri string").collect()])


def _ranks(ids: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places by id, null first, then key; the rank of every place)."""
    both = pa.table({"id": ids, "key": pa.array(keys)})
    order = pc.sort_indices(both, sort_keys=[("id", "ascending"), ("key", "ascending")], null_placement="at_start").to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return order, rank


def _least(key: np.ndarray, n: np.ndarray, of: np.ndarray, ids: pa.Array, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rising distinct keys, their counts, and the place of the first of their documents (ids, then docs)."""
    by_rank, rank = _ranks(ids, docs)
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    if not len(new):
        return key, n, of
    return key[new], np.add.reduceat(n[order].astype(np.int64), new), by_rank[np.minimum.reduceat(rank[of[order]], new)]


def repeated_firsts(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[tuple]], parts: int) -> Lookup:
    """key and doc (key of the first row, by doc_id, then key) of keys that occur more than once.

    ``keys_of`` gives (keys, row of each, doc_ids, row keys), again and again.
    """
    home, splits, kind = shared_dir(rows.sparkSession) + "-lookup", packed.evenly(parts), rows.schema["doc_id"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("text")
        held, size, docs = [], 0, 0
        for b in batches:
            for key, of, ids, own in keys_of(b):
                held.append((key, of + docs, ids, own))
                size, docs = size + len(key), docs + len(own)
                if size >= packed.FLUSH:
                    yield from flush(held)
                    held, size, docs = [], 0, 0
        if size:
            yield from flush(held)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        key, of, ids, own = zip(*held, strict=True)
        ids, own, key = pa.concat_arrays(ids), np.concatenate(own), np.concatenate(key)
        key, n, of = _least(key, np.ones(len(key), np.uint32), np.concatenate(of), ids, own)
        n = n.astype(np.uint32)
        for part, at, to in packed.pieces(key, splits):
            used, place = np.unique(of[at:to], return_inverse=True)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), x) for x in (ids.take(pa.array(used)), pa.array(own[used]))]
            blobs = [pa.array([x.tobytes()]) for x in (key[at:to], n[at:to], place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *blobs, *lists], names=["part", "keys", "counts", "of", "ids", "docs"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("text")
        key, n, of, ids, own, docs = [], [], [], [], [], 0
        for b in batches:
            for i in range(b.num_rows):
                for col, name, t in ((key, "keys", np.int64), (n, "counts", np.uint32), (of, "of", np.int32)):
                    col.append(np.frombuffer(b.column(name)[i].as_py(), t))
                of[-1] = of[-1].astype(np.int64) + docs
                ids.append(b.column("ids")[i].values)
                own.append(b.column("docs")[i].values.to_numpy())
                docs += len(own[-1])
        if key:
            own = np.concatenate(own)
            key, n, of = _least(np.concatenate(key), np.concatenate(n), np.concatenate(of), pa.concat_arrays(ids), own)
            more = n > 1
            yield from _written(f"{home}/{int(key[more][0]) if more.any() else 0}", key=key[more], doc=own[of[more]])

    dealt = rows.mapInArrow(deal, f"part int, keys binary, counts binary, of binary, ids array<{kind}>, docs array<long>").repartitionById(parts, F.col("part"))
    return Lookup([(r["first"], r["uri"]) for r in dealt.mapInArrow(save, "first long, uri string").collect()])
