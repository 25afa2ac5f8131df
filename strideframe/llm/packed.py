"""Keys that are shuffled as packed arrays, by parts of the key range, and added up there.

A task holds a bounded number of keys, adds equal ones up and deals them out; so a key that
is very frequent reaches its part as one entry for each time a task lets go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOB = 128_000  # keys that are shuffled as one value
FLUSH = 2_000_000  # keys that one task holds at a time


def evenly(parts: int) -> np.ndarray:
    """First keys of all parts but the first, for longs that are spread evenly."""
    return np.array([i * (1 << 64) // parts - (1 << 63) for i in range(1, parts)], np.int64)


def pieces(key: np.ndarray, splits: np.ndarray, blob: int = BLOB) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of the pieces of rising keys, ``blob`` of them at most."""
    edges = np.r_[0, np.searchsorted(key, splits), len(key)]
    for part in np.flatnonzero(np.diff(edges)).tolist():
        for at in range(int(edges[part]), int(edges[part + 1]), blob):
            yield part, at, min(at + blob, int(edges[part + 1]))


def summed(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Rising distinct keys and their counts, of packed partial counts (keys, counts)."""
    got = [[np.frombuffer(x, t) for x in b.column(c).to_pylist()] for b in batches for c, t in (("keys", np.int64), ("counts", np.uint32))]
    key, n = (np.concatenate([np.zeros(0, t), *sum(got[i::2], [])]) for i, t in enumerate((np.int64, np.uint32)))
    del got
    order = np.argsort(key)
    key, n = key[order], n[order].astype(np.int64)
    del order
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[new], np.add.reduceat(n, new) if len(new) else n
