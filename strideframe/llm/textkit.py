"""Vectorised text kernels: words, word hashes and shingle hashes of a batch of documents."""

from __future__ import annotations

import numpy as np

U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: Entries that a kernel takes at once where one result follows from the last.
BLOCK = 1 << 15

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown on demand and kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base & _MASK, U)
        full[0] = 1
        have = _powers[base] = np.cumprod(full, dtype=U)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash; see :func:`range_hash`."""
    out, power = np.empty(len(data) + 1, U), powers(_BASE, len(data))
    out[0] = 0
    for i in range(0, len(data), BLOCK):  # in place, and in the cache
        part = out[i + 1 : i + 1 + BLOCK]
        np.add(data[i : i + BLOCK], U(1), out=part)
        part *= power[i : i + BLOCK]
        part[:1] += out[i : i + 1]
        np.cumsum(part, out=part)
    return out


def range_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for arrays of bounds, position independent."""
    inv = powers(_BASE_INV, len(pre))
    return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def running_hash(pre: np.ndarray, size: int) -> np.ndarray:
    """:func:`range_hash` of every range of ``size`` entries."""
    n = max(len(pre) - size, 0)
    return mix((pre[len(pre) - n :] - pre[:n]) * powers(_BASE_INV, len(pre))[:n] + U(size * 0xD6E8FEB86659FD93 & _MASK))


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and first-word index per document of maximal runs without ASCII white space.

    The third array has one more entry than documents: words of document d are first[d]:first[d+1].
    """
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    solid = np.zeros(len(data) + 2, bool)
    np.not_equal(data, 32, out=solid[1:-1])
    solid[1:-1] &= data - np.uint8(9) > 4  # bytes below 9 wrap round
    turns = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = turns[::2], turns[1::2]
    cuts = offs[(offs > 0) & (offs < len(data))]
    cuts = cuts[solid[cuts] & solid[cuts + 1]]  # between documents that touch
    if len(cuts):
        cuts = cuts[np.r_[True, cuts[1:] != cuts[:-1]]]
        starts, ends = np.insert(starts, np.searchsorted(starts, cuts), cuts), np.insert(ends, np.searchsorted(ends, cuts), cuts)
    return starts, ends, np.searchsorted(starts, offs)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first) of the words after lower-casing A-Z."""
    starts, ends, first = word_spans(data, offs)
    return range_hash(prefix_hash(lowered(data)), starts, ends), starts, ends, first


def all_shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the n-word shingles of documents words[first[d]:first[d + 1]]; a shorter one is one shingle."""
    size = np.diff(first)
    parts, owners = [], []
    for k in range(1, n + 1):
        if k < n:
            docs = np.flatnonzero(size == k)
            at = first[docs]
        else:
            at = np.arange(max(len(words) - n + 1, 0))
            doc = np.repeat(np.arange(len(size)), size)
            at = at[doc[at] == doc[at + n - 1]]
            docs = doc[at]
        acc = np.full(len(at), k, U)
        for j in range(k):
            acc = (acc ^ words[at + j]) * U(0xFF51AFD7ED558CCD)
            acc ^= acc >> U(32)
        parts.append(mix(acc))
        owners.append(docs)
    return np.concatenate(parts), np.concatenate(owners)
