"""Elias-Fano coded monotone sequences on plain arrays, so that they can be memory-mapped.

A value is split into low bits, packed side by side, and a high part, coded in
unary; ``select`` on the unary bits gives access by index and, through its
zeros, the few entries that share a high part: successor search looks only there.
All operations take arrays of queries.
"""

from __future__ import annotations

import numpy as np

U = np.uint64

_SELECT = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    for _k, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _SELECT[_b, _k] = _p
_EACH = U(0x0101010101010101)  # one in every byte


def _select_in_words(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) one bit in each word."""
    s = words - ((words >> U(1)) & U(0x5555555555555555))
    s = (s & U(0x3333333333333333)) + ((s >> U(2)) & U(0x3333333333333333))
    s = ((s + (s >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * _EACH  # byte j: ones in bytes 0 to j
    k = k.astype(U)
    byte = np.bitwise_count(((k * _EACH | _EACH << U(7)) - s) & (_EACH << U(7))).astype(U) << U(3)
    before = (s << U(8)) >> byte & U(255)
    return (byte + _SELECT[(words >> byte & U(255)).astype(np.intp), (k - before).astype(np.intp)]).astype(np.int64)


def _first_one(words: np.ndarray) -> np.ndarray:
    """Place of the lowest one bit of words that aren't zero."""
    return np.bitwise_count((words & (~words + U(1))) - U(1)).astype(np.int64)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    n = len(values)
    out = np.zeros((n * bits + 63) // 64 + 2, U)
    if bits and n:
        at = np.arange(n, dtype=np.int64) * bits
        word, off = at >> 6, (at & 63).astype(U)
        np.bitwise_or.at(out, word, values << off)
        spill = (at & 63) + bits > 64
        np.bitwise_or.at(out, word[spill] + 1, values[spill] >> (U(64) - off[spill]))
    return out


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of the coded sequence; ``values`` is uint64 and never falls."""
    values = np.asarray(values, U)
    n = len(values)
    top = int(values[-1]) if n else 0
    bits = max(0, int(top // max(n, 1)).bit_length() - 2)  # at most one entry a high part, on average
    high = (values >> U(bits)).astype(np.int64)
    size = n + (top >> bits) + 2
    words = np.zeros((size + 63) // 64, U)
    at = high + np.arange(n)
    np.bitwise_or.at(words, at >> 6, U(1) << (at & 63).astype(U))
    ones = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.bitwise_count(words), out=ones[1:])
    low = _pack(values & U((1 << bits) - 1), bits)
    return {"high": words, "ones": ones, "low": low, "meta": np.array([n, bits, top], U)}


class EliasFano:
    """Reader of :func:`encode`'s arrays."""

    def __init__(self, parts: dict[str, np.ndarray], prefix: str = ""):
        self.high, self.ones, self.low, meta = (parts[prefix + k] for k in ("high", "ones", "low", "meta"))
        self.n, self.bits, self.top = int(meta[0]), int(meta[1]), int(meta[2])
        self.zeros = None

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U)
        at = i * self.bits
        word, off = at >> 6, at.view(U) & U(63)
        v = self.low[word] >> off
        v |= (self.low[word + 1] << U(1)) << (off ^ U(63))  # in two steps: nothing of the next word where off is 0
        v &= U((1 << self.bits) - 1)
        return v

    def _select1(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        return (word << 6) + _select_in_words(self.high[word], i - self.ones[word])

    def _select0(self, k: np.ndarray) -> np.ndarray:
        if self.zeros is None:
            self.zeros = (np.arange(len(self.ones), dtype=np.int64) << 6) - self.ones
        word = np.searchsorted(self.zeros, k, "right") - 1
        return (word << 6) + _select_in_words(~self.high[word], k - self.zeros[word])

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at the indices ``i``."""
        i = np.asarray(i, np.int64)
        return ((self._select1(i) - i).astype(U) << U(self.bits)) | self._low(i)

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at the indices ``i`` and ``i + 1``: the second bit mostly shares a word with the first."""
        i = np.asarray(i, np.int64)
        at = self._select1(i)
        start = at + 1
        word = self.high[start >> 6] >> (start & 63).astype(U)
        following = start + _first_one(word)
        far = np.flatnonzero(word == 0)
        following[far] = self._select1(i[far] + 1)
        return ((at - i).astype(U) << U(self.bits)) | self._low(i), ((following - i - 1).astype(U) << U(self.bits)) | self._low(i + 1)

    def _bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the indices whose high part is ``h``."""
        start = np.where(h > 0, self._select0(np.maximum(h - 1, 0)) + 1, 0)
        gap = ~self.high[start >> 6] >> (start & 63).astype(U)
        lo = start - h
        hi = lo + _first_one(gap)
        far = np.flatnonzero(gap == 0)  # the run of ones leaves the word
        hi[far] = self._select0(h[far]) - h[far]
        return lo, hi

    def _search(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions in ``v`` up to the top value, index of their successor, whether it is the value itself)."""
        inside = np.flatnonzero(v <= U(self.top)) if self.n else np.zeros(0, np.int64)
        x = v[inside]
        lo, end = self._bucket((x >> U(self.bits)).view(np.int64))
        hi = end - 1  # the last one is only compared at the end
        want = x & U((1 << self.bits) - 1)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):  # binary search among the entries of the same high part
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        some = np.flatnonzero(lo < end)
        low, want = self._low(lo[some]), want[some]
        same = np.zeros(len(lo), bool)
        same[some] = low == want
        lo[some] += low < want
        return inside, lo, same

    def successor(self, v: np.ndarray) -> np.ndarray:
        """Index of the first entry >= v for each v (n where there is none)."""
        v = np.asarray(v, U)
        out = np.full(len(v), self.n, np.int64)
        inside, at, _ = self._search(v)
        out[inside] = at
        return out

    def find(self, v: np.ndarray) -> np.ndarray:
        """Index of each v, -1 where it isn't in the sequence: its successor, if that is v itself."""
        v = np.asarray(v, U)
        out = np.full(len(v), -1, np.int64)
        inside, at, same = self._search(v)
        out[inside[same]] = at[same]
        return out
