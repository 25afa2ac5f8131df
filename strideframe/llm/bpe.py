"""Byte-level BPE encoding and decoding on length-bucketed padded matrices.

Distinct pre-tokens of a batch are laid out as rows of padded id matrices, one
bucket per length class. In every round each row finds the leftmost of its
minimum-rank pairs by a hashed pair lookup, merges it, and closes the gap; rows
without a pair leave the matrix. Decoding concatenates the byte strings of ids.

A pre-token of over 512 bytes is a matrix of its own, whose row minima find the next
merge (:meth:`ByteBPE.merge_long`); it may be as long as the text.

Null text is treated as empty: no ids and no bytes. Extra columns pass through.
Repeated rows are coded each; no rows give none.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import begin, holds, slices

#: Pre-tokens whose ids one worker remembers before it starts afresh; a slice with more holds all of its own.
MEMO = 150_000
#: Cells of one padded matrix.
CELLS = 1 << 21
NONE = np.int32(1 << 30)


class PairTable:
    """Open-addressing hash table (left id, right id) -> rank of the merged token."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 3))))
        size = 1 << self.bits
        self.keys = np.full(size, ~np.uint64(0))
        self.vals = np.full(size, NONE)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == ~np.uint64(0)
            put = todo[free]
            _, firsts = np.unique(slot[put], return_index=True)
            put = put[firsts]
            self.keys[slot[put]], self.vals[slot[put]] = keys[put], rank[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks (= ids) of the merges, NONE where a pair doesn't merge; any shape."""
        keys = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)).ravel()
        out, slot, todo = np.full(len(keys), NONE), self._slot(keys), np.arange(len(keys))
        while len(todo):
            held = self.keys[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.vals[slot[todo[hit]]]
            todo = todo[~hit & (held != ~np.uint64(0))]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
        return out.reshape(left.shape)


class ByteBPE:
    """Encoder and decoder for a rank file of base64 tokens and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.by_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*np.array(pairs, np.int64).T)
        self.whole = ranks
        self.memo: dict[str, np.ndarray] = {}

    def merge(self, rows: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge padded id rows to the end; returns the ids and the lengths."""
        out, out_lens = rows.copy(), lens.copy()
        live, ids, n = np.arange(len(rows)), rows.copy(), lens.copy()
        while len(live) and ids.shape[1] > 1:
            ranks = self.pairs.get(ids[:, :-1], ids[:, 1:])
            ranks[np.arange(ids.shape[1] - 1) >= (n - 1)[:, None]] = NONE
            at = ranks.argmin(1)
            best = ranks[np.arange(len(live)), at]
            done = best == NONE
            if done.any():
                out[live[done], : ids.shape[1]], out_lens[live[done]] = ids[done], n[done]
                keep = ~done
                live, ids, n, at, best = live[keep], ids[keep], n[keep], at[keep], best[keep]
                if not len(live):
                    break
            ids[np.arange(len(live)), at] = best
            cols = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)
            n = n - 1
        if len(live):
            out[live, : ids.shape[1]], out_lens[live] = ids, n
        return out, out_lens

    def merge_long(self, ids: np.ndarray, width: int = 256) -> np.ndarray:
        """One row of any length, laid out as a matrix of ``width`` columns whose row minima are kept.

        A round finds the least rank by the minima and merges all of its places from left
        to right, up to the first merge that makes a pair of lower rank; what is merged
        leaves a hole, so a round costs the rows it touches and not the length.
        """
        n = len(ids)
        ids = np.r_[ids, np.zeros(1, ids.dtype)]  # one more place, for what follows the last
        rank = np.full(-(-n // width) * width, NONE)
        rank[: n - 1] = self.pairs.get(ids[: n - 1], ids[1:n])
        grid = rank.reshape(-1, width)
        least = grid.min(1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # neighbours that are left; n: none

        def pair(left: np.ndarray, right: np.ndarray, fine: np.ndarray) -> np.ndarray:
            return np.where(fine, self.pairs.get(left, right), NONE)

        while (r := least.min()) < NONE:
            rows = np.flatnonzero(least == r)
            y, x = np.nonzero(grid[rows] == r)
            at = rows[y] * width + x
            linked = np.r_[False, after[at[:-1]] == at[1:]]  # shares a token with the place before
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
            at = at[run % 2 == 0]
            gone = after[at]
            right, left = after[gone], before[at]
            joined = np.r_[False, right[:-1] == at[1:]]  # the token to the left has just been made
            made = np.full(len(at), r, ids.dtype)
            lower = (pair(np.where(joined, r, ids[left]), made, left >= 0) < r) | (pair(made, ids[right], right < n) < r)
            if lower.any():
                at = at[: int(lower.argmax()) + 1]
                gone = after[at]
            right = after[gone]
            ids[at], after[at], before[right] = r, right, at
            rank[gone] = NONE
            left = before[at]
            rank[at] = pair(ids[at], ids[right], right < n)
            left = left[left >= 0]
            rank[left] = self.pairs.get(ids[left], ids[after[left]])
            touched = np.unique(np.r_[at, gone, left] // width)
            least[touched] = grid[touched].min(1)
        out, i = [], 0
        while i < n:
            out.append(i)
            i = int(after[i])
        return ids[out]

    def learn(self, pieces: list[str]) -> None:
        """Put the ids of distinct pre-tokens into the memo."""
        rest = []
        for p in pieces:
            whole = self.whole.get(p.encode())
            if whole is None:
                rest.append(p)
            else:
                self.memo[p] = np.array([whole], np.int32)
        pieces = rest
        raw = [p.encode() for p in pieces]
        lens = np.array([len(b) for b in raw])
        order = np.argsort(lens, kind="stable")
        a = 0
        while a < len(order):
            width = int(lens[order[a]])
            cap = width if width <= 16 else 1 << (width - 1).bit_length()
            b = min(int(np.searchsorted(lens[order], cap, "right")), a + max(1, CELLS // max(cap, 1)))
            rows = order[a:b]
            if cap > 512:
                for i in rows:
                    self.memo[pieces[i]] = self.merge_long(self.by_byte[np.frombuffer(raw[i], np.uint8)])
            else:
                n = lens[rows]
                flat = self.by_byte[np.frombuffer(b"".join(raw[i] for i in rows), np.uint8)]
                cells = np.zeros((len(rows), cap), np.int32)
                cells[np.arange(cap) < n[:, None]] = flat
                ids, n = self.merge(cells, n)
                for i, row, k in zip(rows.tolist(), ids, n.tolist(), strict=True):
                    self.memo[pieces[i]] = row[:k].copy()
            a = b

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        parts = [self.split.findall(t) if t else [] for t in texts]
        index: dict[str, int] = {}
        where = np.fromiter((index.setdefault(p, len(index)) for part in parts for p in part), np.int64)
        self.learn_missing(list(index))
        rows = [self.memo[p] for p in index]
        lens = np.array([len(r) for r in rows], np.int64)
        bounds = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=bounds[1:])
        table = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        n = lens[where]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - bounds[where], n)
        doc_ends = np.zeros(len(texts) + 1, np.int64)
        doc_ends[1:] = np.cumsum([len(p) for p in parts])
        token_ends = np.concatenate([[0], ends])
        return table[at], token_ends[doc_ends]

    def learn_missing(self, pieces: list[str]) -> None:
        missing = [p for p in pieces if p not in self.memo]
        if missing and len(self.memo) + len(missing) > MEMO:
            self.memo.clear()  # before the slice is learnt, never within it: all its pieces stay, however many
            missing = pieces
        if missing:
            self.learn(missing)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text or ""])[0].tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBPE:
    """One coder per worker process."""
    return ByteBPE(path, pattern)


holds("bpe", coder.cache_clear)

def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``, the token ids of ``text`` (null text: empty list). A column named ``ids`` is replaced."""
    docs = docs.drop(ids)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe")
        bpe = coder(path, pattern)
        for whole in batches:
            for b in slices(whole, text, 2 << 20):
                flat, offs = bpe.encode_batch(b.column(text).to_pylist())
                col = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, col], names=[*b.schema.names, ids])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the bytes that ``ids`` stand for (null ids: null). A column named ``out`` is replaced."""
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe")
        bpe = coder(path, pattern)
        for b in batches:
            col = pa.array([None if x is None else bpe.decode(x.tolist()) for x in (s.values.to_numpy() if s.is_valid else None for s in b.column(ids))], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, col], names=[*b.schema.names, out])

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded bytes, one row per document."""
    coded = decode(encode(docs.select("doc_id", text), path, pattern, text).drop(text), path, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
