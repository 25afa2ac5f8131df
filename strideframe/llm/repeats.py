"""Removal of repeated byte strings by run-compressed Burrows-Wheeler indexes.

Every string of LENGTH bytes belongs to one anchor, the leftmost smallest k-mer
hash in it, so equal strings have equal anchors at equal places. Neighbouring
strings of one anchor form a span. Anchors that occur once, anywhere, rule their
strings out; anchors whose spans are all alike settle theirs; only anchors with
different spans around them are contested. For those, each distinct span's text
goes to one index partition, where a Burrows-Wheeler transform is built (suffixes
sorted by rank doubling, each only until it is told apart) and kept as runs with the places of their ends sampled;
streaming each text against the samples gives its matching statistics, compared
byte by byte where runs meet, and so the strings with a match of LENGTH bytes.

An anchor with more than HOT different spans is not gathered: its strings are
hashed and counted one by one, which any number of tasks can share.

Definitions: texts are UTF-8 bytes, null text is empty, strings never cross
documents. Rows are told apart by doc_id and text, so repeated rows match each
other and a null doc_id is no obstacle. Strings are judged on the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lookup
from .common import begin, materialise, release, slices, text_bytes
from .textkit import mix, prefix_hash, range_hash

U = np.uint64
LENGTH = 200
ANCHOR = 24
HOT = 4096
#: Bytes of text that one index holds, about; an anchor's spans are never divided. Its arrays, eight bytes for each, stay in the cache.
INDEX_BYTES = 96 << 10
ROW = "anchor long, span long, key long, lo long, n long, off long"


def spans(data: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(anchor, span hash, document, first string's start in the document, strings, anchor's place in the span)."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, U if i < 2 else np.int64) for i in range(6))
    pre = prefix_hash(data)
    at = np.arange(n - ANCHOR + 1)
    h = range_hash(pre, at, at + ANCHOR)
    bits = U(n.bit_length())
    best = (h >> bits << bits) | at.astype(U)  # ties between k-mers go to the leftmost
    width, step = length - ANCHOR + 1, 1
    while step * 2 <= width:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    if width > step:
        best = np.minimum(best[: len(best) - (width - step)], best[width - step :])
    place = (best & ((U(1) << bits) - U(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    m = n - length + 1
    whole = doc[:m] == doc[length - 1 :]
    same = np.r_[False, (place[1:] == place[:-1]) & whole[:-1] & whole[1:] & (doc[1:m] == doc[: m - 1])]
    start = np.flatnonzero(whole & ~same)
    stop = np.flatnonzero(whole & ~np.r_[same[1:], False])
    p = place[start]
    span = mix(range_hash(pre, start, stop + length) + (p - start).astype(U) * U(0x9E3779B97F4A7C15))
    return h[p], span, doc[start], start - offs[doc[start]], stop - start + 1, p - start


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of several texts, each with an end of its own.

    Kept are the runs (head, last row), the text places of each run's first and last row,
    and the common prefix of the two rows at every border between runs. That is enough for
    the matching statistics of every place against all the others: two rows of one run go
    on, one byte earlier, as neighbouring rows too, so a place that starts no run matches
    its upper neighbour for one byte less than the place before it does, and one that ends
    no run likewise its lower neighbour. A text begins a run of its own.
    """

    def __init__(self, texts: list[bytes], counts: np.ndarray, length: int = LENGTH):
        lens = np.array([len(t) for t in texts], np.int64)
        data, size = np.frombuffer(b"".join(texts), np.uint8), int(lens.sum())
        self.begin, self.counts, self.length = np.cumsum(lens) - lens, counts, length
        left = np.repeat(self.begin + lens, lens) - np.arange(size)  # bytes to the end of the text
        key, symbols, bits = self._keys(data, left)
        # Equal endings stay in the order of their texts, as ends that differ would have it.
        order = self._suffixes(key, symbols, bits, left)
        char = np.empty(size, np.int64)
        char[1:] = data[:-1]
        char[self.begin[lens > 0]] = 256 + np.flatnonzero(lens > 0)
        char = char[order]
        edge = np.flatnonzero(np.r_[True, char[1:] != char[:-1]][:size])
        runs = len(edge)
        self.heads, self.run_ends = char[edge], np.r_[edge[1:], size][:runs] - 1
        above, below = order[edge[1:] - 1], order[edge[1:]]
        border = self._common(key, symbols, bits, left, above, below)
        self.run_first, self.first_match = self._by_place(order[edge], np.r_[0, border][:runs])
        self.run_last, self.last_match = self._by_place(order[self.run_ends], np.r_[border, 0][:runs])

    @staticmethod
    def _keys(data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, int, int]:
        """(key, symbols, bits): for each suffix its first ``symbols`` symbols of ``bits`` bits, as many as leave room for a place in the word.

        Symbol 0 is the end of a text, then come the bytes that occur, in their order.
        """
        occurs = np.bincount(data, minlength=256) > 0
        bits = int(occurs.sum()).bit_length()
        count = max((64 - len(data).bit_length()) // max(bits, 1), 1)
        symbols = np.r_[np.cumsum(occurs).astype(U)[data], np.zeros(count, U)]
        key = np.zeros(len(data), U)
        for j in range(count):
            key <<= U(bits)
            key |= symbols[j : j + len(data)]
        over = np.flatnonzero(left < count)  # what follows the end of a text is no part of its suffixes
        key[over] &= ~U(0) << ((count - left[over]) * bits).astype(U)
        return key, count, bits

    @staticmethod
    def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(rising keys, their places), equal keys by place; a key below 2 ** ``bits`` is sorted in one word with its place, if both fit."""
        place = len(key).bit_length()
        if bits + place > 64:
            order = np.argsort(key, kind="stable")
            return key[order], order
        both = np.sort(key << U(place) | np.arange(len(key), dtype=U))
        return both >> U(place), (both & U((1 << place) - 1)).view(np.int64)

    @classmethod
    def _suffixes(cls, key: np.ndarray, symbols: int, bits: int, left: np.ndarray) -> np.ndarray:
        """Places of all suffixes in their order: those that agree so far are sorted by the rank of what follows, twice as far each time."""
        size = len(key)
        rank, order, rows, at = np.zeros(size, np.int64), np.zeros(size, np.int64), np.arange(size), np.arange(size)
        wide, done, longest = size.bit_length(), symbols, int(left.max(initial=0))
        sorted_, place = cls._sorted(key, symbols * bits)
        while True:
            at = at[place]
            order[rows] = at
            new = np.r_[True, sorted_[1:] != sorted_[:-1]][: len(at)]
            first = np.flatnonzero(new)
            rank[at] = np.repeat(rows[first], np.diff(np.r_[first, len(at)]))  # the first row of those that agree
            tied = np.flatnonzero(~(new & np.r_[new[1:], True][: len(at)]))
            if done >= longest or not len(tied):
                return order
            at, rows = at[tied], rows[tied]
            ahead = np.where(left[at] > done, rank[np.minimum(at + done, size - 1)] + 1, 0)
            sorted_, place = cls._sorted(rank[at].view(U) << U(wide) | ahead.view(U), 2 * wide)
            done *= 2

    @staticmethod
    def _common(key: np.ndarray, symbols: int, bits: int, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and ``b``, compared symbol by symbol."""
        most, out = np.minimum(left[a], left[b]), np.zeros(len(a), np.int64)
        open_ = np.arange(len(a))
        while len(open_):
            differ = key[a[open_] + out[open_]] ^ key[b[open_] + out[open_]]
            for j in range(1, symbols + 1):
                out[open_] += differ >> U(bits * (symbols - j)) == 0
            open_ = open_[(differ == 0) & (out[open_] < most[open_])]
        return np.minimum(out, most)

    @staticmethod
    def _by_place(place: np.ndarray, match: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(place)
        return place[order], match[order]

    def statistics(self) -> np.ndarray:
        """For each byte of the joined texts the longest match that it begins, anywhere else in the index."""
        size = int(self.run_ends[-1]) + 1 if len(self.run_ends) else 0
        out, at = np.zeros(size, np.int64), np.arange(size)
        for place, match in ((self.run_first, self.first_match), (self.run_last, self.last_match)):
            out = np.maximum(out, np.repeat(match + place, np.diff(np.r_[place, size])) - at)  # a text's start is always a sample
        return out

    def stream(self) -> Iterator[np.ndarray]:
        """For each text, whether each of its strings occurs elsewhere in the index."""
        long = self.statistics() >= self.length
        for a, n in zip(self.begin.tolist(), self.counts.tolist(), strict=True):
            yield long[a : a + n]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return edge[::2], edge[1::2]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", F.xxhash64(F.col("doc_id"), F.col("text")))


def repeated(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """key, lo, hi: byte ranges of strings that also start elsewhere; ``docs`` has key and text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("text")
        for whole in batches:
            for b in slices(whole, "text"):
                anchor, span, doc, lo, n, off = spans(*text_bytes(b.column("text")), length)
                cols = [anchor.view(np.int64), span.view(np.int64), b.column("key").to_numpy()[doc], lo, n, off]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor", "span", "key", "lo", "n", "off"])

    plain = docs.select("key", "text")
    all_ = materialise(plain.mapInArrow(emit, ROW), "spans")
    multi = all_.groupBy("anchor").agg(F.count("*").alias("times"), F.min("span").alias("low"), F.max("span").alias("high"))
    multi = materialise(multi.where("times > 1").select("anchor", (F.col("low") < F.col("high")).alias("contested")), "anchors")
    met = materialise(all_.join(multi, "anchor"), "met")
    release(all_)
    release(multi)
    reach = (F.col("lo") + F.col("n") + (length - 1)).alias("hi")
    settled = met.where("NOT contested").select("key", "lo", reach)
    open_ = met.where("contested").drop("contested")
    best = F.min(F.struct("key", "lo", "n", "off")).alias("best")
    variants = materialise(open_.groupBy("anchor", "span").agg(F.count("*").alias("times"), best).select("anchor", "span", "times", "best.*"), "variants")
    alike = materialise(variants.where("times > 1").select("anchor", "span"), "alike")
    several = open_.join(alike, ["anchor", "span"]).select("key", "lo", reach)
    many = materialise(variants.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("anchor"), "hot")
    listed = materialise(variants.join(many.withColumn("hot", F.lit(1).cast("long")), "anchor", "left").select("key", "anchor", "times", "lo", "n", "off", F.coalesce("hot", F.lit(0).cast("long")).alias("hot")), "listed")
    table = lookup.save(listed, "lo")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("text")
        names = ["anchor", "times", "lo", "n", "hot"]
        for whole in batches:
            for b in slices(whole, "text"):
                data, offs = text_bytes(b.column("text"))
                raw, keys = data.tobytes(), b.column("key").to_numpy()
                for i, seg, x, y in table.ranges(keys):
                    lo, n, base = seg["lo"][x:y], seg["n"][x:y], int(offs[i])
                    texts = [raw[base + a : base + a + c + length - 1] for a, c in zip(lo.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(y - x, keys[i])), *(pa.array(np.array(seg[c][x:y])) for c in names), pa.array(texts, pa.binary())], names=["key", *names, "ctx"])

    found = plain.mapInArrow(contexts, "key long, anchor long, times long, lo long, n long, hot long, ctx binary")
    found = materialise(found, "contexts")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("text")
        held, size = [], 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("anchor", "key", "times", "lo", "n", "ctx")), strict=True):
                if size >= INDEX_BYTES and held[-1][0] != row[0]:
                    yield marks(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield marks(held)

    def marks(held: list) -> pa.RecordBatch:
        _, key, times, lo, n, texts = zip(*held, strict=True)
        key, times, lo, n = (np.array(c, np.int64) for c in (key, times, lo, n))
        flags = np.concatenate([np.zeros(0, bool), *RunLengthIndex(list(texts), n, length).stream()])
        of, start = np.repeat(np.arange(len(n)), n), np.cumsum(n + 1) - (n + 1)
        apart = np.zeros(len(flags) + len(n), bool)  # with a gap behind every text
        apart[np.arange(len(flags)) + of] = flags & (times[of] == 1)  # spans that occur again whole are known already
        a, b = _runs(apart)
        at = np.searchsorted(start, a, "right") - 1
        base = lo[at] - start[at]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (key[at], base + a, base + b + (length - 1))], names=["key", "lo", "hi"])

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    cold = found.where("hot = 0").repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(index, "key long, lo long, hi long")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column("n").to_numpy()
            texts = b.column("ctx")
            data = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
            begin = np.cumsum(n + length - 1) - (n + length - 1)
            at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            h = range_hash(prefix_hash(data), at, at + length)
            each = lambda c: np.repeat(b.column(c).to_numpy(), n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(each("key")), pa.array(each("times")), pa.array(each("lo") + step)], names=["h", "key", "times", "lo"])

    pieces = [settled, several, cold]
    if many.count():
        apart = materialise(found.where("hot = 1").mapInArrow(strings, "h long, key long, times long, lo long"), "strings")
        twice = materialise(apart.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "twice")
        pieces.append(apart.where("times = 1").join(twice, "h").select("key", "lo", (F.col("lo") + length).alias("hi")))
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    out = materialise(out.distinct(), "ranges")
    for t in (met, variants, alike, many, listed, found):
        release(t)
    return out


def merged(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Unions of touching ranges; ``lo`` is sorted."""
    out: list[list[int]] = []
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removed(docs: DataFrame, table: lookup.Lookup, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_bytes, n_removed, n_spans, kept (bytes) for documents with key and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("text")
        for whole in batches:
            for b in slices(whole, "text"):
                data, offs = text_bytes(b.column("text"))
                raw, rows = data.tobytes(), b.num_rows
                gone, n_spans = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                kept = [raw[offs[i] : offs[i + 1]] for i in range(rows)]
                for i, seg, x, y in table.ranges(b.column("key").to_numpy()):
                    cuts = merged(seg["lo"][x:y], seg["hi"][x:y])
                    text, at, parts = kept[i], 0, []
                    for a, e in cuts:
                        parts.append(text[at:a])
                        at = e
                    kept[i] = b"".join([*parts, text[at:]])
                    gone[i], n_spans[i] = len(text) - len(kept[i]), len(cuts)
                got = [pa.array(np.diff(offs)), pa.array(gone), pa.array(n_spans), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *got], names=[*keep, "n_bytes", "n_removed", "n_spans", "kept"])

    plain = docs.select(*keep, "key", "text")
    schema = ", ".join(f"`{c}` {plain.schema[c].dataType.simpleString()}" for c in keep)
    return plain.mapInArrow(run, f"{schema}, n_bytes long, n_removed long, n_spans long, kept binary")


def deduplicated(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: what is left of every document."""
    keyed = _keyed(docs.select("doc_id", "text"))
    ranges = repeated(keyed, length, hot)
    table = lookup.save(ranges, "lo", "hi")
    release(ranges)
    return removed(keyed, table)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
