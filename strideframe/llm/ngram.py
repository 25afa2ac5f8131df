"""Language-model scores from an Elias-Fano n-gram trie.

Level 1 maps word hashes (a monotone sequence) to exact counts. Level n holds,
for every node of level n - 1 that has followers, a pointer into one monotone
sequence of context-relative word ids, and for every n-gram an 8-bit code of
its discounted probability; interpolation weights of contexts are coded
likewise. Levels are cut into segments by key range; each is a file in the
shared folder that executors memory-map, so nothing of the model passes the driver
but the segments' first keys.

P(w | ctx) = max(c(ctx w) - D, 0) / c(ctx) + weight(ctx) * P(w | shorter ctx), down
to P(w) = (c + 0.5) / (N + 0.5 (V + 1)). An n-gram of two or more words is kept
from MIN_COUNT occurrences on, 1: every one (the weight takes up the rest); as an
n-gram is no more frequent than its parts, candidates hold only kept parts.

Definitions: null text is empty and scores the end token alone. Rows whose fold is
not 1 teach; a null doc_id is never held out. Repeated rows count and are scored
each. Without training rows every token has probability 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packed, store
from .common import begin, holds, materialise, release, shared_dir, slices, text_bytes
from .eliasfano import EliasFano, encode
from .textkit import mix, word_hashes

U = np.uint64
ORDER = 3
MIN_COUNT = 1
DISCOUNT = 0.75
END = U(0x1D872B41C3A95E6F)  # stands for the end token among word hashes
SEGMENT = 2_000_000  # entries a segment, about
FLUSH = 4_000_000  # tokens whose counts one task holds at a time
PART = 3_000_000  # training tokens for each part of the n-grams of an order, about; it holds no more partial counts
WORD_BYTES = 64 << 20  # of training text for each part of the words, about
SAMPLES = ((64, 7), (1, 13))  # for the bounds of parts: of one in so many texts the keys whose hash has so many zeros
SLICE = 4 << 20  # bytes of text that are walked at once: their keys are looked up segment by segment
BLOB = packed.BLOB
SIGN = U(1 << 63)


def as_long(h: np.ndarray) -> np.ndarray:
    """Unsigned keys as longs of the same order."""
    return (h ^ SIGN).view(np.int64)


def as_key(v: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(v).view(U) ^ SIGN


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising distinct keys and the place of every key among them; hashing comes first, so only distinct ones are sorted."""
    code, found = pd.factorize(keys)
    order = np.argsort(found)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found[order], rank[code]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, then one end for each text) and the offsets of the texts."""
    data, offs = text_bytes(texts)
    h, _, _, first = word_hashes(data, offs)
    n = len(offs) - 1
    out = np.full(len(h) + n, END, U)
    bounds = first + np.arange(n + 1)
    out[np.arange(len(h)) + np.repeat(np.arange(n), np.diff(first))] = h
    return out, bounds


@lru_cache(maxsize=256)
def _segment(uri: str) -> dict:
    parts = store.arrays(uri)
    ef = {name: EliasFano(parts, f"{name}.") for name in {k.split(".")[0] for k in parts if "." in k}}
    return parts | ef


holds("ngram", _segment.cache_clear)


class Table:
    """Monotone keys in segments with a value each; segments: (first key, first index, place)."""

    def __init__(self, segments: list[tuple[int, int, str]]):
        self.segments = sorted(segments)
        self.firsts = np.array([s[0] for s in self.segments], U)
        self.starts = np.array([s[1] for s in self.segments], np.int64)

    def get(self, keys: np.ndarray, default: float) -> tuple[np.ndarray, np.ndarray]:
        """(index or -1, decoded value or default) of every key."""
        index, value = np.full(len(keys), -1, np.int64), np.full(len(keys), default)
        at = np.searchsorted(self.firsts, keys, "right") - 1
        for s in np.unique(at[at >= 0]):
            rows, seg = np.flatnonzero(at == s), _segment(self.segments[s][2])
            i = seg["key"].find(keys[rows] - self.firsts[s])
            rows, i = rows[i >= 0], i[i >= 0]
            index[rows], value[rows] = i + self.starts[s], seg["book"][seg["code"][i]]
        return index, value

    def counts_at(self, index: np.ndarray) -> np.ndarray:
        out = np.zeros(len(index), np.int64)
        at = np.searchsorted(self.starts, index, "right") - 1
        for s in np.unique(at):
            rows, seg = np.flatnonzero(at == s), _segment(self.segments[s][2])
            out[rows] = seg["book"][seg["code"][index[rows] - self.starts[s]]]
        return out


class Level:
    """n-grams of one order: pointers from contexts to their followers; segments: (first key, first node, place)."""

    def __init__(self, segments: list[tuple[int, int, str]], words: int, nodes: int):
        self.segments, self.words, self.nodes = sorted(segments), words, nodes
        self.firsts = np.array([s[0] for s in self.segments], U)
        self.starts = np.array([s[1] for s in self.segments], np.int64)

    def get(self, keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(node id or -1, discounted probability or 0) of every key ctx * words + word; keys rise.

        ``weight`` gets the weights of the contexts, where they have followers.
        """
        node, prob = np.full(len(keys), -1, np.int64), np.zeros(len(keys))
        at = np.searchsorted(self.firsts, keys, "right") - 1
        for s in np.unique(at[at >= 0]):
            rows, seg = np.flatnonzero(at == s), _segment(self.segments[s][2])
            words = U(self.words)
            own = keys[rows] // words
            heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])  # a context is looked up once for all its words
            c = seg["ctx"].find(own[heads] - self.firsts[s] // words)
            times = np.diff(np.r_[heads, len(own)])
            rows, times, c = rows[np.repeat(c >= 0, times)], times[c >= 0], c[c >= 0]
            lo, hi = (x.astype(np.int64) for x in seg["ptr"].pair(c))
            base = np.where(lo > 0, seg["rel"].access(np.maximum(lo - 1, 0)), U(0))
            wide = np.repeat(np.arange(len(c)), times)
            if weight is not None:
                weight[rows] = seg["wbook"][seg["wcode"][c]][wide]
            lo, hi, base = lo[wide], hi[wide], base[wide]
            want = base + keys[rows] % words + U(1)
            i = seg["rel"].find(want)  # by successor search
            ok = np.flatnonzero((i >= lo) & (i < hi))  # only the context's own range counts
            rows, i = rows[ok], i[ok]
            node[rows], prob[rows] = i + self.starts[s], seg["book"][seg["code"][i]]
        return node, prob

    def counts_at(self, index: np.ndarray) -> np.ndarray:
        out = np.zeros(len(index), np.int64)
        at = np.searchsorted(self.starts, index, "right") - 1
        for s in np.unique(at):
            rows, seg = np.flatnonzero(at == s), _segment(self.segments[s][2])
            out[rows] = seg["counts"][seg["ccode"][index[rows] - self.starts[s]]]
        return out


def _book(values: np.ndarray, levels: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Codebook of at most ``levels`` values (equal shares of the entries, geometric means) and codes."""
    found, inverse, times = _values(values)
    if len(found) <= levels:
        return found, inverse.astype(np.uint8)
    logs, last = np.log(np.maximum(found, 1e-12)), np.cumsum(times) - 1
    at = np.linspace(0, 1, levels + 1)[1:-1] * last[-1]
    low, high = (logs[np.searchsorted(last, f(at))] for f in (np.floor, np.ceil))
    edges = np.unique(low + (high - low) * (at - np.floor(at)))  # quantiles over all entries
    code = np.searchsorted(edges, logs, "right")
    book = np.exp(np.bincount(code, logs * times, len(edges) + 1) / np.maximum(np.bincount(code, times, len(edges) + 1), 1))
    return book, code.astype(np.uint8)[inverse]


def _exact(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    book, code, _ = _values(values)
    return book, code.astype(np.min_scalar_type(max(len(book) - 1, 0)))


def _values(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rising distinct values, the place of every entry among them and how often each occurs."""
    found, place = distinct(values)
    return found, place, np.bincount(place, minlength=len(found))


def _prefixed(name: str, parts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in parts.items()}


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray] | None:
    got = [[b.column(n).to_numpy() for n in names] for b in batches if b.num_rows]
    return [np.concatenate(x) for x in zip(*got, strict=True)] if got else None


def _placed(parts: list, plus: int = 0) -> list[tuple[int, int, str]]:
    out, at = [], 0
    for r in sorted(parts, key=lambda r: r["first"]):
        out.append((r["first"] + plus, at, r["uri"]))
        at += r["n"]
    return out


def _saved(rows: DataFrame, home: str, pack) -> list:
    """Sort ``rows`` into segments by key range; ``pack(key, n, k)`` gives a segment's arrays."""
    n = max(1, -(-rows.count() // SEGMENT))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _columns(batches, ["key", "n", "k"])
        if got is not None:
            uri = f"{home}/{int(got[0][0]):020d}"
            store.put_arrays(uri, **pack(*got))
            yield pa.RecordBatch.from_arrays([pa.array(got[0][:1]), pa.array([len(got[0])], pa.int64()), pa.array([uri])], names=["first", "n", "uri"])

    return rows.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(save, "first long, n long, uri string").collect()


def _unigrams(docs: DataFrame, home: str) -> tuple[Table, int, int]:
    """(table, tokens, distinct ones); hashes are spread evenly, so parts of equal width are alike."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // WORD_BYTES))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("ngram")
        key, n = packed.summed(batches)
        if len(key):
            book, code = _exact(n)
            uri = f"{home}/{int(key[0]):020d}"
            store.put_arrays(uri, book=book, code=code, **_prefixed("key", encode(as_key(key) - as_key(key[:1]))))
            yield pa.RecordBatch.from_arrays([pa.array(key[:1]), pa.array([len(key)]), pa.array([uri]), pa.array([int(n.sum())])], names=["first", "n", "uri", "tokens"])

    counts = _packed(docs, lambda h, _: as_long(h), packed.evenly(parts)).repartitionById(parts, F.col("part")).select("keys", "counts")
    made = counts.mapInArrow(save, "first long, n long, uri string, tokens long").collect()
    return Table(_placed(made, 1 << 63)), sum(r["tokens"] for r in made), sum(r["n"] for r in made)


def _weights(rows: DataFrame, home: str, parents) -> Table:
    def pack(key, n, k):
        book, code = _weight(n, k, parents.counts_at(key))
        return {"book": book, "code": code, **_prefixed("key", encode((key - key[0]).astype(U)))}

    return Table(_placed(_saved(rows, home, pack)))


def _weight(n: np.ndarray, k: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _book(np.maximum(1 - (n - DISCOUNT * k) / seen, 1e-9))


def _level(grams: DataFrame, parts: int, home: str, words: int, parents) -> tuple[Level, DataFrame]:
    """(level, key, n, k of the contexts at the ends of segments) of packed counts (part, keys, counts).

    A part is a segment. Only the first and the last context of a segment can go on in another.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("ngram")
        key, n = packed.summed(batches)
        key, n = key[n >= MIN_COUNT], n[n >= MIN_COUNT]
        if not len(key):
            return
        ctx, word = np.divmod(key, words)
        heads = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
        ptr = np.r_[heads, len(ctx)]
        seen = parents.counts_at(ctx[heads])
        first, size, name = int(key[0]), len(key), f"{int(key[0]):020d}"
        owner, total, ways = ctx[heads], np.add.reduceat(n, heads), np.diff(ptr)
        del key, ctx
        last = word[ptr[1:] - 1] + 1
        rel = np.repeat(np.cumsum(last) - last, ways) + word + 1
        book, code = _book((n - DISCOUNT) / np.repeat(seen, ways))
        counts, ccode = _exact(n)
        del word, n
        wbook, wcode = _weight(total, ways, seen)  # of a context that goes on in another segment: of no use, see Weights
        store.put_arrays(f"{home}/{name}", book=book, code=code, counts=counts, ccode=ccode, wbook=wbook, wcode=wcode, **_prefixed("ctx", encode((owner - owner[0]).astype(U))), **_prefixed("ptr", encode(ptr.astype(U))), **_prefixed("rel", encode(rel.astype(U))))
        ends = np.unique([0, len(owner) - 1])
        head = (first, size, f"{home}/{name}")
        rows = [(*(head if not e else (None,) * 3), int(owner[e]), int(total[e]), int(ways[e])) for e in ends]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names=["first", "size", "uri", "key", "n", "k"])

    made = materialise(grams.repartitionById(parts, F.col("part")).select("keys", "counts").mapInArrow(save, "first long, size long, uri string, key long, n long, k long"), "segments")
    segments = made.where("uri IS NOT NULL").select("first", F.col("size").alias("n"), "uri").collect()
    ends = materialise(made.groupBy("key").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "weights")  # counted, sampled and read: aggregated once
    release(made)
    return Level(_placed(segments), words, sum(r["n"] for r in segments)), ends


class Weights:
    """Interpolation weights of contexts: those that segments of the level hold, and those of contexts that are cut by a segment's end."""

    def __init__(self, level: Level, ends: Table):
        self.level, self.ends = level, ends
        self.cut = np.unique(level.firsts // U(level.words)) if level.words else level.firsts

    def whole(self, ctx: np.ndarray, weight: np.ndarray) -> None:
        """Puts the weights of cut contexts, which no segment knows, into ``weight``."""
        at = np.searchsorted(self.cut, ctx)
        rows = np.flatnonzero(np.r_[self.cut, U(0)][at] == ctx) if len(self.cut) else at[:0]
        found, value = self.ends.get(ctx[rows], 1.0)
        weight[rows[found >= 0]] = value[found >= 0]

    def get(self, ctx: np.ndarray) -> np.ndarray:
        """Weights of rising contexts, 1 for those without followers."""
        level, out = self.level, np.ones(len(ctx))
        words = U(level.words)
        at = np.searchsorted(level.firsts, ctx * words + (words - U(1)), "right") - 1
        for s in np.unique(at[at >= 0]):
            rows, seg = np.flatnonzero(at == s), _segment(level.segments[s][2])
            first = level.firsts[s] // words
            rows = rows[ctx[rows] >= first]
            c = seg["ctx"].find(ctx[rows] - first)
            out[rows[c >= 0]] = seg["wbook"][seg["wcode"][c[c >= 0]]]
        self.whole(ctx, out)
        return out


class Model:
    """What executors need: where the segments are, and the totals."""

    def __init__(self, unigrams: Table, n: int, v: int):
        self.unigrams, self.n, self.v = unigrams, n, v
        self.levels: list[Level] = []
        self.weights: list[Weights] = []

    def walk(self, h: np.ndarray, starts: np.ndarray, scored: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(count, word id, node of the longest level, its context node, probabilities) at every token; not ``scored``: of words alone."""
        words, back = distinct(h)
        index, count = self.unigrams.get(words, 0.0)
        ids, count = index[back], count[back]
        frequent = count >= MIN_COUNT
        p = (count + 0.5) / (self.n + 0.5 * (self.v + 1))
        base = p.copy()
        node, ctx = np.where(frequent, ids, -1), self._shift(np.where(frequent, ids, -1), starts)
        for level, weight in zip(self.levels, self.weights, strict=True):
            rows = np.flatnonzero(ctx >= 0)
            known = node[rows] >= 0
            tried, other = rows[known], rows[~known]
            keys, inv = distinct(ctx[tried].astype(U) * U(self.v) + ids[tried].astype(U))
            w = np.ones(len(keys)) if scored else None
            found, disc = level.get(keys, w)
            if scored:
                weight.whole(keys // U(self.v), w)
                p[tried] = disc[inv] + w[inv] * p[tried]
                some, back = distinct(ctx[other])
                p[other] *= weight.get(some.astype(U))[back]
            node = np.full(len(h), -1, np.int64)
            node[tried] = found[inv]
            ctx = self._shift(node, starts)
        return count, ids, node, ctx, np.stack([base, p])

    @staticmethod
    def _shift(node: np.ndarray, starts: np.ndarray) -> np.ndarray:
        ctx = np.r_[-1, node[:-1]] if len(node) else node
        ctx[starts] = -1
        return ctx


def _splits(docs: DataFrame, keys_of, parts: int) -> np.ndarray:
    """First keys of all parts but the first; only the parts' sizes depend on the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("ngram")
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                h, bounds = tokens(b.column("text"))
                keys = np.unique(keys_of(h, bounds[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[(mix(keys.view(U)) & U((1 << bits) - 1)) == 0])], names=["key"])

    if parts < 2:
        return np.zeros(0, np.int64)
    for texts, bits in SAMPLES:  # the next one where few texts hold most words
        plain = docs.select("text")
        some = (plain.sample(1 / texts, 7) if texts > 1 else plain).mapInArrow(run, "key long").toArrow().column("key").to_numpy()
        if len(some) >= 50 * parts:
            break
    return np.quantile(some, np.arange(1, parts) / parts, method="lower") if len(some) else np.zeros(0, np.int64)


def _packed(docs: DataFrame, keys_of, splits: np.ndarray) -> DataFrame:
    """part, keys (rising longs), counts (32 bits each): partial counts of the keys that ``keys_of(hashes, starts)`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("ngram")
        held, size = [], 0
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                h, bounds = tokens(b.column("text"))
                held.append(keys_of(h, bounds[:-1]))
                size += len(held[-1])
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        n = n.astype(np.uint32)
        rows, held_keys = [], 0
        for part, at, to in packed.pieces(key, splits, BLOB):
            rows.append((part, key[at:to].tobytes(), n[at:to].tobytes()))
            held_keys += to - at
            if held_keys >= BLOB:
                yield batch(rows)
                rows, held_keys = [], 0
        if rows:
            yield batch(rows)

    def batch(rows: list) -> pa.RecordBatch:
        part, keys, counts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["part", "keys", "counts"])

    return docs.select("text").mapInArrow(run, "part int, keys binary, counts binary")


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when it ends, not when the driver's garbage is collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Model of the rows of ``docs`` (text); all of them teach."""
    with _shuffles_dropped(docs.sparkSession):
        return _train(docs, order)


def _train(docs: DataFrame, order: int) -> Model:
    home = shared_dir(docs.sparkSession) + "-ngram"
    unigrams, n, v = _unigrams(docs, f"{home}/1")
    if v > 3_000_000_000:
        raise ValueError("more than 3e9 distinct words do not fit 64-bit n-gram keys")
    model = Model(unigrams, n, v)
    parents = model.unigrams
    for size in range(2, order + 1):

        def keys_of(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
            _, ids, node, ctx, _ = model.walk(h, starts, scored=False)
            rows = np.flatnonzero((ctx >= 0) & (node >= 0))
            return ctx[rows] * v + ids[rows]

        splits = _splits(docs, keys_of, -(-n // PART))
        level, ends = _level(_packed(docs, keys_of, splits), len(splits) + 1, f"{home}/{size}", v, parents)
        if size < order and level.nodes * v >= 1 << 63:  # no word follows those of the last order
            raise ValueError(f"as many n-grams of {size} words do not fit 64-bit keys with the next word")
        weight = Weights(level, _weights(ends, f"{home}/w{size}", parents))
        release(ends)
        model.levels.append(level)
        model.weights.append(weight)
        parents = level
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, n_tokens, n_known, train_tokens, base_score, score for every row."""
    carried = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("ngram")
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                h, bounds = tokens(b.column("text"))
                count, _, _, _, p = model.walk(h, bounds[:-1])
                base, own = np.add.reduceat(np.log10(p), bounds[:-1], axis=1)
                known = np.add.reduceat((count > 0).astype(np.int64), bounds[:-1])
                got = [np.diff(bounds), known, np.full(b.num_rows, model.n, np.int64), base, own]
                names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), *map(pa.array, got)], names=[*carried, *names])

    plain = docs.select(*carried, "text")
    schema = ", ".join(f"`{c}` {plain.schema[c].dataType.simpleString()}" for c in carried)
    return plain.mapInArrow(run, f"{schema}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def folded(docs: DataFrame) -> DataFrame:
    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    return docs.select("doc_id", "text", F.coalesce(crc == 1, F.lit(False)).alias("held_out"))
