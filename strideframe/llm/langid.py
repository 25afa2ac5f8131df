"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The likelihood of a word is the sum, over all its segmentations into pieces, of
the product of piece probabilities (forward algorithm); a text's likelihood is
the product over its words. Probabilities are fitted by expectation
maximisation on all words of a bounded, documented sample of labelled rows: tasks add up
expected piece counts of slices of the words, the driver turns the sums into probabilities.

Definitions: a null text, or one without a letter (Unicode category L), is ``und`` with score 0. Rows
without language teach nothing. With no labelled row every text is ``und``.
Ties go to the alphabetically first language. Repeated rows are predicted alike, and
teach each. A null doc_id is never held out. No rows give none; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, holds, materialise, release, slices
from .textkit import prefix_hash, range_hash

#: Bound of the training sample: about this many documents a language; all their words teach.
SAMPLE_DOCS = 1_000
#: Words whose segmentations a task weighs at once.
LATTICE = 4_000
ROUNDS = 3
MEMO = 200_000
UNKNOWN = -14.0  # log probability of a character that no piece covers, in any language
FLOOR = 1e-7


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """Lower-cased pieces of the vocabulary that hold letters only (a word start is marked)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    kept = sorted(p for p in pieces if p.replace("▁", "").isalpha())
    return {p: i for i, p in enumerate(kept)}


class Pieces:
    """The vocabulary as sorted 64-bit hashes behind a bit filter."""

    def __init__(self, vocab: dict[str, int]):
        names = list(vocab)
        chars = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) for p in names])
        keys = range_hash(prefix_hash(chars), ends - [len(p) for p in names], ends)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.fromiter(vocab.values(), np.int64)[order]
        self.longest = max(map(len, names), default=0)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[keys >> np.uint64(44)] = True

    def find(self, pre: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the ranges starts:starts+size those that are pieces, and their ids."""
        h = range_hash(pre, starts, starts + size)
        near = self.seen[h >> np.uint64(44)]
        starts, h = starts[near], h[near]
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        same = self.keys[at] == h
        return starts[same], self.ids[at[same]]


@lru_cache(maxsize=2)
def piece_index(path: str) -> Pieces:
    return Pieces(vocabulary(path))


def words_of(text: str) -> list[str]:
    return text.lower().split()


class Lattice:
    """All pieces inside a list of words as arrays, grouped by the position where they end."""

    def __init__(self, words: list[str], pieces: Pieces):
        self.n, self.len = len(words), np.array([len(w) + 1 for w in words], np.int64)
        chars = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        stop = np.cumsum(self.len)
        row = np.repeat(np.arange(self.n), self.len)
        room, begin = stop[row] - np.arange(len(chars)), stop - self.len
        pre, found = prefix_hash(chars), []
        for size in range(1, pieces.longest + 1):
            s = np.flatnonzero(room >= size)
            s, ids = pieces.find(pre, s, size)
            r = row[s]
            found.append((r, s - begin[r], s - begin[r] + size, ids))
        self.row, self.start, self.end, self.id = (np.concatenate(x) for x in zip(*found, strict=True))

    def forward(self, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """logp: (pieces, languages). Forward log sums (words, positions, languages) and word totals."""
        width, langs = int(self.len.max(initial=0)) + 1, logp.shape[1]
        f = np.full((self.n, width, langs), -np.inf)
        f[:, 0] = 0
        order = np.lexsort((self.row, self.end))
        row, start, end, pid = self.row[order], self.start[order], self.end[order], self.id[order]
        cut = np.searchsorted(end, np.arange(width + 1))
        for e in range(1, width):
            f[:, e] = f[:, e - 1] + UNKNOWN
            a, b = cut[e], cut[e + 1]
            if a == b:
                continue
            r = row[a:b]
            term = f[r, start[a:b]] + logp[pid[a:b]]
            heads = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            best = np.maximum(np.maximum.reduceat(term, heads), f[r[heads], e])
            total = np.add.reduceat(np.exp(term - np.repeat(best, np.diff(np.r_[heads, len(r)]), 0)), heads) + np.exp(f[r[heads], e] - best)
            f[r[heads], e] = best + np.log(total)
        return f, f[np.arange(self.n), self.len]

    def expected(self, logp: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts of one language (logp: one column) over weighted words."""
        f, total = self.forward(logp)
        f, total = f[:, :, 0], total[:, 0]
        width = f.shape[1]
        b = np.full((self.n, width), -np.inf)
        b[np.arange(self.n), self.len] = 0
        order = np.lexsort((self.row, self.start))
        row, start, end, pid = self.row[order], self.start[order], self.end[order], self.id[order]
        cut = np.searchsorted(start, np.arange(width + 1))
        lp = logp[:, 0]
        for s in range(width - 2, -1, -1):
            skip = b[:, s + 1] + UNKNOWN
            own = s < self.len
            b[own, s] = np.logaddexp(b[own, s], skip[own])
            x, y = cut[s], cut[s + 1]
            if x == y:
                continue
            r = row[x:y]
            term = b[r, end[x:y]] + lp[pid[x:y]]
            heads = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            best = np.maximum(np.maximum.reduceat(term, heads), b[r[heads], s])
            sums = np.add.reduceat(np.exp(term - np.repeat(best, np.diff(np.r_[heads, len(r)]))), heads) + np.exp(b[r[heads], s] - best)
            b[r[heads], s] = best + np.log(sums)
        post = np.exp(f[self.row, self.start] + lp[self.id] + b[self.row, self.end] - total[self.row]) * weight[self.row]
        return np.bincount(self.id, post, len(lp))


class LanguageModel:
    def __init__(self, langs: list[str], logp: np.ndarray, prior: np.ndarray, path: str):
        self.langs, self.logp, self.prior, self.path = langs, logp, prior, path
        self.memo: dict[str, int] = {}
        self.table = np.zeros((0, len(langs)))

    def __getstate__(self):
        return {**self.__dict__, "memo": {}, "table": self.table[:0]}

    def learn(self, words: list[str]) -> None:
        """Put the log likelihoods of words that the memo lacks into its table."""
        pieces, fresh, new = piece_index(self.path), sorted(words, key=len), []
        a = 0
        while a < len(fresh):  # words of like length together, so that padding stays small
            b = a + 1
            while b < len(fresh) and (len(fresh[b]) + 2) * (b - a + 1) <= 60_000 and len(fresh[b]) <= 2 * len(fresh[a]) + 4:
                b += 1
            new.append(Lattice(fresh[a:b], pieces).forward(self.logp)[1])
            a = b
        self.memo.update(zip(fresh, range(len(self.table), len(self.table) + len(fresh)), strict=True))
        self.table = np.concatenate([self.table, *new])

    def scores(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        counts = [words_of(t) if t else [] for t in texts]
        used = set().union(*counts)
        if len(self.memo) + len(used) > MEMO:
            self.memo, self.table = {}, self.table[:0]
        if fresh := used.difference(self.memo):
            self.learn(list(fresh))
        get = self.memo.__getitem__
        names, probs = [], []
        for t, ws in zip(texts, counts, strict=True):
            if not ws or not self.langs or not any(map(str.isalpha, t)):
                names.append("und")
                probs.append(0.0)
                continue
            total = self.table[np.fromiter(map(get, ws), np.int64, len(ws))].sum(0) + self.prior
            best = int(total.argmax())
            names.append(self.langs[best])
            probs.append(float(1 / np.exp(total - total[best]).sum()))
        return names, probs


def held_out(doc_id: str = "doc_id"):
    """Whether a row must not teach; a null doc_id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, word, n of rows (lang, text); words are cut as for prediction, counts summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("langid")
        for whole in batches:
            for b in slices(whole, "text"):
                seen = Counter((lang, w) for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True) for w in words_of(t))
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _expected(words: DataFrame, langs: list[str], logp: np.ndarray, path: str) -> np.ndarray:
    """(pieces, languages): expected counts over ``words`` (lang, word, n); tasks sum theirs, a number a piece and language is gathered."""
    shared = words.sparkSession.sparkContext.broadcast(logp)  # pieces x languages: bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("langid")
        pieces, total = piece_index(path), np.zeros(shared.value.shape)
        for b in batches:
            lang, n = np.array(b.column("lang").to_pylist(), object), b.column("n").to_numpy().astype(float)
            word = np.array(b.column("word").to_pylist(), object)
            for k, name in enumerate(langs):
                own = sorted(np.flatnonzero(lang == name).tolist(), key=lambda i: len(word[i]))
                for part in slabs(own, [len(word[i]) for i in own]):
                    total[:, k] += Lattice(word[part].tolist(), pieces).expected(shared.value[:, k : k + 1], n[part])
        at, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(at), pa.array(total[at, k])], names=["k", "at", "v"])

    got = words.mapInArrow(run, "k long, at long, v double").groupBy("k", "at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(logp.shape)
    out[got["at"].to_numpy(np.int64), got["k"].to_numpy(np.int64)] = got["v"].to_numpy()
    return out


def slabs(rows: list[int], lens: list[int]) -> Iterator[list[int]]:
    """``rows``, sorted by length, in parts of at most LATTICE rows whose padded characters stay few."""
    a = 0
    while a < len(rows):
        b = a + 1
        while b < len(rows) and b - a < LATTICE and (lens[b] + 2) * (b - a + 1) <= 60_000:
            b += 1
        yield rows[a:b]
        a = b


def train(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Fit on labelled rows of folds 1 to 4: all languages, each on a bounded hash sample of its rows."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs, vocab = sorted(sizes), vocabulary(path)
    ticket = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1 << 30))
    chance = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(int((1 << 30) * min(1.0, sample_docs / n))))]) if sizes else None
    logp = np.full((len(vocab), len(langs)), -math.log(max(1, len(vocab))))
    if langs:
        tasks = max(2, docs.sparkSession.sparkContext.defaultParallelism)
        counted = materialise(word_counts(rows.where(ticket < chance[F.col("lang")])).repartition(tasks, "word"), "langid")
        for _ in range(ROUNDS):
            got = _expected(counted, langs, logp, path)
            logp = np.log(np.maximum((got + 0.01) / (got.sum(0) + 0.01 * len(vocab)), FLOOR))
        release(counted)
    total = sum(sizes.values())
    return LanguageModel(langs, logp, np.array([math.log(sizes[x] / total) for x in langs]), path)


_models: dict[str, LanguageModel] = {}
holds("langid", _models.clear)


def _labelled(docs: DataFrame, model: LanguageModel, emit, schema) -> DataFrame:
    """Run ``emit(batch, names, probabilities)`` over every batch of ``docs``."""
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages: bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("langid")
        if key not in _models:
            _models.clear()
            _models[key] = shared.value
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                yield emit(b, *_models[key].scores(b.column("text").to_pylist()))

    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, lang_pred, score for every row of ``docs``; only text is looked at."""
    carried = ["doc_id", *keep]

    def emit(b, names, probs):
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), pa.array(names, pa.string()), pa.array(probs, pa.float64())], names=[*carried, "lang_pred", "score"])

    plain = docs.select(*carried, "text")
    schema = ", ".join(f"`{c}` {plain.schema[c].dataType.simpleString()}" for c in carried)
    return _labelled(plain, model, emit, f"{schema}, lang_pred string, score double")


def keep_identified(docs: DataFrame, path: str, least: float = 0.5) -> DataFrame:
    """Filtering stage: rows whose language is recognised with at least ``least``; all columns pass unchanged.

    Rejected: ``und`` (null text, or no letter) and texts for which no language reaches ``least``.
    """

    def emit(b, names, probs):
        return b.filter(pa.array([n != "und" and p >= least for n, p in zip(names, probs, strict=True)], pa.bool_()))

    return _labelled(docs, train(docs, path), emit, docs.schema)
