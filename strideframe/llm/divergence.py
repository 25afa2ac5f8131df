"""Source divergence audit: how far the term shares of each source are from those of every other source of its language.

Terms are counted per (lang, source); a language keeps the terms of at least 3 of its
documents. Counts are packed by vocabulary chunk and block of groups, and replicated to
tiles of two blocks; a tile's task goes over successive chunks and adds up the submatrix
of its pairs, holding one chunk at a time. Terms that neither block has are added at once,
as every pair sees the same value there. Long vocabularies are cut in spans, so one
language of few sources is several tasks.

Null text, lang and source are ''. A document counts once for each row. Groups without
terms take part with counts of zero; languages that keep no term give pairs of value 0.
Terms of other letter cases than A-Z stay as they are. No rows give no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, materialise, release

#: Documents that a kept term is in; shares are in parts of SHARE; terms listed a group.
LEAST = 3
SHARE = 1_000_000_000
TOP = 200
#: Entries of a vocabulary chunk, about; chunks of a span; groups of a block.
CHUNK = 1 << 16
SPAN = 16
BLOCK = 32
#: Counted terms that a task holds before it passes them on.
HELD = 1 << 18

#: A-Z lower-cased, other letters and all bytes of non-ASCII characters kept, the rest a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BETWEEN = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def terms(text: bytes, limit: int = SLICE_BYTES) -> Counter:
    """Occurrences of each term; a long text is cut where no term is."""
    found, at = Counter(), 0
    while at < len(text):
        gap = _BETWEEN.search(text, at + limit)
        end = gap.end() if gap else len(text)
        found.update(text[at:end].translate(_TERMS).split())
        at = end
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of what a task has seen, passed on whenever that is much."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            keys = list(n)
            for a in range(0, len(keys), 1 << 15):
                own = keys[a : a + (1 << 15)]
                cols = [pa.array([lang] * len(own), pa.string()), pa.array([source] * len(own), pa.string()), pa.array(own, pa.binary()).cast(pa.string()), pa.array([n[k] for k in own], pa.int64()), pa.array([docs[k] for k in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for b in batches:
        langs, sources, texts = b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text")
        for i in range(b.num_rows):
            if (langs[i], sources[i]) not in held:
                held[langs[i], sources[i]], size = (Counter(), Counter()), size + 1
            n, docs = held[langs[i], sources[i]]
            before, own = len(n), terms(texts[i].as_buffer().to_pybytes())
            n.update(own)
            docs.update(own.keys())
            size += len(n) - before
            if size >= HELD:
                yield from out()
                size = 0
    yield from out()


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, n_lang, first of the terms that a language keeps; one shuffle, by language and term.

    ``first`` is true in one row of each term of a language.
    """
    own = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = own.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    summed = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by = Window.partitionBy("lang", "term")
    marked = summed.withColumns({"n_lang": F.sum("n").over(by), "in_docs": F.sum("docs").over(by), "first": F.row_number().over(by.orderBy("source")) == 1})
    return marked.where(F.col("in_docs") >= LEAST).drop("docs", "in_docs")


def groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """A row for each (lang, source) that occurs: its place among those of the language, its total, and figures of the language."""
    name = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    own = docs.select(*name).distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    lang = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("terms"), F.sum(F.when(F.col("first"), F.col("n_lang"))).alias("lang_total"), F.count("*").alias("entries"))
    out = own.join(lang, "lang", "left").fillna(0, ["total", "terms", "lang_total", "entries"])
    by = Window.partitionBy("lang")
    chunks = F.greatest(F.ceil(F.col("entries") / CHUNK), F.lit(1)).cast("long")
    return out.withColumns({"place": F.row_number().over(by.orderBy("source")) - 1, "size": F.count("*").over(by), "chunks": chunks}).withColumns({"block": F.floor(F.col("place") / BLOCK), "blocks": F.ceil(F.col("size") / BLOCK), "spans": F.ceil(F.col("chunks") / SPAN)}).drop("entries", "size")


def _pack(part: pd.DataFrame) -> pd.DataFrame:
    """One chunk: (column, place in the block, count) of each block's entries as flat arrays of 64-bit numbers."""
    column = pd.factorize(part["term"])[0]
    out = []
    for block, at in part.groupby("block").indices.items():
        own = part.iloc[at]
        data = np.stack([column[at], own["place"].to_numpy(), own["n"].to_numpy()]).astype(np.int64)
        out.append((own["lang"].iloc[0], int(own["chunk"].iloc[0]), int(block), data.tobytes()))
    return pd.DataFrame(out, columns=["lang", "chunk", "block", "data"])


def shares(n: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SHARE * (n + 1) / total), exact at any size."""
    if n.size and int(n.max()) >= (1 << 63) // SHARE - 1:
        return (1 + SHARE * (n.astype(object) + 1) // total).astype(np.int64)
    return 1 + SHARE * (n + 1) // total


class _Tile:
    """Sums of the pairs of two blocks of groups over the chunks of one span."""

    def __init__(self, lang: str, low: int, high: int, span: int):
        self.key = (lang, low, high, span)
        self.names: dict[int, list[str]] = {}
        self.totals: dict[int, list[int]] = {}
        self.terms = self.columns = 0
        self.chunk, self.held = -1, {}
        self.there = self.back = None

    def header(self, block: int, own: list[dict], terms: int) -> None:
        self.names[block], self.totals[block] = [x["source"] for x in own], [x["total"] + terms for x in own]
        self.terms = terms

    def add(self, chunk: int, block: int, data: bytes) -> None:
        if chunk != self.chunk:
            self.flush()
            self.chunk = chunk
        self.held[block] = np.frombuffer(data, np.int64).reshape(3, -1)

    def flush(self) -> None:
        if not self.held:
            return
        used = np.unique(np.concatenate([d[0] for d in self.held.values()]))
        p, q = (self.dense(b, used) for b in self.key[1:3])
        self.sums(p, q)
        self.columns += len(used)
        self.held = {}

    def dense(self, block: int, used: np.ndarray) -> np.ndarray:
        n = np.zeros((len(self.names[block]), len(used)), np.int64)
        if block in self.held:
            column, place, count = self.held[block]
            n[place, np.searchsorted(used, column)] = count
        return np.stack([shares(row, total) for row, total in zip(n, self.totals[block], strict=True)])

    def sums(self, p: np.ndarray, q: np.ndarray, times: int = 1) -> None:
        if self.there is None:
            self.there = np.zeros((len(p), len(q)), np.int64)
            self.back = np.zeros((len(q), len(p)), np.int64)
        for i, row in enumerate(p):
            square = (row - q) ** 2
            self.there[i] += (square // q).sum(1) * times
            if self.key[1] != self.key[2]:
                self.back[:, i] += (square // row).sum(1) * times

    def rows(self) -> pa.RecordBatch:
        self.flush()
        lang, low, high, span = self.key
        if self.terms:  # terms of which neither block has any; all of them are counted in the first span
            rest = (self.terms if span == 0 else 0) - self.columns
            p, q = (np.stack([shares(np.zeros(1, np.int64), t) for t in self.totals[b]]) for b in (low, high))
            self.sums(p, q, rest)
        out = []
        for a, b, m in ((low, high, self.there), (high, low, self.back))[: 1 + (low != high)]:
            for i, source in enumerate(self.names[a]):
                out += [(source, item, 0 if m is None else int(m[i, j])) for j, item in enumerate(self.names[b]) if source != item]
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["lang", "source", "item", "value"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile, then chunk; what describes the groups comes first."""
    tile = None
    for b in batches:
        for r in b.to_pylist():
            key = (r["lang"], r["low"], r["high"], r["span"])
            if tile is None or tile.key != key:
                if tile:
                    yield tile.rows()
                tile = _Tile(*key)
            if r["groups"] is not None:
                tile.header(r["block"], r["groups"], r["terms"])
            else:
                tile.add(r["chunk"], r["block"], r["data"])
    if tile:
        yield tile.rows()


def pairs(kept: DataFrame, own: DataFrame) -> DataFrame:
    """lang, source, item, value of every ordered pair of sources of a language."""
    entries = kept.join(own.select("lang", "source", "place", "block", "chunks"), ["lang", "source"])
    keyed = entries.select("lang", "term", "n", (F.col("place") % BLOCK).alias("place"), "block", F.pmod(F.xxhash64("term"), F.col("chunks")).alias("chunk"))
    packed = keyed.groupBy("lang", "chunk").applyInPandas(_pack, "lang string, chunk long, block long, data binary")
    sizes = own.groupBy("lang").agg(F.first("blocks").alias("blocks"), F.first("spans").alias("spans"), F.first("terms").alias("terms"))
    vectors = packed.join(sizes, "lang").select("lang", "chunk", "block", "data", F.lit(None).cast("array<struct<source:string,total:bigint>>").alias("groups"), "terms", "blocks", F.floor(F.col("chunk") / SPAN).alias("span"))
    about = own.groupBy("lang", "block").agg(F.array_sort(F.collect_list(F.struct("place", "source", "total"))).alias("g"), F.first("blocks").alias("blocks"), F.first("spans").alias("spans"), F.first("terms").alias("terms"))  # BLOCK entries at most
    heads = about.select("lang", F.lit(-1).cast("long").alias("chunk"), "block", F.lit(None).cast("binary").alias("data"), F.transform("g", lambda x: F.struct(x["source"].alias("source"), x["total"].alias("total"))).alias("groups"), "terms", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("spans") - 1)).alias("span"))
    spread = vectors.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = spread.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "span", "chunk", "block", "data", "groups", "terms")
    key = ["lang", "low", "high", "span"]
    sums = dealt.repartition(*key).sortWithinPartitions(*key, "chunk", "block").mapInArrow(_tiles, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def top_terms(kept: DataFrame, own: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank of the terms that a source has more of than its language."""
    of = lambda n, total: F.expr(f"1 + CAST({SHARE} AS DECIMAL(10,0)) * CAST({n} + 1 AS DECIMAL(20,0)) div CAST({total} + terms AS DECIMAL(21,0))")
    rows = kept.join(own.select("lang", "source", "total", "lang_total", "terms"), ["lang", "source"])
    rows = rows.select("lang", "source", F.col("term").alias("item"), of("n", "total").alias("p"), of("n_lang", "lang_total").alias("q")).where("p > q")
    return ranked(rows.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))).where(F.col("rank") <= top)


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def divergence(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    kept = materialise(counted(docs), "terms")
    own = materialise(groups(docs, kept), "groups")
    parts = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, x in (("pair", ranked(pairs(kept, own))), ("term", top_terms(kept, own, top)))]
    out = materialise(parts[0].unionByName(parts[1]), "divergence")
    release(kept)
    release(own)
    return out
