"""Removal of repeated paragraphs: MinHash banding, exact verification, components.

Three kinds of paragraphs are compared, each by MinHash and then exactly:

* lines of at least LINE_WORDS words, and runs of two or more non-blank lines of at most
  WRAP bytes joined to one paragraph (hard-wrapped text): registers banded for recall,
  colliding pairs confirmed on their full sets of five-word shingles (Jaccard 0.8), and
  joined to components;
* shorter lines: they have at most three shingles, so 0.8 means equal sets, and a band
  holds the whole set; they form classes;
* running windows of STRETCH words, for passages inside other paragraphs, wherever they
  begin or end: the register is the least hash of a window's GRAM-word shingles (its
  anchor), windows that share one collide, and of these all are compared word by word
  (Jaccard 1 in the same order), so a repeated run goes to its very ends.

Of each component or class the first member, by document and place, stays (of one
document joined paragraphs come before lines); the others are removed, as a whole.

Definitions: words are runs without ASCII white space, A-Z lower-cased for the
comparison; sets and windows are compared by 64-bit hashes of their words. Null text is
empty. Rows are told apart by doc_id and text; of equal rows each is treated as the same
document, so all keep or lose the same bytes. A null doc_id comes before all others.
Columns of other names are ignored; no rows give no rows. Not found: near copies inside a
longer, different line that share no run of STRETCH words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lookup
from .common import begin, materialise, release, slices, text_bytes
from .neardup import KERNEL_BYTES, cluster
from .repeats import merged
from .textkit import mix, prefix_hash, range_hash, running_hash, word_hashes, word_spans

U = np.uint64
LINE_WORDS = 8
WRAP = 120
STRETCH = 20
SHINGLE = 5
#: Words of an anchor; STRETCH - GRAM + 1 of them lie in a window.
GRAM = 8
#: Three registers a band, 12 bands: a pair at 0.8 is missed with probability (1 - 0.8^3)^12 = 2e-4.
#: Two registers hold too few bits: unrelated lines of a large corpus would meet by chance.
BAND_ROWS, REGISTERS = 3, 36
#: Bytes of text for each part of the anchors and windows that are counted, about.
PART_BYTES = 40 << 20


def _short_lines(data: np.ndarray, offs: np.ndarray, words: tuple | None = None) -> tuple[np.ndarray, ...]:
    """(document, line of the batch, start, class) of the lines of 1 to LINE_WORDS - 1 words; equal classes: equal shingle sets."""
    h, start, _, _ = word_hashes(data, offs) if words is None else words
    of, lo, hi = _lines(data, offs)
    a, b = np.searchsorted(start, lo), np.searchsorted(start, hi)
    line = np.flatnonzero((b > a) & (b - a < LINE_WORDS))
    a, b = a[line], b[line]
    pre = prefix_hash(h)
    one, two, three = (range_hash(pre, np.minimum(a + j, b), np.minimum(a + j + SHINGLE, b)) for j in range(3))
    total = one + np.where((b - a > SHINGLE) & (two != one), two, U(0)) + np.where((b - a > SHINGLE + 1) & (three != one) & (three != two), three, U(0))
    return of[line], line, start[a] - offs[of[line]], mix(mix(total) ^ U(0x2545F4914F6CDD1D)).view(np.int64)


def _lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of all lines of a batch, empty ones too."""
    breaks = np.flatnonzero(data == 10)
    of = np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(breaks, offs)) + 1)
    return of, np.sort(np.r_[offs[:-1], breaks + 1]), np.sort(np.r_[breaks, offs[1:]])


def _joined(data: np.ndarray, offs: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(head, size) for every line of a batch: first line and number of lines of its joined paragraph; size 0: in none."""
    of, lo, hi = _lines(data, offs)
    start = word_spans(data, offs)[0] if start is None else start
    fits = (hi - lo <= WRAP) & (np.searchsorted(start, hi) > np.searchsorted(start, lo))
    new = ~fits | np.r_[True, ~fits[:-1] | (of[1:] != of[:-1])][: len(of)]
    heads = np.flatnonzero(new)
    size = np.diff(np.r_[heads, len(of)])
    group = np.cumsum(new) - 1
    return heads[group], np.where(fits & (size[group] > 1), size[group], 0)


def _anchors(pre: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, document, anchor hash, place of the anchor) of every window of STRETCH words that lies in one document.

    ``pre``: prefix sums over word hashes; ``first``: first word of every document.
    """
    n = len(pre) - STRETCH
    if n < 1:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[:n] == doc[STRETCH - 1 :])
    gram = running_hash(pre, GRAM)
    bits = U(len(gram).bit_length())
    best = (gram >> bits << bits) | np.arange(len(gram), dtype=U)  # ties go to the leftmost
    width, step = STRETCH - GRAM + 1, 1
    while step * 2 <= width:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    if width > step:
        best = np.minimum(best[: len(best) - (width - step)], best[width - step :])
    place = (best[at] & ((U(1) << bits) - U(1))).astype(np.int64)
    return at, doc[at], gram[place].view(np.int64), place


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", F.xxhash64(F.col("doc_id"), F.col("text")))


def _line_id(key, line):
    return F.xxhash64(key, line)


def compared_lines(docs: DataFrame) -> DataFrame:
    """id, doc_id, kind, line (the first one) and text of the lines of LINE_WORDS words on (kind 1) and the joined paragraphs (0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("text")
        for whole in batches:
            for b in slices(whole, "text", KERNEL_BYTES):
                data, offs = text_bytes(b.column("text"))
                of, lo, hi = _lines(data, offs)
                begins = word_spans(data, offs)[0]
                head, size = _joined(data, offs, begins)
                long = np.flatnonzero(np.searchsorted(begins, hi) - np.searchsorted(begins, lo) >= LINE_WORDS)
                at = np.flatnonzero((size > 0) & (head == np.arange(len(head))))
                raw, rows = data.tobytes(), np.r_[long, at]
                texts = [raw[x:y] for x, y in zip(lo[rows].tolist(), np.r_[hi[long], hi[at + size[at] - 1]].tolist(), strict=True)]
                kind = np.repeat(np.array([1, 0], np.int32), [len(long), len(at)])
                line = (rows - np.searchsorted(of, of[rows])).astype(np.int32)
                ids = [b.column(c).take(pa.array(of[rows])) for c in ("key", "doc_id")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(kind), pa.array(line), pa.array(texts, pa.binary()).cast(pa.string())], names=["key", "doc_id", "kind", "line", "text"])

    plain = docs.select("doc_id", "key", "text")
    found = plain.mapInArrow(run, f"key long, doc_id {plain.schema['doc_id'].dataType.simpleString()}, kind int, line int, text string")
    number = F.when(F.col("kind") == 1, F.col("line")).otherwise(-1 - F.col("line"))
    return materialise(found.select(_line_id(F.col("key"), number).alias("id"), "doc_id", "kind", F.col("line").cast("long").alias("line"), "text"), "compared-lines")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """key (id of a line or joined paragraph), component and first (1: the member that stays) of components of two or more."""
    lines = compared_lines(docs)
    found = cluster(lines.select("id", "text"), SHINGLE, rows=BAND_ROWS, buckets=REGISTERS)
    shared = materialise(found.groupBy("component").agg(F.countDistinct("id").alias("n")).where("n > 1").select("component"), "shared-lines")
    members = materialise(found.select("id", "component").distinct().join(shared, "component"), "line-members")
    placed = materialise(lines.drop("text").join(members, "id"), "placed-lines")
    best = materialise(placed.groupBy("component").agg(F.min(F.struct("doc_id", "kind", "line", "id")).alias("best")).select(F.col("best.id").alias("id")).withColumn("first", F.lit(1).cast("long")), "first-lines")
    out = materialise(placed.select("id", "component").distinct().join(best, "id", "left").select(F.col("id").alias("key"), "component", F.coalesce("first", F.lit(0).cast("long")).alias("first")), "lines")
    for t in (lines, found, shared, members, placed, best):
        release(t)
    return out


def repeated_short_lines(docs: DataFrame) -> DataFrame:
    """key (class), doc (row key) and start of the first of the short lines that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("text")
        for whole in batches:
            for b in slices(whole, "text"):
                d, _, start, key = _short_lines(*text_bytes(b.column("text")))
                ids = b.column("doc_id").take(pa.array(d))
                yield pa.RecordBatch.from_arrays([pa.array(key), ids, pa.array(b.column("key").to_numpy()[d]), pa.array(start)], names=["key", "doc_id", "doc", "start"])

    plain = docs.select("doc_id", "key", "text")
    rows = plain.mapInArrow(run, f"key long, doc_id {plain.schema['doc_id'].dataType.simpleString()}, doc long, start long")
    best = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "doc", "start")).alias("best")).where("n > 1")
    return materialise(best.select("key", "best.doc", "best.start"), "short-lines")


def repeated_anchors(docs: DataFrame, parts: int) -> lookup.Lookup:
    """key of the anchors that occur more than once."""

    def anchors(whole: pa.RecordBatch) -> Iterator[np.ndarray]:
        for b in slices(whole, "text", KERNEL_BYTES):
            h, _, _, first = word_hashes(*text_bytes(b.column("text")))
            _, _, anchor, place = _anchors(prefix_hash(h), first)
            yield anchor[np.r_[True, place[1:] != place[:-1]][: len(place)]]

    return lookup.repeated(docs.select("text"), anchors, parts)


def repeated_windows(docs: DataFrame, anchors: lookup.Lookup, parts: int) -> lookup.Lookup:
    """key (window hash) and doc (row key of the first document) of the windows that occur more than once."""

    def windows(whole: pa.RecordBatch) -> Iterator[tuple]:
        for b in slices(whole, "text"):
            h, _, _, first = word_hashes(*text_bytes(b.column("text")))
            _, d, key = _shared(h, first, anchors)
            yield key, d, b.column("doc_id"), b.column("key").to_numpy()

    return lookup.repeated_firsts(docs.select("doc_id", "key", "text"), windows, parts)


def _stretches(mask: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of the runs of marked words, ``of`` being the documents of all words."""
    edge = np.r_[True, of[1:] != of[:-1], True] if len(of) else np.ones(1, bool)
    return np.flatnonzero(mask & (edge[:-1] | ~np.r_[False, mask[:-1]])), np.flatnonzero(mask & (edge[1:] | ~np.r_[mask[1:], False]))


def _shared(h: np.ndarray, first: np.ndarray, anchors: lookup.Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, document, hash) of the windows whose anchor occurs more than once."""
    pre = prefix_hash(h)
    at, d, anchor, place = _anchors(pre, first)
    new = np.r_[True, place[1:] != place[:-1]][: len(place)]
    found = anchors.first(anchor[new])[0]
    keep = found[np.cumsum(new) - 1] if len(new) else np.zeros(0, bool)
    at = at[keep]
    return at, d[keep], mix(range_hash(pre, at, at + STRETCH)).view(np.int64)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_paragraphs, components (of its repeated lines and joined paragraphs), kept (bytes)."""
    keyed = _keyed(docs.select("doc_id", "text"))
    lines, short_lines = repeated_lines(keyed), repeated_short_lines(keyed)
    by_line, by_short = lookup.save(lines), lookup.save(short_lines)
    release(lines)
    release(short_lines)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // PART_BYTES))
    by_anchor = repeated_anchors(keyed, parts)
    by_window = repeated_windows(keyed, by_anchor, parts)
    every = F.sequence(F.lit(0), F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)) - 1)
    numbered = keyed.withColumns({"lines": F.transform(every, lambda i: _line_id(F.col("key"), i)), "paragraphs": F.transform(every, lambda i: _line_id(F.col("key"), -1 - i))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("text")
        for whole in batches:
            for b in slices(whole, "text"):
                yield cut(b)

    def _copies(h: np.ndarray, first: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Which words lie in a window that occurred before."""
        at, d, key = _shared(h, first, by_anchor)
        found, (doc,) = by_window.first(key, "doc")
        at, d, key, own = at[found], d[found], key[found], (doc == keys[d])[found]
        # In the first document the first place stays, and so do windows that overlap it.
        _, firsts, back = np.unique(mix(key.view(U) ^ mix(d.astype(U))), return_index=True, return_inverse=True)
        gone = at[~own | (at >= at[firsts][back] + STRETCH)]
        depth = np.bincount(gone, minlength=len(h) + 1) - np.bincount(gone + STRETCH, minlength=len(h) + 1)
        return np.cumsum(depth[:-1]) > 0

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = text_bytes(b.column("text"))
        raw, keys = data.tobytes(), b.column("key").to_numpy()
        words = h, begins, ends, firsts = word_hashes(data, offs)
        ids = b.column("lines")
        bounds = ids.offsets.to_numpy() - ids.offsets[0].as_py()
        flat, flat_joined = (c.values.to_numpy()[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in (ids, b.column("paragraphs")))
        in_group, (first, component) = by_line.first(flat, "first", "component")
        in_joined, (joined_first, joined_component) = by_line.first(flat_joined, "first", "component")
        lead, size = _joined(data, offs, begins)
        in_joined, joined_first, joined_component = in_joined[lead] & (size > 0), joined_first[lead], joined_component[lead]
        # A line and the paragraph it is joined to may be of one component; what stays of it isn't removed as the other.
        stays = in_group & in_joined & (component == joined_component)
        gone_lines = in_group & (first == 0) & ~(stays & (joined_first == 1)) | in_joined & (joined_first == 0) & ~(stays & (first == 1))
        short_d, short, short_start, short_key = _short_lines(data, offs, words)
        short_found, (short_doc, short_at) = by_short.first(short_key, "doc", "start")
        gone_lines[short[short_found & ~((short_doc == keys[short_d]) & (short_at == short_start))]] = True
        in_group[short[short_found]], component[short[short_found]] = True, short_key[short_found]
        of = np.repeat(np.arange(b.num_rows), np.diff(firsts))
        gone_words = gone_lines[np.searchsorted(_lines(data, offs)[1], begins, "right") - 1] | _copies(h, firsts, keys)
        head, tail = _stretches(gone_words, of)
        gone, spans = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
        kept = [raw[offs[i] : offs[i + 1]] for i in range(b.num_rows)]
        for i in np.unique(of[head]).tolist():
            mine = of[head] == i
            text, begin, parts = kept[i], 0, []
            cuts = merged(begins[head[mine]] - offs[i], ends[tail[mine]] - offs[i])
            for x, y in cuts:
                parts.append(text[begin:x])
                begin = y
            kept[i] = b"".join([*parts, text[begin:]])
            gone[i], spans[i] = len(text) - len(kept[i]), len(cuts)
        groups = [np.unique(np.r_[component[x:y][in_group[x:y]], joined_component[x:y][in_joined[x:y]]]).tolist() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        cols = [b.column("doc_id"), pa.array(np.diff(offs)), pa.array(gone), pa.array(spans), pa.array(np.diff(bounds).astype(np.int64)), pa.array(groups, pa.list_(pa.int64())), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "n_paragraphs", "components", "kept"])

    schema = f"doc_id {numbered.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, n_paragraphs long, components array<long>, kept binary"
    return numbered.select("doc_id", "key", "text", "lines", "paragraphs").mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_paragraphs, components, kept_sha256 for every row."""
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "n_paragraphs", "components", F.sha2("kept", 256).alias("kept_sha256"))
