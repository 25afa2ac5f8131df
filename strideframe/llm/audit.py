"""Filter interaction audit: what five filters remove in each of their 120 orders, alone and together.

Failure conditions of a text (null: empty): A under 200 words; B distinct words are under half of the
words; C over 2 % of its code points are A-Z; D it holds one of ``#$%&*|``; E it equals the text of
a smaller doc_id. Words are maximal runs without ASCII white space.

Equal texts are found by refining a partition: texts of equal length in code points, then of equal
hashes of ever larger blocks, and after each step classes of one are dropped. Texts that are left are
compared whole, by grouping on them. Only small rows without text go through the steps. All but
the rows of the smallest id of a text fail E. Then documents are counted by the mask of what they
fail, and every order is read from these counts.

A null source is ''. Rows without id fail no E and make none fail. A document is good (toxic) if a
row of ``labels`` for its id has quality (toxic) 1; repeated or null labels do no harm. Rows that
repeat an id count each. No rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, materialise, release

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(65, 91))
SPACES = re.compile(rb"[\x20\x09-\x0D]")
CONTINUED = bytes(range(0x80, 0xC0))
#: Bytes of the first block of a text that is hashed, and how many times longer each next one is.
FIRST, LONGER = 256, 16
#: Ids that are broadcast (16 MB of them); more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def words(text: bytes, limit: int = SLICE_BYTES) -> tuple[int, int]:
    """(words, distinct words); a long text is cut at white space."""
    n, seen, at = 0, set(), 0
    while at < len(text):
        gap = SPACES.search(text, at + limit)
        end = gap.end() if gap else len(text)
        own = text[at:end].split()
        n += len(own)
        seen.update(own)
        at = end
    return n, len(seen)


def blocks(text: bytes) -> list[int]:
    """64-bit hashes of successive blocks."""
    out, at, size = [], 0, FIRST
    while at < len(text):
        out.append(int.from_bytes(hashlib.blake2b(text[at : at + size], digest_size=8).digest(), "little", signed=True))
        at, size = at + size, size * LONGER
    return out


def failures(text: bytes, points: int) -> int:
    """Bits 0 to 3 for the conditions A to D."""
    n, distinct = words(text)
    upper = len(text) - len(text.translate(None, UPPER))
    symbol = len(text) != len(text.translate(None, SYMBOLS))
    return (n < 200) | (100 * distinct < 50 * n) << 1 | (100 * upper > 2 * points) << 2 | symbol << 3


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, mask, points, hashes = b.column("text"), [], [], []
        for i in range(b.num_rows):
            t = texts[i].as_buffer().to_pybytes()
            n = len(t.translate(None, CONTINUED))
            mask.append(failures(t, n))
            points.append(n)
            hashes.append(blocks(t))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(mask, pa.int32()), pa.array(points, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "source", "mask", "points", "hashes"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, source, mask of A to D, points (code points), hashes (of blocks)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(_sketch, "doc_id long, source string, mask int, points long, hashes array<long>")


def refined(sketch: DataFrame) -> DataFrame:
    """doc_id, points, hashes of the rows whose length and block hashes another row has too."""
    left = sketch.where("doc_id IS NOT NULL").select("doc_id", "points", "hashes")
    most = left.agg(F.max(F.size("hashes"))).first()[0] or 0  # grows with the logarithm of the longest text
    for k in range(most + 1):  # first by length alone
        key = [F.col("points"), F.slice("hashes", 1, k)]
        several = left.groupBy(key[0].alias("p"), key[1].alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("p", "h")
        kept = left.join(several, (key[0] == F.col("p")) & (key[1] == F.col("h")), "left_semi")
        new = materialise(kept, "alike")
        if k:
            release(left)
        left = new
    return left


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [x.as_buffer().to_pybytes() for x in b.column("text")]
        points = pa.array([len(t.translate(None, CONTINUED)) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([points, pa.array([blocks(t) for t in texts], pa.list_(pa.int64())), b.column("least")], names=["points", "hashes", "least"])


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the documents that ``ids`` names; their texts alone are shuffled while the list is short."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def copies(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """doc_id, points, hashes of the rows that equal the text of a smaller id, once each."""
    alike, key = refined(sketch), ["points", "hashes"]
    # Grouping compares whole texts; copies within a task meet before the shuffle.
    texts = _of(docs, alike.select("doc_id").distinct()).groupBy("text").agg(F.min("doc_id").alias("least"))
    least = materialise(texts.mapInArrow(_keys, "points long, hashes array<long>, least long"), "least")
    clash = least.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    marked = alike.join(least.withColumnRenamed("least", "doc_id"), ["doc_id", *key], "left_anti").distinct()
    if clash.isEmpty():
        return marked
    # Different texts of equal hashes: these few are told apart by their texts.
    doubtful = alike.join(clash, key, "left_semi")
    own = _of(docs, doubtful.select("doc_id").distinct())
    later = own.join(own.groupBy("text").agg(F.min("doc_id").alias("least")), "text").where("doc_id > least").select("doc_id").distinct()
    return marked.join(clash, key, "left_anti").unionByName(doubtful.join(later, "doc_id", "left_semi").distinct())


def orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, bit of its filter, bits of the filters before) of all orders."""
    out = []
    for p in permutations(FILTERS):
        before = 0
        for step, f in enumerate(p, 1):
            bit = 1 << FILTERS.index(f)
            out.append(("".join(p), step, bit, before))
            before |= bit
    return out


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """source, mask (bits 0 to 4 for A to E), n, good, toxic: counts of documents."""
    sketch = materialise(sketches(docs), "sketches")
    marked = copies(docs, sketch).withColumn("copy", F.lit(1 << FILTERS.index("E")))
    flag = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(c)
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    own = sketch.join(marked, ["doc_id", "points", "hashes"], "left").join(told, "doc_id", "left")
    mask = F.col("mask").bitwiseOR(F.coalesce("copy", F.lit(0)))
    return own.groupBy("source", mask.alias("mask")).agg(F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and counts: 600 rows for each source."""
    masks = masked(docs, labels).groupBy("source").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))  # 32 entries at most
    steps = F.explode(F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before")) for o, k, bit, before in orders()]))
    rows = masks.select("source", "m", steps.alias("s")).select("source", "m", "s.*")
    bit, before = F.col("bit"), F.col("before")

    def total(of: str, where) -> Column:
        return F.aggregate("m", F.lit(0).cast("long"), lambda acc, x: acc + F.when(where(x["mask"]), x[of]).otherwise(F.lit(0)))

    fails = lambda m: m.bitwiseAND(bit) != 0
    open_ = lambda m: m.bitwiseAND(before) == 0
    removed = lambda m: fails(m) & open_(m)
    # A document that fails j filters is removed by each of them in 120 / j of the orders.
    share = F.aggregate("m", F.lit(0).cast("long"), lambda acc, x: acc + F.when(fails(x["mask"]), x["n"] * (F.lit(120) / F.bit_count(x["mask"])).cast("long")).otherwise(F.lit(0)))
    out = rows.select(
        F.col("source").alias("part"),
        "filter_order",
        F.col("step").cast("int").alias("step"),
        total("n", lambda m: open_(m) & ~fails(m)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & ~open_(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )
    return materialise(out, "audit")
