"""MinHash near-duplicates on HyperMinHash sketches.

A document's shingle hashes fall into BUCKETS buckets; of each bucket's minimum
only the number of leading zeros and a few mantissa bits are stored. Bands of
these compressed registers propose candidates, a collision-corrected Jaccard
estimate discards hopeless ones, and the rest are confirmed on full shingle sets.

Equal sets collapse first, so copies cost one row each and no pairs. Within a band
bucket the members are first held against one hub, the one with most collisions;
the components that gives settle nearly all of them: a link between members of one
component could change nothing. Of members of different components that still
share a bucket, those that provably reach nobody drop out, and the rest meet in
their rarest shingles and are compared exactly.

Definitions: words are maximal runs without ASCII white space, A-Z lower-cased; a
document with fewer than ``n`` words is one shingle, one without words has the
empty set and links with nothing. Rows without doc_id link with nothing and are
kept (component_id null, n_shingles as for any other). Rows that repeat a doc_id are
one node: with different texts it is found by its smallest set (by size, then hash)
and linked if any of its texts reaches the other; each row has the same component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import lookup
from .common import begin, compact, materialise, narrowed, release, slices, text_bytes
from .graph import components
from .textkit import all_shingles, mix, word_hashes

U = np.uint64
BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA = 10
#: Bands of four registers: a pair at Jaccard 0.8 is missed with probability (1 - 0.8^4)^32 = 5e-8.
BAND_ROWS = 4
#: Standard errors that an estimate may fall below the threshold before a pair is discarded.
SLACK = 6.0
#: Sets that may meet in one shingle as pairs; of more, the sets of one side of a block that is compared with another.
BLOCK = 128
#: Bytes of text whose shingles and registers a task holds at once: arrays that stay in the cache are faster, too.
KERNEL_BYTES = 1 << 19
#: Ids (8 bytes each) up to which a filter on them is broadcast.
BROADCAST_IDS = 500_000
#: Rows of a task: of a few longs, of register pairs, and of texts.
LONGS, REGISTERS, TEXTS = 500_000, 20_000, 1_000
#: Memberships in band buckets that a part counts.
MEETINGS = 4_000_000


#: For each bucket the order in which others stand in for it while it is empty: itself, then at random.
DONORS = np.stack([np.r_[j, np.random.default_rng(j).permutation(BUCKETS)] for j in range(BUCKETS)])
#: For each bucket its place in the order of every other.
TURNS = np.stack([(d[:, None] == np.arange(BUCKETS)).argmax(0) for d in DONORS], axis=1).astype(np.uint8)


def registers(h: np.ndarray, bounds: np.ndarray, first: int = BUCKETS) -> np.ndarray:
    """HyperMinHash registers (sets x the ``first`` of BUCKETS) of sets h[bounds[i]:bounds[i + 1]], each sorted and distinct; 0: empty set."""
    rest, sets = 64 - BUCKET_BITS, len(bounds) - 1
    cell = np.repeat(np.arange(sets), np.diff(bounds)) << BUCKET_BITS | (h >> U(rest)).astype(np.int64)
    least = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][: len(cell)])  # the first of a bucket is its minimum
    value = np.maximum((h[least] & U((1 << rest) - 1)) >> U(rest - 52), 1)  # 52 bits: exact as floats
    zeros = 52 - np.frexp(value.astype(np.float64))[1]
    mantissa = ((value << zeros.astype(U)) >> U(51 - MANTISSA)) & U((1 << MANTISSA) - 1)  # below the leading one, now bit 51
    out = np.zeros(sets << BUCKET_BITS, np.uint16)
    out[cell[least]] = (zeros.astype(U) << U(MANTISSA) | mantissa) + U(1)
    out = out.reshape(sets, BUCKETS)
    full = out > 0
    open_ = np.flatnonzero(full.any(1) & ~full[:, :first].all(1))
    for rows in np.split(open_, range(512, len(open_), 512)) if len(open_) else ():  # an empty bucket takes the register of another, the same way for every set
        of, have = np.nonzero(full[rows])
        turn = np.minimum.reduceat(TURNS[have, :first], np.searchsorted(of, np.arange(len(rows))))
        out[rows, :first] = out[rows[:, None], DONORS[np.arange(first), turn]]
    return out[:, :first]


def bands(regs: np.ndarray, rows: int = BAND_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(keys, valid): one key for each band of ``rows`` registers; bands of empty buckets aren't valid."""
    n, m = regs.shape
    cells = regs[:, : m // rows * rows].reshape(n, m // rows, rows).astype(U)
    key = np.zeros(cells.shape[:2], U)
    for j in range(rows):
        key = mix(key ^ cells[:, :, j] + U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return mix(key ^ (np.arange(m // rows, dtype=U) * U(0xC2B2AE3D27D4EB4F))), (cells > 0).any(2)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of register rows, and how many shingles they rest on."""
    same = (a == b).sum(1)
    size = np.minimum(a.shape[1], np.minimum(na, nb))  # registers that stand for different shingles
    ratio = np.maximum(na, nb) / np.maximum(np.minimum(na, nb), 1)
    # Minima of unrelated sets agree on zeros and mantissa about this often.
    chance = 0.169919487159739 * 4 * ratio / (1 + ratio) ** 2 / 2**MANTISSA
    return np.clip((same / a.shape[1] - chance) / (1 - chance), 0, 1), size


def _by_document(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Order by document, then hash: both in one word, as long as that leaves no hashes of a document in doubt."""
    bits = docs.bit_length()
    both = doc.astype(U) << U(64 - bits) | h >> U(bits)
    order = np.argsort(both)
    both, h = both[order], h[order]
    if ((both[1:] == both[:-1]) & (h[1:] < h[:-1])).any():
        return order[np.lexsort((h, both))]
    return order


def shingle_table(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct shingle hashes of each text, one text after the other."""
    data, offs = text_bytes(texts)
    words, _, _, first = word_hashes(data, offs)
    h, doc = all_shingles(words, first, n)
    order = _by_document(h, doc, len(offs) - 1)
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)]
    return h[new], np.searchsorted(doc[new], np.arange(len(offs)))


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, a bounded number of bytes at a time."""
    out = []
    for b in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", KERNEL_BYTES):
        h, bounds = shingle_table(b.column("text"), n)
        out += np.split(h, bounds[1:-1])
    return out


def sketches(items: DataFrame, n: int, buckets: int = BUCKETS) -> DataFrame:
    """id, size, sig_a, sig_b (sums that name the set), regs for items (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("text")
        for whole in batches:
            for b in slices(whole, "text", KERNEL_BYTES):
                h, bounds = shingle_table(b.column("text"), n)
                sums = [np.r_[U(0), np.cumsum(x)] for x in (h, mix(h ^ U(0x5851F42D4C957F2D)))]
                sig = [(x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in sums]
                regs = registers(h, bounds, buckets)
                cols = [b.column("id"), pa.array(np.diff(bounds)), *map(pa.array, sig), pa.array([r.tobytes() for r in regs], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "size", "sig_a", "sig_b", "regs"])

    return items.select("id", "text").mapInArrow(run, "id long, size long, sig_a long, sig_b long, regs binary")


def confirmed(pairs: DataFrame, rows: int, reps: DataFrame, items: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those pairs (a, b; at most ``rows``) whose shingle sets reach den * |both| >= num * |either|."""
    side = reps.select("id", "size", "regs")
    known = pairs.join(side.toDF("a", "size_a", "regs_a"), "a").join(side.toDF("b", "size_b", "regs_b"), "b")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            na, nb = x.column("size_a").to_numpy(), x.column("size_b").to_numpy()
            ra, rb = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint16).reshape(x.num_rows, -1) for c in ("regs_a", "regs_b"))
            j, size = estimate(ra, rb, na, nb)
            t = num / den
            fine = (den * np.minimum(na, nb) >= num * np.maximum(na, nb)) & (j >= t - SLACK * np.sqrt(t * (1 - t) / np.maximum(size, 1)))
            yield x.select(["a", "b"]).filter(pa.array(fine))

    hopeful = materialise(narrowed(known, rows, REGISTERS).mapInArrow(likely, "a long, b long"), "hopeful")
    rows = hopeful.count()
    text = _involved(items.select("id", "text"), hopeful, rows)
    both = hopeful.join(text.toDF("a", "text_a"), "a").join(text.toDF("b", "text_b"), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("text")
        memo: dict[int, np.ndarray] = {}  # of the sides that repeat; bounded by its bytes

        def sets(ids: list, col: pa.Array) -> list[np.ndarray]:
            if sum(v.nbytes for v in memo.values()) > 32 << 20:
                memo.clear()
            new = [i for i, k in enumerate(ids) if k not in memo]
            if new:
                memo.update(zip((ids[i] for i in new), shingle_sets(col.take(pa.array(new)), n), strict=True))
            return [memo[k] for k in ids]

        for whole in batches:
            for x in slices(whole, "text_a", KERNEL_BYTES):
                a, b = sets(x.column("a").to_pylist(), x.column("text_a")), sets(x.column("b").to_pylist(), x.column("text_b"))
                met = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(a, b, strict=True)], np.int64)
                total = np.array([len(p) + len(q) for p, q in zip(a, b, strict=True)], np.int64) - met
                yield x.select(["a", "b"]).filter(pa.array((den * met >= num * total) & (met > 0)))

    return narrowed(both, rows, TEXTS).mapInArrow(check, "a long, b long")


def _involved(text: DataFrame, pairs: DataFrame, rows: int) -> DataFrame:
    """The texts that ``pairs`` (at most ``rows``) speak of; few ids are broadcast, many looked up, so that no other text is shuffled."""
    ids = materialise(narrowed(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), 2 * rows, LONGS), "involved")
    count = ids.count()
    if count > BROADCAST_IDS:
        return lookup.among(text, "id", lookup.save(ids.select(F.col("id").alias("key")), count=count))
    return text.join(F.broadcast(ids), "id", "left_semi")


def cluster(items: DataFrame, n: int, num: int = 80, den: int = 100, rows: int = BAND_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """id, size, component (smallest id reachable) for items (id long, text), written to the shared folder.

    ``items`` may be read several times and must be deterministic.
    """
    with compact(items.sparkSession):
        return _cluster(items.where(F.col("id").isNotNull()), n, num, den, rows, buckets)


def _cluster(items: DataFrame, n: int, num: int, den: int, rows: int, buckets: int) -> DataFrame:
    all_ = materialise(sketches(items, n, buckets), "sketches")
    count = all_.count()
    sig = ["size", "sig_a", "sig_b"]
    classes = materialise(narrowed(all_.where("size > 0").groupBy(*sig).agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), count), "classes")
    member = materialise(narrowed(all_.select("id", *sig).join(classes, sig, "left").select("id", "size", F.coalesce("rep", "id").alias("rep")), count), "member")
    others = member.where("id <> rep").select("id")
    smallest = F.min_by(F.struct("size", "regs"), F.struct("size", "sig_a", "sig_b")).alias("s")
    reps = materialise(narrowed(all_.where("size > 0").groupBy("id").agg(smallest).join(others, "id", "left_anti").select("id", "s.*"), count), "reps")
    release(all_)
    release(classes)

    most = count * (buckets // rows)
    met = materialise(narrowed(_meeting(reps, rows, buckets, most), most, LONGS), "met")
    degree = materialise(narrowed(met.groupBy("id").agg(F.sum("n").alias("degree")), count), "degree")
    most = met.count()
    ranked = met.select("key", "id").join(degree, "id")
    hubs = materialise(narrowed(ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("hub"))).alias("best")).select("key", (-F.col("best.hub")).alias("hub")), most, LONGS), "hubs")
    spokes = materialise(narrowed(met.select("key", "id").join(hubs, "key").where("id <> hub").groupBy("id", "hub").agg(F.count("*").alias("times")), most, LONGS), "spokes")

    # First every member and its most promising hub, then all its hubs, then whatever is still apart.
    first = spokes.groupBy("id").agg(F.max(F.struct("times", (-F.col("hub")).alias("hub"))).alias("best")).select(F.col("id").alias("a"), (-F.col("best.hub")).alias("b"))
    links = [materialise(confirmed(first, count, reps, items, n, num, den), "links")]
    label = materialise(narrowed(components(links[0]), count), "label")
    apart = _labelled(spokes.select(F.col("id").alias("a"), F.col("hub").alias("b")), label)
    links.append(materialise(confirmed(apart, spokes.count(), reps, items, n, num, den), "links"))
    release(label)
    label = materialise(narrowed(components(_union(links)), count), "label")
    held = materialise(narrowed(met.select("key", "id").join(label, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), most, LONGS), "held")
    open_ = materialise(narrowed(held.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"), most, LONGS), "open")
    still = materialise(narrowed(held.join(open_, "key"), most, LONGS), "still")
    release(open_)
    left, common = _linkable(still, reps, items, n, num, den)
    links.append(_compared(left, common, reps, items, n, num, den))
    final = materialise(narrowed(components(_union(links)), count), "final")
    out = materialise(narrowed(member.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("id", "size", F.coalesce("component", "rep").alias("component")), count), "clusters")
    for t in (member, reps, met, degree, hubs, spokes, label, held, still, left, common, final, *links):
        release(t)
    return out


def _meeting(reps: DataFrame, rows: int, buckets: int, most: int) -> DataFrame:
    """key, id, n: the band buckets (at most ``most`` memberships) in which n > 1 of the sets ``reps`` meet."""

    def keys(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        regs = np.frombuffer(b"".join(b.column("regs").to_pylist()), np.uint16).reshape(b.num_rows, buckets)
        key, valid = bands(regs, rows)
        return key.view(np.int64)[valid], np.nonzero(valid)[0]

    shared = lookup.repeated(reps.select("regs"), lambda b: [keys(b)[0]], max(1, -(-most // MEETINGS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("text")
        for b in batches:
            key, of = keys(b)
            found, (n,) = shared.first(key, "n")
            yield pa.RecordBatch.from_arrays([pa.array(key[found]), b.column("id").take(pa.array(of[found])), pa.array(n[found])], names=["key", "id", "n"])

    return reps.select("id", "regs").mapInArrow(run, "key long, id long, n long")


def _linkable(still: DataFrame, reps: DataFrame, items: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(id, component, size, common) and (id, h, n: sets with it) of the rows (key, id, component) whose set can reach the threshold with one of another component in its band bucket.

    Shingles that no set of another component has cannot be in an intersection that
    matters: with e the others, a link needs num * (|x| + |y|) <= (num + den) * e(x), and
    |y| at least num / den * |x|. Buckets whose rows are left in one component have nothing
    to settle. This takes out far relatives of large groups without comparing them
    with the group.
    """
    most = still.count()
    ids = materialise(narrowed(still.select("id", "component").distinct(), most, LONGS), "ids")
    count = ids.count()
    text = _involved(items.select("id", "text"), ids.select(F.col("id").alias("a"), F.col("id").alias("b")), count)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("text")
        for whole in batches:
            for b in slices(whole, "text", KERNEL_BYTES):
                sets = shingle_sets(b.column("text"), n)
                owner = np.repeat(b.column("id").to_numpy(), [len(x) for x in sets])
                of = np.repeat(b.column("component").to_numpy(), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(of), pa.array(np.concatenate(sets).view(np.int64))], names=["id", "component", "h"])

    own = materialise(narrowed(text.join(ids, "id"), count, TEXTS).mapInArrow(spread, "id long, component long, h long"), "own")
    shingles = own.count()
    across = own.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("h", "n")
    shared = materialise(narrowed(own.join(across, "h").select("id", "h", "n"), shingles, LONGS), "across")
    common = shared.groupBy("id").agg(F.count("*").alias("common"))
    sized = materialise(narrowed(reps.select("id", "size").join(common, "id").select("id", "size", "common"), count), "sized")
    known = materialise(narrowed(still.join(sized, "id"), most, LONGS), "known")
    least = materialise(narrowed(known.groupBy("key").agg(F.collect_set("size").alias("sizes")), most, LONGS), "least")
    fits = F.exists("sizes", lambda y: (den * y >= num * F.col("size")) & (num * (F.col("size") + y) <= (num + den) * F.col("common")))
    able = materialise(narrowed(known.join(least, "key").where(fits).select("key", "id", "component"), most, LONGS), "able")
    open_ = materialise(narrowed(able.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"), most, LONGS), "open")
    left = able.join(open_, "key").select("id", "component").distinct().join(sized, "id")
    left = materialise(narrowed(left.select("id", "component", "size", "common"), count), "left")
    for t in (ids, own, sized, known, least, able, open_):
        release(t)
    return left, shared


def _compared(left: DataFrame, shared: DataFrame, reps: DataFrame, items: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Confirmed links (a, b) between different components of sets (id, component, size, common) with common shingles (id, h, n).

    Two sets that reach the threshold share a shingle among the size - ceil(num * size /
    den) + 1 first of each, in any order of all shingles. Here those that no two components
    share come first and meet nobody, then the rarest; what large groups have in common comes last.
    Where more than BLOCK sets meet in one shingle all the same, they are dealt out as
    pairs of blocks, and a task compares two blocks by exact intersection counts.
    """
    place = F.row_number().over(Window.partitionBy("id").orderBy("n", "h")) + F.col("size") - F.col("common")
    ranked = shared.join(left, "id").withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * num / den) + 1)
    most = shared.count()
    prefix = materialise(narrowed(ranked.select("h", "id", "component", "size"), most, LONGS), "prefix")
    groups = materialise(narrowed(prefix.groupBy("h").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("h", "m"), most, LONGS), "groups")
    side = prefix.join(groups.where(F.col("m") <= BLOCK).select("h"), "h")
    other = side.toDF("h", "b", "component_b", "size_b")
    near = (F.col("a") < F.col("b")) & (F.col("component") != F.col("component_b")) & (den * F.least("size", "size_b") >= num * F.greatest("size", "size_b"))
    pairs = side.withColumnRenamed("id", "a").join(other, "h").where(near).select("a", "b").distinct()
    meetings = groups.where(F.col("m") <= BLOCK).agg(F.coalesce(F.sum(F.col("m") * F.col("m")), F.lit(0))).first()[0]
    links = materialise(confirmed(pairs, meetings, reps, items, n, num, den), "links")
    large = groups.where(F.col("m") > BLOCK)
    if not large.isEmpty():
        links, before = materialise(links.unionByName(_by_blocks(prefix.join(large, "h"), items, n, num, den)), "links"), links
        release(before)
    for t in (prefix, groups):
        release(t)
    return links


def _by_blocks(members: DataFrame, items: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links between different components of members (h, id, component, m), m of which meet in h."""
    placed = members.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    text = _involved(items.select("id", "text"), members.select(F.col("id").alias("a"), F.col("id").alias("b")), members.count())
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = placed.select("id", "component", "h", "block", other).join(text, "id")
    dealt = dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        begin("text")
        part = part.sort_values(["id", "text"]).drop_duplicates("id")
        out: list[tuple[int, int]] = []
        if part["component"].nunique() > 1:
            sets = shingle_sets(pa.array(part["text"].tolist(), pa.string()), n)
            size = np.array([len(x) for x in sets], np.int64)
            of = np.repeat(np.arange(len(sets)), size)
            _, column = np.unique(np.concatenate(sets), return_inverse=True)
            met = np.zeros((len(sets), len(sets)), np.int64)
            for c in range(0, int(column.max(initial=-1)) + 1, 8192):
                here = (column >= c) & (column < c + 8192)
                ones = np.zeros((len(sets), 8192), np.float32)
                ones[of[here], column[here] - c] = 1
                met += (ones @ ones.T).astype(np.int64)
            comp, ids = part["component"].to_numpy(), part["id"].to_numpy()
            near = den * met >= num * (size[:, None] + size[None, :] - met)
            a, b = np.nonzero(np.triu(near & (met > 0) & (comp[:, None] != comp[None, :]), 1))
            out = list(zip(ids[a].tolist(), ids[b].tolist(), strict=True))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    with compact(items.sparkSession, False):  # much work on few bytes
        return materialise(dealt.groupBy("h", "lo", "hi").applyInPandas(compare, "a long, b long"), "compared")


def _union(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def _labelled(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    a, b = label.toDF("a", "ca"), label.toDF("b", "cb")
    return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs`` (rows that repeat a doc_id: each)."""
    found = cluster(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), n, num, den)
    rows = found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
    null = F.lit(None).cast("long")
    lost = sketches(docs.where(F.col("doc_id").isNull()).select(F.lit(0).cast("long").alias("id"), "text"), n)
    lost = lost.select(null.alias("doc_id"), F.col("size").alias("n_shingles"), null.alias("component_id"), F.lit(True).alias("kept"))
    return rows.unionByName(lost)


def drop_near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Filtering stage: one document of each component stays, all columns as they were."""
    found = cluster(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), n, num, den)
    gone = lookup.save(found.where("id <> component").select(F.col("id").alias("key")).distinct())
    release(found)
    return lookup.among(docs, "doc_id", gone, inside=False)
