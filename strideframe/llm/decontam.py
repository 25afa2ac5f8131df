"""Benchmark decontamination by template windows. DataFrame functions only.

Texts become tokens; numbers, names and units turn into typed placeholders, so an
item whose quantities or people were exchanged keeps its template. Windows of
WINDOW canonical tokens are hashed and joined; windows that keep their distance form an
alignment. An alignment counts if its slots are filled consistently: each value of
the item stands for one value of the document and the other way round. Alignments
that agree with each other on the values are united, those with most windows first
(text inserted into an item splits it into two), and the item counts as found if
enough distinct windows of it match; a window that a document repeats counts once.

In a run of placeholders (a table, a list) one with REACH of them on either side stands for
itself in a window: a row of numbers alone is the template of any other row of numbers, so
the inside of a run is found by its values. Slots are checked alike in and out of runs.

An item of fewer than WINDOW tokens is one window of its own length: it is found where
its tokens, lower-cased, follow each other word for word.

Tokens are letter runs and numbers; full stops, question and exclamation marks end
sentences. A name is a capitalised word that does not begin a sentence; a unit is
one of UNITS right after a number.

Definitions: null or empty texts, and texts without tokens, have no windows. Rows
without doc_id or item_id take no part. Repeated rows count once; rows that repeat an
id with other texts are judged each, and the best match of the two ids is returned.
Columns of other names are ignored; an empty side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, release

WINDOW = 8  # a power of two: window hashes are built by doubling
COVERAGE = 0.5
REACH = 2
#: Rows up to which a side is broadcast (a few dozen bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 200_000
UNITS = ("kg", "g", "mg", "lb", "oz", "km", "m", "cm", "mm", "mi", "ft", "in", "l", "ml", "s", "ms", "min", "h", "hours", "hour", "days", "day", "years", "year", "minutes", "seconds", "meters", "metres", "miles", "feet", "inches", "pounds", "dollars", "euros", "percent")
TOKEN = r"\p{L}+|[0-9]++(?:[.,][0-9]++)*+|[.!?]"


def _is_stop(t: Column) -> Column:
    return t.isin(".", "!", "?")


def _canonical(raw: Column, t: Column, i: Column) -> Column:
    before = F.when(i > 0, F.get(raw, i - 1))
    first = F.substring(t, 1, 1)
    number = first.between("0", "9")
    capital = (first != F.lower(first)) & before.isNotNull() & ~_is_stop(before)
    unit = F.when(before.isNotNull() & F.substring(before, 1, 1).between("0", "9"), F.lower(t).isin(*UNITS)).otherwise(False)
    return F.when(number, "<number>").when(unit, "<unit>").when(capital, "<name>").otherwise(F.lower(t))


def tokens(text: Column) -> Column:
    """All tokens of a text, sentence ends among them."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _pairs(step: int, h: str) -> Column:
    """Hash of each entry with the one ``step`` places on."""
    n = F.size(h) - step
    return F.when(n > 0, F.zip_with(F.slice(F.col(h), F.lit(1), n), F.slice(F.col(h), F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def _words(rows: DataFrame, id: str) -> DataFrame:
    """key (of id and text), id, words (canonical and raw tokens without sentence ends)."""
    own = rows.where(F.col(id).isNotNull() & F.col("text").isNotNull())
    out = own.select(F.xxhash64(id, "text").alias("key"), F.col(id), tokens(F.col("text")).alias("raw"))
    out = out.select("key", id, F.transform("raw", lambda t, i: F.struct(_canonical(F.col("raw"), t, i).alias("c"), t.alias("t"))).alias("both"))
    return out.select("key", id, F.filter("both", lambda x: ~_is_stop(x["c"])).alias("words"))


def _open(x: Column) -> Column:
    """Whether a word is a placeholder (tokens of a text hold no such bracket)."""
    return x["c"].startswith("<")


def _in_run(x: Column, i: Column) -> Column:
    """Whether REACH placeholders stand on either side of this one. The word itself comes first, so plain words cost one look."""
    inside = _open(x)
    for k in range(1, REACH + 1):
        inside = inside & _open(F.get("words", i - k)) & _open(F.get("words", i + k))
    return inside  # null beyond the ends, which decides as false does


def windows(rows: DataFrame, id: str) -> DataFrame:
    """key, id, words, h (hashes of the windows by position; none in texts of fewer than WINDOW tokens)."""
    out = _words(rows, id).withColumn("h", F.transform("words", lambda x, i: F.xxhash64(F.when(_in_run(x, i), F.lower(x["t"])).otherwise(x["c"]))))
    step = 1
    while step < WINDOW:
        out = out.withColumn("h", _pairs(step, "h"))
        step *= 2
    return out


def _verbatim(size: int) -> Column:
    """Hashes of the runs of ``size`` lower-cased tokens, by position."""
    low = F.transform("words", lambda x: F.lower(x["t"]))
    every = F.sequence(F.lit(1), F.size("words") - size + 1)
    return F.when(F.size("words") >= size, F.transform(every, lambda i: F.xxhash64(F.lit(size), F.slice(low, i, F.lit(size))))).otherwise(F.array().cast("array<bigint>"))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, matched (windows), windows (of the item), coverage: one row for each item found in a document."""
    items = materialise(windows(benchmark.select("item_id", "text").dropDuplicates(), "item_id"), "items")
    short = [r["n"] for r in items.select(F.size("words").alias("n")).where((F.col("n") > 0) & (F.col("n") < WINDOW)).distinct().collect()]  # at most WINDOW - 1 lengths
    whole = F.col("h")
    for size in sorted(short):
        whole = F.when(F.size("words") == size, _verbatim(size)).otherwise(whole)
    grams = items.select(F.col("key").alias("item"), "item_id", whole.alias("h")).select("item", "item_id", F.size("h").alias("windows"), F.posexplode_outer("h").alias("place", "h"))
    grams = materialise(grams.where("h IS NOT NULL"), "grams")
    known = _sized(grams, grams.count())
    own = windows(docs.select("doc_id", "text"), "doc_id")
    at = F.posexplode_outer("h").alias("at", "h")  # outer: no filter is inferred that would build h anew
    if short:
        paired = lambda h, i: F.struct(i.alias("at"), h.alias("h"))
        at = F.explode_outer(F.concat(F.transform("h", paired), *[F.transform(_verbatim(size), paired) for size in short])).alias("w")
    own = own.select(F.col("key").alias("doc"), "doc_id", at).select("doc", "doc_id", *(["w.*"] if short else ["at", "h"]))
    hits = own.join(known, "h").groupBy("doc", "doc_id", "item", "item_id", "windows", (F.col("at") - F.col("place")).alias("shift")).agg(F.collect_set("place").alias("places"))
    per_shift = materialise(hits, "shifts")
    pair = ["doc", "doc_id", "item", "item_id", "windows"]
    reached = per_shift.select(*pair, F.explode("places").alias("place")).groupBy(*pair).agg(F.countDistinct("place").alias("all"))
    likely = materialise(reached.where(F.col("all") >= F.col("windows") * coverage).select("doc", "item"), "likely")
    aligned = materialise(per_shift.join(likely, ["doc", "item"]), "aligned")

    # Slots are checked in the few documents that are left.
    n = aligned.count()
    few = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").join(_sized(aligned.select("doc_id").distinct(), n), "doc_id", "left_semi")
    mine = _words(few.dropDuplicates(), "doc_id").select(F.col("key").alias("doc"), F.col("words").alias("mine"))
    theirs = items.select(F.col("key").alias("item"), F.col("words").alias("theirs"))
    joined = mine.join(_sized(aligned, n), "doc").join(_sized(theirs, theirs.count()), "item")
    lo = F.array_min("places")
    length = F.array_max("places") - lo + F.least(F.lit(WINDOW), F.size("theirs"))
    slots = F.zip_with(F.slice("theirs", lo + 1, length), F.slice("mine", lo + F.col("shift") + 1, length), _slot)
    slots = F.array_sort(F.array_distinct(F.filter(slots, lambda x: x.isNotNull())))
    alignment = F.struct((-F.size("places")).alias("less"), F.array_sort("places").alias("places"), slots.alias("slots"))
    checked = joined.select(*pair, alignment.alias("x")).where(_one_to_one(F.col("x.slots")))
    united = checked.groupBy(*pair).agg(F.array_sort(F.collect_set("x")).alias("all"))
    none = F.struct(F.expr("cast(array() as array<int>)").alias("places"), F.expr("cast(array() as array<string>)").alias("slots"))
    total = F.aggregate("all", none, _unite, lambda acc: F.size(acc["places"]))
    found = united.select("doc_id", "item_id", "windows", total.cast("long").alias("matched")).where(F.col("matched") >= F.col("windows") * coverage)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("matched") / F.col("windows")).alias("coverage"), "matched", F.col("windows").cast("long").alias("windows"))).alias("x"))
    out = materialise(best.select("doc_id", "item_id", "x.matched", "x.windows", "x.coverage"), "leaks")
    for scratch in (items, grams, per_shift, likely, aligned):
        release(scratch)
    return out


def _one_to_one(slots: Column) -> Column:
    """Whether each value of distinct slots stands for one value of the other side."""
    left, right = (F.array_distinct(F.transform(slots, lambda x: F.substring_index(x, "\t", side))) for side in (1, -1))  # noqa: B023
    return (F.size(left) == F.size(slots)) & (F.size(right) == F.size(slots))


def _unite(acc: Column, x: Column) -> Column:
    """Windows and slots with those of one more alignment, where all slots agree."""
    slots = F.array_union(acc["slots"], x["slots"])
    return F.when(_one_to_one(slots), F.struct(F.array_union(acc["places"], x["places"]).alias("places"), slots.alias("slots"))).otherwise(acc)


def _slot(a: Column, b: Column) -> Column:
    """Both values with a tab between where both tokens are the same placeholder; strings, as sets of structs are compared pair by pair."""
    same = (a["c"] == b["c"]) & a["c"].isin("<number>", "<name>", "<unit>")
    return F.when(same, F.concat(a["c"], F.lower(a["t"]), F.lit("\t"), b["c"], F.lower(b["t"])))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Filtering stage: documents in which no benchmark item is found, all columns as they were. Rows that share a contaminated doc_id go together."""
    found = materialise(leaks(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(_sized(found, found.count()), "doc_id", "left_anti").select(*docs.columns)
