"""Readers of motion corpora, and the checks of the common window schema."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import window_arrays
from . import motion
from .archives import Corpus
from .layout import CHANNELS, CLASSES, LINE_LABELS, LINE_SIGNALS, LINE_WIN, TRIAL_COLUMNS, TRIAL_LABELS

__all__ = ["CHANNELS", "CLASSES", "LINE_LABELS", "LINE_SIGNALS", "LINE_WIN", "TRIAL_COLUMNS", "TRIAL_LABELS"]



def read_line_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Windows that come as one line a channel; both parts, labels 1 to 5, aligned by line number in one shuffle."""
    lines = motion.register(spark).read.format("motion").option("layout", "lines").load(root)
    rows = lines.groupBy("split", "line").pivot("name", ["y", "subject", *LINE_SIGNALS]).agg(F.first("v"))
    sizes = {"y": 1, "subject": 1} | dict.fromkeys(LINE_SIGNALS, LINE_WIN)
    bad = reduce(lambda a, b: a | b, [F.coalesce(F.size(c) != n, F.lit(True)) for c, n in sizes.items()])
    rows = rows.select("*", F.col("y")[0].cast("int").alias("label"), F.col("subject")[0].cast("int").alias("person"))
    seen = rows.agg(F.sum(bad.cast("long")).alias("bad"), F.countDistinct("split").alias("splits")).first()
    if seen["bad"] or seen["splits"] != 2:
        raise ValueError(f"{seen['bad']} lines do not align or are not {LINE_WIN} samples long; {seen['splits']} of 2 parts")
    codes = F.create_map(*[F.lit(x) for kv in LINE_LABELS.items() for x in kv])
    x = F.transform(F.arrays_zip(*LINE_SIGNALS), lambda s: F.array(*[s[c] for c in LINE_SIGNALS]))
    known = rows.where(F.col("label").isin(*LINE_LABELS))
    return known.select(x.alias("X"), codes[F.col("label")].alias("y_act"), F.lit(-1).cast("byte").alias("y_fall"), F.format_string("uci_%02d", "person").alias("subject"), F.lit("uci").alias("dataset"))


def read_trial_corpus(spark: SparkSession, root: str, win: int = 128, stride: int = 64) -> DataFrame:
    """Continuous trials, one CSV each in a folder named after its activity; columns are found by name, file by file."""
    samples = motion.register(spark).read.format("motion").option("layout", "trials").load(root)
    windows = sliding(samples, win, stride)
    if windows.isEmpty():
        raise ValueError(f"no usable trial below {root}")
    return windows


def sliding(samples: DataFrame, win: int, stride: int) -> DataFrame:
    """Windows of the common schema from samples whose index within the trial is known."""
    about = samples.select("path", "subject", "y_act").distinct()
    return window_arrays(samples, "path", list(CHANNELS), win, stride).join(about, "path").select("X", "y_act", F.lit(-1).cast("byte").alias("y_fall"), "subject", F.lit("ms").alias("dataset"))


#: tag -> (reader, windowed by the corpus itself). More corpora are registered here.
LOADERS: dict[str, tuple[Callable, bool]] = {"uci": (read_line_corpus, True), "ms": (read_trial_corpus, False)}


def load_all(spark: SparkSession, roots: dict[str, str | Corpus], win: int = 128, stride: int = 64, tags: list[str] | None = None) -> DataFrame:
    """Union of the corpora ``tags`` (all of ``roots`` by default); a :class:`Corpus` is fetched first where it is missing."""
    tags = list(roots) if tags is None else tags
    unknown = sorted(set(tags) - set(LOADERS) | set(tags) - set(roots))
    if unknown:
        raise ValueError(f"unknown corpora {unknown}")
    parts = []
    for tag in tags:
        root, (f, own) = roots[tag], LOADERS[tag]
        root = str(root.root()) if isinstance(root, Corpus) else root
        parts.append(f(spark, root) if own else f(spark, root, win, stride))
    return concat(*parts)


def concat(*parts: DataFrame) -> DataFrame:
    """Union of window sets; all must hold windows of one length."""
    if not parts:
        raise ValueError("nothing to join")
    out = reduce(DataFrame.unionByName, parts)
    sizes = out.agg(F.min(F.size("X")).alias("lo"), F.max(F.size("X")).alias("hi")).first()
    if sizes["lo"] is None:
        raise ValueError("all parts are empty")
    if sizes["lo"] != sizes["hi"]:
        raise ValueError(f"windows of {sizes['lo']} and {sizes['hi']} samples do not mix")
    return out


def validate(windows: DataFrame, win: int) -> DataFrame:
    """One aggregate over all windows; raises if any breaks the schema."""
    bad = (F.size("X") != win) | ~F.forall("X", lambda s: F.size(s) == len(CHANNELS)) | ~F.col("y_act").between(-1, len(CLASSES) - 1) | ~F.col("y_fall").isin(-1, 0, 1)
    n = windows.where(F.coalesce(bad, F.lit(True))).count()
    if n:
        raise ValueError(f"{n} windows break the schema")
    return windows


def counts(windows: DataFrame, *columns: str, subject: str = "subject") -> DataFrame:
    """(what, value, n, subjects): windows and people in all (what 'all') and for each value of each of ``columns``, in one shuffle."""
    each = windows.select(subject, *columns).groupingSets([[], *[[F.col(c)] for c in columns]], *columns)
    found = each.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.countDistinct(subject).alias("subjects"))
    # Bit k of the id, from the left, tells that column k is not in the set.
    full = (1 << len(columns)) - 1
    what, value = F.when(F.col("g") == full, "all"), F.lit(None).cast("string")
    for k, c in enumerate(columns):
        own = F.col("g") == full - (1 << (len(columns) - 1 - k))
        what, value = what.when(own, c), F.when(own, F.col(c).cast("string")).otherwise(value)
    return found.select(what.alias("what"), value.alias("value"), "n", "subjects")


def summary(windows: DataFrame) -> dict:
    rows = counts(windows, "dataset", "y_act", "y_fall").collect()  # a row a corpus and class
    whole = next((r for r in rows if r["what"] == "all"), None)
    by = lambda c, f: {f(r["value"]): r["n"] for r in rows if r["what"] == c}
    return {"n": whole["n"] if whole else 0, "subjects": whole["subjects"] if whole else 0, "dataset": by("dataset", str), "y_act": by("y_act", int), "y_fall": by("y_fall", int)}


def slug(name: str) -> str:
    return re.sub(r"[^\w-]", "-", name).strip("-")
