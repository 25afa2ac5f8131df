"""Subject-disjoint splits, folds and samples, decided by hashes so that any engine and any partitioning agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ticket(seed: int, col: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), col.cast("string")))


def _drawn(people: DataFrame, subject: str, seed: int) -> DataFrame:
    """``people`` with r, their place (from 1) in the order of their tickets, and n, how many there are.

    Tickets are cut into 256 ranges by their first digits: a task ranks one range, and counts of the ranges give its start.
    """
    known = people.withColumn("_ticket", ticket(seed, F.col(subject))).withColumn("_range", F.substring("_ticket", 1, 2))
    sizes = known.groupBy("_range").agg(F.count("*").alias("_size"))  # at most 256 rows
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_start"), F.sum("_size").over(Window.orderBy(F.lit(0))).alias("n"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_ticket", subject))
    return known.withColumn("_place", place).join(F.broadcast(starts), "_range").withColumn("r", F.col("_place") + F.col("_start")).drop("_ticket", "_range", "_place", "_start")


def subject_split(rows: DataFrame, subject: str, seed: int = 42, fracs: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """(subject, split): train, val or test; whole subjects only, at least one of each."""
    if abs(sum(fracs) - 1) > 1e-9:
        raise ValueError("fractions must sum to 1")
    ranked = _drawn(rows.select(subject).distinct(), subject, seed)
    train = F.least(F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(fracs[0]))), F.col("n") - 2)
    val = F.least(F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(fracs[1]))), F.col("n") - train - 1)
    few = F.when(F.col("n") < 3, F.raise_error(F.lit("need at least three subjects")).cast("string"))
    return ranked.select(subject, few.when(F.col("r") <= train, "train").when(F.col("r") <= train + val, "val").otherwise("test").alias("split"))


def describe(rows: DataFrame, split: DataFrame, subject: str) -> DataFrame:
    return rows.join(split, subject).groupBy("split").agg(F.countDistinct(subject).alias("subjects"), F.count("*").alias("windows"))


def leaks(assignments: DataFrame, subject: str) -> DataFrame:
    """Subjects that are in more than one split."""
    return assignments.groupBy(subject).agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def coverage(rows: DataFrame, assignments: DataFrame, key: str) -> DataFrame:
    """(none, several): how many windows are in no split, and in more than one."""
    held = assignments.groupBy(key).agg(F.count("*").alias("n"))
    n = rows.select(key).join(held, key, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return n.agg(F.coalesce(F.sum((F.col("n") == 0).cast("long")), F.lit(0)).alias("none"), F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("several"))


def assert_partition(rows: DataFrame, assignments: DataFrame, key: str) -> DataFrame:
    """``assignments``, unless a window is in no split or in several."""
    found = coverage(rows, assignments, key).first()
    if found["none"] or found["several"]:
        raise AssertionError(f"{found['none']} windows in no split, {found['several']} in more than one")
    return assignments


def gather(rows: DataFrame, wanted: DataFrame, key: str, position: str = "pos") -> DataFrame:
    """The rows that ``wanted`` (position, key) names, in that order and as often; a key that isn't there gives no row."""
    return wanted.select(position, key).join(rows, key)


def loso_folds(rows: DataFrame, subject: str) -> DataFrame:
    """(held, windows in train, windows in test) of every leave-one-subject-out fold."""
    sizes = rows.groupBy(subject).agg(F.count("*").alias("n_test"))
    total = rows.agg(F.count("*").alias("n"))
    return sizes.crossJoin(F.broadcast(total)).select(F.col(subject).alias("held"), (F.col("n") - F.col("n_test")).alias("n_train"), "n_test")


def loso_fold(rows: DataFrame, subject: str, held) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col(subject) != held), rows.where(F.col(subject) == held)


def leave_dataset_out(rows: DataFrame, dataset: str, test: str, subject: str, val_frac: float = 0.15, seed: int = 42) -> DataFrame:
    """``rows`` plus split: the held-out corpus is test; some subjects of the others are val."""
    rest = rows.where(F.col(dataset) != test).select(subject).distinct()
    ranked = _drawn(rest, subject, seed)
    val = F.least(F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(val_frac))), F.col("n") - 1)
    chosen = ranked.select(F.col(subject), (F.col("r") <= val).alias("is_val"))
    out = rows.join(chosen, subject, "left")
    return out.withColumn("split", F.when(F.col(dataset) == test, "test").when(F.col("is_val"), "val").otherwise("train")).drop("is_val")


def stratified_sample(rows: DataFrame, key: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows, n // classes of each non-negative class."""
    own = rows.where(F.col(label) >= 0)
    per = max(1, n // max(1, own.select(label).distinct().count()))  # a literal bound: tasks keep only so many rows before they shuffle
    order = Window.partitionBy(label).orderBy(ticket(seed, F.col(key)), key)
    kept = own.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per).drop("r")
    return kept.orderBy(ticket(seed, F.col(key)), key).limit(n)


def uniform_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return rows.orderBy(ticket(seed, F.col(key)), key).limit(n)


def expand(rows: DataFrame, times: int, key: str, total: int) -> DataFrame:
    """The rows and ``times`` copies; copy c of row r has key c * total + r."""
    if times < 0:
        raise ValueError("times must not be negative")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times)))).withColumn(key, F.col("copy") * total + F.col(key))
