"""Ranges of a global order, cut from quantiles in one pass, so that no task sorts a whole group.

A range is a number computed from the order columns by a fixed expression: every branch of a plan
and every retry agree on it. A value that alone fills a range is cut further by the next column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a range, about; ranges of one column at least and at most.
PER = 1 << 20
LEAST, MOST = 8, 1024
#: Columns that may be cut.
COLUMNS = 3


def measured(rows: DataFrame, name: str) -> Column | None:
    """A number that orders as the column does and tells all its values apart; None if there is no such number."""
    kind, c = rows.schema[name].dataType, F.col(name)
    if isinstance(kind, T.IntegralType):
        return c.cast("long")
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return c.cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    return None


def _below(cuts: Column, c: Column) -> tuple[Column, Column]:
    """How many cuts are below a value, and how many are not above it."""
    return F.size(F.filter(cuts, lambda x: x < c)).cast("long"), F.size(F.filter(cuts, lambda x: x <= c)).cast("long")


def place(rows: DataFrame, *order: str, per: int | None = None) -> Column:
    """Number of the range that a row falls into; larger for rows that come later by ``order``. Nulls come first."""
    found = [measured(rows, c) for c in order[:COLUMNS]]
    columns = found[: next((i for i, c in enumerate(found) if c is None), len(found))]
    if not columns:
        return F.lit(0).cast("long")
    shares = [i / MOST for i in range(1, MOST)]
    seen = rows.agg(F.count("*").alias("n"), *[F.percentile_approx(c, shares).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    step = max(1, MOST // min(MOST, max(LEAST, -(-seen["n"] // (per or PER)))))
    out, alone = F.lit(0).cast("long"), F.lit(True)
    for i, c in enumerate(columns):
        cuts = sorted(set((seen[f"q{i}"] or [])[step - 1 :: step]))
        if not cuts:
            break
        at = F.array(*map(F.lit, cuts))
        before, upto = _below(at, c)
        out = out * (2 * len(cuts) + 1) + F.when(alone, before + upto).otherwise(0)
        alone = alone & (before != upto)
    return out


def starts(counts: DataFrame, by: list[str], *sums: str) -> DataFrame:
    """``by``, _range and, for each of ``sums`` of a row a range, b_ its sum over the ranges before.

    A group has at most a row for each range here, so its ranges fit an array.
    """
    whole = counts.groupBy(*by) if by else counts.groupBy()
    lists = whole.agg(F.array_sort(F.collect_list(F.struct("_range", *sums))).alias("_s"))
    add = lambda name: lambda acc, x: acc + x[name]
    before = F.transform("_s", lambda x, i: F.struct(x["_range"].alias("_range"), *[F.aggregate(F.slice("_s", F.lit(1), i), F.lit(0).cast(counts.schema[c].dataType), add(c)).alias(f"b_{c}") for c in sums]))
    return lists.select(*by, F.explode(before).alias("_x")).select(*by, "_x.*")

