"""Rank and class metrics, thresholds in alarms an hour, losses. All inputs are DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ranges


def windows_per_hour(hop: float) -> float:
    if hop <= 0:
        raise ValueError("hop must be positive")
    return 3600.0 / hop


def flag_rate_for_far(far: float, hop: float) -> float:
    if far <= 0:
        raise ValueError("far must be positive")
    return min(1.0, far / windows_per_hour(hop))


def far_per_hour(rate: float, hop: float) -> float:
    if not 0 <= rate <= 1:
        raise ValueError("rate must be within 0 and 1")
    return rate * windows_per_hour(hop)


def _running(rows: DataFrame, order: str, cols: list[str], *by: str) -> DataFrame:
    """Exclusive running sums over an order (within ``by``) without one task seeing all rows."""
    parts = rows.withColumn("_range", ranges.place(rows, order))
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    base = ranges.starts(sums, list(by), *[f"_t_{c}" for c in cols])  # a row a range
    out = parts.withColumns({f"_w_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in cols}).join(base if by else F.broadcast(base), [*by, "_range"])
    return out.withColumns({f"{c}_before": F.col(f"_w_{c}") + F.col(f"b__t_{c}") for c in cols}).drop("_range", *[f"_w_{c}" for c in cols], *[f"b__t_{c}" for c in cols])


def percentiles(rows: DataFrame, value: str, ps: list[float], *by: str) -> DataFrame:
    """``by``, p: array of exact, linearly interpolated percentiles (``ps`` from 0 to 1); null values are left out.

    Distinct values are counted first; running counts by range tell which value holds a rank, so no task holds all values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    ranked = _running(counts, "_v", ["_n"], *by)
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    ranked = ranked.join(totals, list(by)) if by else ranked.crossJoin(F.broadcast(totals))  # one row
    at = [(F.col("_total") - 1) * F.lit(float(p)) for p in ps]
    holds = lambda r: F.max(F.when((F.col("_n_before") <= r) & (r < F.col("_n_before") + F.col("_n")), F.col("_v")))
    found = ranked.groupBy(*by, "_total").agg(*[holds(f(a)).alias(f"_{name}{i}") for i, a in enumerate(at) for name, f in (("lo", F.floor), ("hi", F.ceil))])
    return found.select(*by, F.array(*[F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (a - F.floor(a)) for i, a in enumerate(at)]).alias("p"))


def box(rows: DataFrame, value: str, *by: str, reach: float = 1.5) -> DataFrame:
    """``by``, q1, q2, q3, low, high (furthest values within ``reach`` times q3 - q1 of the box), n, n_outside.

    Quartiles are exact. Null values and rows without a group are left out; no rows give no groups.
    """
    p = F.col("p")
    found = percentiles(rows, value, [0.25, 0.5, 0.75], *by).select(*by, p[0].alias("q1"), p[1].alias("q2"), p[2].alias("q3"))
    v, room = F.col("_v"), (F.col("q3") - F.col("q1")) * reach
    inside = (v >= F.col("q1") - room) & (v <= F.col("q3") + room)
    ends = [F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high")]
    return _with(rows, value, found, *by).groupBy(*by, "q1", "q2", "q3").agg(*ends, F.count("*").alias("n"), F.count_if(~inside).alias("n_outside"))


def density(rows: DataFrame, value: str, *by: str, bins: int = 20, lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """``by``, bin, left (its lower edge), n, density over ``bins`` equal bins between two exact percentiles, empty bins too.

    The density of a group sums to 1 over its width. Values beyond the percentiles, nulls and rows without a
    group are left out. Where both percentiles are equal all values are in bin 0 and the density is null.
    """
    p = F.col("p")
    found = percentiles(rows, value, [lo, hi], *by).select(*by, p[0].alias("_lo"), p[1].alias("_hi"))
    v, width = F.col("_v"), F.col("_hi") - F.col("_lo")
    held = _with(rows, value, found, *by).where(v.between(F.col("_lo"), F.col("_hi")))
    at = F.when(width > 0, F.least(F.floor((v - F.col("_lo")) / width * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = F.array(*[F.count_if(F.col("_bin") == i) for i in range(bins)])  # all bins of a group in one partial aggregate
    whole = held.withColumn("_bin", at).groupBy(*by, "_lo", "_hi").agg(F.count("*").alias("_total"), counts.alias("_counts"))
    each = whole.select(*by, "_lo", "_hi", "_total", F.posexplode("_counts").alias("bin", "n"))
    return each.select(*by, "bin", (F.col("_lo") + F.col("bin") * width / bins).alias("left"), "n", F.when(width > 0, F.col("n") * bins / (F.col("_total") * width)).alias("density"))


def _with(rows: DataFrame, value: str, found: DataFrame, *by: str) -> DataFrame:
    """The values (_v) of ``rows`` beside what ``found`` has of their group."""
    values = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    return values.join(found, list(by)) if by else values.crossJoin(F.broadcast(found))  # one row


def percentile_threshold(scores: DataFrame, score: str, p: float) -> DataFrame:
    """Exact, linearly interpolated percentile; a row flags where it is strictly above."""
    if not 0 <= p <= 100:
        raise ValueError("p must be within 0 and 100")
    return percentiles(scores, score, [p / 100]).select(F.col("p")[0].alias("threshold"))


def thresholds(negatives: DataFrame, score: str, fars: list[float], hop: float) -> DataFrame:
    """(target_far, threshold): one row a budget."""
    cuts = percentiles(negatives, score, [1 - flag_rate_for_far(f, hop) for f in fars])
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(float(f)) for f in fars]).alias("target_far"), F.col("p").alias("threshold"))).alias("x")
    return cuts.select(pairs).select("x.*")


def recall_at_far(rows: DataFrame, score: str, positive: str, fars: list[float], hop: float) -> DataFrame:
    """Threshold on negatives for each budget, recall on positives, alarms an hour that result."""
    table = F.broadcast(thresholds(rows.where(~F.col(positive)), score, fars, hop))  # one row a budget
    above = (F.col(score) > F.col("threshold")).cast("double")
    out = rows.join(table).groupBy("target_far", "threshold").agg(F.avg(F.when(F.col(positive), above)).alias("recall"), F.avg(F.when(~F.col(positive), above)).alias("rate"))
    return out.select("target_far", "threshold", "recall", (F.col("rate") * windows_per_hour(hop)).alias("achieved_far"))


def observed_far(held: DataFrame, score: str, table: DataFrame, hop: float) -> DataFrame:
    """Alarms an hour on held-out negatives under thresholds (target_far, threshold) that other rows gave."""
    rate = F.avg((F.col(score) > F.col("threshold")).cast("double"))
    return held.crossJoin(F.broadcast(table)).groupBy("target_far", "threshold").agg((rate * windows_per_hour(hop)).alias("observed_far"))  # one row a budget


def far_table(spark: SparkSession, fars: list[float], hop: float) -> DataFrame:
    """(far, flag_rate, percentile): the share of windows that each budget lets flag, and the percentile to cut at."""
    rows = [(float(f), flag_rate_for_far(f, hop), 100 * (1 - flag_rate_for_far(f, hop))) for f in fars]
    return spark.createDataFrame(rows, "far double, flag_rate double, percentile double")


def score_report(rows: DataFrame, score: str, positive: str, hop: float, fars: tuple[float, ...] = (0.5, 1.0, 2.0, 6.0), label: str = "score") -> str:
    """A few lines of text: separation by rank, then recall at each alarm budget."""
    n = rows.agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("n")).first()
    ranks = auroc(rows, score, positive).first()[0], auprc(rows, score, positive).first()[0]
    out = [f"{label}:", f"  AUROC {ranks[0]:.4f}   AUPRC {ranks[1]:.4f}   ({n['p']:,} events vs {n['n']:,} normal)"]
    for r in recall_at_far(rows, score, positive, list(fars), hop).orderBy("target_far").collect():
        out.append(f"  recall {r['recall']:.3f} at {r['target_far']:>4.1f} false alarms/hour   (threshold {r['threshold']:.4f}, achieved {r['achieved_far']:.2f}/h)")
    return "\n".join(out)


def best_row(rows: DataFrame, by: str, first: str, largest: bool = True) -> DataFrame:
    """The one row with the largest (smallest) ``by``; of equals the first by ``first``; rows without ``by`` are out."""
    return rows.where(F.col(by).isNotNull()).orderBy(F.desc(by) if largest else F.asc(by), first).limit(1)


def paired_predictions(a: DataFrame, b: DataFrame, key: str, probs: str = "probs") -> DataFrame:
    """``key``, a, b: the classes two models give to the same windows, whatever the order of their rows."""
    return a.select(key, argmax(F.col(probs)).alias("a")).join(b.select(key, argmax(F.col(probs)).alias("b")), key)


def per_class_recall(rows: DataFrame, truth: str, a: str, b: str) -> DataFrame:
    """(label, n, float_recall, int8_recall, delta) of the labels that occur."""
    hit = lambda c: F.avg((F.col(c) == F.col(truth)).cast("double"))
    own = rows.where(F.col(truth) >= 0).groupBy(F.col(truth).alias("label"))
    return own.agg(F.count("*").alias("n"), hit(a).alias("float_recall"), hit(b).alias("int8_recall"), (hit(b) - hit(a)).alias("delta"))


def auroc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """Mann-Whitney with ties as halves. Distinct scores are counted first; running sums go by range partition."""
    by_score = rows.groupBy(score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("n"))
    running = _running(by_score, score, ["n"])
    won = F.sum(F.col("p") * (F.col("n_before") + F.col("n") * 0.5))
    return running.agg((won / (F.sum("p") * F.sum("n"))).alias("auroc"))


#: Terms of a tie's sum that are added one by one; the rest has a closed form.
TERMS = 32


def _tie(hits: Column, rows: Column, more: Column) -> Column:
    """Sum of (hits + j) / (rows + j) for j = 1 .. more: a tie's share of average precision, in constant memory.

    Past the first terms the sum is more - (rows - hits) * (H(rows + more) - H(rows)); the harmonic numbers
    are taken by their asymptotic series, whose error there is below 1e-14.
    """
    few = F.least(more, F.lit(TERMS).cast("long"))
    head = F.aggregate(F.sequence(F.lit(1).cast("long"), few), F.lit(0.0), lambda acc, j: acc + (hits + j) / (rows + j))
    rest = (more - TERMS).cast("double")
    low = (rows + TERMS).cast("double")
    high = low + rest
    series = lambda m: 1 / (2 * m) - 1 / (12 * m * m) + 1 / (120 * F.pow(m, F.lit(4))) - 1 / (252 * F.pow(m, F.lit(6)))
    tail = rest - (rows - hits) * (F.log1p(rest / low) + series(high) - series(low))
    return F.when(more > TERMS, head + tail).when(more > 0, head).otherwise(0.0)


def auprc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """Average precision; within equal scores negatives rank first."""
    flipped = rows.select((-F.col(score)).alias("s"), F.col(positive).cast("long").alias("p"))
    by_score = flipped.groupBy("s").agg(F.sum("p").alias("p"), F.sum(1 - F.col("p")).alias("n"))
    run = _running(by_score, "s", ["p", "n"])
    total = _tie(F.col("p_before"), F.col("p_before") + F.col("n_before") + F.col("n"), F.col("p"))
    return run.agg((F.sum(total) / F.sum("p")).alias("auprc"))


def argmax(values: Column) -> Column:
    """Index of the first largest entry."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def class_weights(rows: DataFrame, label: str, n_classes: int, legacy: bool = False) -> DataFrame:
    """(label, weight): inverse frequency over present classes, mean 1 unless ``legacy``; absent classes weigh 0."""
    seen = rows.where(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("n"))
    totals = seen.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    w = seen.crossJoin(F.broadcast(totals)).withColumn("w", F.col("total") / (F.col("k") * F.col("n")))
    if not legacy:
        w = w.crossJoin(F.broadcast(w.agg(F.avg("w").alias("mean_w")))).withColumn("w", F.col("w") / F.col("mean_w"))
    dim = rows.sparkSession.range(n_classes).select(F.col("id").cast("int").alias(label))
    return dim.join(F.broadcast(w.select(label, "w")), label, "left").select(label, F.coalesce("w", F.lit(0.0)).alias("weight"))


def per_class(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """(label, support, precision, recall, f1) over the union of true and predicted labels."""
    pairs = rows.groupBy(truth, pred).agg(F.count("*").alias("n"))
    both = pairs.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col(pred).alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    s = both.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("hit").alias("hit"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return s.select("label", "support", safe(F.col("hit"), F.col("predicted")).alias("precision"), safe(F.col("hit"), F.col("support")).alias("recall"), safe(2 * F.col("hit"), F.col("support") + F.col("predicted")).alias("f1"))


def macro_f1(rows: DataFrame, truth: str, pred: str, present_only: bool = False) -> DataFrame:
    """Mean F1 over the union of labels, or over labels with true rows."""
    table = per_class(rows.where(F.col(truth) >= 0), truth, pred)
    table = table.where("support > 0") if present_only else table
    return table.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def confusion(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """(truth, pred, n, share of the truth's rows)."""
    n = rows.groupBy(truth, pred).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))


def agreement(rows: DataFrame, truth: str, a: str, b: str) -> DataFrame:
    """Accuracies of two predictions on labelled rows, their difference, and how often they agree."""
    hit = lambda c: F.avg((F.col(c) == F.col(truth)).cast("double"))
    return rows.where(F.col(truth) >= 0).agg(hit(a).alias("float_accuracy"), hit(b).alias("int8_accuracy"), (hit(b) - hit(a)).alias("delta"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"))


def masked_ce(rows: DataFrame, probs: str, label: str, weights: dict[int, float] | None = None) -> DataFrame:
    """Weighted cross-entropy over rows with a label."""
    w = F.lit(1.0) if not weights else reduce(lambda acc, kv: acc.when(F.col(label) == kv[0], kv[1]), weights.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    own = rows.where(F.col(label) >= 0)
    loss = -F.log(F.greatest(F.element_at(probs, F.col(label) + 1), F.lit(1e-7)))
    return own.agg((F.sum(w * loss) / F.greatest(F.sum(w), F.lit(1e-6))).alias("loss"))


def masked_bce(rows: DataFrame, prob: str, label: str, positive_weight: float) -> DataFrame:
    own = rows.where(F.col(label) >= 0)
    w = 1 + (positive_weight - 1) * F.col(label)
    p = F.least(F.greatest(F.col(prob), F.lit(1e-7)), F.lit(1 - 1e-7))
    loss = -(F.col(label) * F.log(p) + (1 - F.col(label)) * F.log(1 - p))
    return own.agg((F.sum(w * loss) / F.greatest(F.sum(w), F.lit(1e-6))).alias("loss"))
