"""Diagnostics of int8 quantisation: ranges, deltas, and the verdicts drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.arrays import dequantised
from .metrics import argmax, percentiles
from .splits import ticket


def activation_ranges(values: DataFrame, layer: str, value: str) -> DataFrame:
    """Percentiles of |v| a layer, and how many of 127 levels the 99th percentile gets."""
    sizes = values.select(layer, F.abs(value).alias("size"))
    p = percentiles(sizes, "size", [0.5, 0.99, 0.999], layer).join(sizes.groupBy(layer).agg(F.max("size").alias("max")), layer)
    out = p.select(layer, F.col("p")[0].alias("p50"), F.col("p")[1].alias("p99"), F.col("p")[2].alias("p999"), "max")
    return out.withColumns({"ratio": F.col("max") / F.col("p999"), "levels": 127 * F.col("p99") / F.col("max"), "flagged": 127 * F.col("p99") / F.col("max") < 32})


def weight_ranges(weights: DataFrame, layer: str, channel: str, value: str) -> DataFrame:
    """Spread of channel maxima, and the fewest levels a channel's 99th percentile gets."""
    sizes = weights.select(layer, channel, F.abs(value).alias("size"))
    top = sizes.groupBy(layer, channel).agg(F.greatest(F.max("size"), F.lit(1e-12)).alias("top"))
    per = percentiles(sizes, "size", [0.99], layer, channel).join(top, [layer, channel]).withColumn("p99", F.col("p")[0])
    return per.groupBy(layer).agg((F.max("top") / F.min("top")).alias("spread"), F.min(127 * F.col("p99") / F.col("top")).alias("in_channel"))


def diagnose(rows: DataFrame) -> DataFrame:
    """Verdict from columns float_out_delta, sweep_gain, float_out_gain (accuracies of variants against the base)."""
    verdict = (
        F.when(F.col("float_out_delta") > -0.02, "output resolution")
        .when(F.col("sweep_gain") > 0.02, "calibration")
        .when(F.col("float_out_gain") > 0.02, "mostly output")
        .otherwise("weights")
    )
    return rows.withColumn("verdict", verdict)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _top(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x: F.abs(x)))


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """One row: weights, an array of each class's mean vector in the order of labels from 0, and bias: scores are products plus bias.

    Classes without rows get no weights, so labels have to be 0 .. classes - 1. Classes times components numbers.
    """
    long = rows.select(label, F.posexplode(vector).alias("d", "v")).groupBy(label, "d").agg(F.avg("v").alias("m"))
    each = long.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda x: x["m"]).alias("w"))
    whole = each.agg(F.transform(F.array_sort(F.collect_list(F.struct(label, "w"))), lambda x: x["w"]).alias("weights"))
    return whole.withColumn("bias", F.transform("weights", lambda w: _dot(w, w) / -2))


def _scores(x: Column, weights: Column, bias: Column) -> Column:
    return F.zip_with(F.transform(weights, lambda w: _dot(x, w)), bias, lambda s, b: F.round(s + b, 9))


def _levels(scores: str, step: Column) -> Column:
    return F.transform(scores, lambda v: dequantised(v, step))


def sweep(rows: DataFrame, train: DataFrame, model: DataFrame, key: str, label: str, vector: str, sizes: list[int], n_classes: int, seed: int = 42) -> DataFrame:
    """(rep_size, output, label, n, accuracy, float_accuracy, delta, agreement) of every int8 variant of a linear model, and by class.

    ``model`` is one row of ``weights`` and ``bias``. A variant quantises inputs by the range that ``rep_size`` rows of ``train``
    show (stratified by class, in the order of their tickets), weights by each class's own, and scores by the range of
    those same rows, or leaves scores in floating point (``output`` 'float'). A row is expanded to all variants, and one
    aggregation over grouping sets counts each variant as a whole (label null) and by class.
    """
    order = Window.partitionBy(label).orderBy(ticket(seed, F.col(key)), key)
    most = max(1, max(sizes) // n_classes)
    rep = train.where(F.col(label) >= 0).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    within = lambda n, v: F.max(F.when(F.col("_r") <= max(1, n // n_classes), v))
    coarse = model.select("weights", "bias", F.transform("weights", lambda w: F.transform(w, lambda v: dequantised(v, _top(w) / 127))).alias("small"))  # one row
    steps = rep.agg(F.array(*[within(n, _top(F.col(vector))) / 127 for n in sizes]).alias("steps"))  # one row
    known = coarse.crossJoin(F.broadcast(steps))
    lessened = lambda step: _scores(F.transform(vector, lambda v: dequantised(v, step)), F.col("small"), F.col("bias"))
    outs = rep.crossJoin(F.broadcast(known)).agg(F.array(*[within(n, _top(lessened(F.col("steps")[i]))) / 127 for i, n in enumerate(sizes)]).alias("outs"))
    full = rows.where(F.col(label) >= 0).crossJoin(F.broadcast(known.crossJoin(F.broadcast(outs))))
    made = full.withColumn("float_pred", argmax(_scores(F.col(vector), F.col("weights"), F.col("bias"))))
    for i in range(len(sizes)):
        made = made.withColumn(f"_s{i}", lessened(F.col("steps")[i]))
    cells = [F.struct(F.lit(n).alias("rep_size"), F.lit(output).alias("output"), argmax(_levels(f"_s{i}", F.col("outs")[i]) if output == "int8" else F.col(f"_s{i}")).alias("pred")) for i, n in enumerate(sizes) for output in ("int8", "float")]
    each = made.select(F.col(label).alias("label"), "float_pred", F.explode(F.array(*cells)).alias("v")).select("label", "float_pred", "v.*")
    hit = lambda a, b: F.avg((F.col(a) == F.col(b)).cast("double"))
    sets = [[F.col("rep_size"), F.col("output")], [F.col("rep_size"), F.col("output"), F.col("label")]]
    each = each.withColumns({"right": (F.col("pred") == F.col("label")).cast("double"), "float_right": (F.col("float_pred") == F.col("label")).cast("double")})
    out = each.groupingSets(sets, "rep_size", "output", "label").agg(F.count("*").alias("n"), F.avg("right").alias("accuracy"), F.avg("float_right").alias("float_accuracy"), hit("pred", "float_pred").alias("agreement"))
    return out.select("rep_size", "output", "label", "n", "accuracy", "float_accuracy", (F.col("accuracy") - F.col("float_accuracy")).alias("delta"), "agreement")


def sweep_verdict(found: DataFrame) -> DataFrame:
    """One row: float_accuracy, best_size, best_accuracy, sweep_gain, float_out_delta, float_out_gain, verdict of a :func:`sweep`.

    Best is the int8 variant of highest accuracy, of equals the smallest; the gain of the sweep is its last size over its first.
    """
    whole = found.where("label IS NULL")
    small, acc = F.col("output") == "int8", F.col("accuracy")
    at = lambda f, which, what: f(F.when(which, what), F.when(which, F.col("rep_size")))
    one = whole.agg(
        F.first("float_accuracy").alias("float_accuracy"),
        F.max_by(F.when(small, F.struct("rep_size", "accuracy")), F.when(small, F.struct(acc, -F.col("rep_size")))).alias("best"),
        (at(F.max_by, small, acc) - at(F.min_by, small, acc)).alias("sweep_gain"),
        at(F.max_by, ~small, acc).alias("float_out"),
    )
    gains = one.select("float_accuracy", F.col("best.rep_size").alias("best_size"), F.col("best.accuracy").alias("best_accuracy"), "sweep_gain", (F.col("float_out") - F.col("float_accuracy")).alias("float_out_delta"), (F.col("float_out") - F.col("best.accuracy")).alias("float_out_gain"))
    return diagnose(gains)


def attribute(rows: DataFrame, least: float = 0.02) -> DataFrame:
    """weight_cost and activation_cost from accuracies float_acc, dynamic_acc, int8_acc, and where the loss lies.

    A side is to blame if it costs over ``least`` and over twice the other; else a sum of at most ``least`` is no loss.
    """
    out = rows.withColumns({"weight_cost": F.col("float_acc") - F.col("dynamic_acc"), "activation_cost": F.col("dynamic_acc") - F.col("int8_acc")})
    w, a = F.col("weight_cost"), F.col("activation_cost")
    blamed = lambda x, y: (x > 2 * F.greatest(y, F.lit(1e-6))) & (x > least)
    return out.withColumn("verdict", F.when(blamed(a, w), "activations").when(blamed(w, a), "weights").when(w + a <= least, "neither").otherwise("both"))


def arena_estimate(tensors: DataFrame, size: Column) -> DataFrame:
    """Largest tensor and sum of all, in bytes."""
    return tensors.agg(F.max(size).alias("largest"), F.sum(size).alias("total"))


def op_check(ops: DataFrame, known: DataFrame, op: str = "op") -> DataFrame:
    """(op, status): distinct device ops, mapped ones accelerated or slow, others unmapped. ``known`` has op, accelerated."""
    dim = F.broadcast(known)  # an operator table of a few dozen rows
    status = F.when(F.col("accelerated").isNull(), "unmapped").when(F.col("accelerated"), "accelerated").otherwise("slow")
    return ops.where(F.col(op) != "DELEGATE").select(op).distinct().join(dim, op, "left").select(op, status.alias("status"))
