"""Training on window features: weighted classifiers over folds that share no person, chosen by macro-F1."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics
from .splits import ticket


def subject_folds(rows: DataFrame, subject: str, folds: int, seed: int = 42) -> DataFrame:
    """``rows`` with fold, 0 .. folds - 1, by a hash of the person: all rows of one are in one fold."""
    return rows.withColumn("fold", F.pmod(F.conv(F.substring(ticket(seed, F.col(subject)), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int"))


def weighted(rows: DataFrame, label: str, n_classes: int) -> DataFrame:
    """``rows`` with weight, the inverse frequency of their class (mean 1 over classes)."""
    known = metrics.class_weights(rows, label, n_classes).collect()  # a row a class
    return rows.withColumn("weight", F.create_map(*[F.lit(x) for r in known for x in (r[label], r["weight"])])[F.col(label)])


def pipeline(features: list[str], label: str, regularisation: float, iterations: int) -> Pipeline:
    """Features scaled by the training rows alone, then a multinomial model with weighted rows."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"),
            StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
            LogisticRegression(featuresCol="_scaled", labelCol=label, predictionCol="pred", weightCol="weight", regParam=regularisation, maxIter=iterations, family="multinomial"),
        ]
    )


def cross_validate(rows: DataFrame, features: list[str], label: str, subject: str, n_classes: int, folds: int = 3, grid: tuple[float, ...] = (0.0, 0.1), iterations: int = 10, seed: int = 42) -> DataFrame:
    """(fold, regularisation, n_train, n_val, n_test, people, accuracy, macro_f1) on held-out people, a row a fold.

    Fold f is the test, the next one validates: the parameter of ``grid`` with the best macro-F1 there (of
    equals the first) is fitted again on all rows but the test. A fold without rows in one of its parts is left out.
    """
    if folds < 3:
        raise ValueError("need folds to train, to validate and to test")
    full = rows.dropna(subset=[*features, label, subject])
    own = full.select(*features, F.col(label).cast("int").alias(label), subject)
    kept = subject_folds(own, subject, folds, seed).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {r["fold"]: (r["n"], r["people"]) for r in kept.groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct(subject).alias("people")).collect()}
    out = []
    for test in range(folds):
        val = (test + 1) % folds
        n_train = sum(n for f, (n, _) in sizes.items() if f not in (test, val))
        if test not in sizes or val not in sizes or not n_train:
            continue
        train = weighted(kept.where(~F.col("fold").isin(test, val)), label, n_classes)
        held = kept.where(F.col("fold") == val)
        scores = [metrics.macro_f1(pipeline(features, label, g, iterations).fit(train).transform(held), label, "pred", present_only=True).first()[0] for g in grid]
        best = grid[scores.index(max(scores))]
        model = pipeline(features, label, best, iterations).fit(weighted(kept.where(F.col("fold") != test), label, n_classes))
        done = model.transform(kept.where(F.col("fold") == test))
        table = metrics.per_class(done.withColumn("pred", F.col("pred").cast("int")), label, "pred").where("support > 0")
        macro, accuracy = table.agg(F.avg("f1"), F.sum(F.col("recall") * F.col("support")) / F.sum("support")).first()
        out.append((test, best, n_train, sizes[val][0], *sizes[test], accuracy, macro))
    kept.unpersist()
    return rows.sparkSession.createDataFrame(out, "fold int, regularisation double, n_train long, n_val long, n_test long, people long, accuracy double, macro_f1 double")

