"""Windows over late and shuffled streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.operators.windows import indexed, sliding_windows
from strideframe.streaming import ordered

SCHEMA = "user long, ts timestamp, id long, value double"


def _run(spark, tmp_path, batches, delay="60 seconds", idle="1 day"):
    """Feeds one file a micro-batch; the rows that come out, and the query."""
    ordered.with_state_store(spark)
    src, out = tmp_path / "in", tmp_path / "out"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(u, t, n, v) for u, t, n, v in rows], "user long, t long, id long, value double").select("user", F.timestamp_seconds("t").alias("ts"), "id", "value").coalesce(1).write.mode("append").parquet(str(src / f"b{i:03d}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    found = ordered.ordered_windows(stream, "user", "ts", ["id"], "value", 8, 4, delay, idle)
    q = found.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return {(r["user"], r["k"]): (round(r["mean"], 9), round(r["energy"], 9), r["late"]) for r in spark.read.schema("user long, k long, mean double, energy double, late long").parquet(str(out)).collect()}, q


def _want(spark, rows):
    table = spark.createDataFrame(rows, "user long, t long, id long, value double")
    w = sliding_windows(indexed(table, "user", "t", "id"), "user", 8, 4, F.avg("value").alias("mean"), F.avg(F.abs("value")).alias("energy"))
    return {(r["user"], r["k"]): (round(r["mean"], 9), round(r["energy"], 9)) for r in w.collect()}


def test_shuffled_over_batches_equals_batch(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(int(u), int(t), int(n), float(v)) for n, (u, t, v) in enumerate(zip(r.integers(0, 4, 400), np.sort(r.integers(0, 900, 400)), r.normal(size=400), strict=True))]
    arrival = np.array([t + r.uniform(0, 55) for _, t, _, _ in rows])
    order = np.argsort(arrival)
    batches = [[rows[i] for i in part] for part in np.array_split(order, 5)] + [[(None, 10_000, 0, 0.0)]]
    got, q = _run(spark, tmp_path, batches)
    assert {k: v[:2] for k, v in got.items()} == _want(spark, rows) and ordered.late_rows(q) == 0


def test_late_rows_are_dropped_and_counted_and_state_expires(spark, tmp_path):
    own = [(1, 1000 + 10 * i, i, float(i)) for i in range(20)]
    batches = [own[:10], [(2, 1400, 0, 1.0)], [(2, 1401, 1, 1.0)], [*own[10:], (1, 1005, 99, 50.0)], [(None, 9000, 0, 0.0)], [(1, 9500, 100, 1.0)], [(None, 20_000, 0, 0.0)]]
    got, q = _run(spark, tmp_path, batches, idle="20 minutes")
    # The second batch moves the watermark to 1340, which the third acts on: what the fourth brings for user 1 is too late.
    assert {k: v[:2] for k, v in got.items()} == _want(spark, own[:10])
    assert ordered.late_rows(q) == 11
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_arguments(spark):
    with pytest.raises(ValueError):
        ordered.ordered_windows(spark.range(1), "id", "id", [], "id", 0, 1, "1 second")


def test_many_trials_share_the_state_of_few_lanes(spark, tmp_path, monkeypatch):
    whole = ordered.ordered_windows
    monkeypatch.setattr(ordered, "ordered_windows", lambda *a: whole(*a, lanes=4))
    r = np.random.default_rng(2)
    rows = [(u, 1000 + 10 * i + int(r.integers(0, 9)), 100 * u + i, float(r.normal())) for u in range(60) for i in range(12)]
    order = np.argsort([t + r.uniform(0, 55) for _, t, _, _ in rows])
    batches = [[rows[i] for i in part] for part in np.array_split(order, 3)] + [[(None, 10_000, 0, 0.0)]]
    got, q = _run(spark, tmp_path, batches)
    assert {k: v[:2] for k, v in got.items()} == _want(spark, rows) and len(got) == 120
    assert max(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]) <= 4 * 40  # before: a row a sample and trial
