"""Operators that take groups of any size: brute force on small inputs, plans, and sizes that no array could hold."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.operators import metrics, quant, ranges, scoring, splits, training, windows
from strideframe.plans import catalogue
from strideframe.sources import corpora, splits_sink

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("per", [5, 1 << 20])
def test_index_with_ties_and_nulls(spark, per):
    r = np.random.default_rng(per)
    rows = [(int(u) if u else None, float(t), int(n), i) for i, (u, t, n) in enumerate(zip(r.integers(0, 4, 600), r.choice([1.0, 2.0, 2.0, 2.0, 3.5, np.nan], 600), r.integers(0, 9, 600), strict=True))]
    rows += [(1, None, 5, 1000), (1, None, None, 1001)]
    got = windows.indexed(spark.createDataFrame(rows, "u long, t double, n long, id long").repartition(5), "u", "t", "n", "id", per=per).collect()
    assert len(got) == len(rows)
    key = lambda x: (x["t"] is not None, (np.isnan(x["t"]), x["t"]) if x["t"] is not None else (False, 0), x["n"] is not None, x["n"] or 0, x["id"])
    for u in (1, 2, 3):
        own = sorted((x for x in got if x["u"] == u), key=key)
        assert [x["i"] for x in own] == list(range(len(own)))
    assert all(x["i"] is None for x in got if x["u"] is None)


def test_ranges_cut_what_repeats_by_the_next_column(spark):
    rows = spark.range(1000).select(F.lit(7).cast("long").alias("a"), F.lit(None).cast("date").alias("n"), F.col("id").alias("b"), F.lit("s").alias("c"))
    sizes = rows.groupBy(ranges.place(rows, "a", "b").alias("r")).count().collect()
    assert len(sizes) >= ranges.LEAST and max(x["count"] for x in sizes) <= 200
    for order in (("c",), ("n", "b"), ("c", "b")):
        assert rows.select(ranges.place(rows, *order)).distinct().count() == 1  # texts and nulls are not cut
    none = rows.where("false")
    assert none.select(ranges.place(none, "a")).count() == 0


def test_no_window_over_a_whole_trial(spark):
    for name in ("sensor_index", "window_span_pairs", "label_by_event_spans", "sliding_window_features"):
        text = plan(catalogue.queries()[name](spark, DIR))
        assert "_range" in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        assert not any("windowspecdefinition(user_id" in x and "_range" not in x.split("windowspecdefinition")[1].split("ASC")[0] for x in text.splitlines() if "windowspecdefinition" in x), name


@pytest.mark.parametrize("cell", [1, 3, 8, 100])
def test_interval_pairs(spark, cell):
    r = np.random.default_rng(cell)
    w = [(int(t), int(k), int(s), int(s + n)) for k, (t, s, n) in enumerate(zip(r.integers(0, 3, 60), r.integers(-20, 50, 60), r.integers(0, 12, 60), strict=True))]
    v = [(int(t), int(n), int(s), int(s + d)) for n, (t, s, d) in enumerate(zip(r.integers(0, 3, 40), r.integers(-20, 50, 40), r.choice([0, 1, 5, 40], 40), strict=True))]
    a = spark.createDataFrame([*w, (0, 99, None, 5), (None, 98, 0, 5)], "t long, k long, start long, end long")
    b = spark.createDataFrame([*v, (0, 99, 3, None), (None, 98, 0, 5)], "t long, n long, ev_start long, ev_end long")
    got = sorted((x["k"], x["n"]) for x in windows.interval_pairs(a, b, "t", cell).collect())
    assert got == sorted((k, n) for t, k, s, e in w for u, n, p, q in v if t == u and max(s, p) < min(e, q))
    assert windows.interval_pairs(a, b.where("false"), "t", cell).count() == 0
    with pytest.raises(ValueError):
        windows.interval_pairs(a, b, "t", 0)
    with pytest.raises(ValueError):
        windows.interval_pairs(a, b.withColumnRenamed("n", "k"), "t", cell)


def test_labels_by_several_spans(spark):
    w = spark.createDataFrame([(1, k, 8 * k, 8 * k + 16) for k in range(6)] + [(2, 0, 0, 16)], "t long, k long, start long, end long")
    v = spark.createDataFrame([(1, 2, 6), (1, 14, 18), (1, 40, 80), (3, 0, 9), (1, 5, 5)], "t long, ev_start long, ev_end long")
    got = {(x["t"], x["k"]): (x["n_spans"], x["fraction"], x["label"]) for x in windows.label_by_spans(w, v, "t", cell=7).collect()}
    assert got == {(1, 0): (2, 1.0, 1), (1, 1): (1, 1.0, 1), (1, 2): (1, 0.5, -1), (1, 3): (0, 0.0, 0), (1, 4): (1, 0.2, -1), (1, 5): (1, 0.4, -1), (2, 0): (0, 0.0, 0)}
    with pytest.raises(Exception, match="event ends before it starts"):
        windows.label_by_spans(w, spark.createDataFrame([(1, 9, 2)], "t long, ev_start long, ev_end long"), "t").count()


def test_average_precision_of_ties(spark):
    r = np.random.default_rng(2)
    for shape in ((200, 3), (500, 1), (90, 90)):
        s, p = r.integers(0, shape[1], shape[0]), r.random(shape[0]) < 0.4
        order = np.lexsort((p, -s))
        hits = np.cumsum(p[order])
        want = np.mean((hits / np.arange(1, len(s) + 1))[p[order]])
        got = metrics.auprc(spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, p, strict=True)], "s double, p boolean"), "s", "p").first()[0]
        assert got == pytest.approx(want, rel=1e-12)
    tie = lambda a, c, n: spark.range(1).select(metrics._tie(F.lit(a).cast("long"), F.lit(c).cast("long"), F.lit(n).cast("long"))).first()[0]
    for a, c, n in ((0, 0, 1000), (5, 90, 40), (0, 3_000_000, 200_000), (10, 10**9, 33)):
        j = np.arange(1, n + 1, dtype=np.float64)
        assert tie(a, c, n) == pytest.approx(np.sum((a + j) / (c + j)), rel=1e-11)
    assert 0 < tie(0, 10**9, 10**9) < 10**9 and tie(3, 4, 0) == 0


def test_moments_merge_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(scoring, "FAN_IN", 3)
    x = np.random.default_rng(0).normal(size=(500, 4)) + 1e6
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "e array<double>").repartition(20)
    got = scoring.moments(rows, "e").collect()
    assert len(got) == 1 and got[0]["n"] == 500 and np.allclose(got[0]["mean"], x.mean(0))
    assert np.allclose(np.array(got[0]["m2"]).reshape(4, 4) / 499, np.cov(x.T), atol=1e-6)
    assert scoring.moments(rows.where("false"), "e").count() == 0 and scoring.covariance_pairs(rows.where("false"), "e").count() == 0
    with pytest.raises(ValueError):
        scoring.Mahalanobis.fit(rows.where("false"), "e")
    tracker, before = spark.sparkContext.statusTracker(), set(spark.sparkContext.statusTracker().getJobIdsForGroup())
    spark.sparkContext.setJobGroup("moments", "one")
    scoring.moments(rows, "e").collect()
    jobs = tracker.getJobIdsForGroup("moments")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert before is not None and len(jobs) <= 4  # a job a shuffle under adaptive execution, none a partition


def test_counts_in_one_aggregation(spark):
    rows = spark.createDataFrame([("a", 1, "p"), ("a", None, "q"), ("b", 1, "p"), (None, 2, "r")], "dataset string, y int, subject string")
    got = {(x["what"], x["value"]): (x["n"], x["subjects"]) for x in corpora.counts(rows, "dataset", "y").collect()}
    assert got == {("all", None): (4, 3), ("dataset", "a"): (2, 2), ("dataset", "b"): (1, 1), ("dataset", None): (1, 1), ("y", "1"): (2, 1), ("y", "2"): (1, 1), ("y", None): (1, 1)}


def test_split_sink_is_idempotent(spark, tmp_path):
    rows = spark.range(60).select("id", (F.col("id") * 2.0).alias("v"), (F.col("id") % 3).alias("y"), F.when(F.col("id") < 40, "train").when(F.col("id") < 50, "val").otherwise("test").alias("split"))
    home = str(tmp_path / "out")
    for again in (rows, rows, rows.where("split = 'test'")):
        splits_sink.write_split(again, home, ["v"], "y")
        assert splits_sink.read_split(spark, home).count() == 60
    mean, std = splits_sink.read_statistics(spark, home)["v"]
    assert mean == 39.0 and std == pytest.approx(np.arange(40).std() * 2 + 1e-6)
    assert {p.name for p in (tmp_path / "out/rows").glob("split=*")} == {"split=train", "split=val", "split=test"}
    assert "PartitionFilters: [isnotnull(split" in plan(splits_sink.read_split(spark, home, "val"))


def test_folds_share_no_person(spark):
    rows = spark.range(300).select((F.col("id") % 40).alias("who"), ((F.col("id") % 7) * 1.0).alias("x"), F.when(F.col("id") % 7 > 3, 1).otherwise(0).alias("y"))
    folded = training.subject_folds(rows, "who", 3)
    assert folded.groupBy("who").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    got = training.cross_validate(rows.unionByName(spark.createDataFrame([(None, 1.0, 1), (5, None, 0)], "who long, x double, y int")), ["x"], "y", "who", 2).collect()
    assert [r["fold"] for r in got] == [0, 1, 2] and sum(r["people"] for r in got) == 40 and all(r["macro_f1"] > 0.95 for r in got)
    assert all(r["n_train"] + r["n_val"] + r["n_test"] == 300 for r in got)
    with pytest.raises(ValueError):
        training.cross_validate(rows, ["x"], "y", "who", 2, folds=2)


def test_sweep_tells_lost_output_resolution(spark):
    """Two classes whose scores differ by less than a step of int8: floating-point outputs bring them back."""
    rows = spark.createDataFrame([(i, i % 2, [100.0, 1.0 if i % 2 else -1.0]) for i in range(200)], "id long, y int, x array<double>")
    model = spark.createDataFrame([([[1.0, -0.01], [1.0, 0.01]], [0.0, 0.0])], "weights array<array<double>>, bias array<double>")
    found = quant.sweep(rows, rows, model, "id", "y", "x", [10, 50], 2)
    whole = {(r["rep_size"], r["output"]): r for r in found.where("label IS NULL").collect()}
    assert whole[10, "int8"]["accuracy"] == 0.5 and whole[10, "int8"]["float_accuracy"] == 1.0 and whole[50, "float"]["n"] == 200
    assert found.where("label IS NOT NULL").count() == 8
    verdict = quant.sweep_verdict(found).first()
    assert verdict["best_size"] == 10 and verdict["sweep_gain"] == 0 and verdict["verdict"] in ("output resolution", "weights")
    assert splits.ticket(1, F.lit(2)) is not None


def test_equal_windows_have_the_same_energy_in_any_order_of_rows(spark):
    x = [0.1, 0.2, 0.3, 0.7, 1e9, 0.6, 0.4, 29.27]
    rows = [(u, i, v) for u in range(40) for i, v in enumerate(x)]
    mixed = [rows[i] for i in np.random.default_rng(0).permutation(len(rows))]
    frame = spark.createDataFrame([*mixed, (99, 0, None)], "u long, i long, v double").repartition(7)
    got = windows.sliding_windows(frame, "u", 8, 8, windows.mean_in_order(F.col("v")).alias("e")).collect()
    total = 0.0
    for v in x:
        total += v
    assert len(got) == 40 and {r["e"] for r in got} == {total / 8}
    none = windows.sliding_windows(frame.where("u = 99"), "u", 1, 1, windows.mean_in_order(F.col("v")).alias("e")).first()
    assert none["e"] is None


def test_copies_of_a_window_have_one_energy_and_alarms_equal_sql(spark, tmp_path):
    import duckdb

    r = np.random.default_rng(3)
    rows = [(u * 16 + i, u, i, float(v)) for u, v_ in enumerate(np.tile(np.round(r.exponential(50, (30, 16)), 2), (20, 1))) for i, v in enumerate(v_)]
    mixed = [rows[i] for i in r.permutation(len(rows))]
    frame = spark.createDataFrame(mixed, "event_id long, user_id long, t long, value double")
    frame.select("event_id", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), "value", F.lit('{"k": 1}').alias("props")).repartition(7).write.parquet(str(tmp_path / "events.parquet"))
    energies = {r["energy"] for r in catalogue._energies(spark, str(tmp_path)).collect()}
    got = {tuple(x) for x in catalogue.queries()["alarm_windows"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert len(energies) == 30 and got == set(con.sql(catalogue.oracle_sql()["alarm_windows"]).fetchall())
