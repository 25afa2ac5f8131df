import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.functions import arrays
from strideframe.operators import augment, metrics, quant, scoring, signal, splits, windows
from strideframe.sources import archives, config, corpora, firmware, motion, reports


@pytest.mark.parametrize("n, win, stride, m", [(128, 128, 64, 1), (192, 128, 64, 2), (256, 128, 64, 3), (127, 128, 64, 0), (0, 128, 64, 0), (100, 10, 10, 10)])
def test_window_counts(spark, n, win, stride, m):
    assert spark.range(1).select(windows.n_windows(F.lit(n), win, stride)).first()[0] == m


def test_window_arguments():
    with pytest.raises(ValueError):
        windows.n_windows(F.lit(1), 0, 1)
    with pytest.raises(ValueError):
        windows.overlap_fraction(*[F.lit(0)] * 4, relative_to="x")
    with pytest.raises(ValueError):
        windows.label_by_overlap(F.lit(0), 0.1, 0.2)


@pytest.mark.parametrize("a, b, kind, want", [(0, 100, "window", 1), (200, 300, "window", 0), (50, 150, "window", 0.5), (40, 60, "event", 1), (100, 200, "window", 0), (50, 50, "event", 0)])
def test_overlap(spark, a, b, kind, want):
    assert spark.range(1).select(windows.overlap_fraction(F.lit(0), F.lit(100), F.lit(a), F.lit(b), kind)).first()[0] == want


def test_label_ties_are_negative(spark):
    assert spark.range(1).select(windows.label_by_overlap(F.lit(0.0), 0.0, 0.0)).first()[0] == 0


def test_low_pass_and_gravity():
    t = np.arange(2000) / 200
    keep = signal.low_pass(np.sin(2 * np.pi * 1 * t), 20, 200)
    assert abs(keep - np.sin(2 * np.pi * t)).max() < 0.05
    assert abs(signal.low_pass(np.full(300, 3.0), 0.3, 50) - 3).max() < 0.01
    gone = signal.low_pass(np.sin(2 * np.pi * 60 * t), 20, 200)
    assert (gone[200:-200] ** 2).mean() < 0.01


def test_filters_by_chunk_equal_whole_trials(spark):
    rng = np.random.default_rng(5)
    trials = {1: rng.normal(size=5000).cumsum() / 10, 2: rng.normal(size=7), 3: rng.normal(size=2), 4: rng.normal(size=1000)}
    rows = spark.createDataFrame([(t, i, float(v)) for t, x in trials.items() for i, v in enumerate(x)], "t int, i long, v double")

    def same(df, col, want):
        got = df.toPandas().sort_values(["t", "i"])
        for t in trials:
            mine = got[got["t"] == t]
            assert mine["i"].tolist() == list(range(len(want[t])))
            assert np.abs(mine[col].to_numpy() - want[t]).max() < 1e-9

    def plain(x, sections):  # one sample after the other, as the definition has it
        for b0, b1, b2, _, a1, a2 in sections:
            z1, z2, y = x[0] * (1 - b0), x[0] * (b2 - a2), []
            for v in x:
                y.append(b0 * v + z1)
                z1, z2 = b1 * v - a1 * y[-1] + z2, b2 * v - a2 * y[-1]
            x = np.array(y)
        return x

    def zero_phase(x, cutoff, fs):
        pad, sections = min(21, len(x) - 1), signal.butterworth_sections(cutoff, fs)
        wide = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]] if pad else x
        y = plain(plain(wide, sections)[::-1], sections)[::-1]
        return y[pad : len(y) - pad]

    smooth = {t: signal.median3_array(x) if len(x) > 3 else x for t, x in trials.items()}
    same(signal.denoise(rows, "t", "v", 50, chunk=100), "v", {t: zero_phase(x, 20, 50) for t, x in smooth.items()})
    same(signal.gravity_split(rows, "t", "v", 50, chunk=100), "gravity", {t: zero_phase(x, 0.3, 50) for t, x in trials.items()})
    for fs_in, fs_out in ((100, 50), (50, 75), (200, 60)):
        up, down = signal._ratio(fs_in, fs_out)
        half = 10 * max(up, down)
        at = np.arange(-half, half + 1)
        h = np.sinc(at / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
        h *= up / h.sum()
        want = {}
        for t, x in trials.items():  # zeros between samples, then an ordinary convolution
            wide = np.zeros(len(x) * up)
            wide[::up] = x
            want[t] = np.convolve(wide, h)[half : half + len(wide)][::down]
        same(signal.resample(rows, "t", "v", fs_in, fs_out, chunk=64), "v", want)


def test_resample_alias():
    t = np.arange(2000) / 200
    tone = signal.resample_array(np.sin(2 * np.pi * 5 * t), 200, 50)
    assert len(tone) == 500 and abs(tone[50:-50] - np.sin(2 * np.pi * 5 * np.arange(500) / 50)[50:-50]).max() < 0.05
    assert (signal.resample_array(np.sin(2 * np.pi * 60 * t), 200, 50)[50:-50] ** 2).mean() < 0.01
    assert (signal.resample_array(np.arange(5), 50, 50) == np.arange(5)).all()


def test_augmented_windows_keep_shape_and_magnitude(spark):
    r = np.random.default_rng(0)
    x = [(i, r.normal(size=(16, 6)).tolist()) for i in range(20)]
    w = spark.createDataFrame(x, "window_id long, X array<array<float>>")
    turned = augment.rotate_windows(w, ["window_id"], 180, 1)
    for (_, a), b in zip(x, turned.orderBy("window_id").collect(), strict=True):
        a, b = np.array(a), np.array(b["X"])
        assert np.allclose(np.linalg.norm(a[:, :3], axis=1), np.linalg.norm(b[:, :3], axis=1), atol=1e-4)
    full = augment.augmenter(180, 0.1, 0.15, 0.3, 0.02)(w, "window_id")
    assert full.where("size(X) = 16 AND forall(X, s -> size(s) = 6)").count() == 20
    dropped = augment.drop_channels(w, ["window_id"], 0.9, 3).collect()
    assert all(np.abs(np.array(r["X"])).sum() > 0 for r in dropped)
    two = augment.expand_augmented(w, 2, "window_id", 20, augment.augmenter(jitter_sigma=0.1))
    assert sorted(r["window_id"] for r in two.collect()) == list(range(60))


def test_splits(spark):
    rows = spark.createDataFrame([(f"s{i}",) for i in range(20) for _ in range(10)], "subject string")
    got = splits.subject_split(rows, "subject")
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 14, "val": 3, "test": 3}
    with pytest.raises(Exception, match="three subjects"):
        splits.subject_split(rows.where("subject IN ('s1', 's2')"), "subject").collect()


def test_mahalanobis(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 8)) + 1000
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<double>").repartition(5)
    m = scoring.Mahalanobis.fit(e, "e")
    p = np.linalg.inv(np.cov(x.T) + 1e-3 * np.eye(8))
    assert np.allclose(m.precision, p, rtol=1e-6) and np.allclose(m.cholesky @ m.cholesky.T, p, rtol=1e-6)
    d = x - x.mean(0)
    got = [r["distance"] for r in m.score(e, "e").orderBy("id").collect()]
    assert np.allclose(got, np.sqrt(np.einsum("ni,ij,nj->n", d, p, d)), rtol=1e-6)
    with pytest.raises(ValueError):
        scoring.Mahalanobis.fit(e.limit(4), "e")


def test_entropy(spark):
    one = lambda p: spark.createDataFrame([(p,)], "p array<double>").select(arrays.entropy(F.col("p"), 6)).first()[0]
    assert abs(one([1 / 6] * 6) - 1) < 1e-9 and one([1.0] + [0.0] * 5) < 1e-6
    assert abs(one([1.05 / 6] * 6) - 1) < 1e-9


def test_rates():
    assert metrics.windows_per_hour(1.28) == 2812.5
    assert metrics.far_per_hour(0.01, 1.28) == 28.125
    with pytest.raises(ValueError):
        metrics.windows_per_hour(0)


def test_auroc_ties(spark):
    rows = spark.createDataFrame([(s, p) for s in range(5) for p in (True, False)] + [(9, True)], "s int, p boolean")
    pos, neg = [0, 1, 2, 3, 4, 9], [0, 1, 2, 3, 4]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert abs(metrics.auroc(rows, "s", "p").first()[0] - want) < 1e-12


def test_verdicts(spark):
    rows = spark.createDataFrame([(0.9, 0.89, 0.7)], "float_acc double, dynamic_acc double, int8_acc double")
    assert quant.attribute(rows).first()["verdict"] == "activations"
    for costs, verdict in (((0.015, 0.015), "both"), ((0.005, 0.005), "neither"), ((0.1, 0.01), "weights"), ((0.05, 0.04), "both")):
        case = spark.createDataFrame([(0.9, 0.9 - costs[0], 0.9 - sum(costs))], "float_acc double, dynamic_acc double, int8_acc double")
        assert quant.attribute(case).first()["verdict"] == verdict


def test_percentiles_by_group(spark):
    r = np.random.default_rng(1)
    rows = [(g, float(v)) for g in (1, 2) for v in r.normal(size=500 + g).round(1)] + [(3, 7.0), (1, None)]
    got = {x["g"]: x["p"] for x in metrics.percentiles(spark.createDataFrame(rows, "g int, v double"), "v", [0, 0.25, 0.99, 1], "g").collect()}
    for g in (1, 2, 3):
        assert np.allclose(got[g], np.percentile([v for x, v in rows if x == g and v is not None], [0, 25, 99, 100]))


def test_score_report_and_partition(spark):
    rows = spark.createDataFrame([(float(i % 50), i % 7 == 0) for i in range(700)], "s double, p boolean")
    text = metrics.score_report(rows, "s", "p", 1.28).splitlines()
    assert text[0] == "score:" and "(100 events vs 600 normal)" in text[1] and len(text) == 6
    keys = spark.range(4).withColumnRenamed("id", "k")
    with pytest.raises(AssertionError, match="1 windows in no split, 1 in more than one"):
        splits.assert_partition(keys, spark.createDataFrame([(0,), (1,), (1,), (2,)], "k long"), "k")
    assert [x["k"] for x in splits.gather(keys, spark.createDataFrame([(0, 3), (1, 1), (2, 3), (3, 9)], "pos int, k long"), "k").orderBy("pos").collect()] == [3, 1, 3]


def _line_tree(root):
    r = np.random.default_rng(0)
    for split, labels, people in (("train", [1, 2, 3, 4, 5, 6], [1, 1, 2, 2, 3, 3]), ("test", [1, 4, 6, 5], [11, 11, 12, 12])):
        d = root / split / "Inertial Signals"
        d.mkdir(parents=True)
        for c, name in enumerate(corpora.LINE_SIGNALS):
            (d / f"{name}_{split}.txt").write_text("\n".join(" ".join(f"{v:.6f}" for v in c + r.normal(0, 1e-3, 128)) for _ in labels) + "\n")
        (root / split / f"y_{split}.txt").write_text("\n".join(map(str, labels)) + "\n")
        (root / split / f"subject_{split}.txt").write_text("\n".join(map(str, people)) + "\n")


def test_line_corpus(spark, tmp_path):
    _line_tree(tmp_path)
    w = corpora.validate(corpora.read_line_corpus(spark, str(tmp_path)), 128)
    rows = w.collect()
    assert len(rows) == 8 and "uci_01" in {r["subject"] for r in rows}
    assert np.allclose(np.array([r["X"] for r in rows]).mean((0, 1)), range(6), atol=0.01)
    (tmp_path / "test" / "y_test.txt").write_text("1\n4\n6\n")
    with pytest.raises(ValueError):
        corpora.read_line_corpus(spark, str(tmp_path))


def test_trial_corpus(spark, tmp_path):
    head = ["", "attitude.roll", "gravity.x", *corpora.TRIAL_COLUMNS]
    for act in ("wlk", "jog", "sit", "xyz"):
        (tmp_path / f"{act}_15").mkdir()
        for s in (1, 2):
            order = head if s == 1 else head[::-1]
            value = lambda c: "9" if c not in corpora.TRIAL_COLUMNS else str(corpora.TRIAL_COLUMNS.index(c))
            (tmp_path / f"{act}_15" / f"sub_{s}.csv").write_text("\n".join([",".join(order)] + [",".join(value(c) for c in order)] * 400) + "\n")
    (tmp_path / "wlk_15" / "sub_3.csv").write_text("a,b\n1,2\n")
    w = corpora.load_all(spark, {"ms": str(tmp_path)})
    rows = w.collect()
    assert len(rows) == 5 * 3 * 2 and {r["subject"] for r in rows} == {"ms_sub_1", "ms_sub_2"}
    assert np.allclose(np.array([r["X"] for r in rows]).mean((0, 1)), range(6))
    assert corpora.summary(w)["n"] == 30
    assert corpora.summary(w)["y_act"] == {0: 10, 3: 10, 5: 10} and corpora.summary(w.where("false"))["n"] == 0
    with pytest.raises(ValueError):
        corpora.load_all(spark, {"nope": "x"})
    with pytest.raises(ValueError):
        corpora.load_all(spark, {"ms": str(tmp_path)}, tags=["uci"])
    kept = archives.Corpus("corpus", "sub_1.csv", home=tmp_path.parent)
    (tmp_path.parent / "corpus").mkdir(exist_ok=True)
    (tmp_path / "wlk_15").rename(tmp_path.parent / "corpus" / "wlk_15")
    assert len(corpora.load_all(spark, {"ms": archives.Corpus("corpus", "wlk_15", home=tmp_path.parent)}).collect()) == 10 and kept.located()
    rows = motion.register(spark).read.format("motion").option("layout", "trials").load(f"{tmp_path}")
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 1600 and rows.where("acc_x <> 0 OR gyr_z <> 5").count() == 0
    with pytest.raises(Exception, match="no trials below"):
        motion.register(spark).read.format("motion").load(f"{tmp_path}/nothing").count()
    with pytest.raises(Exception, match="unknown layout"):
        motion.register(spark).read.format("motion").option("layout", "x").load(f"{tmp_path}").count()


def test_settings(tmp_path):
    s = config.Settings({"name": "x", "data": {"win": 64}})
    s["data.stride"] = 32
    s.save(tmp_path / "s.yaml")
    assert config.Settings.load(tmp_path / "s.yaml")["data.win"] == 64 and s.hop_seconds == 0.64
    for bad in ({"nope": 1}, {"data": {"nope": 1}}):
        with pytest.raises(KeyError):
            config.Settings(bad)
    with pytest.raises(ValueError):
        config.Settings({"split": {"protocol": "leave_dataset_out"}})


def test_reports(spark, tmp_path):
    reports.write_manifest(tmp_path, "run one", {}, {"acc": np.float64(0.5)}, stamp="20200101T000000Z")
    reports.write_manifest(tmp_path, "run two", {"deep": {"x": 3}}, {"acc": 0.75, "f1": 0.5, "note": "text"}, stamp="20200102T000000Z")
    (tmp_path / "20200103_bad.json").write_text("{nope")
    got = reports.read_manifests(spark, tmp_path)
    assert sorted(r["file"] for r in got.collect()) == ["20200101T000000Z_run-one.json", "20200102T000000Z_run-two.json"]
    about = {r["run"]: r for r in got.select(reports.field("doc", "name").alias("run"), reports.field("doc", "git.commit").alias("commit"), reports.field("doc", "config.deep.x", "int").alias("x"), reports.field("doc", "timestamp_utc").alias("t")).collect()}
    assert about["run two"]["x"] == 3 and about["run one"]["x"] is None and about["run one"]["t"] == "20200101T000000Z"
    cells = {r["run"]: r for r in reports.compare(got, None, "file").collect()}
    assert cells["run one"]["f1"] == "-" and cells["run two"]["acc"] == "0.7500" and "note" not in cells["run one"]
    assert reports.compare(got.where("false"), ["acc"]).count() == 0
    assert reports.read_manifests(spark, tmp_path / "none").count() == 0


def test_provenance(tmp_path):
    got = reports.provenance(tmp_path / "none")
    assert got["git"] == {"commit": None, "branch": None, "dirty": None} and got["environment"]["pyspark"]


def test_firmware(tmp_path):
    blob = bytes(range(256))
    _, body = firmware.byte_source(blob, tmp_path / "model", "model")
    text = body.read_text().split("{")[1].split("}")[0]
    assert bytes(int(x, 16) for x in text.replace("\n", " ").split(",") if x.strip()) == blob
    doc = firmware.write_settings(tmp_path / "c.json", win=128, channels=6, fs=50, stride=64, classes=["x"], mean=[0], std=[1], thresholds={"e": 1})
    assert doc["windows_per_hour"] == 2812.5 and json.loads((tmp_path / "c.json").read_text())["hop_seconds"] == 1.28
    assert doc["channels"] == 6
    ops = firmware.Operators.of(["PACK", "DELEGATE", "ADD", "ADD"])
    assert ops.status() == {"ADD": "accelerated", "PACK": "slow"} and "OpResolver<2> resolver" in ops.resolver()
    assert "without fast kernel: PACK" in ops.notes("m", {"largest": 1, "total": 2}, 9) and "kMean[2] = {0.500000f" in firmware.statistics_source(kMean=[0.5, 1], kStd=[1, 2])
    with pytest.raises(KeyError):
        firmware.Operators.of(["ZZZ"]).resolver()
    assert firmware.assign_roles([64, 6], 6, 64) == {"probs": 1, "embedding": 0}
    for bad in ([6, 6], [6], [6, 64, 1]):
        with pytest.raises(ValueError):
            firmware.assign_roles(bad, 6, 64)


def test_archives(tmp_path):
    import zipfile

    inner = tmp_path / "inner.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a/b/marker", "x")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.write(inner, "deep/inner.zip")
    corpus = archives.Corpus("c", "marker", least_bytes=1, home=tmp_path)
    assert corpus.root() == corpus.root() == tmp_path / "c" / "deep" / "a" / "b"
    with pytest.raises(FileNotFoundError):
        archives.Corpus("c", "other", least_bytes=1, home=tmp_path).root()
    with pytest.raises(RuntimeError):
        archives.Corpus("none", "marker", home=tmp_path).root()
