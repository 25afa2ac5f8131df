"""The forward pass against plain loops, stress windows, the middle of classes."""

import math

import numpy as np
from pyspark.sql import functions as F

from strideframe.operators import augment, network, stats


def looped(x, w):
    """The network written out value by value for one window."""

    def conv(v, kernel, stride, value):
        n, size = len(v), len(kernel)
        out = math.ceil(n / stride)
        left = max((out - 1) * stride + size - n, 0) // 2
        return np.array([value([(v[i * stride + j - left], kernel[j]) for j in range(size) if 0 <= i * stride + j - left < n]) for i in range(out)])

    relu = lambda name, v: np.maximum(v * w[f"{name}_scale"] + w[f"{name}_shift"], 0)
    v = relu("stem", conv(x, w["stem"], 2, lambda p: sum(a @ k for a, k in p)))
    for name, _, _, pooled in network.BLOCKS:
        v = relu(f"{name}_depth", conv(v, w[f"{name}_depth"], 1, lambda p: sum(a * k for a, k in p)))
        v = relu(f"{name}_point", v @ w[f"{name}_point"])
        if pooled:
            v = np.array([np.maximum(v[i], v[i + 1]) for i in range(0, len(v) - 1, 2)])
    e = np.maximum(v.mean(0) @ w["embedding"] + w["embedding_bias"], 0)
    p = np.exp(e @ w["probs"] + w["probs_bias"])
    return p / p.sum(), e


def test_forward(spark):
    r = np.random.default_rng(0)
    w = network.initial_weights(1)
    for k in list(w):
        if k.endswith(("_scale", "_shift", "_bias")):
            w[k] = (w[k] + r.normal(size=w[k].shape) * 0.1).astype(np.float32)
    x = r.normal(size=(5, 32, 6)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, None), (6, [])]
    df = spark.createDataFrame(rows, "window_id long, X array<array<float>>").repartition(3)
    got = {p["window_id"]: p for p in network.predict(df, w).collect()}
    for i, v in enumerate(x):
        probs, embedding = looped(v, w)
        assert np.allclose(got[i]["probs"], probs, atol=1e-4) and np.allclose(got[i]["embedding"], embedding, rtol=1e-3, atol=1e-4)
        assert got[i]["fall"] is None
    assert got[5]["probs"] is None and got[6]["embedding"] is None
    assert network.predict(df.where("false"), w).count() == 0
    capped = network.forward(x * 100, w, bounded=True)["embedding"]
    assert capped.max() <= 6


def test_stress(spark):
    one = spark.createDataFrame([(1, [[float(t)] * 6 for t in range(64)])], "window_id long, X array<array<float>>")
    base = np.array(one.first()["X"])
    hit = np.array(augment.impact_windows(one, ["window_id"]).first()["X"])
    changed = np.flatnonzero((hit != base).any(1))
    assert len(changed) == 8 and changed[0] >= 20 and changed[-1] - changed[0] == 7 and changed[0] < 44
    still = np.array(augment.freeze_windows(one, ["window_id"]).first()["X"])
    assert abs(still).max() < 0.2 and still.std() > 0.005
    loud = np.array(augment.shake_windows(one, ["window_id"]).first()["X"]) - base
    assert 2 < loud.std() < 4


def test_class_middle(spark):
    rows = [(i * i, i % 3) for i in range(100)] + [(7, None), (None, 1)]
    df = spark.createDataFrame(rows, "id long, y int")
    want = {}
    for c in range(3):
        own = sorted(i * i for i in range(100) if i % 3 == c)
        want[c] = own[len(own) // 2]
    assert dict(stats.class_middle(df, "y", "id").collect()) == want
    assert dict(stats.class_middle(df, "y", "id", bins=2).collect()) == want
    assert stats.class_middle(df.where(F.lit(False)), "y", "id").count() == 0
