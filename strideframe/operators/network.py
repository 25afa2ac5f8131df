"""Forward pass of the motion network with given weights, batches of windows inside Spark's tasks.

A strided convolution, four depthwise-separable blocks with pooling after the first
three, a mean over time, a dense embedding and a softmax; batch normalisation comes
folded into a scale and a shift. Weights are some 50 KB, so they are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

# Fixed values of the network: filters and kernel of the stem, then name, filters, kernel, pooled of each block.
STEM = (24, 9)
BLOCKS = (("b1", 32, 5, True), ("b2", 48, 5, True), ("b3", 64, 5, True), ("b4", 64, 3, False))


def initial_weights(seed: int = 42, channels: int = 6, classes: int = 6, embed: int = 64, fall: bool = False) -> dict[str, np.ndarray]:
    """Random weights in the layout that :func:`forward` reads."""
    rng, held = np.random.default_rng(seed), {}

    def draw(name: str, *shape: int) -> None:
        held[name] = (rng.normal(size=shape) * np.sqrt(2 / np.prod(shape[:-1]))).astype(np.float32)

    def norm(name: str, n: int) -> None:
        held[f"{name}_scale"], held[f"{name}_shift"] = np.ones(n, np.float32), np.zeros(n, np.float32)

    draw("stem", STEM[1], channels, STEM[0])
    norm("stem", STEM[0])
    last = STEM[0]
    for name, filters, kernel, _ in BLOCKS:
        draw(f"{name}_depth", kernel, last)
        norm(f"{name}_depth", last)
        draw(f"{name}_point", last, filters)
        norm(f"{name}_point", filters)
        last = filters
    for name, a, b in (("embedding", last, embed), ("probs", embed, classes), *([("fall", embed, 1)] if fall else [])):
        draw(name, a, b)
        held[f"{name}_bias"] = np.zeros(b, np.float32)
    return held


def _views(x: np.ndarray, kernel: int, stride: int = 1) -> np.ndarray:
    """(windows, steps, channels, kernel) with zeros around, so that ceil(steps / stride) are left."""
    n = x.shape[1]
    pad = max((-(-n // stride) - 1) * stride + kernel - n, 0)
    padded = np.pad(x, ((0, 0), (pad // 2, pad - pad // 2), (0, 0)))
    return sliding_window_view(padded, kernel, axis=1)[:, ::stride]


def forward(x: np.ndarray, w: dict[str, np.ndarray], bounded: bool = False) -> dict[str, np.ndarray]:
    """probs, embedding and, where the weights have it, fall of windows (n, steps, channels)."""
    top = 6.0 if bounded else np.inf

    def active(name: str, v: np.ndarray) -> np.ndarray:
        return np.clip(v * w[f"{name}_scale"] + w[f"{name}_shift"], 0, top)

    v = active("stem", np.einsum("nsck,kcf->nsf", _views(x, STEM[1], 2), w["stem"], optimize=True))
    for name, _, kernel, pooled in BLOCKS:
        v = active(f"{name}_depth", np.einsum("nsck,kc->nsc", _views(v, kernel), w[f"{name}_depth"]))
        v = active(f"{name}_point", v @ w[f"{name}_point"])
        if pooled:
            v = v[:, : v.shape[1] // 2 * 2].reshape(len(v), -1, 2, v.shape[2]).max(2)
    embedding = np.clip(v.mean(1) @ w["embedding"] + w["embedding_bias"], 0, top)
    logits = embedding @ w["probs"] + w["probs_bias"]
    odds = np.exp(logits - logits.max(1, keepdims=True))
    out = {"probs": odds / odds.sum(1, keepdims=True), "embedding": embedding}
    if "fall" in w:
        out["fall"] = 1 / (1 + np.exp(-(embedding @ w["fall"] + w["fall_bias"])[:, 0]))
    return out


def predict(windows: DataFrame, weights: dict[str, np.ndarray], key: str = "window_id", x: str = "X", bounded: bool = False) -> DataFrame:
    """key, probs, embedding, fall (null without that head); windows without samples have null outputs.

    All windows need one length, of at least 16 samples, and the weights' channels.
    """
    given = windows.sparkSession.sparkContext.broadcast(weights)
    plain = windows.select(key, x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = given.value
        for b in batches:
            rows = b.column(x)
            filled = np.array([bool(n) for n in rows.value_lengths().to_pylist()], bool)
            found = {}
            if filled.any():
                kept = rows.filter(pa.array(filled))
                flat = kept.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                found = forward(flat.reshape(len(kept), -1, w["stem"].shape[1]), w, bounded)
            at = np.cumsum(filled) - 1
            cells = lambda name, f=found, a=at, ok=filled: [f[name][i].tolist() if o and name in f else None for i, o in zip(a, ok, strict=True)]
            lists = pa.list_(pa.float32())
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(cells("probs"), lists), pa.array(cells("embedding"), lists), pa.array(cells("fall"), pa.float32())], names=[key, "probs", "embedding", "fall"])

    return plain.mapInArrow(run, f"`{key}` {plain.schema[key].dataType.simpleString()}, probs array<float>, embedding array<float>, fall float")
