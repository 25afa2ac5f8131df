"""Count windows over a stream whose samples come late or out of order, as far as a watermark allows.

Samples wait in a buffer until the watermark has passed them; then they are put in order and go
into windows. A sample that comes after the watermark passed its time is dropped and counted: by
Spark before it reaches the state (``late_rows``; a batch is held against the watermark that the one
before it acted on), or here (column ``late``). State is the buffer of
one delay and the last, at most win, samples of each trial, kept for many trials (a lane) at once; a trial's
goes when it has been quiet for ``idle``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """List state and timers need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


#: Groups that the trials of a stream are dealt into.
LANES = 1024
NEVER = -(1 << 62)
NONE = np.zeros(0, np.float64)
NAN = float("nan")


def _same(x):
    """One object for all NaNs, so that they find each other in a dict."""
    return NAN if x != x else x


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(bytes(blob)).read_next_batch()


class OrderedWindows(StatefulProcessor):
    """A group is a lane, all trials whose id hashes to it: every call to the state costs a round trip to the JVM,
    so it moves the rows of many trials at once, as Arrow blobs."""

    def __init__(self, by: str, ties: list[str], win: int, stride: int, idle_ms: int):
        self.by, self.ties, self.win, self.stride, self.idle_ms = by, ties, win, stride, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "rows binary")
        # Of each trial: samples in order so far, up to time t, dropped here, and the last samples that a window to come may hold.
        self.trials = handle.getValueState("trials", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        trials, changed, first = self._trials(), False, None
        for part in rows:
            code, ids = pd.factorize(part[self.by], use_na_sentinel=False)
            done = np.array([trials[x][1] if x in trials else NEVER for x in map(_same, ids)], np.int64)
            fresh = part["at_us"].to_numpy() > done[code]
            for x, n in zip(map(_same, ids), np.bincount(code[~fresh], minlength=len(ids)).tolist(), strict=True):
                if n:
                    trials[x][2] += n
                    changed = True
            if fresh.any():
                new = part.loc[fresh, [self.by, "at_us", *self.ties, "sample"]]
                self.buffer.appendValue((_packed(pa.RecordBatch.from_pandas(new, preserve_index=False)),))
                low = int(new["at_us"].min())
                first = low if first is None else min(first, low)
        if changed:
            self._put(trials)
        if first is not None:
            self._wake(first)
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        trials, held, out, waiting = self._trials(), self._buffered(), [], set()
        changed = False
        if held is not None:
            due = held["at_us"].to_numpy() <= now
            if due.any():
                out, changed = self._advance(trials, held[due]), True
                held = held[~due]
                self.buffer.clear()
                if len(held):
                    self.buffer.appendValue((_packed(pa.RecordBatch.from_pandas(held, preserve_index=False)),))
            waiting = set(map(_same, held[self.by].unique()))
            if len(held):
                self._wake(int(held["at_us"].min()))
        for x in [x for x, (_, t, _, _) in trials.items() if x not in waiting and now - t >= self.idle_ms * 1000]:
            del trials[x]  # quiet for long: the trial is over
            changed = True
        if changed:
            self._put(trials)
        ends = [t for x, (_, t, _, _) in trials.items() if x not in waiting]
        if ends:
            self.handle.registerTimer(min(ends) // 1000 + self.idle_ms)
        yield self._frame(out)

    def close(self) -> None:
        pass

    def _advance(self, trials: dict, ready: pd.DataFrame) -> list[tuple]:
        """Puts samples in order behind those of their trials; (trial, k's, means, energies, late) of the windows that are complete now."""
        code, ids = pd.factorize(ready[self.by], use_na_sentinel=False)
        order = np.lexsort((ready["sample"], *(ready[c] for c in reversed(self.ties)), ready["at_us"], code))
        sample, at_us = ready["sample"].to_numpy()[order], ready["at_us"].to_numpy()[order]
        ends = np.cumsum(np.bincount(code, minlength=len(ids))).tolist()
        out, lo = [], 0
        for x, hi in zip(map(_same, ids), ends, strict=True):
            seen, _, late, tail = trials.get(x, (0, NEVER, 0, NONE))
            values, at, total = np.concatenate([tail, sample[lo:hi]]), seen - len(tail), seen + hi - lo  # at: index of values[0]
            k = max(0, -(-(seen - self.win + 1) // self.stride))
            end = max(k, (total - self.win) // self.stride + 1)
            if end > k:
                ks = np.arange(k, end)
                w = np.lib.stride_tricks.sliding_window_view(values, self.win)[ks * self.stride - at]
                out.append((x, ks, w.mean(1), np.abs(w).mean(1), late))
            keep = max(0, min(len(values), total - end * self.stride))
            trials[x] = [total, int(at_us[hi - 1]), late, values[len(values) - keep :]]
            lo = hi
        return out

    def _wake(self, t: int) -> None:
        self.handle.registerTimer(-(-t // 1000))

    def _buffered(self) -> pd.DataFrame | None:
        parts = [_unpacked(r[0]) for r in self.buffer.get()] if self.buffer.exists() else []
        return pa.Table.from_batches(parts).to_pandas() if parts else None

    def _trials(self) -> dict:
        """Trial: [samples so far, time of the last one, dropped, last samples]."""
        if not self.trials.exists():
            return {}
        b = _unpacked(self.trials.get()[0])
        seen, t, late = (b.column(c).to_pylist() for c in ("seen", "t", "late"))
        flat, offs = b.column("tail").flatten().to_numpy(), b.column("tail").offsets.to_numpy()
        ids = b.select(["id"]).to_pandas()["id"]
        return {_same(x): [seen[i], t[i], late[i], flat[offs[i] : offs[i + 1]]] for i, x in enumerate(ids)}

    def _put(self, trials: dict) -> None:
        if not trials:
            self.trials.clear()
            return
        seen, t, late, tails = zip(*trials.values(), strict=True)
        offs = np.r_[0, np.cumsum([len(x) for x in tails])].astype(np.int32)
        tail = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(tails)))
        ids = pa.Array.from_pandas(pd.Series(list(trials)))
        self.trials.update((_packed(pa.RecordBatch.from_arrays([ids, *map(pa.array, (seen, t, late)), tail], names=["id", "seen", "t", "late", "tail"])),))

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        n = [len(x[1]) for x in out]
        ids = [x[0] for x, m in zip(out, n, strict=True) for _ in range(m)]
        k, mean, energy = (np.concatenate([x[i] for x in out]) if out else [] for i in (1, 2, 3))
        return pd.DataFrame({self.by: ids, "k": k, "mean": mean, "energy": energy, "late": np.repeat([x[4] for x in out], n) if out else []})


def ordered_windows(stream: DataFrame, by: str, ts: str, ties: list[str], value: str, win: int, stride: int, delay: str, idle: str = "1 day", lanes: int = LANES) -> DataFrame:
    """(by, k, mean, energy, late) of each complete window, whatever the order of arrival within ``delay``.

    Samples are ordered by ``ts``, then the whole-number columns ``ties``. late: samples of the trial that
    the operator has dropped so far. Windows of a trial that comes back after ``idle`` begin at 0 again.
    Samples of no trial (null) only move the watermark; null values take no part. Trials share state in ``lanes``
    groups by hash: a lane's buffer and trials are in a task's memory at once.
    """
    if win <= 0 or stride <= 0:
        raise ValueError("win and stride must be positive")
    kind = stream.schema[by].dataType.simpleString()
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    marked = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    # A filter on the time itself stays above the watermark, so what it drops still moves the watermark.
    full = F.when(F.unix_micros(ts) > -(1 << 62), F.col(by).isNotNull() & F.col(value).isNotNull())
    rows = marked.where(full).select(by, ts, F.unix_micros(ts).alias("at_us"), *[F.col(c).cast("long").alias(c) for c in ties], F.col(value).cast("double").alias("sample"))
    return rows.withColumn("lane", F.pmod(F.xxhash64(by), F.lit(lanes))).groupBy("lane").transformWithStateInPandas(OrderedWindows(by, ties, win, stride, idle_ms), f"{by} {kind}, k long, mean double, energy double, late long", "append", "eventTime")


def late_rows(query: StreamingQuery) -> int:
    """Samples that came after the watermark and were dropped before the state, by the query's kept progress reports."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
