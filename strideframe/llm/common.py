"""Shared plumbing of the training-data operators.

Tables that cut lineage are written below the folder the cluster names in
``spark.checkpoint.dir``; every executor can read them, so a lost executor
costs a task, never a result.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Upper bounds of one Arrow batch that reaches a Python worker.
BATCH_ROWS = 1024
BATCH_BYTES = 4 << 20
#: Bytes of text that a kernel handles at once; its arrays take some ten times eight bytes for each.
SLICE_BYTES = 2 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Ship the package, and bound what one Arrow batch may hold, so long documents cannot exhaust a worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


_held: dict[str, Callable[[], None]] = {}


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def holds(name: str, drop: Callable[[], None]) -> None:
    """Tell that the operator ``name`` keeps something between tasks of one worker, and how to drop it."""
    _held[name] = drop


def begin(name: str) -> None:
    """Called as a task of the operator ``name`` begins: what others kept in this worker goes back to the system.

    Large blocks are mapped and unmapped one by one from then on, so that a
    worker that lives through several operators isn't as large as all of them.
    """
    libc = _libc()
    if libc is not None and hasattr(libc, "mallopt"):
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())
    for other, drop in _held.items():
        if other != name:
            drop()
    gc.collect()
    if libc is not None and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name below ``spark.checkpoint.dir`` (own temp folder where that is unset and all runs on one machine)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='strideframe-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/strideframe-{uuid.uuid4().hex[:12]}"


@contextmanager
def compact(spark: SparkSession, on: bool = True) -> Iterator[None]:
    """Within it, small shuffles are coalesced to the advisory size even where that leaves cores idle.

    For chains of small tables: one file each instead of one for every core. Every
    file costs a create, a rename and, on a local file system, processes that set
    its permissions; those are forks of the executor. ``on=False``: cores first again.
    """
    key = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(key)
    spark.conf.set(key, str(not on).lower())
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, hint: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{hint}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)  # nobody waits for a marker
    out = spark.read.schema(df.schema).parquet(path)
    out._strideframe_path = path
    return out


def narrowed(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """``df`` in no more partitions than ``rows`` (an upper bound) need at ``each`` a partition, but one for every core.

    For tables whose size is known: a file and a task cost the same for a handful of rows,
    and coalescing by AQE may be off.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def release(df: DataFrame) -> None:
    """Delete a table of :func:`materialise` that no returned plan still reads."""
    path, jvm = df._strideframe_path, df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def sha_hex(col: Column) -> Column:
    return F.sha2(col, 256)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of one slice stay below ``limit`` bytes (or are one row)."""
    if not batch.num_rows:
        return
    lens = np.nan_to_num(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(lens):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    yield batch.slice(start)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    col = pc.fill_null(col, "").cast(pa.large_utf8())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    if col.buffers()[2] is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]], offs - offs[0]
