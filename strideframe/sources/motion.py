"""Motion corpora as a Spark data source: ``spark.read.format("motion").option("layout", ...).load(folder)``.

Layout ``trials``: continuous recordings, one CSV each (``sub_*.csv``) in a folder named after its
activity, channels found by name in each file's own header; a row a sample. Layout ``lines``: text files
of one line a window; a row a line, with the part and the file's name. A file is a partition and is
read in batches, so a recording of any length needs no more memory than a batch.

The folder is one that Python can open (a mounted path, or what ``pyarrow.fs`` knows by its URI).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .layout import CHANNELS, LINE_SIGNALS, TRIAL_COLUMNS, TRIAL_LABELS

ROWS = 4096
TRIALS = "path string, subject string, y_act int, i long, " + ", ".join(f"{c} float" for c in CHANNELS)
LINES = "split string, name string, line long, v array<float>"


@dataclass
class File(InputPartition):
    uri: str
    kind: str  # activity of a trial, part of a line file
    name: str


def _open(uri: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _below(root: str) -> list[str]:
    from pyarrow import fs

    system, path = _open(root)
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    prefix = root.split("://")[0] + "://" if "://" in root else ""
    return sorted(prefix + x.path for x in found if x.is_file)


class MotionReader(DataSourceReader):
    def __init__(self, root: str, layout: str):
        self.root, self.layout = root, layout

    def partitions(self) -> list[File]:
        parts = []
        for uri in _below(self.root):
            folder, name = uri.rsplit("/", 2)[-2:]
            if self.layout == "trials":
                act = folder.split("_")[0]
                if fnmatch(name, "sub_*.csv") and act in TRIAL_LABELS:
                    parts.append(File(uri, act, name[:-4]))
            else:
                parts += [File(uri, split, what) for split in ("train", "test") for what in ("y", "subject", *LINE_SIGNALS) if uri.endswith(f"/{split}/{name}") or uri.endswith(f"/{split}/Inertial Signals/{name}") if name == f"{what}_{split}.txt"]
        if not parts:
            raise FileNotFoundError(f"no {self.layout} below {self.root}")
        return parts

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        system, path = _open(partition.uri)
        with system.open_input_stream(path) as f:
            yield from (_trial if self.layout == "trials" else _lines)(f, partition)


def _trial(f, part: File) -> Iterator[pa.RecordBatch]:
    from pyarrow import csv

    reader = csv.open_csv(f, convert_options=csv.ConvertOptions(column_types={c: pa.float32() for c in TRIAL_COLUMNS}))
    names = [n.strip() for n in reader.schema.names]
    if not set(TRIAL_COLUMNS) <= set(names):
        return  # another kind of recording
    at = 0
    for b in reader:
        n = b.num_rows
        own = [pa.array([part.uri] * n), pa.array([f"ms_{part.name}"] * n), pa.array([TRIAL_LABELS[part.kind]] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())]
        yield pa.RecordBatch.from_arrays([*own, *[b.column(names.index(c)).cast(pa.float32()) for c in TRIAL_COLUMNS]], names=["path", "subject", "y_act", "i", *CHANNELS])
        at += n


def _lines(f, part: File) -> Iterator[pa.RecordBatch]:
    import io

    held: list[tuple[int, list[float]]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part.kind] * len(held)), pa.array([part.name] * len(held)), pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.list_(pa.float32()))], names=["split", "name", "line", "v"])

    for i, line in enumerate(io.TextIOWrapper(f, "utf-8")):
        if line.strip():
            held.append((i, [float(x) for x in line.split()]))
        if len(held) == ROWS:
            yield batch()
            held.clear()
    if held:
        yield batch()


class MotionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "motion"

    def _layout(self) -> str:
        found = self.options.get("layout", "trials")
        if found not in ("trials", "lines"):
            raise ValueError(f"unknown layout {found!r}")
        return found

    def schema(self) -> str:
        return TRIALS if self._layout() == "trials" else LINES

    def reader(self, schema) -> MotionReader:
        return MotionReader(self.options["path"], self._layout())


def register(spark: SparkSession) -> SparkSession:
    from ..shipping import ship

    ship(spark)
    spark.dataSource.register(MotionSource)
    return spark
