"""Binary files in the shared folder that executors write once and read by memory map.

A file is written under a temporary name and renamed, so a task that is run
again, or twice at once, leaves the same bytes. Where the shared folder is not a
mounted path, a reader first copies the file into a temporary folder of its own
process; such a copy is a cache that any executor can make anew.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np


def _mounted(uri: str) -> str | None:
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def put(uri: str, blob: bytes | memoryview) -> None:
    path = _mounted(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(blob)
        os.replace(part, path)
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(blob)
    system.move(part, path)


@lru_cache(maxsize=4096)
def local(uri: str) -> str:
    path = _mounted(uri)
    if path is not None:
        return path
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    out = tempfile.NamedTemporaryFile(delete=False)
    with system.open_input_stream(path) as f, out:
        while block := f.read(1 << 22):
            out.write(block)
    return out.name


def put_arrays(uri: str, **arrays: np.ndarray) -> None:
    """Several arrays in one file: a small header of names, types and places, then the raw values."""
    import json

    head, at, parts = {}, 0, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[name] = (a.dtype.str, a.shape, at)
        raw = a.tobytes()
        pad = -len(raw) % 64
        parts += [raw, b"\0" * pad]
        at += len(raw) + pad
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    put(uri, b"".join([len(text).to_bytes(8, "little"), text, *parts]))


def arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of :func:`put_arrays`, memory-mapped."""
    import json

    raw = np.memmap(local(uri), np.uint8, "r").view(np.ndarray)  # plain views are cheaper to index
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    out = {}
    for name, (kind, shape, at) in head.items():
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = raw[8 + n + at : 8 + n + at + size].view(kind).reshape(shape)
    return out


def exists(uri: str) -> bool:
    path = _mounted(uri)
    if path is not None:
        return os.path.exists(path)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound
