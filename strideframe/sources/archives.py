"""Local copies of published corpora: one record says where a corpus comes from and how its folder is told."""

from __future__ import annotations

import os
import shutil
import urllib.error
import urllib.request
import zipfile
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Corpus:
    """A corpus that is downloaded once, unpacked (archives inside the archive too), and found by a file it must hold."""

    name: str
    marker: str
    mirrors: tuple[str, ...] = ()
    least_bytes: int = 1_000_000
    home: Path = field(default_factory=lambda: Path(os.environ.get("DATA_ROOT", "data")))
    depth: int = 4

    @property
    def archive(self) -> Path:
        return self.home / f"{self.name}.zip"

    def root(self) -> Path:
        """The folder that holds the marker; what is missing for it is downloaded and unpacked first."""
        if (found := self.located()) is None:
            self._downloaded()
            self._unpacked(self.archive)
            found = self.located()
        if found is None:
            raise FileNotFoundError(f"no folder with {self.marker} below {self.home / self.name}")
        return found

    def located(self) -> Path | None:
        """The shallowest folder, then the first by name, that holds the marker at most ``depth`` folders down."""
        top = self.home / self.name
        hits = [p.parent for p in top.rglob(self.marker) if len(p.parent.relative_to(top).parts) <= self.depth]
        return min(hits, key=lambda p: (len(p.parts), str(p)), default=None)

    def _downloaded(self) -> None:
        if self.archive.exists() and self.archive.stat().st_size >= self.least_bytes:
            return
        self.home.mkdir(parents=True, exist_ok=True)
        if shutil.disk_usage(self.home).free < 3 * self.least_bytes:  # the archive and what comes out of it
            raise OSError(f"too little space below {self.home} for {self.name}")
        part = self.archive.with_suffix(".part")
        for url in self.mirrors:
            try:
                with urllib.request.urlopen(url, timeout=60) as source, part.open("wb") as out:
                    shutil.copyfileobj(source, out)
            except (urllib.error.URLError, OSError, ValueError):
                continue
            if part.stat().st_size >= self.least_bytes:
                part.replace(self.archive)
                return
        raise RuntimeError(f"no mirror gave {self.name}; put it at {self.archive} by hand: {list(self.mirrors)}")

    def _unpacked(self, archive: Path) -> None:
        if not zipfile.is_zipfile(archive):
            raise ValueError(f"{archive} is no zip file")
        waiting = [(archive, self.home / self.name)]
        while waiting:
            source, into = waiting.pop()
            with zipfile.ZipFile(source) as z:
                z.extractall(into)
                waiting += [(into / n, (into / n).parent) for n in z.namelist() if n.endswith(".zip")]
