"""Run settings: a default tree of values, strict keys, dotted overrides, YAML in and out."""

from __future__ import annotations

import copy
from pathlib import Path

import yaml

# Sections, keys and defaults that existing settings files use.
DEFAULTS = {
    "name": "movement-baseline",
    "notes": "",
    "out_dir": "artifacts",
    "report_dir": "reports",
    "data": {"root": "data", "datasets": ["uci", "ms"], "win": 128, "stride": 64, "fs": 50, "download": True},
    "split": {"protocol": "subject", "seed": 42, "fracs": [0.7, 0.15, 0.15], "test_dataset": None},
    "augment": {"times": 0, "rotation_deg": 180.0, "scale_sigma": 0.1, "jitter_sigma": 0.02, "warp_ratio": 0.15, "dropout_p": 0.0, "seed": 42},
    "model": {"embed_dim": 64, "width": 1.0, "dropout": 0.3, "with_fall_head": False, "bounded_relu": False},
    "train": {"epochs": 120, "batch_size": 64, "lr": 0.001, "patience": 20, "monitor": "val_macro_f1", "class_weighted": True, "deterministic": True, "fall_positive_weight": 1.0, "seed": 42},
    "quantize": {"n_representative": 512, "output_int8": True, "seed": 42},
    "scoring": {"shrinkage": 0.001, "target_fars": [0.5, 1.0, 2.0, 6.0], "export_far": 1.0},
}


class Settings:
    """Values by dotted name: ``s["data.win"]``."""

    def __init__(self, given: dict | None = None):
        self.tree = copy.deepcopy(DEFAULTS)
        for key, value in (given or {}).items():
            if isinstance(DEFAULTS.get(key), dict):
                for k, v in (value or {}).items():
                    self[f"{key}.{k}"] = v
            else:
                self[key] = value
        self.check()

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        return cls(yaml.safe_load(Path(path).read_text()) or {})

    def save(self, path: str | Path) -> None:
        Path(path).write_text(yaml.safe_dump(self.tree, sort_keys=False))

    def _home(self, name: str) -> tuple[dict, str]:
        *path, last = name.split(".")
        node = self.tree
        for p in path:
            node = node.get(p) if isinstance(node, dict) else None
        if not isinstance(node, dict) or last not in node or isinstance(node[last], dict):
            raise KeyError(f"no setting {name!r}")
        return node, last

    def __getitem__(self, name: str):
        node, last = self._home(name)
        return node[last]

    def __setitem__(self, name: str, value) -> None:
        node, last = self._home(name)
        node[last] = list(value) if isinstance(value, tuple) else value

    @property
    def hop_seconds(self) -> float:
        return self["data.stride"] / self["data.fs"]

    def check(self) -> None:
        faults = []
        if self["split.protocol"] not in ("subject", "leave_dataset_out"):
            faults.append("split.protocol is subject or leave_dataset_out")
        if self["split.protocol"] == "leave_dataset_out" and not self["split.test_dataset"]:
            faults.append("leave_dataset_out needs split.test_dataset")
        if self["data.stride"] > self["data.win"]:
            faults.append("data.stride exceeds data.win")
        if self["model.with_fall_head"] and "sisfall" not in self["data.datasets"]:
            faults.append("a fall head needs a corpus with falls (sisfall)")
        if not self["scoring.export_far"] > 0:
            faults.append("scoring.export_far must be positive")
        if faults:
            raise ValueError("; ".join(faults))
