"""Run manifests: JSON files written by the driver, read as VARIANT so that no field is lost, compared run by metric."""

from __future__ import annotations

import json
import platform
import subprocess
from datetime import UTC, datetime
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpora import slug


def provenance(repo: str | Path = ".", packages: tuple[str, ...] = ("pyspark", "numpy", "pandas")) -> dict:
    """What code ran and on what: one status call tells commit, branch and changes (all null without a repository)."""
    call = subprocess.run(["git", "-C", str(repo), "status", "--porcelain=v2", "--branch"], capture_output=True, text=True) if Path(repo).exists() else None
    lines = call.stdout.splitlines() if call and not call.returncode else []
    heads = dict(x[2:].split(" ", 1) for x in lines if x.startswith("# branch."))

    def installed(name: str) -> str | None:
        try:
            return version(name)
        except PackageNotFoundError:
            return None

    code = {"commit": heads.get("branch.oid"), "branch": heads.get("branch.head"), "dirty": any(x[0] != "#" for x in lines) if heads else None}
    return {"git": code, "environment": {"python": platform.python_version(), "platform": platform.platform()} | {p: installed(p) for p in packages}}


def write_manifest(folder: str | Path, name: str, config: dict, metrics: dict, extra: dict | None = None, stamp: str | None = None) -> Path:
    """One JSON file named by UTC time and run; earlier ones stay."""
    when = stamp or datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
    record = {"name": name, "timestamp_utc": when, **provenance(), "config": config, "metrics": metrics} | ({"extra": extra} if extra else {})
    if record["git"]["dirty"]:
        record["note"] = "uncommitted changes"
    target = Path(folder) / f"{when}_{slug(name)}.json"
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(record, indent=2, default=lambda x: x.tolist() if hasattr(x, "tolist") else str(x)))
    return target


def read_manifests(spark: SparkSession, folder: str | Path) -> DataFrame:
    """(file, doc VARIANT) of the JSON files of a folder; those that don't parse or name no run are left out."""
    if not any(Path(folder).glob("*.json")):
        return spark.createDataFrame([], "file string, text string").select("file", F.try_parse_json("text").alias("doc"))
    raw = spark.read.text(str(folder), wholetext=True, pathGlobFilter="*.json")
    docs = raw.select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("doc"))
    return docs.where(field("doc", "name").isNotNull())


def field(doc: str, path: str, kind: str = "string") -> Column:
    """A field of a manifest by its path, e.g. ``git.commit``; null where a run lacks it."""
    return F.try_variant_get(F.col(doc), f"$.{path}", kind)


def metrics(manifests: DataFrame, *keep: str) -> DataFrame:
    """(keep, run, metric, value): one row for each number among the metrics of a run."""
    spark = manifests.sparkSession
    pairs = manifests.select(*keep, field("doc", "name").alias("run"), F.try_variant_get("doc", "$.metrics", "variant").alias("_m")).where("_m IS NOT NULL")
    flat = pairs.lateralJoin(spark.tvf.variant_explode(F.col("_m").outer()))
    number = F.when(F.schema_of_variant("value").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)"), F.try_variant_get("value", "$", "double"))
    return flat.select(*keep, "run", F.col("key").alias("metric"), number.alias("value")).where("value IS NOT NULL")


def compare(manifests: DataFrame, keys: list[str] | None = None, *keep: str) -> DataFrame:
    """A row a run and a column a metric, four decimals, a dash where a run lacks the metric; runs without metrics are rows of dashes."""
    found = metrics(manifests, *keep)
    if keys is None:
        keys = [r["metric"] for r in found.select("metric").distinct().orderBy("metric").collect()]  # a few dozen names
    every = manifests.select(*keep, field("doc", "name").alias("run"))
    if not keys:
        return every
    wide = found.groupBy(*keep, "run").pivot("metric", keys).agg(F.first(F.format_string("%.4f", "value")))
    return every.join(wide, [*keep, "run"], "left").fillna("-", keys)
