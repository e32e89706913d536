"""Import of folder states kept as JSON by older versions."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinfold.functions.signatures import from_hex
from kinfold.schema import BEST, GROUPING, GROUPS
from kinfold.state import StateStore, read_summary

LEGACY_VERSION = "1.0"


def find(root: str, name: str) -> list[Path]:
    """Old state files below a root, by the name that they had."""
    return sorted(Path(d) / name for d, _, names in os.walk(root) if name in names)


def readable(data: dict) -> bool:
    """Whether a file has the known version and keeps hashes as text, not as the still older pairs."""
    hashes = data.get("hashes") if isinstance(data, dict) else None
    return isinstance(hashes, dict) and data.get("version") == LEGACY_VERSION and all(isinstance(h, str) for h in hashes.values())


def migrate(spark: SparkSession, file: str | Path, state_path: str, dry_run: bool = False, remove: bool = False) -> bool:
    """Bring one file's five sections into a new state. False, with nothing written, if the file cannot be read or has
    another version, or if there is a state already. The file is one folder's and read on the driver."""
    try:
        data = json.loads(Path(file).read_text())
    except (OSError, ValueError):
        return False
    if not readable(data) or read_summary(spark, state_path)["status"] != "pending" or dry_run:
        return readable(data) and dry_run
    store = StateStore.of(spark, state_path)
    if store.table("file_hashes").count():
        return False
    stats = data.get("file_stats") or {}
    rows = [(p, h, float((stats.get(p) or {}).get("mtime", 0.0)), int((stats.get(p) or {}).get("size", 0))) for p, h in data["hashes"].items()]
    hashes = spark.createDataFrame(rows, "path string, h string, mtime double, size long")
    p, d = from_hex(F.col("h"))
    now = store.now()
    hashes = hashes.select("path", p.alias("phash"), d.alias("dhash"), "mtime", "size", F.lit(now).alias("updated_at")).where("phash is not null")
    grouping = [(r, list(f), now) for r, f in (data.get("grouping_results") or {}).items()]
    best = [(g, f, now) for g, f in (data.get("best_files") or {}).items()]
    groups = [(g, list(v.get("files") or []), bool(v.get("processed")), now) for g, v in (data.get("groups") or {}).items()]
    meta = {"created": repr(float(data.get("created") or now))}
    if data.get("grouping_timestamp"):
        meta["grouping_timestamp"] = repr(float(data["grouping_timestamp"]))
    store.commit({
        "file_hashes": hashes, "grouping_results": spark.createDataFrame(grouping, GROUPING),
        "best_files": spark.createDataFrame(best, BEST), "groups": spark.createDataFrame(groups, GROUPS),
    }, **meta)
    if remove:
        Path(file).unlink()
    return True


def main(spark: SparkSession, root: str, name: str, state_dir: str, dry_run: bool = False) -> dict[str, bool]:
    """Migrate the old states of a name in the folders right below a data root to where an ``Engine`` with this
    ``state_dir`` looks for them. Others below the root are no folder's state and are not found."""
    found = [f for f in find(root, name) if f.parent.parent == Path(root)]
    return {str(f): migrate(spark, f, f"{state_dir.rstrip('/')}/{f.parent.name}", dry_run, remove=not dry_run) for f in found}
