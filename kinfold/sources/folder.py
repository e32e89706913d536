"""Listing folders of files: recursive, without links and thumbnails, keyed by paths relative to the resolved root."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.labels import media_kind
from kinfold.schema import ASSET, IMAGE_EXTENSIONS, VIDEO_EXTENSIONS

#: Thumbnails, whatever tool made them, and the dot files in which tools keep a folder's state, databases among them.
THUMBS = re.compile(r"thumb(-[A-Za-z0-9]+)?\.")
STATE_FILES = re.compile(r"\.[A-Za-z0-9]+(\.db.*)?$")


def walk(root: str) -> Iterator[tuple[str, int, float]]:
    """(relative path, size, time of change) of all files below a root; what cannot be read is skipped."""
    base = os.path.realpath(root)
    todo = [base]
    while todo:
        try:
            entries = sorted(os.scandir(todo.pop()), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            try:
                if THUMBS.match(e.name) or e.is_symlink():
                    continue
                if e.is_dir():
                    todo.append(e.path)
                elif e.is_file():
                    stat = e.stat()
                    yield os.path.relpath(e.path, base), stat.st_size, stat.st_mtime
            except OSError:
                continue


def folders(root: str, hidden: bool = False) -> list[str]:
    """Names of the folders below a root, in case-insensitive order."""
    found = [e.name for e in os.scandir(root) if e.is_dir() and (hidden or not e.name.startswith("."))]
    return sorted(found, key=lambda n: (n.lower(), n))


def content_mtime(root: str) -> float:
    """The latest change of anything below a folder but its thumbnails and its own state."""
    latest = [m for p, _, m in walk(root) if not STATE_FILES.match(os.path.basename(p))]
    return max(latest, default=0.0)


def listing(spark: SparkSession, roots: dict[str, str], images=IMAGE_EXTENSIONS, videos=VIDEO_EXTENSIONS) -> DataFrame:
    """Assets of several folders, ``{name: root}``, as ``(folder, path, kind, size, mtime)``; each folder is walked by one
    task. The roots must be visible to the executors. Files of other kinds are left out."""
    seed = spark.createDataFrame(sorted(roots.items()), "folder string, root string").repartition(max(1, len(roots)))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for folder, root in zip(b["folder"], b["root"], strict=True):
                rows = [(folder, p, s, m) for p, s, m in walk(root)]
                for i in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[i : i + 10_000], columns=["folder", "path", "size", "mtime"])

    found = seed.mapInPandas(run, "folder string, path string, size long, mtime double")
    names = [c.split()[0] for c in ASSET.split(", ")]
    return found.withColumn("kind", media_kind(F.col("path"), tuple(images), tuple(videos))).where("kind is not null").select(*names)
