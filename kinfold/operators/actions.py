"""Replacement actions as a relation, and an applier that carries them out only when told to."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.labels import link_target


def replacements(actions: DataFrame) -> DataFrame:
    """``(dup, best)`` with ``link``, the relative target that a link in the place of ``dup`` would have."""
    return actions.withColumn("link", link_target(F.col("dup"), F.col("best")))


def relinks(listing: DataFrame, actions: DataFrame) -> DataFrame:
    """Links of ``listing(path, target)`` that point to a file about to be replaced, with the best file to point to."""
    return listing.where("target is not null").join(actions.select(F.col("dup").alias("target"), "best"), "target").select(F.col("path").alias("dup"), "best").withColumn("link", link_target(F.col("dup"), F.col("best")))


def links_to(listing: DataFrame, path: str) -> DataFrame:
    """Links of ``listing(path, target)`` to one file."""
    return listing.where(F.col("target") == path).select("path")


def manage(groups: DataFrame, action: str, group_id: str, file: str | None = None) -> DataFrame:
    """What a user's decision on one group asks for, as ``(action, dup, best)``.

    ``groups`` has a row (group_id, path, is_best) for each member. ``delete`` replaces one file by the best, ``set_best``
    only notes a choice, ``process_all`` replaces every other member.
    """
    rows = groups.where(F.col("group_id") == group_id)
    best = rows.where("is_best").select("group_id", F.col("path").alias("best"))
    others = rows.where("not is_best").join(best, "group_id")
    if action == "process_all":
        return others.select(F.lit("replace").alias("action"), F.col("path").alias("dup"), "best")
    if action == "delete":
        return others.where(F.col("path") == file).select(F.lit("replace").alias("action"), F.col("path").alias("dup"), "best")
    if action == "set_best":
        return rows.where(F.col("path") == file).select(F.lit("set_best").alias("action"), F.lit(None).cast("string").alias("dup"), F.col("path").alias("best"))
    raise ValueError(f"unknown action {action!r}")


def apply(actions: DataFrame, root: str, dry_run: bool = True) -> list[tuple[str, str, str]]:
    """Replace each ``dup`` below ``root`` by a relative link to its ``best``: (dup, best, outcome) of each.

    Nothing is touched in a dry run, which is the default. A row is skipped unless both files exist, differ, lie below
    the root and the duplicate is no link already. The link is made beside the file and renamed over it, so a failure
    leaves the file as it was. This runs on the driver: it is meant for the files of one folder.
    """
    base, out = Path(root).resolve(), []
    for row in actions.select("dup", "best").toLocalIterator():
        dup, best = base / row.dup, base / row.best
        inside = all(base in p.parent.resolve().parents or p.parent.resolve() == base for p in (dup, best))
        if not inside or dup.is_symlink() or not dup.is_file() or not best.is_file() or dup.samefile(best):
            out.append((row.dup, row.best, "skipped"))
            continue
        if dry_run:
            out.append((row.dup, row.best, "would replace"))
            continue
        temp = dup.with_name(f".{dup.name}.link")
        try:
            temp.unlink(missing_ok=True)
            temp.symlink_to(os.path.relpath(best, dup.parent))
            os.replace(temp, dup)
            dup.with_name(f"thumb-frame.{dup.name}.jpg").unlink(missing_ok=True)
            out.append((row.dup, row.best, "replaced"))
        except OSError as e:
            temp.unlink(missing_ok=True)
            out.append((row.dup, row.best, f"failed: {e.strerror}"))
    return out
