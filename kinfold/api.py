"""The engine: scan folders, show results, decide on groups. Results are DataFrames; nothing is replaced unless asked."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.functions.labels import extension
from kinfold.functions.signatures import group_id
from kinfold.operators import actions as acts
from kinfold.operators import grouping, selection
from kinfold.operators.simjoin import THRESHOLD
from kinfold.schema import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS
from kinfold.sources import folder as folders
from kinfold.sources import media
from kinfold.state import StateStore, read_summary
from kinfold.streaming.metrics import Recorder

Progress = Callable[[str, int, int, str], None]


def _below(root: str) -> Column:
    """The path below ``root`` of a file URL in ``origin``."""
    plain = F.url_decode(F.replace(F.col("origin"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:(//)?" + re.escape(root) + "/", "")


class Engine:
    """Near-duplicates of the media folders below ``data_dir``; states are kept below ``state_dir``.

    ``frame`` and ``probe`` give the frame and the properties of a video file; ``progress`` is told of each phase.
    """

    def __init__(self, spark: SparkSession, data_dir: str, state_dir: str, images=IMAGE_EXTENSIONS, videos=VIDEO_EXTENSIONS, threshold: int = THRESHOLD, exact_rule: str = "dims_size", frame=media.ffmpeg_frame, probe=media.ffprobe):
        self.spark, self.data_dir, self.state_dir = spark, os.path.realpath(data_dir), state_dir.rstrip("/")
        self.images, self.videos, self.threshold, self.exact_rule = tuple(images), tuple(videos), threshold, exact_rule
        self.frame, self.probe, self.metrics = frame, probe, Recorder()

    # -- folders and files ---------------------------------------------------------------------------------------

    def folders(self) -> list[str]:
        return folders.folders(self.data_dir)

    def _root(self, folder: str) -> str:
        if not folder or re.search(r"\.\.|[/\\]", folder):
            raise ValueError(f"{folder!r} is no folder name")
        root = os.path.join(self.data_dir, folder)
        if not os.path.isdir(root):
            raise FileNotFoundError(root)
        return root

    def store(self, folder: str) -> StateStore:
        self._root(folder)
        return StateStore.of(self.spark, f"{self.state_dir}/{folder}")

    def listing(self, folder: str) -> DataFrame:
        return folders.listing(self.spark, {folder: self._root(folder)}, self.images, self.videos)

    def _signatures(self, root: str) -> Callable[[DataFrame], DataFrame]:
        def compute(files: DataFrame) -> DataFrame:
            named = files.withColumn("file", F.concat(F.lit(root + "/"), F.col("path")))
            still = named.where("kind = 'image'")
            found = media.video_rows(named.where("kind = 'video'"), self.frame, lambda _: (0, 0, 0.0)).select("path", "phash", "dhash")
            paths = [r.file for r in still.select("file").collect()]  # the image source takes a list of paths
            if not paths:
                return found
            pixels = media.image_signatures(media.image_rows(self.spark, paths))
            by = pixels.withColumn("path", _below(root))
            return found.unionByName(by.select("path", "phash", "dhash"))

        return compute

    def _dimensions(self, root: str) -> Callable[[DataFrame], DataFrame]:
        def compute(files: DataFrame) -> DataFrame:
            named = files.withColumn("file", F.concat(F.lit(root + "/"), F.col("path")))
            found = media.video_rows(named.where("kind = 'video'"), lambda _: None, self.probe).select("path", "width", "height", "duration")
            paths = [r.file for r in named.where("kind = 'image'").select("file").collect()]
            if not paths:
                return found
            seen = media.image_rows(self.spark, paths).select(F.greatest("width", F.lit(0)).alias("width"), F.greatest("height", F.lit(0)).alias("height"), F.lit(0.0).alias("duration"), "origin")
            by = seen.withColumn("path", _below(root))
            return found.unionByName(by.select("path", "width", "height", "duration"))

        return compute

    # -- scanning ------------------------------------------------------------------------------------------------

    def scan(self, folder: str, progress: Progress | None = None) -> DataFrame:
        """Bring a folder's state up to date and return its results, see ``results``.

        The first scan groups everything. Later ones attach files that are new or have changed, and skip grouping and
        exact copies if there are none. Errors are raised, so that a scheduler sees them.
        """
        tell = progress or (lambda *_: None)
        with self.metrics.timer("scan", {"folder": folder}):
            root, store = self._root(folder), self.store(folder)
            files = self.listing(folder)
            files = self.spark.createDataFrame(files.toPandas(), files.schema)  # one look at the folder for all steps
            total = files.count()
            tell("listing", total, total, "files listed")
            store.cleanup(files)
            fresh = store.missing_hashes(files).select("path", "kind")
            fresh = self.spark.createDataFrame(fresh.collect(), "path string, kind string")
            n_new = fresh.count()
            tell("hashing", 0, n_new, "files to read")
            sigs = store.hashes(files, self._signatures(root))
            store.metadata(files, self._dimensions(root))
            first = not store.has_grouping()
            if first or n_new:
                live = files.select("path")
                if first:
                    rows = grouping.members(sigs, self.threshold).select("rep", "path")
                else:
                    known = store.cached_members(live).select("rep", "path")
                    rows = grouping.incremental(sigs, known, fresh.select("path"), self.threshold)
                tell("grouping", n_new, n_new, "groups found")
                rows = rows.groupBy("rep").agg(F.array_sort(F.collect_list("path")).alias("files"))
                store.put_grouping(rows.where(F.size("files") > 1))
                store.put_groups(store.table("grouping_results").select(group_id(F.col("files")).alias("group_id"), "files"))
            counts = {r.kind: r["count"] for r in files.groupBy("kind").count().collect()}
            for kind in ("image", "video"):
                self.metrics.set_gauge(f"{kind}s", counts.get(kind, 0), {"folder": folder})
            out = self.results(folder)
            tell("complete", total, total, "done")
            self.metrics.increment("scans", 1, {"folder": folder})
            return out

    def members(self, folder: str, first_is_best: bool = False) -> DataFrame:
        """Members of the stored groups with metadata, ``is_best`` (a chosen file wins) and ``is_exact``."""
        store, files = self.store(folder), self.listing(folder)
        rows = store.cached_members(files.select("path"))
        meta = store.table("media_metadata").select("path", "width", "height", "duration")
        sigs = store.table("file_hashes").select("path", "phash", "dhash")
        known = rows.join(files.select("path", "kind", "size"), "path").join(meta, "path", "left").join(sigs, "path", "left")
        ids = rows.groupBy("rep").agg(group_id(F.collect_list("path")).alias("group_id"), F.count("*").alias("n")).where("n > 1").drop("n")
        known = known.join(ids, "rep")
        if first_is_best:
            known = known.withColumn("is_best", F.col("pos") == F.min("pos").over(Window.partitionBy("rep")))
        else:
            known = selection.ranked(known, "rep", "pos", F.col("kind") == "video")
        return selection.with_exact(selection.with_overrides(known, store.table("best_files")), "rep", self.exact_rule)

    def results(self, folder: str) -> DataFrame:
        """``(kind, group_id, best_file, duplicate_files)``, nested, for image and for video groups."""
        rows = self.members(folder)
        one = lambda kind, video: selection.result_groups(rows.where(F.col("kind") == kind), video).select(F.lit(kind).alias("kind"), "group_id", F.to_json("best_file").alias("best_file"), F.to_json("duplicate_files").alias("duplicate_files"))
        return one("image", False).unionByName(one("video", True))

    def cached_results(self, folder: str) -> DataFrame | None:
        """Stored results without a scan; None before the first one."""
        return self.results(folder) if self.summary(folder)["status"] != "pending" else None

    def exact_actions(self, folder: str) -> DataFrame:
        """``(dup, best, link)``: exact copies and what they may be replaced by."""
        return acts.replacements(selection.eliminate(self.members(folder))[0].select("dup", "best"))

    def manage(self, folder: str, action: str, group: str, file: str | None = None, dry_run: bool = True) -> list[tuple[str, str, str]]:
        """Carry out a decision on a group (see ``actions.manage``): what is or would be done to each file. The state
        follows what was done."""
        store = self.store(folder)
        rows = acts.manage(self.members(folder).select("group_id", "path", "is_best"), action, group, file)
        if action == "set_best":
            for r in rows.collect():
                store.set_best(group, r.best)
            return []
        done = acts.apply(rows, self._root(folder), dry_run)
        for dup, _, outcome in done:
            if outcome == "replaced":
                store.touch_file(dup, None)
                store.remove_file(dup)
        if action == "process_all" and not dry_run:
            store.mark_processed(group)
        return done

    # -- state ---------------------------------------------------------------------------------------------------

    def summary(self, folder: str) -> dict:
        return read_summary(self.spark, f"{self.state_dir}/{folder}", folders.content_mtime(self._root(folder)))

    def stats(self, folder: str) -> dict:
        return self.store(folder).stats(self.listing(folder).select("path"))

    def invalidate(self, folder: str) -> None:
        self.store(folder).invalidate()

    def extensions(self, folder: str) -> DataFrame:
        return self.listing(folder).groupBy(extension(F.col("path")).alias("extension")).count()
