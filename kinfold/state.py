"""The state of a folder: fingerprints, metadata, groups and choices, kept as versioned parquet tables.

A state lives under one path of any file system that Spark reads. Each table version is a directory of its own; a pointer
file names the version of each table and holds the meta values. Pointers are numbered, the highest that can be read is the
state. A change writes new directories first and then the next pointer, which must not exist yet: nothing is replaced or
deleted, so readers see the state before or after it and never between, and a writer that dies leaves a directory that
nobody names or a broken pointer, behind which the one before still stands. Only a state of which no pointer can be parsed
counts as damaged and is started anew; a file system that fails raises.

Of two writers the second finds its number taken and puts its tables on top of the first one's. Those of one process share
one store for a path (``StateStore.of``) and take turns.
"""

from __future__ import annotations

import functools
import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.signatures import group_id
from kinfold.schema import STATE_TABLES, STATE_VERSION

#: Tables that a version change empties. Dimensions do not depend on how signatures are made and stay.
VERSIONED = ("file_hashes", "grouping_results", "best_files", "groups")


def unchanged(stored: str = "c", listed: str = "f") -> Column:
    """Whether a stored row still describes a listed file: equal time of change and size."""
    return (F.col(f"{stored}.mtime") == F.col(f"{listed}.mtime")) & (F.col(f"{stored}.size") == F.col(f"{listed}.size"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key. Keys must be unique in ``new``."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def _changing(method):
    """A method that changes the state: one at a time, on top of its newest version."""

    @functools.wraps(method)
    def run(self, *args, **kwargs):
        with self._lock:
            self._refresh()
            return method(self, *args, **kwargs)

    return run


class StateStore:
    """The state at a path. Writers of one process should share it by ``of``; readers need no lock."""

    _shared: dict[tuple, StateStore] = {}
    _sharing = threading.Lock()

    def __init__(self, spark: SparkSession, path: str, version: str = STATE_VERSION, now: Callable[[], float] = time.time):
        self.spark, self.path, self.version, self.now = spark, path.rstrip("/"), version, now
        self._lock = threading.RLock()
        self._pointer: dict = {}
        self._number = 0
        self._load()

    @classmethod
    def of(cls, spark: SparkSession, path: str, version: str = STATE_VERSION) -> StateStore:
        """The one store of this process for a path, however the path is written."""
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        whole = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
        with cls._sharing:
            key = (spark.sparkContext.applicationId, whole, version)
            if key not in cls._shared:
                cls._shared[key] = cls(spark, whole, version)
            return cls._shared[key]

    # -- files ---------------------------------------------------------------------------------------------------

    def _fs(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def _numbers(self) -> list[int]:
        """Numbers of the pointers, the newest first."""
        p, fs, _ = self._fs("pointers")
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def _parsed(self, number: int) -> dict | None:
        """A pointer, or None if it is broken: cut off, no JSON, or naming tables that are not there."""
        p, fs, jvm = self._fs(f"pointers/{number:012d}")
        stream = fs.open(p)
        try:
            text = str(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        try:
            pointer = json.loads(text)
            named = [pointer["tables"][name] for name in STATE_TABLES]
            pointer["meta"]["version"], pointer["meta"]["last_updated"]
        except (ValueError, KeyError, TypeError):
            return None
        return pointer if all(fs.exists(self._fs(at)[0]) for at in named if at) else None

    def _read_pointer(self) -> dict | None:
        """The newest pointer that is whole; None if there is none."""
        for number in self._numbers():
            pointer = self._parsed(number)
            if pointer is not None:
                return pointer
        return None

    def _write_pointer(self, change: Callable[[dict | None], dict]) -> None:
        """Write what ``change`` makes of the newest pointer as the next one; again if another writer was faster."""
        while True:
            numbers = self._numbers()
            pointer = change(self._read_pointer())
            p, fs, _ = self._fs(f"pointers/{(numbers[0] if numbers else 0) + 1:012d}")
            try:
                out = fs.create(p, False)
            except Exception:
                if fs.exists(p):
                    continue
                raise
            try:
                out.write(bytearray(json.dumps(pointer, sort_keys=True).encode()))
            finally:
                out.close()
            self._pointer = pointer
            return

    def _refresh(self) -> None:
        pointer = self._read_pointer()
        if pointer is not None and pointer["meta"]["version"] == self.version:
            self._pointer = pointer

    def _load(self) -> None:
        """Open the state, create an empty one, empty tables of another version, start anew if no pointer is whole."""
        pointer = self._read_pointer()
        if pointer is None:
            stamp = repr(self.now())
            self._write_pointer(lambda _: {"tables": dict.fromkeys(STATE_TABLES), "meta": {"version": self.version, "created": stamp, "last_updated": stamp}})
        elif pointer["meta"]["version"] != self.version:
            pointer["meta"].update(version=self.version, last_updated=repr(self.now()))
            pointer["meta"].pop("grouping_timestamp", None)
            self._write_pointer(lambda _: pointer | {"tables": pointer["tables"] | dict.fromkeys(VERSIONED)})
        else:
            self._pointer = pointer

    # -- tables --------------------------------------------------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        at = self._pointer["tables"][name]
        return self.spark.read.schema(STATE_TABLES[name]).parquet(f"{self.path}/{at}") if at else self.spark.createDataFrame([], STATE_TABLES[name])

    @_changing
    def commit(self, changed: dict[str, DataFrame | None], forget: tuple[str, ...] = (), **meta: str) -> None:
        """Write new versions of some tables (None empties one) and switch to all of them at once; ``meta`` values are
        set, those in ``forget`` dropped."""
        tables: dict[str, str | None] = {}
        for name, df in changed.items():
            tables[name] = None
            if df is not None:
                tables[name] = f"{name}/v={uuid.uuid4().hex}"
                df.write.parquet(f"{self.path}/{tables[name]}")

        def change(newest: dict | None) -> dict:
            base = newest or self._pointer
            kept = {k: v for k, v in base["meta"].items() if k not in forget}
            return {"tables": base["tables"] | tables, "meta": kept | {"last_updated": repr(self.now())} | meta}

        self._write_pointer(change)

    @_changing
    def vacuum(self) -> None:
        """Delete older pointers and table versions that the state no longer names. No reader may be at work on them."""
        for number in self._numbers():
            if self._parsed(number) != self._pointer:
                p, fs, _ = self._fs(f"pointers/{number:012d}")
                fs.delete(p, False)
        used = set(self._pointer["tables"].values())
        for name in STATE_TABLES:
            p, fs, _ = self._fs(name)
            if fs.exists(p):
                for status in fs.listStatus(p):
                    if f"{name}/{status.getPath().getName()}" not in used:
                        fs.delete(status.getPath(), True)

    def meta(self) -> dict[str, str]:
        return dict(self._pointer["meta"])

    # -- fingerprints and metadata -------------------------------------------------------------------------------

    @_changing
    def put_hashes(self, rows: DataFrame) -> None:
        """Insert or replace ``(path, phash, dhash, mtime, size)``."""
        new = rows.withColumn("updated_at", F.lit(self.now()))
        self.commit({"file_hashes": upsert(self.table("file_hashes"), new, "path")})

    @_changing
    def put_metadata(self, rows: DataFrame) -> None:
        """Insert or replace ``(path, width, height, duration, mtime, size)``."""
        new = rows.withColumn("updated_at", F.lit(self.now()))
        self.commit({"media_metadata": upsert(self.table("media_metadata"), new, "path")})

    def valid_hashes(self, listing: DataFrame) -> DataFrame:
        """``listing(path, mtime, size)`` joined with the stored signatures that still describe it."""
        f, c = listing.alias("f"), self.table("file_hashes").alias("c")
        return f.join(c, F.col("f.path") == F.col("c.path")).where(unchanged()).select("f.*", "c.phash", "c.dhash")

    def missing_hashes(self, listing: DataFrame) -> DataFrame:
        """Listed files that have no stored signature or have changed since."""
        f, c = listing.alias("f"), self.table("file_hashes").alias("c")
        return f.join(c, (F.col("f.path") == F.col("c.path")) & unchanged(), "left_anti")

    def hashes(self, listing: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Signatures of all listed files: stored ones where valid, otherwise from ``compute(files)``, which returns
        ``(path, phash, dhash)`` and sees the misses only. What it finds is stored."""
        misses = self.missing_hashes(listing)
        if not misses.isEmpty():
            found = compute(misses).where("phash is not null").join(misses.select("path", "mtime", "size"), "path")
            self.put_hashes(found.select("path", "phash", "dhash", "mtime", "size"))
        return self.valid_hashes(listing)

    def metadata(self, listing: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``(path, width, height, duration)`` of all listed files, stored or from ``compute``; zeros where unknown."""
        f, c = listing.alias("f"), self.table("media_metadata").alias("c")
        on = (F.col("f.path") == F.col("c.path")) & unchanged()
        misses = f.join(c, on, "left_anti")
        if not misses.isEmpty():
            found = misses.join(compute(misses).select("path", "width", "height", "duration"), "path", "left").fillna(0, ["width", "height", "duration"])
            self.put_metadata(found.select("path", "width", "height", "duration", "mtime", "size"))
            c = self.table("media_metadata").alias("c")
        return listing.alias("f").join(c, on).select("f.*", "c.width", "c.height", "c.duration")

    @_changing
    def touch_file(self, path: str, stat: tuple[float, int] | None) -> None:
        """Note a file's new time and size, or forget it where ``stat`` is None."""
        tables = {}
        for name in ("file_hashes", "media_metadata") if stat is None else ("file_hashes",):
            rows, mine = self.table(name), F.col("path") == path
            if stat is None:
                tables[name] = rows.where(~mine)
            else:
                tables[name] = rows.withColumn("mtime", F.when(mine, stat[0]).otherwise(F.col("mtime"))).withColumn("size", F.when(mine, stat[1]).otherwise(F.col("size")))
        self.commit(tables)

    @_changing
    def cleanup(self, listing: DataFrame) -> None:
        """Forget files that are not listed any more."""
        live = listing.select("path")
        self.commit({n: self.table(n).join(live, "path", "left_semi").select(*self.table(n).columns) for n in ("file_hashes", "media_metadata")})

    # -- groups --------------------------------------------------------------------------------------------------

    @_changing
    def put_grouping(self, groups: DataFrame) -> None:
        """Replace the grouping by ``(rep, files)``; an empty one counts as a grouping, too."""
        now = self.now()
        self.commit({"grouping_results": groups.select("rep", "files", F.lit(now).alias("updated_at"))}, grouping_timestamp=repr(now))

    def has_grouping(self) -> bool:
        return "grouping_timestamp" in self._pointer["meta"]

    def grouping_timestamp(self) -> float:
        return float(self._pointer["meta"].get("grouping_timestamp", 0.0))

    def cached_members(self, live: DataFrame) -> DataFrame:
        """``(rep, pos, path)`` of stored groups, without files that ``live(path)`` does not have."""
        rows = self.table("grouping_results").select("rep", F.posexplode("files").alias("pos", "path"))
        return rows.join(live.select("path").distinct(), "path", "left_semi").select("rep", "pos", "path")

    def cached_groups(self, live: DataFrame) -> DataFrame:
        """``(rep, files)`` in stored order; groups without a live file are dropped, the name stays if its file is gone."""
        rows = self.cached_members(live).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("f"))
        return rows.select("rep", F.transform("f", lambda x: x["path"]).alias("files"))

    @_changing
    def put_groups(self, groups: DataFrame) -> None:
        """Insert or replace ``(group_id, files)``. A group that is known keeps its processed mark."""
        old = self.table("groups")
        kept = old.select("group_id", "processed")
        new = groups.select("group_id", "files").join(kept, "group_id", "left").select("group_id", "files", F.coalesce("processed", F.lit(False)).alias("processed"), F.lit(self.now()).alias("updated_at"))
        self.commit({"groups": upsert(old, new, "group_id")})

    @_changing
    def mark_processed(self, group: str) -> None:
        mine = F.col("group_id") == group
        rows = self.table("groups")
        self.commit({"groups": rows.withColumn("processed", mine | F.col("processed")).withColumn("updated_at", F.when(mine, self.now()).otherwise(F.col("updated_at")))})

    def group_ids(self) -> DataFrame:
        return self.table("groups").select("group_id")

    def group_files(self, group: str) -> list[str]:
        """The files of a group by its id, or by the id that the files of a stored grouping give."""
        row = self.table("groups").where(F.col("group_id") == group).select("files").first()
        if row is None:
            row = self.table("grouping_results").where(group_id(F.col("files")) == group).select("files").first()
        return list(row.files) if row else []

    @_changing
    def set_best(self, group: str, file: str) -> None:
        new = self.spark.createDataFrame([(group, file, self.now())], STATE_TABLES["best_files"])
        self.commit({"best_files": upsert(self.table("best_files"), new, "group_id")})

    def get_best(self, group: str) -> str | None:
        row = self.table("best_files").where(F.col("group_id") == group).select("best_file").first()
        return row.best_file if row else None

    @_changing
    def remove_file(self, path: str) -> None:
        """Take a file out of all groups and drop groups that become empty."""
        tables = {}
        for name in ("grouping_results", "groups"):
            rows = self.table(name)
            tables[name] = rows.withColumn("files", F.filter("files", lambda f: f != path)).where(F.size("files") > 0)
        self.commit(tables)

    # -- whole state ---------------------------------------------------------------------------------------------

    @_changing
    def invalidate(self) -> None:
        """Forget fingerprints, groupings and choices."""
        self.commit(dict.fromkeys(VERSIONED), ("grouping_timestamp",))

    @_changing
    def invalidate_grouping(self) -> None:
        self.commit({"grouping_results": None}, ("grouping_timestamp",))

    @_changing
    def reset(self) -> None:
        """Empty every table."""
        self.commit(dict.fromkeys(STATE_TABLES), ("grouping_timestamp",))

    def save(self) -> None:
        self.commit({})

    def size_bytes(self) -> int:
        total = 0
        for at in self._pointer["tables"].values():
            if at:
                p, fs, _ = self._fs(at)
                total += fs.getContentSummary(p).getLength()
        return total

    def stats(self, live: DataFrame | None = None) -> dict:
        """Counts of the state; ``remaining_files`` are members of groups that ``live`` still has."""
        rows = self.table("grouping_results").agg(F.count("*").alias("groups"), F.count_if(F.size("files") > 1).alias("duplicate_groups")).first()
        remaining = self.cached_members(live).count() if live is not None else self.table("grouping_results").agg(F.sum(F.size("files"))).first()[0] or 0
        return {
            "total_files": self.table("file_hashes").count(), "total_groups": rows.groups, "duplicate_groups": rows.duplicate_groups,
            "processed_groups": self.table("groups").where("processed").count(), "remaining_files": remaining,
            "size_mb": self.size_bytes() / 1048576.0, "created": float(self.meta()["created"]), "last_updated": float(self.meta()["last_updated"]),
        }


def read_summary(spark: SparkSession, path: str, folder_mtime: float | None = None, version: str = STATE_VERSION) -> dict:
    """What a folder's state says without opening it for work: ``status`` pending, complete or stale, and counts. A
    missing or damaged state, one of another version and one without a grouping are pending; nothing is written."""
    store = StateStore.__new__(StateStore)
    store.spark, store.path, store.version, store._pointer = spark, path.rstrip("/"), version, None
    empty = {"status": "pending", "file_count": 0, "duplicate_count": 0, "last_updated": 0.0}
    pointer = store._read_pointer()
    if pointer is None or pointer.get("meta", {}).get("version") != version or "grouping_timestamp" not in pointer["meta"]:
        return empty
    store._pointer = pointer
    row = store.table("grouping_results").agg(F.sum(F.size("files")).alias("files"), F.count_if(F.size("files") > 1).alias("groups")).first()
    updated = float(pointer["meta"].get("last_updated", 0.0))
    stale = folder_mtime is not None and folder_mtime > updated
    return {"status": "stale" if stale else "complete", "file_count": row.files or 0, "duplicate_count": row.groups, "last_updated": updated}
