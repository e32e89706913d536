"""Queries on the state store, links, scheduler relations, kinds and picture hashes, over the parquet tables.

Documents stand for files: the path is the number, the size ``n_chars``. A store is opened in the shared scratch folder
for each query and filled by the operations that the query is named for.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import imagehash
from kinfold.functions.signatures import group_id
from kinfold.operators import actions, grouping, simjoin
from kinfold.plans.oracle import D, SG, STATES
from kinfold.runtime import _remove, materialize, scratch_root, table
from kinfold.sources import tables
from kinfold.state import StateStore
from kinfold.streaming import scheduler

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _store(spark: SparkSession, path: str | None = None, **kwargs) -> StateStore:
    path = path or f"{scratch_root(spark)}/kinfold-store-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return StateStore(spark, path, **kwargs)


def _files(spark: SparkSession, d: str) -> DataFrame:
    """``(path, mtime, size)`` of the documents."""
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(1.0).alias("mtime"), F.coalesce("n_chars", F.lit(0)).alias("size"))


def _known(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as stored rows; those of quality 0 had another size then."""
    quality = table(spark, d, "labels").where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("path")).agg(F.max(F.coalesce("quality", F.lit(0))).alias("quality"))
    return _files(spark, d).join(quality, "path").select("path", "mtime", (F.col("size") + 1 - F.col("quality")).alias("size"))


def _number() -> F.Column:
    return F.col("path").cast("long")


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.select("path", _number().alias("phash"), F.col("size").alias("dhash"), "mtime", "size")


_KNOWN = "f AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS path, coalesce(n_chars, 0) AS size FROM documents), k AS (SELECT doc_id, max(coalesce(quality, 0)) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id)"


@query(f"""WITH {_KNOWN} SELECT path, CASE WHEN quality = 1 THEN f.doc_id ELSE -f.doc_id END AS phash, CASE WHEN quality = 1 THEN size ELSE 7 END AS dhash FROM f LEFT JOIN k USING (doc_id)
    WHERE quality = 1 OR f.doc_id % 10 <> 9""")
def store_read_through(spark, d):
    """Stored signatures where they still hold, computed ones elsewhere; files that cannot be read have none."""
    store = _store(spark)
    store.put_hashes(_hashed(_known(spark, d)))
    compute = lambda misses: misses.select("path", F.when(_number() % 10 != 9, -_number()).alias("phash"), F.lit(7).cast("long").alias("dhash"))
    return store.hashes(_files(spark, d), compute).select("path", "phash", "dhash")


@query(f"""WITH {_KNOWN} SELECT path, CASE WHEN quality = 1 THEN 4 WHEN f.doc_id % 7 = 0 THEN 0 ELSE 8 END AS width, CASE WHEN quality = 1 THEN 3 WHEN f.doc_id % 7 = 0 THEN 0 ELSE 6 END AS height,
    CASE WHEN quality = 1 THEN 0.5::DOUBLE WHEN f.doc_id % 7 = 0 THEN 0 ELSE 1.5::DOUBLE END AS duration FROM f LEFT JOIN k USING (doc_id)""")
def store_metadata(spark, d):
    """Stored dimensions where they still hold, computed ones elsewhere, zeros where nothing is known."""
    store = _store(spark)
    store.put_metadata(_known(spark, d).select("path", F.lit(4).alias("width"), F.lit(3).alias("height"), F.lit(0.5).alias("duration"), "mtime", "size"))
    compute = lambda misses: misses.where(_number() % 7 != 0).select("path", F.lit(8).alias("width"), F.lit(6).alias("height"), F.lit(1.5).alias("duration"))
    return store.metadata(_files(spark, d), compute).select("path", "width", "height", "duration")


def _groups(spark: SparkSession, d: str, by: str) -> DataFrame:
    """``(name, rep, files)`` of the documents by a column."""
    rows = table(spark, d, "documents").select(F.coalesce(by, F.lit("")).alias("name"), "doc_id")
    packed = rows.groupBy("name").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return packed.select("name", F.transform("ids", lambda i: i.cast("string")).alias("files")).withColumn("rep", F.element_at("files", 1))


_LIVE = "CAST(doc_id AS VARCHAR) IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"


@query(f"""WITH g AS (SELECT coalesce(lang, '') AS name, min(doc_id) AS rep FROM documents GROUP BY 1)
    SELECT CAST(g.rep AS VARCHAR) AS rep, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS files FROM documents JOIN g ON name = coalesce(lang, '') WHERE {_LIVE} GROUP BY 1""")
def store_grouping(spark, d):
    """A grouping replaces the one before it; files that are gone are left out of what is read."""
    store = _store(spark)
    store.put_grouping(_groups(spark, d, "source").select("rep", "files"))
    store.put_grouping(_groups(spark, d, "lang").select("rep", "files"))
    live = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("path"))
    return store.cached_groups(live).select("rep", F.array_join("files", ",").alias("files"))


@query("""WITH s AS (SELECT coalesce(source, '') AS name, doc_id FROM documents), o AS (SELECT DISTINCT name FROM s), f AS (SELECT min(name) AS low, max(name) AS high FROM o)
    SELECT name AS group_id, count(*) FILTER (name <> high OR doc_id % 2 = 0) AS n, name = low AS processed FROM s, f GROUP BY name, low, high""")
def store_groups_upsert(spark, d):
    """Groups are replaced by their id and keep the mark that they were dealt with."""
    store, groups = _store(spark), materialize(_groups(spark, d, "source").withColumnRenamed("name", "group_id"), "groups")
    store.put_groups(groups)
    names = groups.agg(F.min("group_id").alias("low"), F.max("group_id").alias("high")).first()
    store.mark_processed(names.low)
    store.put_groups(groups.where(F.col("group_id") == names.low))
    store.put_groups(groups.where(F.col("group_id") == names.high).withColumn("files", F.filter("files", lambda f: f.cast("long") % 2 == 0)))
    return store.table("groups").select("group_id", F.size("files").cast("long").alias("n"), "processed")


@query("SELECT min(coalesce(source, '')) AS group_id, 'second' AS best_file FROM documents UNION ALL SELECT max(coalesce(source, '')) || '-', 'only' FROM documents")
def store_best(spark, d):
    """The latest choice of each group stands."""
    store = _store(spark)
    names = _groups(spark, d, "source").agg(F.min("name").alias("low"), F.max("name").alias("high")).first()
    store.set_best(names.low, "first")
    store.set_best(names.high + "-", "only")
    store.set_best(names.low, "second")
    return store.table("best_files").select("group_id", "best_file")


@query(f"WITH {_KNOWN}, o AS (SELECT min(doc_id) AS low, max(doc_id) AS high FROM f) SELECT path, CASE WHEN doc_id = low THEN 2.0::DOUBLE ELSE 1 END AS mtime, CASE WHEN doc_id = low THEN 5 ELSE size END AS size FROM f, o WHERE doc_id <> high")
def store_touch_delete(spark, d):
    """One file has a new time and size, one is forgotten."""
    store, files = _store(spark), _files(spark, d)
    store.put_hashes(_hashed(files))
    ends = files.agg(F.min(_number()).alias("low"), F.max(_number()).alias("high")).first()
    store.touch_file(str(ends.low), (2.0, 5))
    store.touch_file(str(ends.high), None)
    return store.table("file_hashes").select("path", "mtime", "size")


def _filled(spark: SparkSession, d: str) -> StateStore:
    store = _store(spark)
    store.put_hashes(_hashed(_files(spark, d)))
    store.put_metadata(_known(spark, d).select("path", F.lit(4).alias("width"), F.lit(3).alias("height"), F.lit(0.5).alias("duration"), "mtime", "size"))
    store.put_grouping(_groups(spark, d, "lang").select("rep", "files"))
    store.put_groups(_groups(spark, d, "lang").select(F.col("name").alias("group_id"), "files"))
    store.set_best("g", "1")
    return store


def _counts(spark: SparkSession, store: StateStore, step: str) -> DataFrame:
    out = None
    for name in ("file_hashes", "media_metadata", "grouping_results", "groups", "best_files"):
        rows = store.table(name).agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), F.lit(name).alias("name"), "n", F.lit(store.has_grouping()).alias("grouped"))
        out = rows if out is None else out.unionAll(rows)
    return out


_STORED = f"WITH {_KNOWN}, n AS (SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM f JOIN k USING (doc_id)) AS known, (SELECT count(DISTINCT coalesce(lang, '')) FROM documents) AS langs)"


def _counted(step: str, grouped: bool, *counts: str) -> str:
    names = ("file_hashes", "media_metadata", "grouping_results", "groups", "best_files")
    return " UNION ALL ".join(f"SELECT '{step}' AS step, '{n}' AS name, CAST({c} AS BIGINT) AS n, {str(grouped).lower()} AS grouped FROM n" for n, c in zip(names, counts, strict=True))


@query(f"{_STORED} {_counted('filled', True, 'files', 'known', 'langs', 'langs', '1')} UNION ALL {_counted('regroup', False, 'files', 'known', '0', 'langs', '1')} UNION ALL {_counted('invalidate', False, '0', 'known', '0', '0', '0')} UNION ALL {_counted('reset', False, '0', '0', '0', '0', '0')}")
def store_invalidate(spark, d):
    """What is left after a grouping, all derived tables, and the whole state are forgotten."""
    store = _filled(spark, d)
    out = _counts(spark, store, "filled")
    store.invalidate_grouping()
    out = out.unionAll(_counts(spark, store, "regroup"))
    store.invalidate()
    out = out.unionAll(_counts(spark, store, "invalidate"))
    store.reset()
    return out.unionAll(_counts(spark, store, "reset"))


@query(f"{_STORED} {_counted('again', True, 'files', 'known', 'langs', 'langs', '1')} UNION ALL {_counted('newer', False, '0', 'known', '0', '0', '0')}")
def store_reopen(spark, d):
    """A state that is opened again is as it was; one of another version keeps the dimensions only."""
    store = _filled(spark, d)
    again = _counts(spark, _store(spark, store.path), "again")
    return again.unionAll(_counts(spark, _store(spark, store.path, version="other"), "newer"))


@query("""WITH g AS (SELECT coalesce(lang, '') AS name, min(doc_id) AS rep FROM documents GROUP BY 1)
    SELECT substr(md5(string_agg(DISTINCT CAST(doc_id AS VARCHAR), '|' ORDER BY CAST(doc_id AS VARCHAR))), 1, 8) AS group_id, count(*) AS n FROM documents WHERE coalesce(lang, '') = (SELECT name FROM g ORDER BY rep LIMIT 1)""")
def store_group_lookup(spark, d):
    """The files of a group by the id that its members give."""
    store = _store(spark)
    store.put_grouping(_groups(spark, d, "lang").select("rep", "files"))
    first = store.table("grouping_results").orderBy(F.col("rep").cast("long")).select(group_id(F.col("files")).alias("id")).first().id
    return spark.createDataFrame([(first, f) for f in store.group_files(first)], "group_id string, file string").groupBy("group_id").agg(F.count("*").alias("n"))


# -- links ---------------------------------------------------------------------------------------------------------

_LINKS = """a AS (SELECT doc_id, coalesce(lang, '') || '/' || doc_id AS path FROM documents),
l AS (SELECT a.path, t.path AS target FROM a LEFT JOIN a t ON a.doc_id % 10 = 3 AND t.doc_id = a.doc_id - 3), x AS (SELECT a.path AS dup, b.path AS best FROM a JOIN a b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 20 = 0)"""


def _links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A listing in which every tenth document is a link to the one three before it, and replacements of every twentieth."""
    a = materialize(tables.document_assets(table(spark, d, "documents")).select("doc_id", "path"), "paths")
    to = a.select((F.col("doc_id") + 3).alias("doc_id"), F.col("path").alias("target")).where("doc_id % 10 = 3")
    best = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("best"))
    return a.join(to, "doc_id", "left").select("path", "target"), a.where("doc_id % 20 = 0").join(best, "doc_id").select(F.col("path").alias("dup"), "best")


@query(f"""WITH {_LINKS} SELECT l.path AS dup, x.best, CASE WHEN split_part(l.path, '/', 1) = split_part(best, '/', 1) THEN split_part(best, '/', 2) ELSE '../' || best END AS link FROM l JOIN x ON l.target = x.dup""")
def relinked(spark, d):
    """Links to files that are about to be replaced, pointed to the best."""
    return actions.relinks(*_links(spark, d))


@query(f"WITH {_LINKS} SELECT path FROM l WHERE target = (SELECT path FROM a WHERE doc_id = 10)")
def links_to_target(spark, d):
    listing, _ = _links(spark, d)
    target = tables.document_assets(table(spark, d, "documents")).where("doc_id = 10").first()
    return actions.links_to(listing, target.path if target else "")


# -- scheduler -----------------------------------------------------------------------------------------------------


def _scanning(spark: SparkSession, d: str) -> DataFrame:
    from kinfold.plans.catalogue import _states

    return _states(spark, d).withColumn("status", F.when(F.pmod("folder", F.lit(5)) == 0, "scanning").otherwise(F.col("status")))


@query(f"WITH {STATES} SELECT folder, last_scan FROM s WHERE folder % 5 = 0 AND 2592000 - last_scan > 3600")
def timed_out_scans(spark, d):
    return scheduler.timed_out(_scanning(spark, d), 2592000.0).select("folder", "last_scan")


@query(f"WITH {STATES} SELECT folder, CASE WHEN folder = 7 THEN true ELSE held END AS held FROM s")
def user_holds(spark, d):
    """A user's scan takes a folder from the scheduler, but not one that is being scanned."""
    states = scheduler.hold(scheduler.hold(_scanning(spark, d), 7, True), 5, True)
    return states.select("folder", "held")


@query("SELECT DISTINCT user_id AS folder, user_id <> 7 AS asked FROM events WHERE event_type = 'error' OR user_id = 7")
def refresh_flags(spark, d):
    """Asking for a folder's flag takes it away and leaves the others."""
    flags = materialize(table(spark, d, "events").where("event_type = 'error' or user_id = 7").select(F.col("user_id").alias("folder")).distinct(), "flags")
    asked, left = scheduler.take_refresh(flags, 7)
    again, _ = scheduler.take_refresh(left, 7)
    mine = spark.createDataFrame([(7, again)] if asked else [], "folder long, asked boolean")
    return left.select("folder", F.lit(True).alias("asked")).unionByName(mine)


@query("""WITH d AS (SELECT DISTINCT coalesce(source, '') AS folder FROM documents), s AS (SELECT coalesce(lang, '') AS folder, count(*)::DOUBLE AS last_updated FROM documents GROUP BY 1)
    SELECT folder, coalesce(CASE WHEN last_updated > 100 THEN 'complete' WHEN last_updated IS NOT NULL THEN 'stale' END, 'pending') AS status, coalesce(last_updated, 0::DOUBLE) AS last_scan
    FROM (SELECT folder FROM d UNION SELECT folder FROM s WHERE last_updated > 50) LEFT JOIN s USING (folder)""")
def first_states(spark, d):
    """What the stored summaries say of folders, pending without one."""
    docs = table(spark, d, "documents")
    stored = docs.groupBy(F.coalesce("lang", F.lit("")).alias("folder")).agg(F.count("*").cast("double").alias("last_updated")).withColumn("status", F.when(F.col("last_updated") > 100, "complete").otherwise("stale"))
    folders = docs.select(F.coalesce("source", F.lit("")).alias("folder")).union(stored.where("last_updated > 50").select("folder")).distinct()
    return scheduler.from_summaries(folders, stored)


@query(f"WITH {STATES} SELECT folder, CASE WHEN failures + 1 >= 3 THEN 'error' ELSE 'pending' END AS status, failures, last_failure + CASE WHEN failures <= 0 THEN 0 WHEN status = 'error' THEN least(300 * pow(2, failures), 3600) ELSE 300 * pow(2, failures - 1) END AS at FROM s")
def next_tries(spark, d):
    """The status after one more failure and when the folder is tried again."""
    from kinfold.plans.catalogue import _states

    s, f = F.col("status"), F.col("failures")
    return _states(spark, d).select("folder", scheduler.after_failure(s, f).alias("status"), f.cast("long").alias("failures"), scheduler.next_try(s, f, F.col("last_failure")).alias("at"))


# -- kinds, signatures ---------------------------------------------------------------------------------------------


@query(f"""{SG}, nd AS (SELECT doc_id % 2 AS k, phash, dhash, min(doc_id) AS id FROM sg WHERE phash IS NOT NULL GROUP BY ALL),
    ed AS (SELECT a.id AS x, b.id AS y FROM nd a JOIN nd b ON a.k = b.k AND a.id <> b.id AND {D} <= 5),
    rc AS (SELECT id AS x, id AS r FROM nd UNION SELECT ed.x, rc.r FROM rc JOIN ed ON ed.y = rc.x), cc AS (SELECT x AS id, min(r) AS rep FROM rc GROUP BY x),
    ms AS (SELECT cc.rep, nd.k, sg.doc_id FROM sg JOIN nd ON sg.phash = nd.phash AND sg.dhash = nd.dhash AND sg.doc_id % 2 = nd.k JOIN cc ON cc.id = nd.id)
    SELECT CASE k WHEN 0 THEN 'image' ELSE 'video' END AS kind, rep, doc_id FROM ms WHERE rep IN (SELECT rep FROM ms GROUP BY rep HAVING count(*) > 1)""")
def kind_groups(spark, d):
    """Groups of two kinds of assets side by side: no group has members of both."""
    sigs = materialize(tables.document_signatures(table(spark, d, "documents")), "signatures").withColumn("kind", F.when(F.col("doc_id") % 2 == 0, "image").otherwise("video"))
    return grouping.members(sigs, path="doc_id").select("kind", "rep", F.col("path").alias("doc_id"))


@query(f"{SG} SELECT a.doc_id AS a, b.doc_id AS b, CAST({D} AS INTEGER) AS distance FROM sg a JOIN sg b ON a.doc_id < b.doc_id AND {D} < 5")
def dup_pairs_strict(spark, d):
    """Pairs of assets less than five bits apart."""
    return simjoin.similar_pairs(materialize(tables.document_signatures(table(spark, d, "documents")), "signatures"), t=4, path="doc_id")


_PIXEL = "CAST(floor((({0} + 40) * ({1} + 3) + ({2} + 35) * ({3} + 7)) % 256) AS INTEGER)"
_TWOS = "CAST(CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END AS BIGINT)"


@query(f"""WITH e AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings WHERE len(embedding) = 64),
    g AS (SELECT vec_id, r, c, {_PIXEL.format("e[(r * 7 + c * 3) % 64 + 1]", "r", "e[(r + c * 5) % 64 + 1]", "c")} AS x FROM e, range(32) a(r), range(32) b(c)),
    h AS (SELECT vec_id, r, u, sum(x * cos(pi() * u * (2 * c + 1) / 64)) AS x FROM g, range(8) t(u) GROUP BY ALL),
    f AS (SELECT vec_id, u, w, sum(x * cos(pi() * w * (2 * r + 1) / 64)) AS x FROM h, range(8) t(w) GROUP BY ALL),
    m AS (SELECT vec_id, median(x) AS m FROM f GROUP BY 1),
    p AS (SELECT vec_id, sum(CASE WHEN x > m THEN pow(2::HUGEINT, 63 - 8 * w - u)::HUGEINT ELSE 0 END) AS v FROM f JOIN m USING (vec_id) GROUP BY 1),
    q AS (SELECT a.vec_id, sum(CASE WHEN b.x > a.x THEN pow(2::HUGEINT, 63 - 8 * a.r - a.c)::HUGEINT ELSE 0 END) AS v FROM g a JOIN g b ON a.vec_id = b.vec_id AND a.r = b.r AND b.c = a.c + 1 WHERE a.r < 8 AND a.c < 8 GROUP BY 1)
    SELECT vec_id, {_TWOS.replace("v ", "p.v ").replace("ELSE v", "ELSE p.v")} AS phash, {_TWOS.replace("v ", "q.v ").replace("ELSE v", "ELSE q.v")} AS dhash FROM p JOIN q USING (vec_id)""")
def picture_hashes(spark, d):
    """The two hashes of small grey pictures: a 32 x 32 and a 9 x 8 one made of the numbers of each vector."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, c = np.arange(32)[:, None], np.arange(32)[None, :]
        for b in it:
            found = []
            for e in b.column(1).to_pylist():
                e = np.floor(64 * np.array(e, np.float64)).astype(np.int64)
                grey = np.fmod((e[(r * 7 + c * 3) % 64] + 40) * (r + 3) + (e[(r + c * 5) % 64] + 35) * (c + 7), 256).astype(np.float64)
                found.append((imagehash.phash(grey), imagehash.dhash(grey[:8, :9])))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in found], pa.int64()) for i in (0, 1))], ["vec_id", "phash", "dhash"])

    return table(spark, d, "embeddings").where("size(embedding) = 64").select("vec_id", "embedding").mapInArrow(run, "vec_id long, phash long, dhash long")
