"""Named queries of the engine over the parquet tables. ``oracle`` has DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.functions import labels as L
from kinfold.functions.signatures import from_hex, group_id, to_hex
from kinfold.operators import actions, grouping, selection, simjoin
from kinfold.plans import oracle
from kinfold.runtime import materialize, table
from kinfold.sources import tables
from kinfold.state import unchanged, upsert
from kinfold.streaming import metrics, scheduler

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    if f.__name__ in oracle.SQL:
        ORACLE_SQL[f.__name__] = oracle.SQL[f.__name__]
    return f


# -- relations that several queries start from ---------------------------------------------------------------------


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _sigs(spark: SparkSession, d: str) -> DataFrame:
    return materialize(tables.document_signatures(_docs(spark, d)), "signatures")


def _members(spark: SparkSession, d: str) -> DataFrame:
    """``(rep, doc_id, equal)`` of all groups."""
    return materialize(grouping.members(_sigs(spark, d), path="doc_id").select("rep", F.col("path").alias("doc_id"), "equal"), "members")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Members with dimensions, ``path`` their number, is_best and is_exact."""
    assets = tables.document_assets(_docs(spark, d)).select("doc_id", "width", "height", "size")
    rows = _members(spark, d).join(assets.hint("merge"), "doc_id").withColumn("path", F.col("doc_id"))
    return selection.with_exact(selection.ranked(rows))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Metric events out of the events table: whole values, so that sums do not depend on their order."""
    kind = F.when(F.col("event_type").isin("click", "view"), "counter").when(F.col("event_type") == "purchase", "gauge").otherwise("timer")
    user = F.create_map(F.lit("u"), F.pmod("user_id", F.lit(50)).cast("string"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", kind.alias("kind"), F.col("event_type").alias("name"), user.alias("tags"), F.floor(F.col("value") * 100).cast("double").alias("value"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("folder"), "ts", F.col("event_id").alias("id"))


def _states(spark: SparkSession, d: str) -> DataFrame:
    """A scheduler state out of the events of each user, times in seconds from the first event of all."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    first = e.agg(F.min("us").alias("zero"))
    e = e.join(F.broadcast(first)).withColumn("at", (F.col("us") - F.col("zero")) / 1e6)
    order = F.struct("us", "event_id")
    last = lambda t: F.coalesce(F.max(F.when(F.col("event_type") == t, F.col("at"))), F.lit(0.0))
    rows = e.groupBy(F.col("user_id").alias("folder")).agg(
        F.max_by("event_type", order).alias("t"), last("view").alias("mtime"), last("purchase").alias("last_scan"), last("view").alias("last_change"),
        F.pmod(F.count_if(F.col("event_type") == "error"), F.lit(4)).cast("int").alias("failures"), last("error").alias("last_failure"), F.max("at").alias("enqueued_at"),
    )
    status = F.when(F.col("t") == "error", "error").when(F.col("t") == "view", "stale").when(F.col("t") == "purchase", "complete").otherwise("pending")
    third = F.pmod("folder", F.lit(3)) == 0
    return rows.select("folder", status.alias("status"), "mtime", F.lit(None).cast("double").alias("last_seen"), "last_scan", "last_change", "failures", "last_failure", (F.pmod("folder", F.lit(11)) == 0).alias("held"), third.alias("queued"), F.when(third, F.col("enqueued_at")).alias("enqueued_at"), F.when(third, F.pmod("folder", F.lit(4)).cast("int")).alias("priority"))


# -- signatures and joins ------------------------------------------------------------------------------------------


@query
def sig_text(spark, d):
    return tables.document_signatures(_docs(spark, d))


@query
def sig_vector(spark, d):
    return tables.embedding_signatures(table(spark, d, "embeddings"))


@query
def hash_hex_roundtrip(spark, d):
    s = tables.document_signatures(_docs(spark, d)).where("phash is not null").withColumn("hex", to_hex(F.col("phash"), F.col("dhash")))
    p, q = from_hex(F.col("hex"))
    old_p, old_q = from_hex(F.substring("hex", 1, 16))
    return s.select("doc_id", "hex", p.alias("phash"), q.alias("dhash"), (old_p == old_q).alias("legacy_both"), old_q.alias("legacy"))


@query
def dup_pairs_dual(spark, d):
    return simjoin.similar_pairs(_sigs(spark, d), path="doc_id")


@query
def dup_pairs_phash_only(spark, d):
    return simjoin.similar_pairs(_sigs(spark, d), path="doc_id", phash_only=True)


@query
def vec_pairs_within(spark, d):
    return simjoin.similar_pairs(materialize(tables.embedding_signatures(table(spark, d, "embeddings")), "vectors"), t=20, path="vec_id")


@query
def thumb_similarity(spark, d):
    pairs = simjoin.similar_pairs(_sigs(spark, d), t=10, path="doc_id")
    return pairs.select("a", "b", L.similarity(F.col("distance")).alias("similarity"))


@query
def nearest_known(spark, d):
    s = _sigs(spark, d).select(F.col("doc_id").alias("path"), F.lit("text").alias("kind"), "phash", "dhash").where("phash is not null")
    return simjoin.nearest(s.where("path % 2 = 1"), s.where("path % 2 = 0")).select(F.col("path").alias("doc_id"), "near", "distance")


# -- groups --------------------------------------------------------------------------------------------------------


@query
def near_dup_groups(spark, d):
    m = _members(spark, d)
    return m.join(m.groupBy("rep").agg(F.count("*").alias("size")), "rep").select("rep", "doc_id", "size")


@query
def group_kind_counts(spark, d):
    return grouping.kind_counts(grouping.cold(_sigs(spark, d), path="doc_id"))


@query
def group_labels(spark, d):
    return grouping.cold(_sigs(spark, d), path="doc_id").select("rep", "size", "label", F.array_join(F.transform("files", lambda f: f.cast("string")), ",").alias("files"))


@query
def exact_text_groups(spark, d):
    return simjoin.collapse(_sigs(spark, d), "doc_id").where("n > 1").select(F.col("first").alias("rep"), F.col("n").alias("size"))


@query
def group_ids(spark, d):
    m = _members(spark, d)
    return m.groupBy("rep").agg(group_id(F.collect_list(F.col("doc_id").cast("string"))).alias("group_id"), F.count("*").alias("size"))


@query
def incremental_attach(spark, d):
    s = _sigs(spark, d).withColumnRenamed("doc_id", "path")
    known = grouping.members(s.where("path % 2 = 0")).select("rep", "path")
    return grouping.incremental(s, known, s.where("path % 2 = 1").select("path")).select("rep", F.col("path").alias("doc_id"))


@query
def grouping_diff(spark, d):
    m = _members(spark, d).select(F.col("doc_id").alias("path"))
    return grouping.membership_diff(m, table(spark, d, "labels").where("doc_id is not null").select(F.col("doc_id").alias("path")))


# -- the best and the exact ----------------------------------------------------------------------------------------


@query
def group_best(spark, d):
    return _judged(spark, d).where("is_best").select("rep", "doc_id", L.pixel_count(F.col("width"), F.col("height")).alias("pixels"))


@query
def group_members_exact_flag(spark, d):
    return _judged(spark, d).select("rep", "doc_id", "is_best", "is_exact")


@query
def exact_elimination(spark, d):
    act, stay = selection.eliminate(_judged(spark, d))
    return act.select("rep", F.col("dup").alias("doc_id"), F.col("best").alias("best")).unionByName(stay.select("rep", "doc_id", F.lit(None).cast("long").alias("best")))


@query
def best_override(spark, d):
    rows = _judged(spark, d).withColumn("group_id", F.col("rep"))
    chosen = table(spark, d, "labels").where("toxic = 1").select((F.col("doc_id")).alias("best_file"))
    mine = rows.join(chosen, F.col("path") == F.col("best_file")).groupBy("group_id").agg(F.max("best_file").alias("best_file"))
    return selection.with_overrides(rows, mine).where("is_best").select("rep", "doc_id")


@query
def result_json(spark, d):
    rows = _judged(spark, d).withColumn("group_id", F.col("rep"))
    return selection.result_groups(rows).select("group_id", F.to_json("best_file").alias("best_file"), F.to_json("duplicate_files").alias("duplicate_files"))


@query
def best_temporal(spark, d):
    c = tables.conversation_assets(table(spark, d, "conversations")).where("conv_id is not null").withColumn("rep", F.pmod("conv_id", F.lit(20)))
    best = selection.ranked(c, "rep", "conv_id", F.lit(True)).where("is_best")
    return best.select("rep", "conv_id", "width", "height", "duration", "size")


@query
def enhanced_score(spark, d):
    a = tables.document_assets(_docs(spark, d)).where("doc_id is not null")
    first = F.min(F.struct("doc_id", "width", "height", "size")).over(Window.partitionBy("folder", "height"))
    r = a.withColumn("r", first)
    score = L.enhanced_score(F.col("width"), F.col("height"), F.col("size"), F.col("size"), F.col("width"), F.col("r.height"), F.col("r.size"), F.col("r.size"))
    return r.select("doc_id", score.alias("score"))


@query
def replacement_links(spark, d):
    act, _ = selection.eliminate(_judged(spark, d))
    path = tables.document_assets(_docs(spark, d)).select("doc_id", "path")
    named = act.join(path.withColumnRenamed("doc_id", "dup"), "dup").withColumn("a", F.col("path")).drop("path").join(path.withColumnRenamed("doc_id", "best"), "best")
    return actions.replacements(named.select(F.col("a").alias("dup"), F.col("path").alias("best")))


# -- labels --------------------------------------------------------------------------------------------------------


@query
def size_labels(spark, d):
    size = F.col("n_chars") * F.col("n_chars") * F.col("doc_id")
    return _docs(spark, d).select("doc_id", L.format_size(size).alias("label"), L.megabytes(size.cast("double")).alias("mb"))


@query
def duration_labels(spark, d):
    c = tables.conversation_assets(table(spark, d, "conversations"))
    return c.select("conv_id", L.duration_label(F.col("duration") / 4 - 0.25).alias("label"))


@query
def resolution_labels(spark, d):
    return tables.document_assets(_docs(spark, d)).select("doc_id", L.resolution_label(F.col("width"), F.col("height")).alias("label"), L.pixel_count(F.col("width"), F.col("height")).alias("pixels"))


@query
def timestamp_labels(spark, d):
    return _docs(spark, d).select("doc_id", L.format_timestamp(F.col("doc_id") * 37.5 - 40).alias("label"))


@query
def ext_normalize(spark, d):
    given = F.array(F.lit("HTML"), F.lit(".Html"), F.lit(" "), F.lit(""), F.col("ext"))
    p = table(spark, d, "pages").withColumn("ext", L.extension(F.regexp_replace("url", r"[?#].*$", "")))
    return p.select("page_id", "ext", F.array_join(L.normalize_extensions(given), ",").alias("extensions"))


@query
def media_kinds(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    return p.select("page_id", L.media_kind(F.col("path"), (".html", ".htm"), ("/", ".net")).alias("kind"), L.is_thumb(F.col("path")).alias("thumb"))


@query
def thumb_paths(spark, d):
    return tables.document_assets(_docs(spark, d)).select("doc_id", L.thumb_path(F.col("path")).alias("thumb"), L.safe_folder_name(F.col("path")).alias("safe"))


@query
def url_codec(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", L.url_of(F.lit("my files"), F.col("url")).alias("address"))
    return p.select("page_id", "address", (F.url_decode("address") == F.concat(F.lit("/data/my files/"), F.col("url"))).alias("same"))


@query
def metric_keys(spark, d):
    tags = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select(L.metric_key(F.col("event_type"), F.map_concat(tags, F.create_map(F.lit("a"), F.pmod("user_id", F.lit(3)).cast("string")))).alias("key")).groupBy("key").count().withColumnRenamed("count", "n")


@query
def retry_schedule(spark, d):
    n = table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.pmod(F.count("*"), F.lit(8)).alias("failures"))
    return n.select("user_id", "failures", L.retry_delay(F.lit("pending"), F.col("failures")).alias("pending_s"), L.retry_delay(F.lit("error"), F.col("failures")).alias("error_s"))


# -- state ---------------------------------------------------------------------------------------------------------


def _stored(spark, d):
    """A stored table out of documents and labels: labelled documents, some with another size."""
    docs = _docs(spark, d).select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.lit(1.0).alias("mtime"))
    known = table(spark, d, "labels").groupBy(F.col("doc_id").alias("path")).agg(F.max("quality").alias("quality"))
    return docs, docs.join(known, "path").select("path", (F.col("size") + 1 - F.col("quality")).alias("size"), "mtime")


@query
def new_or_changed(spark, d):
    f, c = _stored(spark, d)
    return f.alias("f").join(c.alias("c"), (F.col("f.path") == F.col("c.path")) & unchanged(), "left_anti").select(F.col("path").alias("doc_id"))


@query
def cache_partition(spark, d):
    f, c = _stored(spark, d)
    both = f.alias("f").join(c.alias("c"), F.col("f.path") == F.col("c.path"), "left")
    state = F.when(F.col("c.path").isNull(), "new").when(unchanged(), "valid").otherwise("changed")
    return both.select(state.alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query
def cleanup_missing(spark, d):
    f, c = _stored(spark, d)
    return c.join(f.where("path % 3 <> 0"), "path", "left_semi").select(F.col("path").alias("doc_id"), "size")


@query
def upsert_latest(spark, d):
    f, c = _stored(spark, d)
    return upsert(f, c, "path").select(F.col("path").alias("doc_id"), "size")


@query
def live_groups(spark, d):
    live = table(spark, d, "labels").select("doc_id").where("doc_id is not null").distinct()
    rows = _members(spark, d).join(live, "doc_id", "left_semi")
    return rows.groupBy("rep").agg(F.count("*").alias("live"), F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("files"))


@query
def groups_without_file(spark, d):
    g = grouping.cold(_sigs(spark, d), path="doc_id").withColumn("files", F.filter("files", lambda f: f % 5 != 0)).where(F.size("files") > 0)
    return g.select("rep", F.size("files").alias("left"), F.element_at("files", 1).alias("first"))


@query
def store_stats(spark, d):
    g = grouping.cold(_sigs(spark, d), path="doc_id").agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.size("files")), F.lit(0)).alias("members"), F.coalesce(F.max(F.size("files")), F.lit(0)).cast("long").alias("largest"))
    files = _docs(spark, d).agg(F.count("*").alias("files"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("bytes"))
    return files.join(F.broadcast(g))


@query
def folder_summary(spark, d):
    a = tables.document_assets(_docs(spark, d)).select("doc_id", "folder")
    m = a.join(_members(spark, d).hint("merge"), "doc_id", "left")
    return m.groupBy("folder").agg(F.count("*").alias("files"), F.count("rep").alias("grouped"), F.countDistinct("rep").alias("groups"))


@query
def folder_listing(spark, d):
    names = tables.document_assets(_docs(spark, d)).groupBy("folder").agg(F.count("*").alias("files"))
    return names.select("folder", "files", F.row_number().over(Window.orderBy(F.lower("folder"), "folder")).alias("position"))


# -- metrics and scheduling ----------------------------------------------------------------------------------------


@query
def counters(spark, d):
    return metrics.counters(_events(spark, d))


@query
def gauges(spark, d):
    return metrics.gauges(_events(spark, d))


@query
def timer_stats(spark, d):
    return metrics.timer_stats(_events(spark, d), 20)


@query
def metric_dump(spark, d):
    return metrics.dump(_events(spark, d), 20)


@query
def quiet_sessions(spark, d):
    s = scheduler.quiet_sessions(_changes(spark, d), 6 * 3600)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return s.select("folder", "session", "changes", (us("last") - us("first")).alias("length_us"), (us("quiet_at") - us("last")).alias("wait_us"))


@query
def rescan_gate(spark, d):
    changes = _changes(spark, d)
    quiet = scheduler.quiet_sessions(changes, 3600).select("folder", "session", F.unix_micros(F.col("quiet_at").cast("timestamp")).alias("quiet_us"))
    due = scheduler.rescans(changes, 3600, 12 * 3600)
    return due.join(quiet, ["folder", "session"]).select("folder", "session", (F.unix_micros(F.col("due").cast("timestamp")) - F.col("quiet_us")).alias("held_us"))


@query
def stale_folders(spark, d):
    return scheduler.stale(_states(spark, d)).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("last_change"))).alias("changes"))


@query
def ready_folders(spark, d):
    return scheduler.ready(_states(spark, d), 30 * 86400.0, ui_folder=1, ui_at=30 * 86400.0 - 10).select("folder", "reason")


@query
def scan_queue(spark, d):
    s = _states(spark, d)
    chosen = scheduler.ready(s.withColumn("queued", F.lit(False)), 30 * 86400.0).select("folder", "reason")
    return scheduler.enqueue(s, chosen, 30 * 86400.0).where("queued").select("folder", "priority", F.row_number().over(Window.partitionBy("priority").orderBy("enqueued_at", "folder")).alias("place"))


@query
def scheduler_status(spark, d):
    return scheduler.status_row(_states(spark, d), 0.0, 30.0)


from kinfold.plans import stores  # noqa: E402  it uses the relations above

QUERIES.update(stores.QUERIES)
ORACLE_SQL.update(stores.SQL)
