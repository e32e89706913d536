"""When to scan a folder again: quiet periods, throttling, retries, priorities, over change events or a state relation.

Change events are ``(folder, ts[, id])``. The state relation has a row per folder:
``folder, status, mtime, last_seen, last_scan, last_change, failures, last_failure, held, queued, enqueued_at, priority``,
times in seconds. Everything here is a batch formulation; ``stateful`` keeps the same rules over streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.labels import RETRY_BASE, RETRY_MOST, retry_delay
from kinfold.runtime import materialize

#: Fixed values, seconds: poll, quiet time, least time between scans, hold of a folder that a user looks at, scan limit.
POLL, QUIET, MIN_INTERVAL, UI_HOLD, SCAN_TIMEOUT = 30, 300, 600, 300, 3600
MAX_FAILURES, WORKERS = 3, 2
#: Order of the queue: what a user asks for comes first.
PRIORITY = {"user": 0, "pending": 1, "stale": 2, "retry": 3}


def seconds(ts: Column) -> Column:
    """Seconds of a timestamp as a double, exact to the microsecond."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def quiet_sessions(events: DataFrame, quiet: int = QUIET) -> DataFrame:
    """``(folder, session, first, last, changes, quiet_at)``: bursts of changes with less than ``quiet`` seconds between
    two, numbered from 1, and when each has been quiet for long enough."""
    by = Window.partitionBy("folder").orderBy("ts", "id")
    gap = seconds(F.col("ts")) - seconds(F.lag("ts").over(by))
    opened = events.withColumn("session", F.sum(F.when(gap < quiet, 0).otherwise(1)).over(by))
    out = opened.groupBy("folder", "session").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("changes"))
    return out.withColumn("quiet_at", F.col("last") + F.expr(f"interval {int(quiet)} seconds"))


def rescans(events: DataFrame, quiet: int = QUIET, min_interval: int = MIN_INTERVAL) -> DataFrame:
    """``(folder, session, due)``: scans that the quiet periods of a folder ask for, a scan held back until
    ``min_interval`` after the one before it. Sessions that end while one is held back are covered by it."""
    s = quiet_sessions(events, quiet).select("folder", "session", F.unix_micros(F.col("quiet_at").cast("timestamp")).alias("at"))
    by = Window.partitionBy("folder").orderBy("at")
    gap = F.lit(int(min_interval) * 1_000_000)
    # A scan is held back by less than the interval, so twice the interval after a session nothing depends on it.
    run = F.sum(F.when(F.col("at") - F.lag("at").over(by) < 2 * gap, 0).otherwise(1)).over(by)
    rows = materialize(s.withColumn("run", run), "sessions")
    packed = rows.groupBy("folder", "run").agg(F.array_sort(F.collect_list(F.struct("at", "session"))).alias("r"))
    start = F.array().cast("array<struct<due:bigint,session:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)["due"]
        due = F.greatest(x["at"], last + gap)
        first = F.array(F.struct(x["at"].alias("due"), x["session"].alias("session")))
        covered = x["at"] <= last
        return F.when(F.size(acc) == 0, first).when(covered, acc).otherwise(F.concat(acc, F.array(F.struct(due.alias("due"), x["session"].alias("session")))))

    scans = packed.withColumn("s", F.explode(F.aggregate("r", start, step)))
    return scans.select("folder", F.col("s.session").alias("session"), F.timestamp_micros(F.col("s.due")).alias("due"))


def stale(states: DataFrame) -> DataFrame:
    """States in which complete folders whose contents changed after the scan, and since the last look, are stale."""
    changed = (F.col("status") == "complete") & (F.col("mtime") > F.col("last_scan")) & ~F.col("mtime").eqNullSafe(F.col("last_seen"))
    return states.withColumn("status", F.when(changed, "stale").otherwise(F.col("status"))).withColumn("last_change", F.when(changed, F.col("mtime")).otherwise(F.col("last_change")))


def after_failure(status: Column, failures: Column) -> Column:
    """The status after one more failure: pending for another try, error at the third."""
    return F.when(failures + 1 >= MAX_FAILURES, "error").otherwise("pending")


def next_try(status: Column, failures: Column, last_failure: Column) -> Column:
    return last_failure + retry_delay(status, failures)


def ready(states: DataFrame, now: float, ui_folder: str | None = None, ui_at: float = 0.0) -> DataFrame:
    """Folders to enqueue now with their ``reason`` (pending, stale, retry). Held, queued and running folders wait, and so
    does the folder that a user looked at within the last ``UI_HOLD`` seconds."""
    t = F.lit(float(now))
    free = ~F.coalesce("held", F.lit(False)) & ~F.coalesce("queued", F.lit(False)) & (F.col("status") != "scanning")
    watched = F.lit(False) if ui_folder is None or now - ui_at >= UI_HOLD else F.col("folder") == ui_folder
    failures = F.coalesce("failures", F.lit(0))
    waited = (failures == 0) | (t >= F.coalesce("last_failure", F.lit(0.0)) + retry_delay(F.col("status"), failures))
    quiet = (t - F.coalesce("last_change", F.lit(0.0)) >= QUIET) & (t - F.coalesce("last_scan", F.lit(0.0)) >= MIN_INTERVAL)
    reason = F.when((F.col("status") == "pending") & waited & (failures == 0), "pending").when((F.col("status") == "pending") & waited, "retry").when((F.col("status") == "stale") & quiet, "stale").when((F.col("status") == "error") & waited, "retry")
    return states.where(free & ~watched).withColumn("reason", reason).where("reason is not null")


def enqueue(states: DataFrame, chosen: DataFrame, now: float) -> DataFrame:
    """States in which the folders of ``chosen(folder, reason)`` are queued. A folder that is queued already takes the
    better priority of the two and keeps its place in time; running and held folders are left alone."""
    rank = F.coalesce(*[F.when(F.col("reason") == k, v) for k, v in PRIORITY.items()])
    joined = states.join(chosen.groupBy("folder").agg(F.min_by("reason", rank).alias("reason")), "folder", "left").withColumn("_rank", rank)
    open_ = F.col("_rank").isNotNull() & ~F.coalesce("held", F.lit(False)) & (F.col("status") != "scanning")
    was = F.coalesce("queued", F.lit(False))
    out = joined.withColumn("priority", F.when(open_ & was, F.least("priority", "_rank")).when(open_, F.col("_rank")).otherwise(F.col("priority")))
    out = out.withColumn("enqueued_at", F.when(open_ & ~was, F.lit(float(now))).otherwise(F.col("enqueued_at"))).withColumn("queued", was | open_)
    return out.select(*states.columns)


def queue(states: DataFrame, workers: int = WORKERS) -> DataFrame:
    """The next folders for free workers, by priority and waiting time."""
    return states.where("queued").orderBy(F.asc_nulls_last("priority"), "enqueued_at", "folder").limit(workers)


def hold(states: DataFrame, folder: str, held: bool) -> DataFrame:
    """States in which a user's own scan keeps the scheduler off a folder, or gives it back."""
    mine = F.col("folder") == folder
    busy = mine & (F.col("status") == "scanning")
    return states.withColumn("held", F.when(mine & ~busy, F.lit(held)).otherwise(F.coalesce("held", F.lit(False))))


def timed_out(states: DataFrame, now: float, limit: int = SCAN_TIMEOUT) -> DataFrame:
    """Running scans that have gone on for longer than the limit."""
    return states.where((F.col("status") == "scanning") & (F.lit(float(now)) - F.col("last_scan") > limit))


def from_summaries(folders: DataFrame, summaries: DataFrame) -> DataFrame:
    """First states: what a folder's stored summary says, pending without one."""
    return folders.join(summaries.select("folder", "status", "last_updated"), "folder", "left").select("folder", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("last_updated", F.lit(0.0)).alias("last_scan"))


def status_row(states: DataFrame, now: float, next_action: float | None = None) -> DataFrame:
    """One row: what the scheduler is doing, for which folder, how many scans run and wait, seconds to the next look."""
    running = F.col("status") == "scanning"
    found = states.agg(F.count_if(running).alias("active_scans"), F.count_if("queued").alias("queue_size"), F.min(F.when(running, F.col("folder"))).alias("current_folder"))
    left = F.greatest(F.lit(0.0), F.lit(float(next_action)) - float(now)) if next_action is not None else F.lit(0.0)
    state = F.when(F.col("active_scans") > 0, "scanning").when(F.col("queue_size") > 0, "waiting").when(left > 0, "sleeping").otherwise("idle")
    return found.select(state.alias("state"), "current_folder", "active_scans", "queue_size", left.alias("seconds_to_next"))


def take_refresh(flags: DataFrame, folder: str) -> tuple[bool, DataFrame]:
    """Whether ``flags(folder)`` asks for a refresh of a folder, and the flags without it."""
    mine = F.col("folder") == folder
    return not flags.where(mine).isEmpty(), flags.where(~mine)


def retry_wait(status: str, failures: int) -> float:
    """``retry_delay`` of plain values."""
    if failures <= 0:
        return 0.0
    return min(RETRY_BASE * 2.0**failures, RETRY_MOST) if status == "error" else RETRY_BASE * 2.0 ** (failures - 1)
