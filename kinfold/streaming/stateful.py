"""The scheduler's rules over streams: quiet sessions by event time, and a state machine per folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinfold.streaming.scheduler import MAX_FAILURES, MIN_INTERVAL, QUIET, SCAN_TIMEOUT

STATE = "status string, last_change double, last_scan double, failures int, last_failure double"
OUT = "folder string, at double, was string, status string, failures int"


def quiet_stream(events: DataFrame, quiet: int = QUIET, late: str = "10 minutes") -> DataFrame:
    """Sessions of change events ``(folder, ts)`` that have been quiet long enough: ``(folder, first, last, changes)``.

    A session is closed when the watermark has passed its end; events later than ``late`` are dropped."""
    found = events.withWatermark("ts", late).groupBy("folder", F.session_window("ts", f"{quiet} seconds").alias("w"))
    return found.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("changes")).select("folder", "first", "last", "changes")


def transition(state: tuple, event: str, at: float) -> tuple:
    """The next (status, last_change, last_scan, failures, last_failure) of a folder.

    Events: change, begin, done, failed, timeout. A change makes a complete folder stale, a third failure an error; a
    scan that ends well, complete. Anything else leaves the status as it is."""
    status, changed, scanned, failures, failed = state
    if event == "change":
        return ("stale" if status == "complete" and at > scanned else status, max(changed, at), scanned, failures, failed)
    if event == "begin" and status != "scanning":
        return "scanning", changed, at, failures, failed
    if event == "done" and status == "scanning":
        return ("stale" if changed > scanned else "complete"), changed, at, 0, 0.0
    if event in ("failed", "timeout") and status == "scanning":
        return ("error" if failures + 1 >= MAX_FAILURES else "pending"), changed, scanned, failures + 1, at
    return state


def folder_states(events: DataFrame, timeout_s: int = SCAN_TIMEOUT, late: str = "10 minutes") -> DataFrame:
    """State changes of each folder from a stream ``(folder, ts, event)``: ``(folder, at, was, status, failures)``.

    Events of one micro-batch count in time order. A scan that has not ended ``timeout_s`` seconds of event time after
    it began has failed."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("pending", 0.0, 0.0, 0, 0.0)
        rows = []

        def move(event: str, at: float) -> None:
            nonlocal now
            was, now = now[0], transition(now, event, at)
            if now[0] != was:
                rows.append((key[0], at, was, now[0], now[3]))

        if state.hasTimedOut:
            move("timeout", now[2] + timeout_s)
        else:
            found = sorted((float(t), e) for b in batches for t, e in zip(b["at"], b["event"], strict=True))
            for at, event in found:
                if now[0] == "scanning" and at > now[2] + timeout_s:
                    move("timeout", now[2] + timeout_s)
                move(event, at)
        state.update(now)
        if now[0] == "scanning":
            state.setTimeoutTimestamp(max(int((now[2] + timeout_s) * 1000), state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame(rows, columns=["folder", "at", "was", "status", "failures"])

    timed = events.withWatermark("ts", late).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return timed.groupBy("folder").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def due(sessions: DataFrame, states: DataFrame, now: float, min_interval: int = MIN_INTERVAL) -> DataFrame:
    """Folders of closed sessions whose last scan is long enough ago: a batch's work list."""
    return sessions.join(states, "folder").where(F.lit(now) - F.col("last_scan") >= min_interval).select("folder").distinct()


def emit(changes: DataFrame, handle: Callable[[list], None], name: str | None = None) -> StreamingQuery:
    """Hand each micro-batch's state changes to ``handle``: the sink of status updates, a few rows a batch."""

    def sink(batch: DataFrame, _: int) -> None:
        rows = batch.collect()
        if rows:
            handle(rows)

    writer = changes.writeStream.outputMode("append").foreachBatch(sink)
    return (writer.queryName(name) if name else writer).start()
