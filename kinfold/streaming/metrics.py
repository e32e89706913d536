"""Counters, gauges and timers over a relation of metric events, and a recorder that fills it."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.functions.labels import metric_key
from kinfold.schema import METRIC

#: Values a timer keeps, the latest ones.
HISTORY = 1000


def keyed(events: DataFrame) -> DataFrame:
    return events.withColumn("key", metric_key(F.col("name"), F.col("tags")))


def counters(events: DataFrame) -> DataFrame:
    """``(key, total)``: the sum of all increments."""
    return keyed(events.where("kind = 'counter'")).groupBy("key").agg(F.sum("value").alias("total"))


def gauges(events: DataFrame) -> DataFrame:
    """``(key, value)``: the latest value."""
    return keyed(events.where("kind = 'gauge'")).groupBy("key").agg(F.max_by("value", F.struct("ts", "id")).alias("value"))


def latest(events: DataFrame, history: int = HISTORY) -> DataFrame:
    """The latest events of each key."""
    return keyed(events).withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("id")))).where(F.col("n") <= history)


def timer_stats(events: DataFrame, history: int = HISTORY) -> DataFrame:
    """``(key, min, max, avg, count)`` of the latest values of each timer."""
    rows = latest(events.where("kind = 'timer'"), history)
    return rows.groupBy("key").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"), F.count("*").alias("count"))


def dump(events: DataFrame, history: int = HISTORY) -> DataFrame:
    """Everything at once: ``(kind, key, value, min, max, avg, count)``."""
    none = lambda *names: [F.lit(None).cast("long" if n == "count" else "double").alias(n) for n in names]
    a = counters(events).select(F.lit("counter").alias("kind"), "key", F.col("total").alias("value"), *none("min", "max", "avg", "count"))
    b = gauges(events).select(F.lit("gauge").alias("kind"), "key", "value", *none("min", "max", "avg", "count"))
    c = timer_stats(events, history).select(F.lit("timer").alias("kind"), "key", *none("value"), "min", "max", "avg", "count")
    return a.unionByName(b).unionByName(c)


class Recorder:
    """Collects metric events on the driver; ``frame`` gives them as a relation. Timers keep the latest values only."""

    def __init__(self, now: Callable[[], float] = time.time, history: int = HISTORY):
        self.now, self.history = now, history
        self.reset()

    def reset(self) -> None:
        self.rows: list[tuple] = []
        self.id = 0

    def _add(self, kind: str, name: str, value: float, tags: dict[str, str] | None) -> None:
        from datetime import datetime, timezone

        self.id += 1
        self.rows.append((self.id, datetime.fromtimestamp(self.now(), timezone.utc), kind, name, dict(tags or {}), float(value)))
        if len(self.rows) > 20 * self.history:
            self._compact()

    def _compact(self) -> None:
        """Sum up counters, keep the last of each gauge and the latest values of each timer."""
        kept: dict[tuple, list] = {}
        for row in self.rows:
            mine = kept.setdefault((row[2], row[3], tuple(sorted(row[4].items()))), [])
            if row[2] == "counter" and mine:
                row = (*row[:5], mine.pop()[5] + row[5])
            elif row[2] == "gauge":
                mine.clear()
            mine.append(row)
        self.rows = sorted(r for rows in kept.values() for r in rows[-self.history :])

    def increment(self, name: str, value: float = 1, tags: dict[str, str] | None = None) -> None:
        self._add("counter", name, value, tags)

    def set_gauge(self, name: str, value: float, tags: dict[str, str] | None = None) -> None:
        self._add("gauge", name, value, tags)

    def record_timer(self, name: str, seconds: float, tags: dict[str, str] | None = None) -> None:
        self._add("timer", name, seconds, tags)

    def timer(self, name: str, tags: dict[str, str] | None = None) -> Timer:
        return Timer(self, name, tags)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, METRIC)


class Timer:
    """Times a ``with`` block or, as a decorator, each call; also when it raises."""

    def __init__(self, recorder: Recorder, name: str, tags: dict[str, str] | None = None):
        self.recorder, self.name, self.tags = recorder, name, tags

    def __enter__(self) -> Timer:
        self.began = time.perf_counter()
        return self

    def __exit__(self, *_) -> None:
        self.recorder.record_timer(self.name, time.perf_counter() - self.began, self.tags)

    def __call__(self, f: Callable) -> Callable:
        @functools.wraps(f)
        def timed(*args, **kwargs):
            with Timer(self.recorder, self.name, self.tags):
                return f(*args, **kwargs)

        return timed
