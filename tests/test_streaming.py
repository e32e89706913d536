"""Streams: quiet sessions, the folder state machine, metrics, scheduling rules."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kinfold.functions import labels as L
from kinfold.streaming import metrics, scheduler, stateful

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def run(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def stream(spark, tmp_path, schema, *batches):
    """A file stream that reads each batch in turn."""
    src = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/b{i}")
        time.sleep(1.1)  # files are read in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")


def test_quiet_sessions_close_with_the_watermark(spark, tmp_path):
    events = stream(spark, tmp_path, "folder string, ts timestamp", [("a", at(0)), ("a", at(100)), ("b", at(50))], [("a", at(900)), ("b", at(2000))], [("b", at(9000))])
    q = stateful.quiet_stream(events, 300, "1 minute").writeStream.format("memory").queryName("quiet").option("checkpointLocation", str(tmp_path / "cp")).start()
    run(q)
    got = {(r.folder, r.changes, (r.last - r.first).total_seconds()) for r in spark.table("quiet").collect()}
    assert got == {("a", 2, 100.0), ("b", 1, 0.0), ("a", 1, 0.0)} | {("b", 1, 0.0)}


def test_folder_states_over_a_stream(spark, tmp_path):
    schema = "folder string, ts timestamp, event string"
    one = [("a", at(1), "begin"), ("a", at(50), "done"), ("b", at(1), "begin"), ("b", at(20), "failed"), ("c", at(1), "begin")]
    two = [("a", at(100), "change"), ("b", at(700), "begin"), ("b", at(710), "failed"), ("b", at(1400), "begin"), ("b", at(1500), "failed")]
    events = stream(spark, tmp_path, schema, one, two, [("z", at(9000), "change")], [("z", at(9001), "change")])
    q = stateful.folder_states(events, 3600, "1 minute").writeStream.format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).start()
    run(q)
    got = {}
    for r in spark.table("states").orderBy("at").collect():
        got.setdefault(r.folder, []).append((r.was, r.status, r.failures))
    assert got["a"] == [("pending", "scanning", 0), ("scanning", "complete", 0), ("complete", "stale", 0)]
    assert [s for _, s, _ in got["b"]] == ["scanning", "pending", "scanning", "pending", "scanning", "error"]
    assert got["c"] == [("pending", "scanning", 0), ("scanning", "pending", 1)]


def test_emit_hands_over_changes(spark, tmp_path):
    seen = []
    events = stream(spark, tmp_path, "folder string, ts timestamp", [("a", at(0))])
    run(stateful.emit(events, seen.extend))
    assert [r.folder for r in seen] == ["a"]


def test_transitions():
    s = ("complete", 0.0, 10.0, 0, 0.0)
    assert stateful.transition(s, "change", 5.0)[0] == "complete" and stateful.transition(s, "change", 11.0)[0] == "stale"
    assert stateful.transition(s, "done", 11.0) == s
    running = stateful.transition(s, "begin", 20.0)
    assert stateful.transition(stateful.transition(running, "change", 25.0), "done", 30.0)[0] == "stale"


def test_rescans_are_throttled(spark):
    rnd = random.Random(3)
    rows = [(f, at(t), i) for f in "ab" for i, t in enumerate(sorted(rnd.sample(range(0, 200_000, 50), 150)))]
    got = {}
    df = spark.createDataFrame(rows, "folder string, ts timestamp, id long")
    for r in scheduler.rescans(df, 300, 2500).orderBy("folder", "due").collect():
        got.setdefault(r.folder, []).append((r.due - T0).total_seconds())
    for f in "ab":
        ts, want, last = [(t - T0).total_seconds() for g, t, _ in rows if g == f], [], None
        for i, t in enumerate(ts):
            if i + 1 == len(ts) or ts[i + 1] - t >= 300:
                q = t + 300
                if last is None or q > last:
                    last = q if last is None else max(q, last + 2500)
                    want.append(last)
        assert got[f] == want


def state(spark, *rows):
    names = "folder status mtime last_seen last_scan last_change failures last_failure held queued enqueued_at priority"
    base = dict(status="pending", mtime=0.0, last_seen=None, last_scan=0.0, last_change=0.0, failures=0, last_failure=0.0, held=False, queued=False, enqueued_at=None, priority=None)
    schema = "folder string, status string, mtime double, last_seen double, last_scan double, last_change double, failures int, last_failure double, held boolean, queued boolean, enqueued_at double, priority int"
    return spark.createDataFrame([tuple((base | {"folder": f} | kw)[n] for n in names.split()) for f, kw in rows], schema)


def test_who_is_ready(spark):
    s = state(
        spark, ("new", {}), ("held", {"held": True}), ("queued", {"queued": True}), ("busy", {"status": "scanning"}), ("noisy", {"status": "stale", "last_change": 9800.0}),
        ("calm", {"status": "stale", "last_change": 9600.0}), ("recent", {"status": "stale", "last_change": 9500.0, "last_scan": 9500.0}), ("tried", {"failures": 1, "last_failure": 9800.0}),
        ("again", {"failures": 1, "last_failure": 9700.0}), ("error", {"status": "error", "failures": 3, "last_failure": 7600.0}), ("late", {"status": "error", "failures": 3, "last_failure": 7601.0}), ("done", {"status": "complete"}),
    )
    got = {r.folder: r.reason for r in scheduler.ready(s, 10_000.0).collect()}
    assert got == {"new": "pending", "calm": "stale", "again": "retry", "error": "retry"}
    assert "new" not in {r.folder for r in scheduler.ready(s, 10_000.0, "new", 9_900.0).collect()}
    q = scheduler.enqueue(s, scheduler.ready(s, 10_000.0), 10_000.0)
    assert [r.folder for r in scheduler.queue(q, 9).collect()] == ["new", "calm", "again", "error", "queued"]
    user = spark.createDataFrame([("queued", "user"), ("held", "user")], "folder string, reason string")
    assert [r.folder for r in scheduler.queue(scheduler.enqueue(q, user, 10_001.0)).collect()] == ["queued", "new"]


def test_small_rules(spark):
    s = state(spark, ("a", {"status": "complete", "mtime": 5.0, "last_scan": 4.0}), ("b", {"status": "complete", "mtime": 5.0, "last_seen": 5.0, "last_scan": 4.0}), ("c", {"status": "scanning", "last_scan": 1.0}))
    assert {r.folder: r.status for r in scheduler.stale(s).collect()} == {"a": "stale", "b": "complete", "c": "scanning"}
    assert [r.folder for r in scheduler.timed_out(s, 3700.0).collect()] == ["c"] and scheduler.timed_out(s, 3600.0).count() == 0
    assert {r.folder: r.held for r in scheduler.hold(scheduler.hold(s, "a", True), "c", True).collect()} == {"a": True, "b": False, "c": False}
    row = scheduler.status_row(s, 10.0, 25.0).first()
    assert (row.state, row.current_folder, row.active_scans, row.queue_size, row.seconds_to_next) == ("scanning", "c", 1, 0, 15.0)
    flags = spark.createDataFrame([("a",), ("b",)], "folder string")
    asked, rest = scheduler.take_refresh(flags, "a")
    assert asked and not scheduler.take_refresh(rest, "a")[0]
    first = scheduler.from_summaries(s.select("folder"), spark.createDataFrame([("a", "complete", 3.0)], "folder string, status string, last_updated double"))
    assert {r.folder: (r.status, r.last_scan) for r in first.collect()} == {"a": ("complete", 3.0), "b": ("pending", 0.0), "c": ("pending", 0.0)}
    after = spark.range(4).select(scheduler.after_failure(F.lit("pending"), F.col("id")).alias("s")).collect()
    assert [r.s for r in after] == ["pending", "pending", "error", "error"]


def test_metrics(spark):
    clock = iter(range(100, 10**6))
    r = metrics.Recorder(now=lambda: float(next(clock)), history=3)
    for i in range(100):
        r.increment("n", 2, {"b": "1", "a": "x"})
        r.set_gauge("g", i)
        r.record_timer("t", i)
    assert len(r.rows) < 200

    @r.timer("f")
    def f(x):
        return x

    assert f(4) == 4
    with pytest.raises(KeyError), r.timer("f"):
        raise KeyError
    got = {x.key: x for x in metrics.dump(r.frame(spark), 3).collect()}
    assert got["n[a=x,b=1]"].value == 200 and got["g"].value == 99
    assert (got["t"].min, got["t"].max, got["t"].avg, got["t"].count) == (97.0, 99.0, 98.0, 3) if not callable(got["t"].count) else got["t"]["count"] == 3
    assert got["f"]["count"] == 2
    r.reset()
    assert metrics.dump(r.frame(spark)).count() == 0


def test_labels(spark):
    def one(*cols):
        return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())

    sizes = [None, 0, 500, 1023, 1024, 1536, 1024**2, 5 * 1024**5, 1024**6]
    assert one(*[L.format_size(F.lit(s).cast("long")) for s in sizes]) == ["0 B", "0 B", "500.0 B", "1023.0 B", "1.0 KB", "1.5 KB", "1.0 MB", "5.0 PB", "1024.0 PB"]
    assert one(*[L.format_timestamp(F.lit(s)) for s in (-3.0, 59.9, 3661.0, 360000.0)]) == ["00:00:00", "00:00:59", "01:01:01", "100:00:00"]
    assert one(*[L.duration_label(F.lit(s)) for s in (0.0, 0.25, 0.35, 1.25)]) == ["Unknown", "0.2s", "0.3s", "1.2s"]
    assert one(L.normalize_extensions(F.array(F.lit("JPG"), F.lit(".jpg"), F.lit(" "), F.lit(""), F.lit("png"))))[0] == [".jpg", ".png"]
    assert one(*[L.link_target(F.lit(a), F.lit(b)) for a, b in (("x/a", "x/b"), ("a", "x/b"), ("x/y/a", "x/z/b"), ("x/a", "b"))]) == ["b", "x/b", "../z/b", "../b"]
    assert one(L.thumb_path(F.lit("v/a.mp4")), L.thumb_path(F.lit("a.mkv"))) == ["v/thumb-frame.a.mp4.jpg", "thumb-frame.a.mkv.jpg"]
    assert one(*[L.is_thumb(F.lit(p)) for p in ("thumb.x/a.png", "a/thumb-frame.b.jpg", "a/thumbs.png")]) == [True, True, False]
    assert one(*[L.safe_folder_name(F.lit(p)) for p in ("a b", "..", "a/b", "a\\b", "")]) == [True, False, False, False, False]
    assert one(*[L.similarity(F.lit(x)) for x in (0, 5, 12, None)]) == [1.0, 0.5, 0.0, 0.0]
    assert one(*[L.retry_delay(F.lit(s), F.lit(n)) for s, n in (("pending", 1), ("pending", 2), ("error", 3), ("error", 9), ("pending", 0))]) == [300.0, 600.0, 2400.0, 3600.0, 0.0]
    hd = [F.lit(1920), F.lit(1080)]
    small = [F.lit(960), F.lit(540)]
    assert one(L.enhanced_score(*hd, F.lit(9.0), F.lit(9))) == [1.0]
    assert one(L.enhanced_score(*small, F.lit(20.0), F.lit(1), *small, F.lit(10.0), F.lit(4))) == [pytest.approx(0.25 + 0.1 - 0.1)]
    assert one(L.enhanced_score(*small, F.lit(20.0), F.lit(1), *hd, F.lit(10.0), F.lit(4))) == [0.25]
    assert one(L.enhanced_score(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1.0), F.lit(1))) == [0.0]
    kinds = [L.media_kind(F.lit(p), (".png",), (".gif", ".mp4")) for p in ("A.PNG", "b.gif", "c.txt")]
    assert one(*kinds) == ["image", "video", None]
    assert one(L.metric_key(F.lit("m"), F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.lit("2"))), L.metric_key(F.lit("m"), F.lit(None).cast("map<string,string>"))) == ["m[a=2,z=1]", "m"]
