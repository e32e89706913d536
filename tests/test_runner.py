"""The scanner's loop with a clock and an engine of the test's own."""

import threading
import time

from kinfold.streaming.runner import Scanner


class World:
    def __init__(self):
        self.t, self.names, self.mtimes, self.fail, self.scanned, self.cancelled, self.seen = 10_000.0, ["a", "b"], {"a": 1.0, "b": 1.0}, set(), [], [], []
        self.summaries = {"b": {"status": "complete", "file_count": 4, "duplicate_count": 1, "last_updated": 9_000.0}}
        self.scanner = Scanner(lambda: self.names, self.summary, lambda n: self.mtimes[n], self.scan, cancel=self.cancelled.append, now=lambda: self.t, on_change=lambda f: self.seen.append((f["name"], f["status"])))

    def summary(self, n):
        return self.summaries.get(n, {"status": "pending", "file_count": 0, "duplicate_count": 0, "last_updated": 0.0})

    def scan(self, n, progress):
        progress("hashing", 1, 2, "x")
        if n in self.fail:
            raise RuntimeError("no disk")
        self.scanned.append(n)
        self.summaries[n] = {"status": "complete", "file_count": 7, "duplicate_count": 2, "last_updated": self.t}


def test_new_folders_are_scanned_and_changes_wait_for_quiet():
    w = World()
    s = w.scanner
    s.tick()
    assert s.status()["queue_size"] == 1 and s.work() and not s.work() and w.scanned == ["a"]
    assert w.seen == [("a", "scanning"), ("a", "complete")] and s.folder("a")["file_count"] == 7 and s.ready("a")
    assert s.take_refresh("a") and not s.take_refresh("a")
    w.mtimes["b"] = 9_950.0
    s.tick()
    assert s.folder("b")["status"] == "stale" and not s.work()
    w.t = 10_250.0
    s.tick()
    assert s.work() and w.scanned == ["a", "b"]
    w.mtimes["a"] = 10_260.0
    w.t = 10_590.0
    s.tick()
    assert not s.work()  # quiet, but scanned less than ten minutes ago
    w.t = 10_601.0
    s.tick()
    assert s.work() and w.scanned == ["a", "b", "a"]
    w.names = ["a"]
    s.tick()
    assert s.folder("b")["status"] == "unknown"


def test_failures_are_tried_again_later_and_later():
    w = World()
    w.fail = {"a"}
    s = w.scanner
    tries = []
    for _ in range(1200):
        s.tick()
        if s.work():
            tries.append(w.t)
        w.t += 30
    assert [b - a for a, b in zip(tries, tries[1:])][:4] == [300, 600, 2400, 3600]
    assert s.folder("a")["status"] == "error" and s.folder("a")["error"] == "no disk"
    w.fail = set()
    w.t += 3600
    s.tick()
    assert s.work() and s.folder("a")["failures"] == 0


def test_users_come_first():
    w = World()
    w.names = ["a", "b", "c", "d"]
    w.mtimes = dict.fromkeys("abcd", 1.0)
    s = w.scanner
    s.set_ui_folder("c")
    assert s.begin_user_scan("d") and not s.begin_user_scan("d")
    s.tick()
    assert s.status()["queue_size"] == 1 and not s.prioritize("d")
    assert s.prioritize("b") and s.prioritize("c") and s.work() and s.work() and s.work()
    assert w.scanned == ["b", "c", "a"]
    s.end_user_scan("d")
    assert s.folder("d")["status"] == "complete"
    assert s.progress("a") == ("hashing", 1, 2, "x") and s.progress("zz")[0] == "idle"


def test_long_scans_are_cancelled():
    w = World()
    s = w.scanner
    begun, go = threading.Event(), threading.Event()

    def scan(n, progress):
        progress("hashing", 0, 1, "")
        begun.set()
        go.wait(10)

    s._scan = scan
    s.tick()
    t = threading.Thread(target=s.work)
    t.start()
    assert begun.wait(10) and not s.begin_user_scan("a")
    w.t += 100
    assert s.status()["active_scans"] == 1 and s.progress("a")[0] == "error"
    w.t += 3600
    s.tick()
    go.set()
    t.join(10)
    assert len(w.cancelled) == 1 and s.folder("a")["status"] == "pending" and s.folder("a")["failures"] == 1


def test_threads_start_and_stop():
    w = World()
    s = w.scanner
    s.now, s.poll = time.time, 0.05
    w.mtimes = dict.fromkeys("ab", 1.0)
    s.start()
    until = time.time() + 10
    while "a" not in w.scanned and time.time() < until:
        time.sleep(0.02)
    assert s.running()
    s.stop()
    assert not s.running() and w.scanned == ["a"]


def test_errors_of_the_loop_are_told():
    w = World()
    w.scanner.poll = 0.02
    good, w.scanner._folders = w.scanner._folders, lambda: 1 / 0
    w.scanner.start()
    try:
        until = time.time() + 10
        while not w.scanner.status()["errors"] and time.time() < until:
            time.sleep(0.02)
        assert "zero" in w.scanner.status()["errors"]["tick"]
        w.scanner._folders = good
        while w.scanner.status()["errors"] and time.time() < until:
            time.sleep(0.02)
        assert not w.scanner.status()["errors"]
    finally:
        w.scanner.stop()
