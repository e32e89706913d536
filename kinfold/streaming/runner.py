"""A scanner that keeps folders fresh: looks for changes, queues what is ready, scans with a few workers.

The state has one small row per folder and lives with the scanner; the rules are those of ``scheduler``. Each scan runs
in a Spark job group of its own, so that it can be cancelled when it takes too long or is not wanted any more.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from kinfold.streaming import scheduler as rules
from kinfold.streaming.stateful import transition


@dataclass
class Folder:
    name: str
    status: str = "pending"
    last_change: float = 0.0
    last_scan: float = 0.0
    failures: int = 0
    last_failure: float = 0.0
    last_seen: float = 0.0
    held: bool = False
    priority: int | None = None
    enqueued_at: float = 0.0
    file_count: int = 0
    duplicate_count: int = 0
    error: str = ""
    progress: tuple[str, int, int, str] = ("idle", 0, 0, "")
    progress_at: float = 0.0
    group: str = ""


class Scanner:
    """``folders()``, ``summary(name)``, ``mtime(name)`` and ``scan(name, progress)`` come from an engine; ``cancel(group)``
    stops a job group. ``on_change(folder)`` hears of each new status."""

    def __init__(self, folders, summary, mtime, scan, cancel=lambda group: None, set_group=lambda group: None, now: Callable[[], float] = time.time, workers: int = rules.WORKERS, poll: float = rules.POLL, timeout: float = rules.SCAN_TIMEOUT, on_change=lambda folder: None):
        self._folders, self._summary, self._mtime, self._scan, self._cancel, self._set_group = folders, summary, mtime, scan, cancel, set_group
        self.now, self.workers, self.poll, self.timeout, self.on_change = now, workers, poll, timeout, on_change
        self.lock = threading.RLock()
        self.state: dict[str, Folder] = {}
        self.ui: tuple[str | None, float] = (None, 0.0)
        self.refresh: set[str] = set()
        self.callbacks: dict[str, Callable] = {}
        self.next_look = 0.0
        self._errors: dict[str, str] = {}  # of the loops' last rounds, by step
        self._stop = threading.Event()
        self._threads: list[threading.Thread] = []

    @classmethod
    def of(cls, engine, **settings) -> Scanner:
        sc = engine.spark.sparkContext
        from kinfold.sources import folder as files

        return cls(
            engine.folders, engine.summary, lambda n: files.content_mtime(f"{engine.data_dir}/{n}"), engine.scan,
            cancel=sc.cancelJobGroup, set_group=lambda g: sc.setJobGroup(g, "scan", interruptOnCancel=True), **settings,
        )

    # -- looking -------------------------------------------------------------------------------------------------

    def discover(self) -> None:
        """Take up new folders with what their stored summary says; forget folders that are gone."""
        names = set(self._folders())
        with self.lock:
            for name in names - set(self.state):
                found = self._summary(name)
                self.state[name] = Folder(name, found["status"], last_scan=found["last_updated"], file_count=found["file_count"], duplicate_count=found["duplicate_count"])
            for name in set(self.state) - names:
                if self.state[name].status != "scanning":
                    del self.state[name]

    def look(self) -> None:
        """Mark folders whose contents changed after their scan and since the last look."""
        for name in list(self.state):
            try:
                at = self._mtime(name)
            except OSError:
                continue
            with self.lock:
                f = self.state.get(name)
                if f is not None and at > f.last_scan and at != f.last_seen:
                    self._move(f, "change", at)
                if f is not None:
                    f.last_seen = at

    def _move(self, f: Folder, event: str, at: float) -> None:
        was = f.status
        f.status, f.last_change, f.last_scan, f.failures, f.last_failure = transition((f.status, f.last_change, f.last_scan, f.failures, f.last_failure), event, at)
        if f.status != was:
            self.on_change(asdict(f))

    def reason(self, f: Folder) -> str | None:
        """Why a folder is ready to be queued now, if it is."""
        now = self.now()
        if f.held or f.priority is not None or f.status == "scanning" or f.name == self.ui[0] and now - self.ui[1] < rules.UI_HOLD:
            return None
        base = rules.retry_wait(f.status, f.failures)
        waited = f.failures == 0 or now >= f.last_failure + base
        if f.status == "stale":
            return "stale" if now - f.last_change >= rules.QUIET and now - f.last_scan >= rules.MIN_INTERVAL else None
        return (("pending" if f.failures == 0 else "retry") if waited else None) if f.status in ("pending", "error") else None

    def tick(self) -> None:
        """One look at all folders: what is ready is queued, scans that take too long are cancelled."""
        self.discover()
        self.look()
        with self.lock:
            now = self.now()
            for f in self.state.values():
                if why := self.reason(f):
                    f.priority, f.enqueued_at = rules.PRIORITY[why], now
                if f.status == "scanning" and now - f.last_scan > self.timeout:
                    self._cancel(f.group)
                    f.error = f"stopped after {self.timeout:g} s"
                    f.group = ""
                    self._move(f, "timeout", now)
            self.next_look = now + self.poll

    # -- scanning ------------------------------------------------------------------------------------------------

    def take(self) -> Folder | None:
        """The next folder of the queue, now scanning."""
        with self.lock:
            waiting = sorted((f for f in self.state.values() if f.priority is not None and f.status != "scanning"), key=lambda f: (f.priority, f.enqueued_at, f.name))
            if not waiting or sum(f.status == "scanning" for f in self.state.values()) >= self.workers:
                return None
            f = waiting[0]
            f.priority, f.group, f.error = None, f"scan-{f.name}-{uuid.uuid4().hex[:8]}", ""
            self._move(f, "begin", self.now())
            return f

    def work(self) -> bool:
        """Scan the next folder of the queue; False if there is none. A failure counts towards the folder's retries."""
        f = self.take()
        if f is None:
            return False
        group = f.group

        def progress(status: str, current: int, total: int, message: str) -> None:
            f.progress, f.progress_at = (status, current, total, message), self.now()
            if call := self.callbacks.get(f.name):
                call(status, current, total, message)

        error = ""
        try:
            self._set_group(group)
            self._scan(f.name, progress)
            found = self._summary(f.name)
        except Exception as e:  # the folder's next try is the scheduler's business
            error, found = str(e)[:500] or type(e).__name__, None
        with self.lock:
            if f.group != group:
                return True  # timed out meanwhile
            f.group = ""
            if found is None:
                f.error = error
                self._move(f, "failed", self.now())
            else:
                f.file_count, f.duplicate_count = found["file_count"], found["duplicate_count"]
                self._move(f, "done", self.now())
                self.refresh.add(f.name)
        return True

    def start(self) -> None:
        def keep(step: Callable[[], object], pause: float) -> None:
            while not self._stop.is_set():
                done = False
                try:
                    done = bool(step())
                    self._errors.pop(step.__name__, None)
                except Exception as e:  # the next round tries again; ``status`` tells what is wrong
                    self._errors[step.__name__] = str(e)[:500] or type(e).__name__
                if not done:
                    self._stop.wait(pause)

        if not self.running():
            self._stop.clear()
            jobs = [(self.tick, self.poll), *[(self.work, min(1.0, self.poll))] * self.workers]
            self._threads = [threading.Thread(target=keep, args=j, daemon=True) for j in jobs]
            for t in self._threads:
                t.start()

    def stop(self, wait: float = 10.0) -> None:
        self._stop.set()
        for f in self.state.values():
            if f.group:
                self._cancel(f.group)
        for t in self._threads:
            t.join(wait)
        self._threads = []

    def running(self) -> bool:
        return any(t.is_alive() for t in self._threads)

    # -- users ---------------------------------------------------------------------------------------------------

    def begin_user_scan(self, name: str) -> bool:
        """Keep the scanner off a folder while a user scans it; False if it is being scanned already."""
        with self.lock:
            f = self.state.setdefault(name, Folder(name))
            if f.status == "scanning" or f.held:
                return False
            f.held, f.priority = True, None
            return True

    def end_user_scan(self, name: str, done: bool = True) -> None:
        with self.lock:
            f = self.state[name]
            f.held = False
            if done:
                self._move(f, "begin", self.now())
                self._move(f, "done", self.now())

    def prioritize(self, name: str) -> bool:
        """Put a folder at the head of the queue, also if it waits there already."""
        with self.lock:
            f = self.state.get(name)
            if f is None or f.held or f.status == "scanning":
                return False
            f.enqueued_at = f.enqueued_at if f.priority is not None else self.now()
            f.priority = rules.PRIORITY["user"]
            return True

    def set_ui_folder(self, name: str | None) -> None:
        self.ui = (name, self.now())

    def mark_ui_activity(self) -> None:
        self.ui = (self.ui[0], self.now())

    def take_refresh(self, name: str) -> bool:
        """Whether a folder was scanned since the last such question."""
        with self.lock:
            asked = name in self.refresh
            self.refresh.discard(name)
            return asked

    def ready(self, name: str) -> bool:
        return name in self.state and self.state[name].status in ("complete", "stale")

    def folder(self, name: str) -> dict:
        f = self.state.get(name)
        return asdict(f) | {"ready": self.ready(name)} if f else {"name": name, "status": "unknown", "ready": False}

    def progress(self, name: str, stale_after: float = 60.0) -> tuple[str, int, int, str]:
        """The last progress of a folder; an error once a running scan has been silent for too long."""
        f = self.state.get(name)
        if f is None:
            return "idle", 0, 0, ""
        if f.status == "scanning" and f.progress_at and self.now() - f.progress_at > stale_after:
            return "error", f.progress[1], f.progress[2], "no progress"
        return f.progress

    def status(self) -> dict:
        with self.lock:
            active = [f.name for f in self.state.values() if f.status == "scanning"]
            waiting = sum(f.priority is not None for f in self.state.values())
            left = max(0.0, self.next_look - self.now())
            state = "scanning" if active else "waiting" if waiting else "sleeping" if left and self.running() else "idle"
            return {"running": self.running(), "state": state, "current_folder": min(active, default=None), "active_scans": len(active), "queue_size": waiting, "seconds_to_next": left, "errors": dict(self._errors)}
