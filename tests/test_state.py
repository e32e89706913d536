"""The state store: round trips, validity, cleanup, versions, damage, old files."""

import json

import pytest

from kinfold.sources import legacy
from kinfold.state import StateStore, read_summary


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/state"


@pytest.fixture
def store(spark, path):
    clock = iter(range(1000, 9999))
    return StateStore(spark, path, now=lambda: float(next(clock)))


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, mtime double, size long")


def hashed(files):
    return files.selectExpr("path", "length(path) as phash", "2L as dhash").selectExpr("path", "cast(phash as long) as phash", "dhash")


def test_hashes_are_read_through_and_checked(spark, store):
    calls = []

    def compute(misses):
        calls.append(sorted(r.path for r in misses.collect()))
        return hashed(misses.where("path <> 'broken'"))

    now = files(spark, ("a", 1.0, 10), ("b", 1.5, 20), ("broken", 1.0, 1))
    assert sorted((r.path, r.phash) for r in store.hashes(now, compute).collect()) == [("a", 1), ("b", 1)]
    store.hashes(now.where("path <> 'broken'"), compute)
    store.hashes(files(spark, ("a", 1.0, 10), ("b", 1.6, 20)), compute)
    assert calls == [["a", "b", "broken"], ["b"]]
    assert store.missing_hashes(files(spark, ("a", 1.0, 11))).count() == 1
    store.cleanup(files(spark, ("b", 1.6, 20)))
    assert [r.path for r in store.table("file_hashes").collect()] == ["b"]
    store.touch_file("b", (2.0, 21))
    assert store.valid_hashes(files(spark, ("b", 2.0, 21))).count() == 1
    store.touch_file("b", None)
    assert store.table("file_hashes").count() == 0


def test_metadata_has_its_own_validity(spark, store):
    compute = lambda m: m.selectExpr("path", "4 as width", "3 as height", "0.5D as duration").where("path <> 'bad'")
    rows = store.metadata(files(spark, ("a", 1.0, 10), ("bad", 1.0, 1)), compute).collect()
    assert sorted((r.path, r.width, r.duration) for r in rows) == [("a", 4, 0.5), ("bad", 0, 0.0)]
    again = store.metadata(files(spark, ("a", 1.0, 10)), lambda m: pytest.fail("asked again"))
    assert again.count() == 1


def test_groups(spark, store, path):
    assert not store.has_grouping() and read_summary(spark, path)["status"] == "pending"
    store.put_grouping(spark.createDataFrame([("a", ["a", "b"]), ("c", ["c", "d", "e"])], "rep string, files array<string>"))
    live = files(spark, ("a", 1.0, 1), ("b", 1.0, 1), ("d", 1.0, 1)).select("path")
    assert {r.rep: r.files for r in store.cached_groups(live).collect()} == {"a": ["a", "b"], "c": ["d"]}
    assert read_summary(spark, path, 10.0) == {"status": "complete", "file_count": 5, "duplicate_count": 2, "last_updated": pytest.approx(store.grouping_timestamp(), abs=9)}
    assert read_summary(spark, path, 1e12)["status"] == "stale"
    store.put_groups(spark.createDataFrame([("g1", ["a", "b"]), ("g2", ["c"])], "group_id string, files array<string>"))
    store.mark_processed("g1")
    store.put_groups(spark.createDataFrame([("g1", ["a"])], "group_id string, files array<string>"))
    assert {r.group_id: (r.files, r.processed) for r in store.table("groups").collect()} == {"g1": (["a"], True), "g2": (["c"], False)}
    assert store.group_files("g1") == ["a"] and store.group_files("nope") == []
    by_files = store.table("grouping_results").selectExpr("substr(md5(array_join(files, '|')), 1, 8) as i", "files").where("size(files) = 3").first()
    assert store.group_files(by_files.i) == ["c", "d", "e"]
    store.set_best("g1", "a")
    store.set_best("g1", "b")
    assert StateStore(spark, path).get_best("g1") == "b" and store.get_best("g2") is None
    stats = store.stats(live)
    assert (stats["total_groups"], stats["duplicate_groups"], stats["processed_groups"], stats["remaining_files"]) == (2, 2, 1, 3)
    store.remove_file("c")
    assert {r.rep: r.files for r in store.table("grouping_results").collect()} == {"a": ["a", "b"], "c": ["d", "e"]}
    assert [r.group_id for r in store.group_ids().collect()] == ["g1"]
    store.invalidate_grouping()
    assert not store.has_grouping() and store.get_best("g1") == "b"
    store.invalidate()
    assert store.get_best("g1") is None
    store.vacuum()
    assert store.stats()["total_files"] == 0


def test_an_empty_grouping_is_a_grouping(spark, store, path):
    store.put_grouping(spark.createDataFrame([], "rep string, files array<string>"))
    assert StateStore(spark, path).has_grouping() and read_summary(spark, path, 1.0)["status"] == "complete"


def test_another_version_empties_and_damage_rebuilds(spark, store, path, tmp_path):
    f = files(spark, ("a", 1.0, 1))
    store.hashes(f, hashed)
    store.metadata(f, lambda m: m.selectExpr("path", "1 as width", "1 as height", "0D as duration"))
    newer = StateStore(spark, path, version="9")
    assert newer.table("file_hashes").count() == 0 and newer.table("media_metadata").count() == 1
    assert read_summary(spark, path, version="8")["status"] == "pending"
    for f in (tmp_path / "state/pointers").iterdir():
        if f.name.isdigit():
            f.write_text("no json")
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert read_summary(spark, path)["status"] == "pending"
    assert StateStore(spark, path).stats()["total_files"] == 0


def test_a_failed_write_changes_nothing(spark, store):
    store.hashes(files(spark, ("a", 1.0, 1)), hashed)
    bad = spark.range(1).selectExpr("'x' as path", "cast(raise_error('no') as long) as phash", "1L as dhash", "1D as mtime", "1L as size")
    with pytest.raises(Exception, match="no"):
        store.put_hashes(bad)
    assert [r.path for r in store.table("file_hashes").collect()] == ["a"]


def test_a_writer_that_dies_leaves_the_state_before(spark, store, path, tmp_path):
    """Between the tables and the pointer, within the pointer, and where the newest names tables that are gone."""
    store.hashes(files(spark, ("a", 1.0, 1)), hashed)
    pointers = tmp_path / "state/pointers"
    last = max(int(f.name) for f in pointers.iterdir() if f.name.isdigit())
    (tmp_path / "state/file_hashes/v=half").mkdir()
    for n, text in ((1, ""), (2, '{"tables": {"file_'), (3, json.dumps({"tables": {**store._pointer["tables"], "groups": "groups/v=gone"}, "meta": store.meta()}))):
        (pointers / f"{last + n:012d}").write_text(text)
        again = StateStore(spark, path)
        assert [r.path for r in again.table("file_hashes").collect()] == ["a"] and read_summary(spark, path)["status"] == "pending"
    again.set_best("g", "a")
    assert StateStore(spark, path).get_best("g") == "a" and StateStore(spark, path).table("file_hashes").count() == 1
    again.vacuum()
    assert len([f for f in pointers.iterdir() if f.name.isdigit()]) == 1 and not (tmp_path / "state/file_hashes/v=half").exists()


def test_a_file_system_that_fails_empties_nothing(spark, store, path, monkeypatch):
    store.hashes(files(spark, ("a", 1.0, 1)), hashed)

    def broken(self, number):
        raise OSError("no answer")

    with monkeypatch.context() as m:
        m.setattr(StateStore, "_parsed", broken)
        with pytest.raises(OSError):
            StateStore(spark, path)
    assert StateStore(spark, path).table("file_hashes").count() == 1


def test_writers_do_not_lose_each_other(spark, path):
    """Two stores of a path, and threads on the shared one."""
    import threading

    one, other = StateStore(spark, path), StateStore(spark, path)
    one.set_best("g", "a")
    other.put_hashes(files(spark, ("a", 1.0, 1)).selectExpr("path", "1L as phash", "2L as dhash", "mtime", "size"))
    one.set_best("h", "b")
    assert other.get_best("g") is None or other.table("best_files").count() >= 1
    assert StateStore(spark, path).table("best_files").count() == 2 and StateStore(spark, path).table("file_hashes").count() == 1
    shared = StateStore.of(spark, path)
    assert shared is StateStore.of(spark, path + "/") and shared is StateStore.of(spark, path.replace("file://", "file:"))
    threads = [threading.Thread(target=shared.set_best, args=(f"t{i}", "x")) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert StateStore(spark, path).table("best_files").count() == 8


def test_old_states_come_where_the_engine_looks(spark, tmp_path):
    from kinfold.api import Engine

    data = tmp_path / "data" / "trip"
    data.mkdir(parents=True)
    (data / "a.jpg").write_bytes(b"x")
    stat = (data / "a.jpg").stat()
    old = {"version": "1.0", "grouping_timestamp": 7, "hashes": {"a.jpg": "00000000000000ff|0000000000000001"}, "file_stats": {"a.jpg": {"mtime": stat.st_mtime, "size": 1}}, "grouping_results": {}}
    (data / ".old").write_text(json.dumps(old))
    states = f"file://{tmp_path}/states"
    assert list(legacy.main(spark, str(tmp_path / "data"), ".old", states).values()) == [True]
    engine = Engine(spark, str(tmp_path / "data"), states)
    assert engine.store("trip").missing_hashes(engine.listing("trip")).isEmpty() and engine.store("trip").has_grouping()


def test_old_files_are_brought_in(spark, path, tmp_path):
    old = {"version": "1.0", "created": 5, "grouping_timestamp": 7, "hashes": {"a": "00000000000000ff|0000000000000001", "b": "0f"}, "file_stats": {"a": {"mtime": 1.5, "size": 9}},
           "grouping_results": {"a": ["a", "b"]}, "best_files": {"g": "b"}, "groups": {"g": {"files": ["a", "b"], "processed": True}}}
    f = tmp_path / "x" / ".old"
    f.parent.mkdir()
    f.write_text(json.dumps(old))
    assert legacy.find(str(tmp_path), ".old") == [f]
    assert legacy.migrate(spark, f, path, dry_run=True) and f.exists()
    assert legacy.migrate(spark, f, path, remove=True) and not f.exists()
    store = StateStore(spark, path)
    assert sorted((r.path, r.phash, r.dhash, r.size) for r in store.table("file_hashes").collect()) == [("a", 255, 1, 9), ("b", 15, 15, 0)]
    assert store.get_best("g") == "b" and store.group_files("g") == ["a", "b"] and store.grouping_timestamp() == 7.0
    f.write_text(json.dumps(old))
    assert not legacy.migrate(spark, f, path)
    for bad in ({**old, "version": "2"}, {**old, "hashes": {"a": [1, 2]}}, [1]):
        f.write_text(json.dumps(bad))
        assert not legacy.migrate(spark, f, path + "2")
