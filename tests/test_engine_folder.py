"""Folders of generated pictures: scan, rescan, changes, decisions."""

import os
import shutil
import struct
import zlib

import numpy as np
import pytest

from kinfold.api import Engine
from kinfold.functions.imagehash import dhash, luma, phash, resize, signature
from kinfold.sources import folder, media


def gradient(w, h, seed):
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    return np.stack([(7 * x + seed) % 256, (5 * y + seed) % 256, (3 * (x + y) + seed) % 256], axis=2).astype(np.uint8)


def smooth(w, h, seed):
    r = np.random.default_rng(seed)
    g = resize(r.integers(0, 256, (6, 6)).astype(float), w, h)
    return np.repeat(g[..., None], 3, axis=2).astype(np.uint8)


def png(path, pixels):
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture
def engine(spark, tmp_path):
    data = tmp_path / "data"
    (data / "pics" / "deep dir").mkdir(parents=True)
    (data / ".hidden").mkdir()
    a = smooth(240, 240, 1)
    png(data / "pics/img_a.png", a)
    shutil.copy(data / "pics/img_a.png", data / "pics/img_a_copy.png")
    png(data / "pics/deep dir/img_a_small.png", resize(a[..., 0].astype(float), 120, 120)[..., None].repeat(3, axis=2).astype(np.uint8))
    png(data / "pics/img_b.png", smooth(200, 200, 9))
    (data / "pics/broken.png").write_bytes(b"no picture")
    (data / "pics/notes.txt").write_text("x")
    (data / "pics/thumb-frame.v.mp4.jpg").write_bytes(b"x")
    os.symlink(data / "pics/img_b.png", data / "pics/link.png")
    return Engine(spark, str(data), f"file://{tmp_path}/state", frame=lambda p: None, probe=lambda p: (0, 0, 0.0))


def groups(engine):
    return {tuple(sorted([r.path for r in rows])): {r.path: (r.is_best, r.is_exact) for r in rows} for rows in _by_rep(engine)}


def _by_rep(engine):
    out = {}
    for r in engine.members("pics").collect():
        out.setdefault(r.rep, []).append(r)
    return out.values()


def test_hashes_tell_pictures_apart():
    a, b = smooth(240, 240, 1), smooth(200, 200, 9)
    far = lambda x, y: max(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(signature(x), signature(y)))
    small = resize(luma(a), 120, 120)[..., None].repeat(3, axis=2)
    assert far(a, a) == 0 and far(a, small) < 5 <= far(a, b)
    assert dhash(np.tile(np.arange(90.0), (80, 1))) == -1 and phash(luma(a)) != phash(luma(b))


def test_listing_skips_links_thumbs_and_other_files(engine):
    rows = {r.path: r for r in engine.listing("pics").collect()}
    assert set(rows) == {"img_a.png", "img_a_copy.png", "deep dir/img_a_small.png", "img_b.png", "broken.png"}
    assert rows["img_a.png"].size == rows["img_a_copy.png"].size > 0 and engine.folders() == ["pics"]
    assert folder.content_mtime(engine.data_dir + "/pics") > 0
    with pytest.raises(ValueError):
        engine.scan("../x")
    with pytest.raises(FileNotFoundError):
        engine.scan("nowhere")


def test_scan_rescan_and_decide(engine):
    assert engine.cached_results("pics") is None and engine.stats("pics")["total_files"] == 0
    seen = []
    first = engine.scan("pics", lambda *a: seen.append(a[0])).collect()
    assert seen == ["listing", "hashing", "grouping", "complete"] and len(first) == 1
    want = ("deep dir/img_a_small.png", "img_a.png", "img_a_copy.png")
    assert groups(engine) == {want: {want[0]: (False, False), want[1]: (True, False), want[2]: (False, True)}}
    assert [tuple(r) for r in engine.exact_actions("pics").collect()] == [("img_a_copy.png", "img_a.png", "img_a.png")]
    assert engine.stats("pics")["duplicate_groups"] == 1 and engine.summary("pics")["status"] == "complete"

    again = engine.scan("pics").collect()
    assert again == first

    # a late similar picture joins, an unrelated one does not, a removed one goes
    root = engine.data_dir + "/pics"
    png_path = __import__("pathlib").Path(root) / "img_a_mid.png"
    png(png_path, resize(luma(smooth(240, 240, 1)), 180, 180)[..., None].repeat(3, axis=2).astype(np.uint8))
    png(png_path.with_name("img_c.png"), gradient(210, 210, 133))
    os.remove(root + "/img_a_copy.png")
    engine.scan("pics")
    assert list(groups(engine)) == [("deep dir/img_a_small.png", "img_a.png", "img_a_mid.png")]

    gid = engine.members("pics").first().group_id
    engine.manage("pics", "set_best", gid, "img_a_mid.png")
    assert {r.path for r in engine.members("pics").where("is_best").collect()} == {"img_a_mid.png"}
    assert engine.manage("pics", "process_all", gid) and not os.path.islink(root + "/img_a.png")
    done = engine.manage("pics", "delete", gid, "deep dir/img_a_small.png", dry_run=False)
    assert done == [("deep dir/img_a_small.png", "img_a_mid.png", "replaced")]
    assert os.readlink(root + "/deep dir/img_a_small.png") == "../img_a_mid.png"
    assert list(groups(engine)) == [("img_a.png", "img_a_mid.png")]
    engine.invalidate("pics")
    assert engine.cached_results("pics") is None


def test_videos_use_their_providers(spark):
    frames = {"a.mp4": gradient(64, 64, 1)}
    df = spark.createDataFrame([("a.mp4", "a.mp4"), ("b.mp4", "b.mp4")], "path string, file string")
    got = {r.path: r for r in media.video_rows(df, frames.get, lambda p: (640, 480, 3.0) if p == "a.mp4" else (0, 0, 0.0)).collect()}
    assert (got["a.mp4"].phash, got["a.mp4"].dhash) == signature(frames["a.mp4"]) and got["a.mp4"].duration == 3.0
    assert got["b.mp4"].phash is None and got["b.mp4"].width == 0
    assert media.parse_probe('{"streams":[{"width":0},{"width":4,"height":3,"duration":"2.5"}]}') == (4, 3, 2.5)
    assert media.parse_probe("no json") == (0, 0, 0.0)
    assert media.read_ppm(b"P6 2 1 255\n" + bytes(range(6))).tolist() == [[[0, 1, 2], [3, 4, 5]]]
    assert media.read_ppm(b"junk") is None
