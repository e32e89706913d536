"""Signatures and dimensions of image and video files.

Images are decoded by Spark's image source on the executors. Frames and properties of videos come from a provider, by
default the ffmpeg and ffprobe programs; where these are missing or fail, the signature is null and dimensions are zero.
"""

from __future__ import annotations

import json
import shutil
import subprocess
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.imagehash import signature

Frame = Callable[[str], "np.ndarray | None"]
Probe = Callable[[str], tuple[int, int, float]]
#: Seconds into a video, width of its frame, limits of the programs.
FRAME_AT, FRAME_WIDTH, FRAME_TIMEOUTS, PROBE_TIMEOUT = 1.0, 320, (10, 15), 10


def image_rows(spark: SparkSession, files: list[str] | str) -> DataFrame:
    """``(origin, width, height, channels, data)``; a file that cannot be decoded has width -1."""
    found = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(files)
    return found.select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def image_signatures(images: DataFrame) -> DataFrame:
    """``(origin, phash, dhash, width, height)`` of decoded images; null and zero for broken ones."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = []
            for origin, w, h, n, data in zip(b["origin"], b["width"], b["height"], b["channels"], b["data"], strict=True):
                if w <= 0 or h <= 0 or data is None or len(data) != w * h * n:
                    out.append((origin, None, None, 0, 0))
                    continue
                pixels = np.frombuffer(data, np.uint8).reshape(h, w, n)
                rgb = pixels[..., 2::-1] if n >= 3 else np.repeat(pixels[..., :1], 3, axis=2)
                out.append((origin, *signature(rgb), w, h))
            df = pd.DataFrame(out, columns=["origin", "phash", "dhash", "width", "height"])
            yield df.astype({"phash": "Int64", "dhash": "Int64"})

    return images.mapInPandas(run, "origin string, phash long, dhash long, width int, height int")


def ffmpeg_frame(path: str) -> np.ndarray | None:
    """One RGB frame, scaled to a width of 320; None if the program is missing or gives nothing."""
    if not shutil.which("ffmpeg"):
        return None
    command = ["ffmpeg", "-v", "error", "-ss", str(FRAME_AT), "-i", path, "-frames:v", "1", "-vf", f"scale={FRAME_WIDTH}:-2", "-f", "image2pipe", "-vcodec", "ppm", "-"]
    for limit in FRAME_TIMEOUTS:
        try:
            out = subprocess.run(command, capture_output=True, timeout=limit, check=True).stdout
        except (subprocess.SubprocessError, OSError):
            continue
        if (frame := read_ppm(out)) is not None:
            return frame
    return None


def read_ppm(data: bytes) -> np.ndarray | None:
    """Pixels of a binary PPM."""
    head = data[:64].split(maxsplit=4)
    if len(head) < 4 or head[0] != b"P6" or not all(x.isdigit() for x in head[1:4]):
        return None
    w, h = int(head[1]), int(head[2])
    body = data[len(data) - 3 * w * h :] if len(data) > 3 * w * h else b""
    return np.frombuffer(body, np.uint8).reshape(h, w, 3) if body and w and h else None


def ffprobe(path: str) -> tuple[int, int, float]:
    """Width, height and seconds of a video; zeros if they cannot be had."""
    if not shutil.which("ffprobe"):
        return 0, 0, 0.0
    command = ["ffprobe", "-v", "error", "-print_format", "json", "-show_streams", "-show_format", path]
    try:
        return parse_probe(subprocess.run(command, capture_output=True, timeout=PROBE_TIMEOUT, check=True).stdout)
    except (subprocess.SubprocessError, OSError):
        return 0, 0, 0.0


def parse_probe(text: bytes | str) -> tuple[int, int, float]:
    """The first stream with both dimensions, and the duration of the file or else of that stream."""
    try:
        found = json.loads(text)
        streams = found.get("streams") or []
        s = next((s for s in streams if int(s.get("width") or 0) > 0 and int(s.get("height") or 0) > 0), {})
        seconds = (found.get("format") or {}).get("duration") or s.get("duration") or 0
        return int(s.get("width") or 0), int(s.get("height") or 0), float(seconds)
    except (ValueError, TypeError, AttributeError):
        return 0, 0, 0.0


def video_rows(videos: DataFrame, frame: Frame = ffmpeg_frame, probe: Probe = ffprobe) -> DataFrame:
    """``videos(path, file)`` to ``(path, phash, dhash, width, height, duration)``; ``file`` is what the providers open."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = []
            for path, file in zip(b["path"], b["file"], strict=True):
                pixels = frame(file)
                out.append((path, *(signature(pixels) if pixels is not None else (None, None)), *probe(file)))
            df = pd.DataFrame(out, columns=["path", "phash", "dhash", "width", "height", "duration"])
            yield df.astype({"phash": "Int64", "dhash": "Int64"})

    return videos.select("path", "file").mapInPandas(run, "path string, phash long, dhash long, width int, height int, duration double")


def missing_tools() -> list[str]:
    """Programs that videos need and that are not installed."""
    return [t for t in ("ffmpeg", "ffprobe") if not shutil.which(t)]
