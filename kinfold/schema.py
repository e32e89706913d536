"""Relations of the engine. Times are seconds since the epoch, as the state tables keep them."""

from __future__ import annotations

#: A file or record that may have duplicates; ``path`` is relative to its folder.
ASSET = "folder string, path string, kind string, size long, mtime double"
#: Two 64-bit fingerprints, signed; null where the asset could not be read.
SIGNATURE = "path string, phash long, dhash long"
METADATA = "path string, width int, height int, duration double, mtime double, size long, updated_at double"
HASHES = "path string, phash long, dhash long, mtime double, size long, updated_at double"
GROUPING = "rep string, files array<string>, updated_at double"
BEST = "group_id string, best_file string, updated_at double"
GROUPS = "group_id string, files array<string>, processed boolean, updated_at double"
META = "key string, value string"
STATE_TABLES = {"file_hashes": HASHES, "grouping_results": GROUPING, "best_files": BEST, "groups": GROUPS, "media_metadata": METADATA}
STATE_VERSION = "2.2"

#: The file kinds of the default configuration. GIF counts as a video.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tiff", ".tif", ".avif")
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv", ".gif", ".webm", ".flv", ".wmv", ".m4v")

METRIC = "id long, ts timestamp, kind string, name string, tags map<string,string>, value double"
