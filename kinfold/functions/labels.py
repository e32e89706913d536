"""Scalar functions as Column expressions: names, labels, scores, delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of sizes, pixels of full HD, seconds of the retry schedule.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
FULL_HD = 1920 * 1080
RETRY_BASE, RETRY_MOST = 300.0, 3600.0


def one_decimal(x: Column) -> Column:
    """A number with one decimal, the half rounded to even as most languages print it."""
    return F.call_function("format_number", x, F.lit("0.0"))


def normalize_extensions(extensions: Column) -> Column:
    """Lower-cased extensions with a leading dot, without blanks and repeats, in order."""
    low = F.transform(extensions, lambda e: F.lower(F.trim(e)))
    dotted = F.transform(F.filter(low, lambda e: e.isNotNull() & (e != "")), lambda e: F.when(e.startswith("."), e).otherwise(F.concat(F.lit("."), e)))
    return F.array_distinct(dotted)


def extension(path: Column) -> Column:
    """The last suffix of a path's file name with its dot, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def media_kind(path: Column, images: tuple[str, ...], videos: tuple[str, ...]) -> Column:
    """image, video or null. Image endings are tried first."""
    low = F.lower(path)
    ends = lambda among: F.exists(F.array(*[F.lit(e) for e in among]), lambda e: F.endswith(low, e))
    return F.when(ends(images), "image").when(ends(videos), "video")


def known(width: Column, height: Column) -> Column:
    return (F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0)


def pixel_count(width: Column, height: Column) -> Column:
    return F.coalesce(width.cast("long") * height.cast("long"), F.lit(0).cast("long"))


def resolution_label(width: Column, height: Column) -> Column:
    return F.when(known(width, height), F.concat(width.cast("string"), F.lit("x"), height.cast("string"))).otherwise("Unknown")


def format_size(size: Column) -> Column:
    """``1.5 KB``: the largest unit up to PB that leaves 1 or more; ``0 B`` for nothing."""
    size = size.cast("double")
    out = F.when(size.isNull() | (size <= 0), "0 B")
    for i, unit in enumerate(SIZE_UNITS):
        shown = F.concat(one_decimal(size / float(1024**i)), F.lit(f" {unit}"))
        out = out.otherwise(shown) if i == len(SIZE_UNITS) - 1 else out.when(size < float(1024 ** (i + 1)), shown)
    return out


def format_timestamp(seconds: Column) -> Column:
    """``HH:MM:SS`` of whole seconds, hours unbounded, nothing below zero."""
    s = F.greatest(F.floor(F.coalesce(seconds, F.lit(0.0))), F.lit(0)).cast("long")
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    return F.concat_ws(":", two(F.floor(s / 3600).cast("long")), two(F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long")), two(F.pmod(s, F.lit(60))))


def duration_label(seconds: Column) -> Column:
    return F.when(F.coalesce(seconds, F.lit(0.0)) > 0, F.concat(one_decimal(seconds), F.lit("s"))).otherwise("Unknown")


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def thumb_path(path: Column) -> Column:
    """Where a video's frame is kept: beside it, named by the whole file name so that no two videos share one."""
    folder, frame = folder_of(path), F.concat(F.lit("thumb-frame."), base_name(path), F.lit(".jpg"))
    return F.when(folder == "", frame).otherwise(F.concat(folder, F.lit("/"), frame))


def is_thumb(path: Column) -> Column:
    """Whether a file or a folder above it is a thumbnail's."""
    return path.rlike(r"(^|/)thumb(-[A-Za-z0-9]+)?\.")


def link_target(link: Column, target: Column) -> Column:
    """A relative path from the folder of ``link`` to ``target``, both relative to one root."""
    a, b = (F.filter(F.split(folder_of(p), "/"), lambda x: x != "") for p in (link, target))
    n = F.least(F.size(a), F.size(b))
    same = F.aggregate(F.sequence(F.lit(0), n), F.lit(0), lambda acc, i: F.when((i < n) & (acc == i) & (F.get(a, i) == F.get(b, i)), i + 1).otherwise(acc))
    up = F.array_repeat(F.lit(".."), F.size(a) - same)
    down = F.slice(b, same + 1, F.greatest(F.size(b) - same, F.lit(0)))
    return F.array_join(F.concat(up, down, F.array(base_name(target))), "/")


def similarity(distance: Column) -> Column:
    """1 at distance 0, falling to 0 at 10; 0 where there is no distance."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - distance / 10.0), F.lit(0.0))


def enhanced_score(width, height, duration, size, ref_width=None, ref_height=None, ref_duration=None, ref_size=None) -> Column:
    """Quality from 0 to 1: pixels against full HD, with a bonus or malus for duration and size against a reference of
    equal resolution. References that are absent or zero say nothing."""
    none = F.lit(None).cast("double")
    ref_width, ref_height, ref_duration, ref_size = (none if c is None else c for c in (ref_width, ref_height, ref_duration, ref_size))
    alike = F.coalesce((width == ref_width) & (height == ref_height), F.lit(False))

    def bonus(value: Column, ref: Column, most: float, malus: float) -> Column:
        ratio = F.coalesce(value, F.lit(0)).cast("double") / F.when(ref > 0, ref.cast("double"))
        moved = F.when(ratio > 1, F.least(F.lit(most), (ratio - 1) * 0.1)).when(ratio < 0.5, F.lit(malus)).otherwise(0.0)
        return F.when(alike & (ref > 0), moved).otherwise(0.0)

    base = F.least(F.lit(1.0), pixel_count(width, height) / float(FULL_HD))
    total = base + bonus(duration, ref_duration, 0.3, -0.2) + bonus(size, ref_size, 0.2, -0.1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def metric_key(name: Column, tags: Column) -> Column:
    """``name[k=v,...]`` with the tags in key order, or the bare name."""
    pairs = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, F.concat(name, F.lit("["), F.array_join(pairs, ","), F.lit("]"))).otherwise(name)


def retry_delay(status: Column, failures: Column) -> Column:
    """Seconds to wait after failures: doubling from 300 while pending, and from 600 up to an hour after an error."""
    n = failures.cast("double")
    pending = RETRY_BASE * F.pow(F.lit(2.0), n - 1)
    return F.when(failures <= 0, 0.0).when(status == "error", F.least(RETRY_BASE * F.pow(F.lit(2.0), n), F.lit(RETRY_MOST))).otherwise(pending)


def megabytes(size: Column) -> Column:
    return size / 1048576.0


def safe_folder_name(name: Column) -> Column:
    """Whether a name is one folder below the root and nothing else."""
    return F.coalesce((name != "") & ~name.contains("..") & ~name.contains("/") & ~name.contains("\\"), F.lit(False))


def url_of(folder: Column, path: Column) -> Column:
    """The address of a file: each path segment percent-encoded, spaces as %20."""
    code = lambda c: F.regexp_replace(F.url_encode(c), r"\+", "%20")
    return F.concat_ws("/", F.lit("/data"), code(folder), F.array_join(F.transform(F.split(path, "/"), code), "/"))
