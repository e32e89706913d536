"""The best member of a group, exact copies of it, and what is left when these go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.labels import duration_label, format_size, pixel_count, resolution_label


def ranked(rows: DataFrame, group: str = "rep", pos: str = "path", video: Column | None = None) -> DataFrame:
    """``rows`` with ``is_best``: the first member by pixels, or where ``video`` holds, within the resolution of the first
    member by pixels the one with the longest duration, then the largest size. Ties go to the earlier ``pos``."""
    by = Window.partitionBy(group)
    px = pixel_count(F.col("width"), F.col("height"))
    first = by.orderBy(F.desc(px), pos)
    is_video = F.lit(False) if video is None else video
    shape = F.first(F.struct("width", "height")).over(first)
    alike = F.struct("width", "height").eqNullSafe(shape)
    zero = F.lit(0)
    long_ = F.when(is_video, F.coalesce("duration", zero.cast("double"))).otherwise(0.0) if "duration" in rows.columns else F.lit(0.0)
    large = F.when(is_video, F.coalesce("size", zero.cast("long"))).otherwise(0)
    out = rows.withColumn("_alike", F.when(is_video, alike).otherwise(True)).withColumn("_long", long_).withColumn("_large", large)
    order = by.orderBy(F.desc("_alike"), F.desc(F.when(is_video, zero).otherwise(px)), F.desc("_long"), F.desc("_large"), pos)
    return out.withColumn("is_best", F.row_number().over(order) == 1).drop("_alike", "_long", "_large")


def with_overrides(rows: DataFrame, overrides: DataFrame, group: str = "rep", group_key: str = "group_id") -> DataFrame:
    """Let a chosen best file of ``overrides(group_id, best_file)`` win where it is a member of its group."""
    chosen = rows.join(overrides.select(group_key, "best_file"), group_key, "left")
    mine = F.coalesce(F.col("path") == F.col("best_file"), F.lit(False))
    has = F.max(mine).over(Window.partitionBy(group))
    return chosen.withColumn("is_best", F.when(has, mine).otherwise(F.col("is_best"))).drop("best_file")


def with_exact(rows: DataFrame, group: str = "rep", rule: str = "dims_size") -> DataFrame:
    """``is_exact``: a member other than the best whose width, height and size equal the best's. Unknown dimensions equal
    nothing. The rule ``dims_size_hash`` asks for equal signatures as well."""
    best = lambda c: F.max(F.when(F.col("is_best"), F.col(c))).over(Window.partitionBy(group))
    equal = (F.col("width") == best("width")) & (F.col("height") == best("height")) & (F.col("size") == best("size"))
    if rule == "dims_size_hash":
        equal &= (F.col("phash") == best("phash")) & (F.col("dhash") == best("dhash"))
    elif rule != "dims_size":
        raise ValueError(f"unknown rule {rule!r}")
    return rows.withColumn("is_exact", F.coalesce(~F.col("is_best") & equal, F.lit(False)))


def eliminate(rows: DataFrame, group: str = "rep") -> tuple[DataFrame, DataFrame]:
    """Split members with is_best and is_exact into actions ``(group, dup, best)`` that replace exact copies by their
    best, and the members that stay, without groups of which only the best does."""
    by = Window.partitionBy(group)
    best = F.max(F.when(F.col("is_best"), F.col("path"))).over(by)
    size = F.count("*").over(by)
    marked = rows.withColumn("_best", best).withColumn("_left", size - F.count_if("is_exact").over(by)).withColumn("_size", size)
    actions = marked.where("is_exact and _size > 1").select(group, F.col("path").alias("dup"), F.col("_best").alias("best"))
    return actions, marked.where("not is_exact and _left > 1").drop("_best", "_left", "_size")


def described(video: bool) -> Column:
    """A member as results show it."""
    out = [
        F.col("path"), F.struct(F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"), resolution_label(F.col("width"), F.col("height")).alias("label")).alias("resolution"),
        F.col("size"), format_size(F.col("size")).alias("size_formatted"),
    ]
    if video:
        out += [F.coalesce("duration", F.lit(0.0)).alias("duration"), duration_label(F.col("duration")).alias("duration_formatted")]
    return F.struct(*out)


def result_groups(rows: DataFrame, video: bool = False, group: str = "rep") -> DataFrame:
    """Nested results of members with is_best and is_exact: ``(group_id, best_file, duplicate_files)``; other members
    follow the best in path order, each with its exact flag."""
    member = rows.withColumn("m", described(video))
    others = F.array_sort(F.collect_list(F.when(~F.col("is_best"), F.struct("path", "m", "is_exact"))))
    out = member.groupBy(group, "group_id").agg(F.max(F.when(F.col("is_best"), F.col("m"))).alias("best_file"), others.alias("o"), F.count("*").alias("n"))
    flat = F.transform("o", lambda x: x["m"].withField("is_exact_match", x["is_exact"]))
    return out.where("n > 1").select("group_id", "best_file", flat.alias("duplicate_files"))
