"""Groups of near-duplicate assets: from scratch, and by attaching what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.signatures import group_id
from kinfold.operators.components import connected_components
from kinfold.operators.simjoin import THRESHOLD, collapse, nearest, signature_pairs
from kinfold.runtime import materialize


def members(signatures: DataFrame, t: int = THRESHOLD, path: str = "path") -> DataFrame:
    """``(kind, rep, path)``: the members of each group of two or more assets that hang together by steps of at most
    ``t`` bits, ``rep`` the smallest path. Kinds are never mixed, assets without signature are in no group.

    Nothing is broadcast: nodes, parts and groups grow with the input, and what is broadcast passes through the driver."""
    nodes = materialize(collapse(signatures, path), "nodes").withColumn("id", F.struct("kind", "phash", "dhash"))
    pairs = signature_pairs(nodes, t)
    name = lambda side: F.struct("kind", F.col(f"{side}_phash").alias("phash"), F.col(f"{side}_dhash").alias("dhash"))
    parts = connected_components(pairs.select(name("a").alias("src"), name("b").alias("dst")))
    labelled = nodes.join(parts.withColumnRenamed("node", "id").hint("merge"), "id", "left").withColumn("part", F.coalesce("component", "id"))
    groups = labelled.groupBy("part").agg(F.min("first").alias("rep"), F.sum("n").alias("size"), F.count("*").alias("forms")).where("size > 1")
    of = labelled.join(groups.hint("merge"), "part").select("kind", "phash", "dhash", "rep", "forms")
    kind = F.col("kind") if "kind" in signatures.columns else F.lit("asset")
    rows = signatures.select(F.col(path).alias("path"), kind.alias("kind"), "phash", "dhash")
    return rows.join(of.hint("merge"), ["kind", "phash", "dhash"]).select("kind", "rep", "path", (F.col("forms") == 1).alias("equal"))


def cold(signatures: DataFrame, t: int = THRESHOLD, path: str = "path") -> DataFrame:
    """Groups in packed form: ``(rep, kind, files, size, label, group_id)``; files ascending, label ``exact`` where all
    signatures of the group are equal and ``similar`` otherwise."""
    return pack(members(signatures, t, path))


def pack(rows: DataFrame) -> DataFrame:
    files = F.array_sort(F.collect_list("path"))
    grouped = rows.groupBy("rep", "kind").agg(files.alias("files"), F.bool_and("equal").alias("equal"))
    label = F.when(F.col("equal"), "exact").otherwise("similar")
    return grouped.select("rep", "kind", "files", F.size("files").alias("size"), label.alias("label"), group_id(F.col("files")).alias("group_id"))


def kind_counts(groups: DataFrame) -> DataFrame:
    """One row: groups whose signatures are equal, other groups, all groups."""
    return groups.agg(F.count_if(F.col("label") == "exact").alias("exact_groups"), F.count_if(F.col("label") == "similar").alias("similar_groups"), F.count("*").alias("total_groups"))


def incremental(signatures: DataFrame, existing: DataFrame, new: DataFrame, t: int = THRESHOLD, max_rounds: int = 64) -> DataFrame:
    """Attach new assets to existing groups: ``(rep, path)`` of all members, singles left out.

    ``signatures(path, phash, dhash[, kind])`` covers known and new assets, ``existing(rep, path)`` the groups so far,
    ``new(path)`` what to attach, in path order. Each new asset follows the nearest of the known ones and of the new ones
    before it. It joins that one's group; where that has none the two found one, named by the older. Groups that a new
    asset lies between stay apart; only ``cold`` joins them. Known assets do not move; an asset that is new because it
    changed leaves its old group first.

    Which asset is nearest does not depend on groups, so all parents are found by one join; chains of new assets are
    then followed to their ends by doubling.
    """
    kind = F.col("kind") if "kind" in signatures.columns else F.lit("asset")
    sigs = materialize(signatures.where("phash is not null and dhash is not null").select("path", kind.alias("kind"), "phash", "dhash"), "signatures")
    fresh = sigs.join(new.select("path").distinct(), "path", "left_semi")
    among = sigs.join(new.select("path", F.lit(True).alias("late")).distinct(), "path", "left").withColumn("late", F.coalesce("late", F.lit(False)))
    links = materialize(nearest(fresh, among, t).select("path", F.col("near").alias("up")), "parents")
    for _ in range(max_rounds):
        further = links.alias("a").join(links.alias("b"), F.col("a.up") == F.col("b.path"), "left")
        moved = materialize(further.select("a.path", F.coalesce("b.up", "a.up").alias("up"), F.col("b.up").isNotNull().alias("moved")), "chains")
        links = moved.select("path", "up")
        if moved.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("chains of new assets did not end")
    held = existing.select("rep", "path").join(new.select("path").distinct(), "path", "left_anti").select("rep", "path")
    home = links.join(held.withColumnRenamed("path", "up"), "up", "left").select(F.coalesce("rep", "up").alias("rep"), "path")
    founders = home.join(held, home.rep == held.path, "left_anti").select("rep").distinct().select("rep", F.col("rep").alias("path"))
    founders = founders.join(held.select("path"), "path", "left_anti")
    rows = held.unionByName(home).unionByName(founders).distinct()
    sizes = rows.groupBy("rep").count().where("count > 1").select("rep")
    return rows.join(sizes, "rep").select("rep", "path")


def membership_diff(groups: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, side)``: members that are not among ``files(path)`` and files that no group of ``groups(path)`` has."""
    a, b = groups.select("path").distinct(), files.select("path").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("gone")).unionByName(b.exceptAll(a).withColumn("side", F.lit("ungrouped")))


def is_stale(groups: DataFrame, files: DataFrame) -> bool:
    return not membership_diff(groups, files).isEmpty()
