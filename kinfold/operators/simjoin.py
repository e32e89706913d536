"""Similarity joins on dual signatures: all pairs whose larger Hamming distance is within a threshold.

Within a threshold t, two signatures agree wholly on at least one of t + 1 bit fields of their first hash, and on one of
their second. A pair is looked for under the pair of the first field of either hash that it agrees on, and nowhere else:
an equi-join on (field, field, value, value) that is exact, finds each pair once and needs no deduplication. Signatures
that many assets share are joined once. Where only the first hash counts, it has t + 2 fields, of which two agree, and a
pair is looked for under the first two that do: one field alone would be too narrow.

Filed signatures are never broadcast, whatever the session allows: the planner takes them for as small as the table that
they come from, although each has a row for every pair of fields, 36 at t = 5.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.signatures import distance, hamming
from kinfold.runtime import materialize, partitions_for

THRESHOLD = 5
#: Above this threshold fields are too narrow to tell anything; blocks are compared outright.
WIDEST = 10
BLOCK = 4096
#: Paths of a signature that meet as one list.
LISTED = 512


def fields(h: Column, t: int) -> list[Column]:
    cuts = [64 * i // (t + 1) for i in range(t + 2)]
    return [F.shiftrightunsigned(h, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) if b - a < 64 else h for a, b in zip(cuts, cuts[1:], strict=False)]


def _first_equal(a: str, b: str, t: int) -> Column:
    out = None
    for i in range(t + 1):
        x, y = (fields(F.col(c), t)[i] for c in (a, b))
        out = F.when(x == y, i) if out is None else out.when(x == y, i)
    return out


def _first_two_equal(a: str, b: str, t: int) -> Column:
    x, y = (fields(F.col(c), t + 1) for c in (a, b))
    out = None
    for n, (i, j) in enumerate(combinations(range(t + 2), 2)):
        both = (x[i] == y[i]) & (x[j] == y[j])
        out = F.when(both, n) if out is None else out.when(both, n)
    return out


def _filed(sigs: DataFrame, t: int, single: bool) -> DataFrame:
    if single:
        f = fields(F.col("phash"), t + 1)
        two = [F.shiftleft(f[i], 32).bitwiseOR(f[j]) for i, j in combinations(range(t + 2), 2)]
        return sigs.select("*", F.posexplode(F.array(*two)).alias("pf", "pv")).withColumn("df", F.lit(0)).withColumn("dv", F.lit(0).cast("long"))
    one = sigs.select("*", F.posexplode(F.array(*fields(F.col("phash"), t))).alias("pf", "pv"))
    return one.select("*", F.posexplode(F.array(*fields(F.col("dhash"), t))).alias("df", "dv"))


def collapse(signatures: DataFrame, path: str = "path") -> DataFrame:
    """Distinct non-null signatures of each kind: ``(kind, phash, dhash, first, n)``, first the smallest path."""
    kind = F.col("kind") if "kind" in signatures.columns else F.lit("asset")
    known = signatures.where("phash is not null and dhash is not null").withColumn("kind", kind)
    return known.groupBy("kind", "phash", "dhash").agg(F.min(path).alias("first"), F.count("*").alias("n"))


def signature_pairs(nodes: DataFrame, t: int = THRESHOLD, phash_only: bool = False) -> DataFrame:
    """``(kind, a_phash, a_dhash, b_phash, b_dhash, distance)`` of distinct ``nodes(kind, phash, dhash)``, each unordered
    pair once, within ``t`` bits. With ``phash_only`` the second hash is not compared."""
    sigs = nodes.select("kind", "phash", "dhash")
    apart = hamming(F.col("a_phash"), F.col("b_phash")) if phash_only else distance(*[F.col(c) for c in ("a_phash", "a_dhash", "b_phash", "b_dhash")])
    if t > WIDEST:
        return _block_pairs(sigs, t, phash_only)
    f = _filed(sigs, t, phash_only)
    on = ["kind", "pf", "pv", "df", "dv"]
    a = f.select(*on, F.col("phash").alias("a_phash"), F.col("dhash").alias("a_dhash"))
    b = f.select(*on, F.col("phash").alias("b_phash"), F.col("dhash").alias("b_dhash"))
    ordered = (F.col("a_phash") < F.col("b_phash")) | (F.col("a_phash") == F.col("b_phash")) & (F.col("a_dhash") < F.col("b_dhash"))
    if phash_only:
        once = _first_two_equal("a_phash", "b_phash", t) == F.col("pf")
    else:
        once = (_first_equal("a_phash", "b_phash", t) == F.col("pf")) & (_first_equal("a_dhash", "b_dhash", t) == F.col("df"))
    joined = a.hint("merge").join(b.hint("merge"), on).where(ordered & (apart <= t) & once)
    return joined.select("kind", "a_phash", "a_dhash", "b_phash", "b_dhash", apart.cast("int").alias("distance"))


def _block_pairs(sigs: DataFrame, t: int, phash_only: bool) -> DataFrame:
    """The same by comparing blocks of signatures with each other: for thresholds that no index prunes."""
    spark = sigs.sparkSession
    blocks = max(1, -(-sigs.count() // BLOCK))
    own = F.pmod(F.xxhash64("phash", "dhash"), F.lit(blocks)).cast("int")
    numbered = sigs.withColumn("i", own)
    left = numbered.select(F.explode(F.sequence("i", F.lit(blocks - 1))).alias("j"), "i", F.lit(0).alias("side"), "kind", "phash", "dhash")
    right = numbered.select(F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), "i")).alias("i"), F.lit(1).alias("side"), "kind", "phash", "dhash")

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = [x for x in it if x.num_rows]
        if not b:
            return
        whole = pa.Table.from_batches(b)
        j, i, side = (whole.column(c).to_numpy() for c in ("j", "i", "side"))
        kind = whole.column("kind").to_numpy(zero_copy_only=False).astype(str)
        p, d = (whole.column(c).to_numpy().view(np.uint64) for c in ("phash", "dhash"))
        for pair in np.unique(np.stack([i, j], axis=1), axis=0):
            here = (i == pair[0]) & (j == pair[1])
            x, y = np.flatnonzero(here & (side == 0)), np.flatnonzero(here & (side == 1))
            for s in range(0, len(x), 256):
                q = x[s : s + 256]
                far = np.bitwise_count(p[q, None] ^ p[None, y]).astype(np.int32)
                if not phash_only:
                    far = np.maximum(far, np.bitwise_count(d[q, None] ^ d[None, y]))
                a, c = np.nonzero((far <= t) & (kind[q, None] == kind[None, y]))
                f, a, c = far[a, c], q[a], y[c]
                ps, ds = p.view(np.int64), d.view(np.int64)
                less = (ps[a] < ps[c]) | (ps[a] == ps[c]) & (ds[a] < ds[c])
                keep = less if pair[0] == pair[1] else (a != c)
                lo, hi = np.where(less, a, c)[keep], np.where(less, c, a)[keep]
                yield pa.RecordBatch.from_arrays([pa.array(kind[lo]), *(pa.array(z) for z in (ps[lo], ds[lo], ps[hi], ds[hi])), pa.array(f[keep])], ["kind", "a_phash", "a_dhash", "b_phash", "b_dhash", "distance"])

    sent = left.unionByName(right).repartition(blocks * (blocks + 1) // 2, "i", "j")
    schema = "kind string, a_phash long, a_dhash long, b_phash long, b_dhash long, distance int"
    return spark.createDataFrame([], schema) if not blocks else sent.mapInArrow(compare, schema)


def similar_pairs(signatures: DataFrame, t: int = THRESHOLD, path: str = "path", phash_only: bool = False) -> DataFrame:
    """All pairs of assets within ``t`` bits: ``(a, b, distance)`` with a < b; assets without signature have none.

    This lists the pairs inside groups of equal signatures too, which grow with the square of a group; ``grouping``
    works on distinct signatures and does not need them. Distinct signatures are joined; the paths of each travel as lists
    of about ``LISTED`` and become rows last, dealt by pairs of lists, so that no task lists all pairs of a large group.
    """
    spark = signatures.sparkSession
    kind = F.col("kind") if "kind" in signatures.columns else F.lit("asset")
    second = F.lit(0).cast("long") if phash_only else F.col("dhash")
    known = signatures.where("phash is not null and dhash is not null").select(F.col(path).alias("path"), kind.alias("kind"), "phash", second.alias("dhash"))
    sig = ["kind", "phash", "dhash"]
    counted = materialize(known.groupBy(*sig).agg(F.count("*").alias("n"), F.ceil(F.count("*") / LISTED).alias("parts")), "counted")
    numbered = known.join(counted.where("parts > 1").select(*sig, "parts"), sig, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("path"), "parts"), F.lit(0).cast("long")))
    lists = materialize(numbered.groupBy(*sig, "part").agg(F.collect_list("path").alias("paths")), "lists")

    def side(s: str) -> list[Column]:
        return ["kind", F.col("phash").alias(f"{s}_phash"), F.col("dhash").alias(f"{s}_dhash")]

    upto = F.col("parts") - 1
    same = counted.where("n > 1").select("*", F.explode(F.sequence(F.lit(0).cast("long"), upto)).alias("a_part")).select("*", F.explode(F.sequence("a_part", upto)).alias("b_part"))
    same = same.select(*side("a"), F.col("phash").alias("b_phash"), F.col("dhash").alias("b_dhash"), F.lit(0).alias("distance"), "a_part", "b_part")
    apart = signature_pairs(counted, t, phash_only)
    for s in "ab":
        large = counted.where("parts > 1").select(*side(s), "parts")
        apart = apart.join(large, ["kind", f"{s}_phash", f"{s}_dhash"], "left").withColumn(f"{s}_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1))).drop("parts")
    met = apart.unionByName(same).withColumn("own", (F.col("a_phash") == F.col("b_phash")) & (F.col("a_dhash") == F.col("b_dhash")) & (F.col("a_part") == F.col("b_part")))
    for s in "ab":
        met = met.join(lists.select(*side(s), F.col("part").alias(f"{s}_part"), F.col("paths").alias(f"{s}_paths")), ["kind", f"{s}_phash", f"{s}_dhash", f"{s}_part"])
    n = partitions_for(spark, 0)
    dealt = met.repartition(n, *[f"{s}_{c}" for s in "ab" for c in ("phash", "dhash", "part")])
    listed = dealt.select("distance", "own", "b_paths", F.explode("a_paths").alias("a")).select("distance", "own", "a", F.explode("b_paths").alias("b"))
    return listed.where("a < b or a > b and not own").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")


def nearest(new: DataFrame, known: DataFrame, t: int = THRESHOLD) -> DataFrame:
    """For each row of ``new(path, kind, phash, dhash)`` the nearest of ``known`` within ``t`` bits other than itself,
    the smaller path on ties: ``(path, near, distance)``. Rows of ``known`` with a column ``late`` set only count for
    paths above their own.

    Distinct signatures are joined, and of the assets of a known one only those that can be nearest count: the two
    smallest paths, as one may be the row itself, and the smallest late one. So n equal assets make n rows.
    """
    if t > WIDEST:
        raise ValueError(f"nearest needs a threshold of at most {WIDEST}")
    sig, on = ["kind", "phash", "dhash"], ["kind", "pf", "pv", "df", "dv"]
    late = F.col("late") if "late" in known.columns else F.lit(False)
    rows = known.select("path", *sig, late.alias("late"))
    least = rows.groupBy(*sig).agg(F.min(F.when(~F.col("late"), F.col("path"))).alias("low"), F.min(F.when(F.col("late"), F.col("path"))).alias("late"))
    after = rows.where("not late").drop("late").join(least, sig).where("path > low").groupBy(*sig).agg(F.min("path").alias("after"))
    least = least.join(after, sig, "left")
    a = _filed(new.select(*sig).distinct(), t, False).select(*on, F.col("phash").alias("a_phash"), F.col("dhash").alias("a_dhash"))
    b = _filed(least, t, False).select(*on, "low", "after", "late", F.col("phash").alias("b_phash"), F.col("dhash").alias("b_dhash"))
    apart = distance(*[F.col(c) for c in ("a_phash", "a_dhash", "b_phash", "b_dhash")])
    once = (_first_equal("a_phash", "b_phash", t) == F.col("pf")) & (_first_equal("a_dhash", "b_dhash", t) == F.col("df"))
    pairs = a.hint("merge").join(b.hint("merge"), on).where((apart <= t) & once).select("kind", F.col("a_phash").alias("phash"), F.col("a_dhash").alias("dhash"), "low", "after", "late", apart.cast("int").alias("distance"))
    near = F.least(F.when(F.col("low") != F.col("path"), F.col("low")).otherwise(F.col("after")), F.when(F.col("late") < F.col("path"), F.col("late")))
    found = new.select("path", *sig).join(pairs, sig).withColumn("near", near).where("near is not null")
    return found.groupBy("path").agg(F.min(F.struct("distance", "near")).alias("m")).select("path", "m.near", "m.distance")
