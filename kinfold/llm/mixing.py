"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Each document has a hash. Sizes are summed by source and leading hash bits; along the running sum lies the bucket in
which a source's budget runs out. All buckets before it are taken, all after it are not, and only the documents of that
bucket are summed again by their next bits, down to a single hash value, which is taken if that comes nearer to the
budget. What remains is one threshold per source: documents are filtered by comparing their hash to it, never sorted.
Thresholds are nested: a larger budget takes what a smaller one takes and more, and a document's second copy is taken
only where all first copies are.

A hash is that of the key. Rows that share a key, null or not, are told apart by their text and source, and rows that are
equal in all of these by a number, so that no group of rows is one unit that a threshold takes as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.runtime import materialize, small

WORDS = r"[^\x20\x09-\x0D]+"
HASH_BITS, LEVEL_BITS = 60, 12
WEIGHTS, SHARE, MAX_REPEAT = (5, 2, 1), 1.5, 2


def size_of(text: str = "text") -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def _hash(value: Column) -> Column:
    """60 bits of a string's md5."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("long")


def with_hash(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", column: str = "h") -> DataFrame:
    """``docs`` with each row's hash in ``column``: that of its key; where rows share a key, that of key, source and text;
    where these are equal, too, that of them and a number from 0 on, whichever row has which.

    Equal rows are numbered by the partition that they came in and there in turn: the numbers of a large group are given
    out by many tasks. Only rows of shared keys are looked at more closely, and only equal ones are shuffled.
    """
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    first = docs.withColumn("_mix_key", _hash(name))
    shared = materialize(first.groupBy(F.col("_mix_key")).agg(F.count("*").alias("n")).where("n > 1").select("_mix_key", F.lit(True).alias("_mix_shared")), "shared")
    if shared.isEmpty():
        return first.withColumnRenamed("_mix_key", column)
    whole = F.concat(name, F.lit("|"), F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`")), F.lit("n")), F.lit("|"), F.coalesce(F.concat(F.lit("t"), F.col(f"`{text}`")), F.lit("n")))
    marked = first.join(small(shared), "_mix_key", "left").withColumn("_mix_whole", F.when(F.col("_mix_shared"), _hash(whole)))
    equal = marked.where("_mix_shared").groupBy("_mix_whole").agg(F.count("*").alias("n")).where("n > 1").select("_mix_whole", F.lit(True).alias("_mix_equal"))
    marked = marked.join(small(materialize(equal, "equal")), "_mix_whole", "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = marked.where("_mix_equal is null").select(*columns, F.coalesce("_mix_whole", "_mix_key").alias(column))
    several = materialize(marked.where("_mix_equal").select(*columns, "_mix_whole").withColumn("_mix_part", F.spark_partition_id()), "several")
    before = Window.partitionBy("_mix_whole").orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = several.groupBy("_mix_whole", "_mix_part").count().select("_mix_whole", "_mix_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_mix_ahead"))
    own = F.row_number().over(Window.partitionBy("_mix_whole", "_mix_part").orderBy(F.lit(0))) - 1
    several = several.withColumn("_mix_own", own).join(ahead, ["_mix_whole", "_mix_part"])
    number = F.col("_mix_own") + F.col("_mix_ahead")
    return single.unionAll(several.select(*columns, F.when(number == 0, F.col("_mix_whole")).otherwise(_hash(F.concat_ws("|", F.col("_mix_whole").cast("string"), number.cast("string")))).alias(column)))


def source_key(source: str = "source") -> Column:
    """A key that equals itself for null, too."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``(s, source_size, target)`` from ``sizes(s, source_size)``, one row per source key.

    Sources in code point order, null last, weigh ``weights`` in turn and split ``share`` of all sizes. No target is
    above ``max_repeat`` times its source; what is over is split again by weight. That ends where every source has its
    limit or a common amount per weight, whichever is less, and the amount follows from sums along the sources sorted
    by limit per weight. One row per source is all that these windows see.
    """
    order = Window.orderBy(F.col("s").startswith("n"), "s")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(max_repeat)))
    rising = Window.orderBy(F.col("most") / F.col("w"), "s")
    before = F.coalesce(F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing))
    all_ = F.sum("source_size").over(Window.partitionBy())
    rows = rows.withColumn("per_weight", (all_ * F.lit(share) - before) / onward)
    common = F.min(F.when(F.col("per_weight") <= F.col("most") / F.col("w"), F.struct((F.col("most") / F.col("w")).alias("at"), "s", "per_weight"))).over(Window.partitionBy())
    return rows.select("s", "source_size", F.least("most", F.coalesce(common["per_weight"], F.lit(float("inf"))) * F.col("w")).alias("target"))


def thresholds(hashed: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``(s, source_size, target, whole, threshold)`` per source key, from a materialized ``hashed(s, h, size)``.

    Documents of the source are taken ``whole`` times each, and once more if their hash is below ``threshold``.
    """
    plan = targets(hashed.groupBy("s").agg(F.sum("size").alias("source_size")), weights, share, max_repeat)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = materialize(plan.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    state = plan.select("s", "budget", F.lit(0).cast("long").alias("prefix"))
    running = Window.partitionBy("s").orderBy("bucket")
    for used in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        inside = F.shiftright("h", HASH_BITS - used + LEVEL_BITS) == F.col("prefix")
        bits = hashed.join(state, "s").where(inside).groupBy("s", F.shiftright("h", HASH_BITS - used).alias("bucket"))
        sums = bits.agg(F.sum("size").alias("n"), F.first("budget").alias("budget")).withColumn("upto", F.sum("n").over(running))
        edge = sums.where("upto > budget").groupBy("s").agg(F.min(F.struct("bucket", "n", "upto", "budget")).alias("e"))
        state = materialize(edge.select("s", (F.col("e.budget") - F.col("e.upto") + F.col("e.n")).alias("budget"), F.col("e.bucket").alias("prefix"), F.col("e.n").alias("n")), "boundary")
    # The boundary is one hash value now; a source without one has a budget for all it holds.
    last = state.select("s", (F.col("prefix") + (2 * F.col("budget") >= F.col("n")).cast("long")).alias("threshold"))
    return plan.drop("budget").join(last, "s", "left").withColumn("threshold", F.coalesce("threshold", F.lit(1 << HASH_BITS)))


def copies() -> Column:
    """How often a hashed document is taken, beside its source's threshold."""
    return F.col("whole") + (F.col("h") < F.col("threshold")).cast("int")


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **plan) -> DataFrame:
    """``docs``, each row as often as the mix takes it: the sample itself, with the columns that it had.

    Null texts have size 0, null sources are a source, rows with null or repeated keys are taken or left one by one. An
    empty table gives an empty one. Columns may have any names but those starting with ``_mix_``.
    """
    docs = with_hash(docs, key, text, source, "_mix_h")
    hashed = materialize(docs.select(source_key(source).alias("s"), F.col("_mix_h").alias("h"), size_of(text).alias("size")), "hashed")
    cut = materialize(thresholds(hashed, **plan), "thresholds").select(F.col("s").alias("_mix_s"), F.col("whole").alias("_mix_whole"), F.col("threshold").alias("_mix_below"))
    rows = docs.withColumn("_mix_s", source_key(source)).join(cut, "_mix_s")
    times = F.col("_mix_whole") + (F.col("_mix_h") < F.col("_mix_below")).cast("int")
    return rows.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), times))).select(*[F.col(f"`{c}`") for c in docs.columns if c != "_mix_h"])


def op5_query(docs: DataFrame) -> DataFrame:
    hashed = materialize(with_hash(docs.select("doc_id", "text", "source")).select("doc_id", source_key().alias("s"), "h", size_of().alias("size")), "hashed")
    rows = hashed.join(materialize(thresholds(hashed), "thresholds"), "s")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


OP5_SQL = r"""
WITH k AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
k1 AS (SELECT doc_id, source, size,
              CASE WHEN count(*) OVER (PARTITION BY h) = 1 THEN h
                   ELSE CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce('s' || source, 'n') || '|' || coalesce('t' || text, 'n')), 1, 15) AS BIGINT) END AS h FROM k),
k2 AS (SELECT *, row_number() OVER (PARTITION BY h) - 1 AS number FROM k1),
d AS (SELECT doc_id, source, size, CASE WHEN number = 0 THEN h ELSE CAST('0x' || substr(md5(h || '|' || number), 1, 15) AS BIGINT) END AS h FROM k2),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w,
             source_size * 2.0::DOUBLE AS most FROM s),
a AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY most / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS per_weight FROM w),
c AS (SELECT per_weight FROM a WHERE per_weight <= most / w ORDER BY most / w, source IS NULL, source LIMIT 1),
t AS (SELECT source, source_size, least(most, coalesce((SELECT per_weight FROM c), 'inf'::DOUBLE) * w) AS target FROM a),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
v AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
u AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM v),
e AS (SELECT u.source, u.h, CASE WHEN u.upto <= b.target - b.whole * b.source_size THEN 1
                                 WHEN u.upto - u.n <= b.target - b.whole * b.source_size AND 2 * (b.target - b.whole * b.source_size - u.upto + u.n) >= u.n THEN 1
                                 ELSE 0 END AS more
      FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, b.source_size, b.target, CAST(d.size * (b.whole + e.more) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.h = e.h
"""
