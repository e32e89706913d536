"""Exact top-k by inner product over an impact-ordered, score-at-a-time index.

A posting is a component of a vector; its impact is the component's size. The postings of a block of candidates are
held in segments of falling quantised impact: the largest power-of-two band first, then the next. For a block of
queries, segment after segment adds its share to the scores of all candidates. What the segments not yet read could
still add to a score is at most the product of the query's norm with the norm of the candidate's unread postings. A
candidate whose score so far plus that bound stays below the k-th best lower bound (of this block, or of the blocks
before it) is proved out. Reading stops when few candidates are left, or with the last segment; those left are scored
again, exactly, in integers.

Queries meet candidates in blocks: each query block goes to every candidate group and each candidate to every query
block, and a task streams its candidates past its queries, keeping k rows a query. Vectors that many rows share are
held once, with the k + 1 smallest ids that could be asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import batch
from kinfold.runtime import materialize

#: Queries of a block, and candidates from which on a further group is made.
QUERY_BLOCK, GROUP_ROWS = 4096, 8192
#: Queries that are scored together against a stretch of candidates.
STEP, STRETCH = 256, 8192
#: Part of the candidates that may be left when reading stops before the last segment.
ENOUGH = 0.02


def segments(v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Impact-ordered segments of the postings of ``v`` (candidates x dimensions, integers): each the postings of one
    band of impacts as a float matrix, and the norm of what each candidate has in later bands."""
    size = np.abs(v)
    top = int(size.max(initial=0))
    out = []
    rest = (v.astype(np.float64) ** 2).sum(axis=1)
    high = 1 << top.bit_length()
    while high > 1:
        low = high // 2 if high > 2 else 1
        part = np.where((size >= low) & (size < high), v, 0).astype(np.float64)
        if part.any():
            rest = np.maximum(rest - (part**2).sum(axis=1), 0)
            out.append((part, np.sqrt(rest)))
        high = low if high > 2 else 1
    return out or [(np.zeros(v.shape), np.zeros(len(v)))]


def candidates(q: np.ndarray, index: list[tuple[np.ndarray, np.ndarray]], floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that may be among a query's k best, given that scores under ``floor`` are not."""
    n = len(index[0][1])
    norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    qf = q.astype(np.float64)
    acc = np.zeros((len(q), n))
    whole = index[0][1].mean() if len(index) > 1 else 0.0
    for i, (part, rest) in enumerate(index):
        acc += qf @ part.T
        last = i == len(index) - 1
        if not last and rest.mean() > 0.5 * whole and i:
            continue  # too much is unread for a proof
        slack = norm[:, None] * (rest * (1 + 1e-9) + 1e-9)[None, :]
        at_least = floor
        if n >= k:
            at_least = np.maximum(floor, np.partition(acc - slack, n - k, axis=1)[:, n - k] - 1e-3)
        left = acc + slack + 1e-3 >= at_least[:, None]
        if last or left.sum() <= ENOUGH * left.size:
            return np.nonzero(left)
    raise AssertionError


class Best:
    """The k best (score, smallest id first) of each of a block's queries so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.query, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(len(q), -np.inf)

    def see(self, ids: np.ndarray, v: np.ndarray) -> None:
        for s in range(0, len(ids), STRETCH):
            part, part_ids = v[s : s + STRETCH], ids[s : s + STRETCH]
            index = segments(part)
            found = []
            for a in range(0, len(self.q), STEP):
                i, j = candidates(self.q[a : a + STEP], index, self.floor[a : a + STEP], self.k + 1)
                found.append((i + a, j))
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            keep = self.ids[i] != part_ids[j]
            i, j = i[keep], j[keep]
            exact = np.concatenate([(self.q[i[x : x + 65536]] * part[j[x : x + 65536]]).sum(axis=1) for x in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
            self._merge(i, part_ids[j], exact)

    def _merge(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = np.r_[self.query, query], np.r_[self.id, ids], np.r_[self.score, score]
        by = np.lexsort((ids, -score, query))
        query, ids, score = query[by], ids[by], score[by]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        top = rank < self.k
        self.query, self.id, self.score = query[top], ids[top], score[top]
        full = np.flatnonzero(rank[top] == self.k - 1)
        self.floor[self.query[full]] = self.score[full]


def _matrix(column: pa.Array) -> np.ndarray:
    n = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), n.max(initial=0)), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _pad(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, max(0, width - a.shape[1]))))


def top_k(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """The ``k`` highest integer inner products of each query with all other rows: ``(query_id, rank, vec_id, score)``.

    ``vectors`` is ``(vec_id long, v array<long>)`` without nulls, ``is_query`` a condition on it. Ties go to the
    smaller id. Vectors of unequal length are taken as filled up with zeros. Repeated rows count once; of rows that
    share an id but not the vector, the smallest vector stands. Scores must fit a long.
    """
    spark = vectors.sparkSession
    rows = materialize(vectors.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    queries = rows.where(is_query)
    n, m = rows.count(), queries.count()
    blocks, groups = max(1, -(-m // QUERY_BLOCK)), max(1, min(n // GROUP_ROWS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    among = Window.partitionBy("v").orderBy("vec_id")
    held = rows.withColumn("n", F.row_number().over(among)).where(F.col("n") <= k + 1)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    sent = queries.select(own(blocks).alias("block"), every(groups).alias("group"), F.lit(0).alias("kind"), "vec_id", "v")
    sent = sent.unionAll(held.select(every(blocks).alias("block"), own(groups).alias("group"), F.lit(1).alias("kind"), "vec_id", "v"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, q, best = None, [], [], None

        def results() -> Iterator[pa.RecordBatch]:
            if best is not None and len(best.query):
                yield batch(query_id=pa.array(best.ids[best.query]), vec_id=pa.array(best.id), score=pa.array(best.score))

        for b in it:
            block, group, kind, vec = (b.column(i).to_numpy() for i in range(4))
            v = _matrix(b.column(4))
            edges = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (group[1:] != group[:-1]) | (kind[1:] != kind[:-1])])
            for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(vec)], strict=True):
                if at != (block[s], group[s]):
                    yield from results()
                    at, ids, q, best = (block[s], group[s]), [], [], None
                if not kind[s]:
                    ids.append(vec[s:e])
                    q.append(v[s:e])
                elif ids:
                    if best is None:
                        width = max(x.shape[1] for x in q)
                        best = Best(np.concatenate(ids), np.concatenate([_pad(x, width) for x in q]), k)
                    width = max(best.q.shape[1], v.shape[1])
                    best.q = _pad(best.q, width)
                    best.see(vec[s:e], _pad(v[s:e], width))
        yield from results()

    parts = sent.repartition(max(blocks * groups, 1), "block", "group").sortWithinPartitions("block", "group", "kind")
    found = parts.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, v)`` with floor(64 * x) of each component. Rows with a null id, a null vector, or a null or non-finite
    component are left out; an empty vector is all zeros."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    return whole.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("long")).alias("v"))


def op10_query(embeddings: DataFrame) -> DataFrame:
    return top_k(integer_vectors(embeddings), F.col("vec_id") % 20 == 0, 20)


OP10_SQL = """
WITH d AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
      FROM d q, d c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
