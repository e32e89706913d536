"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the 4- and 5-grams of code points of the lower-cased text, a space at either end, hashed to ``2**BITS``
buckets; a text has a feature or not. From labelled texts come the log ratio of a feature's rate among toxic and other
texts, and by a G-test the features that tell the two apart with an error probability below 0.001 (``MIN_G``), the
``FEATURES`` best of them (the size of the model, whatever the input's). A logistic regression is fitted on them, each
scaled by its ratio. Scoring looks every n-gram of every
text up in the table of weights. Two n-grams of one bucket are one feature; 4 million buckets make that rare.

The fit takes at most ``max_rows`` labelled documents (all, if there are fewer), those with the lowest hashed keys, one
row for each key; that bounds the tables that counting shuffles and the matrix that the driver fits. Scoring covers all
rows whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import U64, batch, mix, release
from kinfold.runtime import materialize

SIZES = (4, 5)
BITS = 22
MAX_ROWS = 20_000
#: The G statistic of a feature that is used: the 0.999 quantile of chi-square with one degree of freedom.
MIN_G = 10.828
#: Features of a model at most: the driver holds the labelled rows' features while it fits.
FEATURES = 2_000
THRESHOLD = 0.7
#: Code points that are hashed at once; longer texts are taken in overlapping parts.
PART = 1 << 18
#: Features that a counting task holds before it sums them, and texts that are scored together.
HELD, TOGETHER = 2_000_000, 1_000
#: Features of rows that a gradient step holds at a time.
STRETCH = 500_000


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, in parts of bounded size."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(U64)
    for s in range(0, max(1, len(points) - SIZES[0] + 1), PART):
        p = points[s : s + PART + SIZES[-1] - 1]
        h = p
        for n in range(2, SIZES[-1] + 1):
            if len(p) < n:
                break
            h = h[:-1] * U64(0x9E3779B97F4A7C15) + p[n - 1 :]
            if n in SIZES:
                yield (mix(h + U64(n)) >> U64(64 - BITS)).astype(np.int64)


def present(text: str, wanted: np.ndarray) -> np.ndarray:
    """The distinct positive values that ``wanted`` has for the text's buckets."""
    hits = [x[x > 0] for x in (wanted[g] for g in grams(text))]
    return np.unique(np.concatenate(hits)) if hits else np.zeros(0, wanted.dtype)


@dataclass
class Model:
    """Weights by bucket; a score is the logistic function of their sum over a text's features."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def scorer(self):
        index = np.zeros(1 << BITS, np.int32)
        index[self.buckets] = np.arange(1, len(self.buckets) + 1)
        weights = np.r_[0.0, self.weights]

        def score(text: str | None) -> float:
            z = self.intercept + float(weights[present(text or "", index)].sum())
            return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

        return score


def count_features(rows: DataFrame) -> DataFrame:
    """``(bucket, pos, neg)``: in how many toxic and other texts of ``rows(text, toxic)`` a bucket occurs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def summed() -> Iterator[pa.RecordBatch]:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            bucket, side = np.unique(code >> 1), code & 1
            at = np.searchsorted(bucket, code >> 1)
            pos, neg = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64)
            pos[at[side == 1]], neg[at[side == 0]] = n[side == 1], n[side == 0]
            yield batch(bucket=pa.array(bucket), pos=pa.array(pos), neg=pa.array(neg))

        for b in it:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                g = np.unique(np.concatenate(list(grams(text or "")) or [np.zeros(0, np.int64)]))
                held.append(g << 1 | (toxic == 1))
                size += len(g)
                if size > HELD:
                    yield from summed()
                    held, size = [], 0
        if held:
            yield from summed()
        del held
        release()

    return rows.select("text", "toxic").mapInArrow(run, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def select_features(counts: DataFrame, pos: int, neg: int, min_g: float = MIN_G, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """The ``features`` buckets with the highest G statistic of ``min_g`` or more, in order, and their log-count ratios."""
    p, q, a, b = F.col("pos"), F.col("neg"), F.lit(float(pos)), F.lit(float(neg))
    term = lambda seen, want: F.when(seen > 0, seen * F.log(seen / want)).otherwise(0.0)
    all_ = F.lit(float(pos + neg))
    have, lack = (p + q), (all_ - p - q)
    g = term(p, have * a / all_) + term(q, have * b / all_) + term(a - p, lack * a / all_) + term(b - q, lack * b / all_)
    telling = counts.where("pos + neg > 1").withColumn("g", 2 * g).where(F.col("g") >= min_g).orderBy(F.desc("g"), "bucket").limit(features)
    telling = telling.select("bucket", "pos", "neg").toArrow().sort_by("bucket")
    bucket, seen, other = (telling.column(i).to_numpy() for i in range(3))
    return bucket, np.log((seen + 1) / (pos + 2)) - np.log((other + 1) / (neg + 2))


def logistic(lens: np.ndarray, cols: np.ndarray, y: np.ndarray, ratio: np.ndarray, l2: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on features scaled by ``ratio``, classes weighing alike, by accelerated gradient steps.

    ``cols`` are the features of each row in turn, ``lens`` how many a row has; they are worked on in stretches, so that
    nothing else as large is made of them. Returns the weight of each feature's presence and the intercept."""
    n, k = len(y), len(ratio)
    ends = np.cumsum(lens)
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, (ends[cuts[-1] - 1] if cuts[-1] else 0) + STRETCH))))
    parts = [(a, min(b, n), int(ends[a - 1]) if a else 0, int(ends[min(b, n) - 1])) for a, b in zip(cuts, cuts[1:], strict=False)]
    row_of = lambda a, b: np.repeat(np.arange(b - a), lens[a:b])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    reach = np.concatenate([np.bincount(row_of(a, b), (ratio**2)[cols[s:e]], b - a) for a, b, s, e in parts]) + 1  # squared norm of each row
    rate = 1 / (0.25 * float((weight * reach).sum()) + l2 / n)
    w, v, c, u = np.zeros(k), np.zeros(k), 0.0, 0.0
    for i in range(steps):
        shift, slope, scaled = 0.0, np.zeros(k), ratio * v
        for a, b, s, e in parts:
            rows, own = row_of(a, b), cols[s:e]
            z = np.bincount(rows, scaled[own], b - a) + u
            d = weight[a:b] * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[a:b])
            slope += np.bincount(own, d[rows], k)
            shift += d.sum()
        nw = v - rate * (ratio * slope + l2 / n * 1e-2 * v)
        nc = u - rate * shift
        m = i / (i + 3)
        v, u, w, c = nw + m * (nw - w), nc + m * (nc - c), nw, nc
    return w * ratio, float(c)


def fit(labelled: DataFrame, min_g: float = MIN_G, features: int = FEATURES) -> Model:
    """A model from ``labelled(text, toxic)``: a bounded table. With one class or no rows every score is that class's
    rate (0.5 without rows)."""
    rows = materialize(labelled.select("text", "toxic"), "labelled")
    seen = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    pos, neg = seen.get(1, 0), seen.get(0, 0)
    if not pos or not neg:
        rate = 0.5 if not pos and not neg else float(bool(pos))
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.clip(np.log((rate + 1e-9) / (1 - rate + 1e-9)), -20, 20)))
    buckets, ratio = select_features(count_features(rows), pos, neg, min_g, features)
    held = rows.sparkSession.sparkContext.broadcast(buckets)  # at most ``features`` numbers

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.zeros(1 << BITS, np.int32)
        index[held.value] = np.arange(1, len(held.value) + 1)
        for b in it:
            yield batch(toxic=b.column(1).cast(pa.int32()), features=pa.array([present(t or "", index) - 1 for t in b.column(0).to_pylist()], pa.list_(pa.int32())))

    matrix = rows.mapInArrow(run, "toxic int, features array<int>").toArrow()
    lists = matrix.column("features").combine_chunks()
    n = np.asarray(lists.value_lengths())
    weights, intercept = logistic(n, lists.flatten().to_numpy(), matrix.column("toxic").to_numpy(), ratio)
    del matrix, lists
    release()
    return Model(buckets, weights, intercept)


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with a new column: how likely each whole text is toxic. Null and empty texts have no feature and get the
    intercept's score. A column of that name is replaced."""
    if column != text:
        docs = docs.drop(column)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value.scorer()
        for whole in it:
            for s in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(s, TOGETHER)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([of(t) for t in b.column(at).to_pylist()], pa.float64())], [*b.schema.names, column])
        del of
        release()

    return docs.mapInArrow(run, _with_score(docs.schema, column))


def _with_score(schema, column: str):
    from pyspark.sql.types import DoubleType, StructField, StructType

    return StructType([*schema.fields, StructField(column, DoubleType())])


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, held_out=None) -> DataFrame:
    """``(text, toxic)`` of at most ``max_rows`` documents with a label 0 or 1, lowest hashed doc_id first. Where rows
    of ``labels`` disagree, toxic wins; of rows of ``docs`` that share a doc_id the smallest text is taken. ``held_out`` is
    a condition on doc_id: such rows are never taken."""
    known = labels.where("doc_id is not null and toxic in (0, 1)")
    if held_out is not None:
        known = known.where(~held_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taken = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    own = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")
    return own.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def is_held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op9_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A null doc_id is not held out. Repeated documents are scored each, extra columns are not read."""
    docs = docs.select("doc_id", "text")
    scored = score(docs, fit(training_rows(docs, labels, held_out=is_held_out())))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
