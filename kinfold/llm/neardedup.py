"""Near-duplicate filter: of documents whose five-word shingles have a Jaccard similarity of 0.8 or more, one stays.

Candidates come from the Gray-order index of ``simhash``. Documents this far apart differ in about one fingerprint bit in
seven, too many for a fixed radius on whole fingerprints. So each document is sketched with ``64 * WORDS`` SimHash bits
and filed in ``TABLES`` tables under ``BITS`` of them each; within a table entry the index finds, for each document, the
nearest other one within ``RADIUS`` bits of the whole sketch. That is at most one candidate pair per document and table,
however many copies an entry holds. Every such pair is then decided exactly on the two texts' shingle sets. Documents that
may have further partners come together in families, which hang together by steps within ``RADIUS`` bits in an entry; a
family's shingle sets travel to tasks in which each two of its documents meet, and what leaves a task are only the accepted
pairs that unite components. The components of all accepted pairs are the groups. So no table has a row for each pair of a
family. Texts of equal words are one document from the start.

A pair of similarity 0.8 shares an entry of some table with a probability of about 0.98, one of 0.9 nearly surely. More
documents want more ``BITS``, so that an entry stays small, and then more ``TABLES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import batch, release, texts
from kinfold.llm.simhash import Links, Nearest, fingerprint_words, gray_rank, group_links, shingle_hashes
from kinfold.operators.components import connected_components
from kinfold.runtime import TEXT_ROWS, materialize, partitions_for, small

SHINGLE, SIMILARITY = 5, 0.8
WORDS, TABLES, BITS, RADIUS = 4, 36, 14, 64
#: Documents of a table entry that one task compares; an entry with more is dealt by further bits in the first round, and
#: in blocks that all meet each other afterwards.
MAX_ENTRY, MORE_BITS = 20_000, 12
#: Pairs that a task of ``further_pairs`` holds at a time, about.
HELD = 1_500_000
#: Links that one task contracts.
LINKS = 200_000
#: A family is dealt in so many blocks, of so many documents at least and at most; more blocks where these would be larger.
FAMILY_BLOCKS, LEAST_BLOCK, MOST_BLOCK = 32, 32, 1000


def table_bits() -> np.ndarray:
    """The sketch bits that each table files by: fixed random choices."""
    r = np.random.default_rng(20)
    return np.stack([r.permutation(64 * WORDS)[: BITS + MORE_BITS] for _ in range(TABLES)])


def entries(sketch: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The value of each sketch (rows x WORDS) at the bits of each table, after the table's number."""
    out = np.empty((len(sketch), len(bits)), np.int64)
    for t, own in enumerate(bits):
        key = np.full(len(sketch), t, np.int64)
        for b in own.tolist():
            key = key << 1 | (sketch[:, b // 64] >> np.uint64(b % 64) & np.uint64(1)).astype(np.int64)
        out[:, t] = key
    return out


def large_entries(nodes: DataFrame, bits: np.ndarray, most: int) -> DataFrame:
    """Table entries with over ``most`` documents: ``(entry)``."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sketch = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64).reshape(-1, WORDS)
            entry, n = np.unique(entries(sketch, bits[:, :BITS]), return_counts=True)
            yield batch(entry=pa.array(entry), n=pa.array(n.astype(np.int64)))

    found = nodes.select("sketch").mapInArrow(count, "entry long, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    return materialize(found.where(F.col("n") > most).select("entry"), "large")


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs(_near_id, key, text)`` to ``(id, key, words, sketch)``; ``words`` is a 128-bit digest of the words, empty if
    there are none."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            t = texts(b.column(2))
            f = fingerprint_words(t, SHINGLE, WORDS)
            words = [xxhash.xxh3_128_digest(w) if (w := b" ".join(x.lower().split())) else b"" for x in t]
            yield batch(id=b.column(0), key=b.column(1), words=pa.array(words, pa.binary()), sketch=pa.array([r.tobytes() for r in f], pa.binary()))
        release()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select("_near_id", key, text).mapInArrow(run, f"id long, key {kind}, words binary, sketch binary")


class Counted(Nearest):
    """The nearest row of each row, and how many rows it was paired with."""

    def __init__(self, n: int):
        super().__init__(n)
        self.partners = np.zeros(n, np.int64)

    def join(self, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> None:
        super().join(i, j, distance)
        self.partners += np.bincount(i, minlength=len(self.best)) + np.bincount(j, minlength=len(self.best))


class Nearby:
    """For each row the ``most`` nearest rows of other components that it was paired with, and how many there were."""

    def __init__(self, component: np.ndarray, most: int):
        self.component, self.most = component, most
        self.label = np.arange(len(component))
        self.partners = np.zeros(len(component), np.int64)
        self.reach = np.full(len(component), RADIUS + 1)  # from this distance on a row takes no more
        self.held, self.new = np.zeros((3, 0), np.int64), []

    def join(self, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> None:
        other = self.component[i] != self.component[j]
        row, distance, partner = np.r_[i[other], j[other]], np.r_[distance[other], distance[other]], np.r_[j[other], i[other]]
        self.partners += np.bincount(row, minlength=len(self.label))
        nearer = distance < self.reach[row]
        self.new.append(np.stack([row, distance, partner])[:, nearer])
        if sum(x.shape[1] for x in self.new) > HELD // 4:
            self.cut()

    def cut(self) -> np.ndarray:
        """(row, distance, partner) of what is held, the nearest ``most`` of each row."""
        x = np.concatenate([self.held, *self.new], axis=1)
        x = x[:, np.lexsort((x[2], x[1], x[0]))]
        rank = np.arange(x.shape[1]) - np.searchsorted(x[0], x[0])
        self.held, self.new = x[:, rank < self.most], []
        last = x[:, rank == self.most - 1]
        self.reach[last[0]] = last[1]
        return self.held


def file(nodes: DataFrame) -> DataFrame:
    """``nodes(id, sketch, ...)`` to ``(full, id, sketch, ...)``, a row for each table."""
    bits = table_bits()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sketch = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(-1, WORDS)
            at, entry = np.repeat(np.arange(b.num_rows), TABLES), entries(sketch, bits).ravel()
            for s in range(0, len(at), 65536):
                part = pa.array(at[s : s + 65536])
                yield pa.RecordBatch.from_arrays([pa.array(entry[s : s + 65536]), *(c.take(part) for c in b.columns)], ["full", *b.schema.names])

    return nodes.mapInArrow(run, "full long, " + ", ".join(f"{n} {k}" for n, k in nodes.dtypes))


def gathered_entries(b: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """Columns of batches ``(entry, id, sketch, ...)``, the sketch as rows x WORDS."""
    numbers = [np.concatenate([x.column(i).to_numpy() for x in b]) for i in range(b[0].num_columns) if i != 2]
    sketch = np.frombuffer(b"".join(v for x in b for v in x.column(2).to_pylist()), np.uint64).reshape(-1, WORDS)
    return (*numbers[:2], sketch, *numbers[2:])


def proposed(a: np.ndarray, b: np.ndarray, over: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Distinct pairs in order, and ``(id, null)`` for the ids in ``over``."""
    pairs, over = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0), np.unique(over)
    yield batch(a=pa.array(pairs[:, 0]), b=pa.array(pairs[:, 1]))
    yield batch(a=pa.array(over), b=pa.nulls(len(over), pa.int64()))


def candidate_pairs(nodes: DataFrame, rows: int, most: int = MAX_ENTRY) -> DataFrame:
    """``nodes(id, sketch)`` to distinct ``(a, b)`` with a < b: each node with the nearest of its entry in each table; and
    ``(a, null)`` for a node that may have partners left over.

    An entry with over ``most`` documents holds families of near copies; there a document first meets those that agree on
    ``MORE_BITS`` further bits as well, which unites most of a family, and counts as one with partners left over.
    """
    def nearest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = [x for x in it if x.num_rows]
        if not b:
            return
        entry, ids, sketch = gathered_entries(b)
        by = np.lexsort((*sketch.T, gray_rank(sketch[:, 0]), entry))  # ties go by content, however rows are numbered and in whatever order they arrive
        entry, ids, sketch = entry[by], ids[by], sketch[by]
        found = Counted(len(ids))
        i, j = group_links(entry, gray_rank(sketch[:, 0]), sketch, RADIUS, lambda n: found)
        yield from proposed(ids[i], ids[j], ids[(found.partners > 1) | (entry < 0)])
        del b, entry, ids, sketch, found, by, i, j
        release()

    n = partitions_for(nodes.sparkSession, rows * TABLES, 200_000)
    filed = file(nodes.select("id", "sketch")).withColumn("entry", F.shiftright("full", MORE_BITS))
    large = large_entries(nodes, table_bits(), most)
    if large.isEmpty():
        filed = filed.select("entry", "id", "sketch")
    else:
        filed = filed.join(small(large.withColumn("large", F.lit(True))), "entry", "left")
        filed = filed.select(F.when(F.col("large"), -F.col("full") - 1).otherwise(F.col("entry")).alias("entry"), "id", "sketch")
    return filed.repartition(n, "entry").mapInArrow(nearest, "a long, b long").distinct()


def dealt(filed: DataFrame, large: DataFrame, most: int) -> DataFrame:
    """``filed(entry, id, sketch, component)`` to ``(task, id, sketch, component)``: any two documents of an entry that lie
    in different components share a task.

    The documents of a large entry are dealt in blocks of half of ``most``, those of its largest component apart from the
    others, and each two blocks make a task unless both are of that component.
    """
    half, shift = max(1, most // 2), 1 << 21
    kinds = filed.join(small(large), "entry").groupBy("entry", "component").agg(F.count("*").alias("n"))
    top = kinds.groupBy("entry").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"))
    blocks = materialize(top.select("entry", F.col("top.component").alias("main"), F.ceil(F.col("top.n") / half).alias("own"), F.ceil((F.col("n") - F.col("top.n")) / half).alias("others")), "blocks")
    main, own, others = F.col("component") == F.col("main"), F.col("own"), F.col("others")
    block = F.when(main, F.pmod(F.xxhash64("id"), own)).otherwise(own + F.pmod(F.xxhash64("id"), F.greatest(others, F.lit(1))))
    visits = F.filter(F.sequence(F.lit(0).cast("long"), own + others - 1), lambda x: F.when(main, x >= own).otherwise(x != F.col("block")))
    tasks = F.transform(visits, lambda x: F.least(x, "block") * shift + F.greatest(x, "block"))
    met = filed.join(small(blocks), "entry", "left").withColumn("block", block)
    met = met.withColumn("task", F.explode(F.when(F.col("main").isNull(), F.array(F.lit(0).cast("long"))).otherwise(tasks)))
    return met.select((F.col("entry") * (shift * shift) + F.col("task")).alias("task"), "id", "sketch", "component")


def contracted(links: DataFrame) -> DataFrame:
    """``(a, b)`` that unite what the materialized ``links(a, b)`` unite: each task leaves one link for each of its nodes, to
    the smallest that it hangs together with there."""

    def contract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [np.stack([b.column(c).to_numpy() for c in "ab"]) for b in it if b.num_rows]
        if not pairs:
            return
        ids, (a, b) = np.unique(np.concatenate(pairs, axis=1), return_inverse=True)
        found = Links(len(ids))
        found.join(a, b)
        yield batch(a=pa.array(ids[found.label]), b=pa.array(ids))

    return links.repartition(max(1, -(-links.count() // LINKS))).mapInArrow(contract, "a long, b long").where("a <> b")


def mixed_entries(b: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """``gathered_entries`` of ``(entry, id, sketch, component)`` in Gray order, of entries with several components only,
    and their sizes."""
    entry, ids, sketch, component = gathered_entries(b)
    by = np.lexsort((*sketch.T, gray_rank(sketch[:, 0]), entry))
    starts = np.flatnonzero(np.r_[True, np.diff(entry[by]) != 0])
    sizes = np.diff(np.r_[starts, len(by)])
    mixed = np.minimum.reduceat(component[by], starts) != np.maximum.reduceat(component[by], starts)
    by, sizes = by[np.repeat(mixed, sizes)], sizes[mixed]
    return entry[by], ids[by], sketch[by], component[by], sizes


def met_in_entries(nodes: DataFrame, rows: int, most: int) -> DataFrame:
    """``nodes(id, sketch, component)`` to ``(task, id, sketch, component)``, dealt by task: any two documents of an entry
    that lie in different components share a task."""
    filed = file(nodes.select("id", "sketch", "component")).select(F.shiftright("full", MORE_BITS).alias("task"), "id", "sketch", "component")
    large = large_entries(nodes, table_bits(), most)
    if not large.isEmpty():
        filed = dealt(filed.withColumnRenamed("task", "entry"), large, most)
    return filed.repartition(partitions_for(nodes.sparkSession, rows * TABLES, 200_000), "task")


def further_pairs(nodes: DataFrame, rows: int, partners: int, most: int = MAX_ENTRY) -> DataFrame:
    """``nodes(id, sketch, component)`` to distinct ``(a, b)`` with a < b: each node with the ``partners`` nearest of other
    components in its entry in each table; and ``(a, null)`` for a node that has partners left over."""

    def nearby(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = [x for x in it if x.num_rows]
        if not b:
            return
        entry, ids, sketch, component, sizes = mixed_entries(b)
        slices = np.cumsum(sizes * np.minimum(sizes, partners)) // HELD
        at = 0
        for n in [int(sizes[slices == s].sum()) for s in np.unique(slices)]:
            own = slice(at, at + n)
            at += n
            found = Nearby(component[own], partners)
            group_links(entry[own], gray_rank(sketch[own, 0]), sketch[own], RADIUS, lambda n, found=found: found)
            row, _, partner = found.cut()
            yield from proposed(ids[own][row], ids[own][partner], ids[own][found.partners > partners])
        del b, entry, ids, sketch, component
        release()

    most = min(most, max(2, HELD // partners))  # so that the pairs of one task can be held
    return met_in_entries(nodes, rows, most).mapInArrow(nearby, "a long, b long").distinct()


def families(nodes: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """``nodes(id, sketch, component)`` to ``(a, b)``: any two documents of different components that share an
    entry within ``RADIUS`` bits hang together by these links, of which a document has at most one in each entry."""

    def hanging(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = [x for x in it if x.num_rows]
        if not b:
            return
        entry, ids, sketch, component, _ = mixed_entries(b)
        if len(ids):
            i, j = group_links(entry, gray_rank(sketch[:, 0]), sketch, RADIUS)
            other = np.zeros(len(ids), bool)  # by the smallest row of what hangs together: whether it has several components
            other[j[component[i] != component[j]]] = True
            yield from proposed(ids[i][other[j]], ids[j][other[j]], np.zeros(0, np.int64))
        del b, entry, ids, sketch, component
        release()

    return met_in_entries(nodes, rows, MAX_ENTRY if most is None else most).mapInArrow(hanging, "a long, b long")


def uniting(ids: np.ndarray, sketch: np.ndarray, component: np.ndarray, block: np.ndarray, sets: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Accepted pairs that unite components, of documents in different blocks if there are two, else of any: a forest.

    ``sets`` are the distinct shingles of all documents one after the other, and how many each has.
    """
    lens = sets[1]
    code = np.unique(sets[0], return_inverse=True)[1]
    ends = np.cumsum(lens)
    starts = ends - lens
    mark = np.zeros(int(code.max()) + 1, bool)
    label = np.unique(component, return_inverse=True)[1]
    two, links = block.min() != block.max(), []
    for i in range(len(ids) - 1):
        rest = slice(i + 1, None)
        can = (label[rest] != label[i]) & (np.minimum(lens[rest], lens[i]) >= similarity * np.maximum(lens[rest], lens[i]))
        if two:
            can &= block[rest] != block[i]
        j = np.flatnonzero(can) + i + 1
        j = j[np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1, dtype=np.int64) <= RADIUS]
        if not len(j):
            continue
        own = code[starts[i] : ends[i]]
        mark[own] = True
        before = np.cumsum(lens[j]) - lens[j]
        both = np.add.reduceat(mark[code[np.repeat(starts[j] - before, lens[j]) + np.arange(lens[j].sum())]], before, dtype=np.int64)
        mark[own] = False
        for k in j[both >= similarity * (lens[j] + lens[i] - both)].tolist():
            if label[k] != label[i]:
                links.append((ids[i], ids[k]))
                label[label == label[k]] = label[i]
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    return a, b


def united(members: DataFrame, similarity: float) -> DataFrame:
    """``members(family, id, sketch, component, shingles)`` to ``(a, b)``: accepted pairs that unite the components of each
    family as all its accepted pairs would.

    A large family is dealt in blocks, each two of which, and each by itself, make a task.
    """

    def decide(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forest(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            ids, component, block = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("id", "component", "block"))
            sketch = np.frombuffer(b"".join(v for x in held for v in x.column("sketch").to_pylist()), np.uint64).reshape(-1, WORDS)
            sets = [x.column("shingles") for x in held]
            lens = np.concatenate([x.value_lengths().to_numpy() for x in sets]).astype(np.int64)
            a, b = uniting(ids, sketch, component, block, (np.concatenate([x.flatten().to_numpy() for x in sets]), lens), similarity)
            return batch(a=pa.array(np.minimum(a, b)), b=pa.array(np.maximum(a, b)))

        held, now = [], None
        for b in it:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy() for c in ("family", "lo", "hi")], axis=1)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]).tolist()
            for s, e in zip(starts, [*starts[1:], b.num_rows], strict=True):
                if held and tuple(key[s]) != now:
                    yield forest(held)
                    held = []
                held, now = [*held, b.slice(s, e - s)], tuple(key[s])
        if held:
            yield forest(held)
        del held
        release()

    size = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(MOST_BLOCK), F.ceil(F.col("n") / FAMILY_BLOCKS)))
    blocks = members.groupBy("family").agg(F.count("*").alias("n")).where(F.col("n") > LEAST_BLOCK)
    blocks = materialize(blocks.select("family", F.ceil(F.col("n") / size).alias("blocks")), "blocks")
    met = members.join(small(blocks), "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    met = met.withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("family", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "id", "sketch", "component", "block", "shingles")
    task = ["family", "lo", "hi"]
    return met.repartition(partitions_for(members.sparkSession, 0), *task).sortWithinPartitions(*task).mapInArrow(decide, "a long, b long")


def near_links(nodes: DataFrame, docs: DataFrame, text: str, similarity: float) -> DataFrame:
    """``(a, b)`` of accepted pairs whose components are the groups of ``nodes(id, sketch)``."""
    found = materialize(candidate_pairs(nodes, nodes.count()), "pairs")
    links = materialize(verified(found.where("b is not null"), docs, text, similarity), "links")
    over = found.where("b is null").select(F.col("a").alias("id"))
    if over.isEmpty():
        return links
    part = connected_components(contracted(links), "a", "b").withColumnRenamed("node", "id")
    left = nodes.select("id", "sketch").join(over, "id").join(part, "id", "left").select("id", "sketch", F.coalesce("component", "id").alias("component"))
    left = materialize(left, "left")
    hanging = contracted(materialize(families(left, left.count()), "hanging"))
    family = connected_components(hanging, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("family"))
    members = materialize(left.join(family, "id"), "members")
    members = members.join(shingle_sets(docs, members.select("id"), text), "id")
    return links.unionAll(materialize(united(members, similarity), "links", TEXT_ROWS))


def shingle_sets(docs: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """``(id, shingles)`` of the documents ``ids(id)``: the hashes of their distinct shingles."""

    def shingles(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sets = [np.unique(np.array(shingle_hashes(t, SHINGLE), np.uint64)).view(np.int64) for t in texts(b.column(1))]
            yield batch(id=b.column(0), shingles=pa.array(sets, pa.list_(pa.int64())))
        release()

    ids = ids.withColumnRenamed("id", "_near_id")
    return materialize(docs.select("_near_id", text).join(small(ids), "_near_id").mapInArrow(shingles, "id long, shingles array<long>"), "shingles", TEXT_ROWS)


def verified(pairs: DataFrame, docs: DataFrame, text: str, similarity: float) -> DataFrame:
    """The pairs whose texts have at least this Jaccard similarity of distinct shingles."""
    ids = materialize(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct(), "paired")
    sets = shingle_sets(docs, ids, text)
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(other, "b").where(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest key, nulls last; of equal keys any one.

    Words are runs of other than ASCII white space, lower-cased A-Z; a text of fewer than five words is one shingle.
    Texts without words, null ones among them, are copies of each other. An empty table gives an empty one. Columns may
    have any names but those starting with ``_near_``.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = materialize(docs.withColumn("_near_id", F.monotonically_increasing_id()), "rows")
    made = materialize(sketches(rows, key, text), "sketches", TEXT_ROWS)
    first = F.struct(F.col("key").isNull().alias("none"), "key", "id")
    nodes = materialize(made.groupBy("words").agg(F.min(first).alias("first"), F.first("sketch").alias("sketch")).select(F.col("first.id").alias("id"), "first", "sketch", (F.length("words") > 0).alias("some")), "nodes")
    links = near_links(nodes.where("some"), rows, text, similarity)
    part = nodes.join(connected_components(contracted(links), "a", "b").withColumnRenamed("node", "id"), "id", "left")
    kept = part.groupBy(F.coalesce("component", "id").alias("part")).agg(F.min("first").alias("first")).select(F.col("first.id").alias("id"))
    gone = materialize(made.select("id").join(kept, "id", "left_anti").withColumnRenamed("id", "_near_id"), "gone")
    return rows.join(small(gone), "_near_id", "left_anti").select(*columns)
