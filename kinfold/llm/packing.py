"""Best-fit packing of token sequences by bin completion with branch and bound.

Documents become pieces of at most ``capacity`` tokens. What packing needs to know of any number of pieces is how many
there are of each length, a table of at most ``capacity`` rows. The search runs on that table: it completes the bin
around the longest piece left, with each filling in turn that no other one dominates (one that holds a further piece, or
a longer one in place of one or two of its pieces), the fullest first as best fit would. A filling is repeated as often
as the counts allow, then once less often, and so on, so that effort depends on the number of lengths and not of
documents. Best fit decreasing gives the first incumbent; dives of the search that take another of the fullest fillings
at one place, the last places first, give better ones (limited discrepancy, ``DIVE_NODES`` fillings). Then the search is
for one sequence fewer, depth first over all fillings, where the waste that is left and a lower bound on the rest prune.
It ends when the incumbent meets the lower bound, when everything is searched (the incumbent is the best then), or after
``SEARCH_NODES`` steps; what is returned says how many sequences there are and how many are needed at least.

The result is a list of fillings with multiplicities. Each says which ranks of which length go to which bins, so pieces
are placed by a join on length and rank. Ranks come from counts per (length, salt) and a row number inside them: a
length that a third of all pieces share is dealt to many tasks.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import batch, release, trim
from kinfold.runtime import TEXT_ROWS, materialize

CAPACITY = 2048
#: Distinct words that a generation of a tokenizing worker's memory keeps, and the length of the longest word kept.
CACHE_WORDS, CACHE_LENGTH = 80_000, 64
#: Bytes of text whose distinct words are looked up together, and words whose ids are put in place together.
TOGETHER, GATHERED = 12_000_000, 200_000
#: Punctuation that may close a word and is encoded by itself.
CLOSING = ".,!?;:"
#: Steps of the search (fillings chosen, pieces tried for one) after which it keeps its incumbent.
SEARCH_NODES = 30_000
#: Fillings that dives may choose before.
DIVE_NODES = 15_000
#: Pieces of one length that are numbered together.
SALTED_ROWS = 1_000


class WordTokenizer:
    """Token ids of whole texts for a tokenizer that drops white space and upper case, one distinct word at a time.

    Such a tokenizer gives a text the ids of its words in turn. Only ASCII white space is split at here; any other
    stays inside a word and is the tokenizer's business. Words that are letters but for closing punctuation are encoded
    many in a call and told apart by the tokens that end a word (one by one if the vocabulary has none). Known words are kept in two generations of
    ``CACHE_WORDS``: what the younger one has not asked for by the time it is full is forgotten.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        suffix = json.loads(self.encoder.to_str())["model"].get("end_of_word_suffix")
        self.last = np.zeros(self.encoder.get_vocab_size(), bool)  # tokens that end a word
        if suffix:
            self.last[[i for t, i in self.encoder.get_vocab().items() if t.endswith(suffix)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.closing: dict[str, bytes] = {}

    def _plain(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.encoder.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words that are letters only, 1000 in a call."""
        out: list[bytes] = []
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            (e,) = self.encoder.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            cut = np.flatnonzero(self.last[ids]) + 1
            if len(cut) == len(part):
                raw, cut = ids.tobytes(), [0, *(4 * cut).tolist()]
                out += [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]
            else:
                out += self._plain(part)
        return out

    def _known(self, words: pa.Array) -> list[bytes]:
        """Ids of distinct words. What is remembered are words without their closing punctuation."""
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        bare = pc.utf8_rtrim(words, characters=CLOSING)
        plain, other = (np.asarray(x) for x in (pc.and_(pc.string_is_ascii(bare), pc.ascii_is_alpha(bare)), pc.invert(pc.string_is_ascii(bare))))
        for i in np.flatnonzero(other).tolist():
            w = bare[i].as_py()
            plain[i] = w.isalpha() and w.lower().isalpha()
        coded = pc.if_else(pa.array(plain), bare, words).dictionary_encode()
        cores, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        simple = np.zeros(len(cores), bool)
        simple[which] = plain
        found = list(map(self.young.get, cores))
        new = [i for i, x in enumerate(found) if x is None]
        old, young = self.old, self.young
        letters, others = [], []
        for i in new:
            w = cores[i]
            x = old.get(w)
            if x is None:
                (letters if simple[i] else others).append(i)
            else:
                found[i] = young[w] = x
        for these, encode in ((letters, self._letters), (others, self._plain)):
            for i, x in zip(these, encode([cores[i] for i in these]), strict=True):
                found[i] = x
                if len(cores[i]) <= CACHE_LENGTH:
                    young[cores[i]] = x
        out = list(map(found.__getitem__, which.tolist()))
        closed = np.flatnonzero(plain & (np.asarray(pc.binary_length(words)) != np.asarray(pc.binary_length(bare))))
        ends = [w[len(c) :] for w, c in zip(words.take(pa.array(closed)).to_pylist(), bare.take(pa.array(closed)).to_pylist(), strict=True)]
        closing = self.closing if len(self.closing) < 10_000 else {}
        unseen = [e for e in set(ends) if e not in closing]
        closing.update(zip(unseen, self._plain(unseen), strict=True))
        self.closing = closing
        for i, e in zip(closed.tolist(), ends, strict=True):
            out[i] += closing[e]
        return out

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text of a string array, null as empty."""
        texts = pc.fill_null(texts, "")
        for at, stop in _runs(np.asarray(pc.binary_length(texts)), TOGETHER):
            yield from self._ids(texts.slice(at, stop - at))
            trim()

    def _ids(self, texts: pa.Array) -> Iterator[bytes]:
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are matched before upper case is dropped
            texts = pc.ascii_lower(texts)
        words = pc.ascii_split_whitespace(texts)
        per_text = np.asarray(words.value_lengths())
        coded = words.flatten().dictionary_encode()
        del words
        ids = self._known(coded.dictionary)
        lens = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(lens) - lens
        del ids
        which, bounds = coded.indices.to_numpy(), np.concatenate([np.zeros(1, np.int64), np.cumsum(per_text)])
        for at, stop in _runs(per_text, GATHERED):
            w = which[bounds[at] : bounds[stop]]
            n = lens[w]
            upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
            tokens = flat[np.repeat(first[w] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
            cuts = (4 * upto[bounds[at : stop + 1] - bounds[at]]).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield tokens[a:b]


def gathered(it: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold about ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in it:
        held.append(b)
        n += b.nbytes
        if n >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive members whose sizes add up to about ``most``, one member at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)))
        yield at, stop
        at = stop


def tokenize_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """``(key, piece, start, length, ids_crc32[, ids])``: the ids of each text and ``end_id``, cut every ``capacity``.

    A null or empty text has the end id alone. Repeated rows stay repeated; other columns of ``docs`` are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer(tokenizer)
        for b in gathered(it, TOGETHER):
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, x in enumerate(words.ids(b.column(1))):
                x += end
                n = len(x) // 4
                for p, s in enumerate(range(0, n, capacity)):
                    part = x[4 * s : 4 * (s + capacity)]
                    rows.append(i)
                    piece.append(p)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            out = {"key": b.column(0).take(pa.array(rows, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            yield batch(**out, **({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))
        del words
        release()

    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


Fill = tuple[tuple[int, ...], int]


class Spent(Exception):
    """The search has used up its steps."""


@dataclass
class Search:
    """Bin completion over a table of lengths. ``best`` holds (lengths of a bin, number of such bins), ``bins`` their
    number, ``bound`` the number that is needed at least: where they differ, the steps ran out."""

    capacity: int
    nodes: int = SEARCH_NODES
    dives: int = DIVE_NODES
    best: list[Fill] = field(default_factory=list)
    bins: int = 0
    bound: int = 0

    def run(self, counts: dict[int, int]) -> list[Fill]:
        have = np.zeros(self.capacity + 1, np.int64)
        for size, n in counts.items():
            if not 0 < size <= self.capacity:
                raise ValueError(f"a piece of {size} does not fit a bin of {self.capacity}")
            have[size] = n
        self.bound = lower_bound(have, self.capacity)
        self.best, self.bins = [], 0
        if not self.bound:
            return []
        self.best = best_fit(have, self.capacity)
        self.bins = sum(n for _, n in self.best)
        self._dive(have, [], 0, 0)
        self._improve(have)
        try:
            while self.bins > self.bound:
                found = self._complete(have, self.bins - 1)
                if found is None:
                    self.bound = self.bins
                else:
                    self.best, self.bins = found, sum(n for _, n in found)
        except Spent:
            pass
        return self.best

    def step(self) -> None:
        self.nodes -= 1
        if self.nodes < 0:
            raise Spent

    def _dive(self, have: np.ndarray, done: list[Fill], bins: int, skip: int) -> None:
        """Complete bins to the end, with the fullest of a few fillings each time but the ``skip``-th best first."""
        have, done = have.copy(), list(done)
        left = int((have * np.arange(len(have))).sum())
        while left:
            self.dives -= 1
            if bins + -(-left // self.capacity) >= self.bins or self.dives < 0:
                return
            big = int(np.flatnonzero(have)[-1])
            have[big] -= 1
            few = fullest(have, self.capacity - big)
            have[big] += 1
            take = (big, *few[min(skip, len(few) - 1)])
            skip = 0
            need = np.bincount(take, minlength=len(have))
            used = np.flatnonzero(need)
            times = int((have[used] // need[used]).min())
            have[used] -= times * need[used]
            done.append((take, times))
            bins += times
            left -= times * sum(take)
        self.best, self.bins = done, bins

    def _improve(self, have: np.ndarray) -> None:
        """From the last state of the incumbent to the first, dive with another filling; again while that gains."""
        before = self.bins + 1
        while self.bound < self.bins < before and self.dives > 0:
            before, fills = self.bins, self.best
            state, bins = np.zeros_like(have), self.bins
            for i in range(len(fills) - 1, -1, -1):
                take, times = fills[i]
                state = state + times * np.bincount(take, minlength=len(state))
                bins -= times
                for skip in (1, 2):
                    if self.bins > self.bound and self.dives > 0:
                        self._dive(state, fills[:i], bins, skip)

    def _complete(self, have: np.ndarray, target: int) -> list[Fill] | None:
        """A packing into ``target`` bins, or None if there is none: depth first, all undominated fillings."""
        spare = target * self.capacity - int((have * np.arange(len(have))).sum())
        stack = [_Node(have, spare, target, 0, ())]
        while stack:
            node = stack[-1]
            if node.options is None:
                self.step()
                lengths = np.flatnonzero(node.have)
                if not len(lengths):
                    return [(x.take, x.times) for x in stack[:-1]]
                if node.spare < 0 or lower_bound(node.have, self.capacity) > node.bins:
                    stack.pop()
                    continue
                node.big = int(lengths[-1])
                rest = node.have.copy()
                rest[node.big] -= 1
                node.options = fillings(rest, self.capacity - node.big, node.spare, self.step)
            node.times -= 1
            while node.times < 1:
                fill = next(node.options, None)
                if fill is None:
                    break
                node.take = (node.big, *fill)
                # Fillings of pieces of one length are chosen in their order: others would only repeat a set of bins.
                if node.after and node.after[0] == node.big and _order(node.take, self.capacity) <= _order(node.after, self.capacity):
                    continue
                node.need = np.bincount(node.take, minlength=len(node.have))
                used = np.flatnonzero(node.need)
                waste = self.capacity - sum(node.take)
                node.times = min(int((node.have[used] // node.need[used]).min()), node.bins, node.spare // waste if waste else node.bins)
            if node.times < 1:
                stack.pop()
                continue
            waste = self.capacity - sum(node.take)
            stack.append(_Node(node.have - node.times * node.need, node.spare - node.times * waste, node.bins - node.times, 0, node.take))
        return None


@dataclass
class _Node:
    """A state of the search: pieces, waste and bins left, and the filling that is being tried, how often."""

    have: np.ndarray
    spare: int
    bins: int
    times: int
    after: tuple[int, ...]
    take: tuple[int, ...] = ()
    need: np.ndarray | None = None
    big: int = 0
    options: Iterator[tuple[int, ...]] | None = None


def _order(take: tuple[int, ...], capacity: int) -> tuple:
    return (capacity - sum(take), len(take), tuple(-x for x in take))


def fillings(have: np.ndarray, room: int, spare: int, step: Callable[[], None] = lambda: None) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of ``room`` by pieces of ``have`` that waste ``spare`` at most: the fullest first, then
    those of fewest pieces, then those of the longest. ``step`` is called as the enumeration goes on."""
    sizes = np.flatnonzero(have[: room + 1])
    if not len(sizes):
        if room <= spare:
            yield ()
        return
    low = int(sizes[0])
    used = np.zeros(len(have), np.int64)

    def sums(total: int, pieces: int, most: int) -> Iterator[tuple[int, ...]]:
        """Fillings of this sum and number of pieces, none longer than ``most``."""
        if pieces == 1:
            if total <= most and have[total] > used[total]:
                yield (total,)
            return
        x = sizes[np.searchsorted(sizes, -(-total // pieces)) : np.searchsorted(sizes, min(most, total - (pieces - 1) * low), side="right")][::-1]
        x = x[have[x] > used[x]]
        if pieces == 2:
            y = total - x
            for a, b in zip(x.tolist(), y.tolist(), strict=True) if len(x) < 8 else zip(x[have[y] > used[y]].tolist(), y[have[y] > used[y]].tolist(), strict=True):
                if have[b] > used[b] + (a == b):
                    yield (a, b)
            return
        for a in x.tolist():
            step()
            used[a] += 1
            for more in sums(total - a, pieces - 1, a):
                yield (a, *more)
            used[a] -= 1

    for waste in range(min(spare, room) + 1):
        total = room - waste
        if waste >= low and have[low] * low > total:
            return  # there is always a short piece left that fits as well
        for pieces in range(1, total // low + 1):
            step()
            for fill in sums(total, pieces, int(sizes[-1])):
                if not waste or undominated(have, fill, waste):
                    yield fill


def undominated(have: np.ndarray, fill: tuple[int, ...], waste: int) -> bool:
    """Whether no piece left fits into the waste, and none is longer than one or two of ``fill`` by no more than it."""
    left = have - np.bincount(fill, minlength=len(have)) > 0
    if left[1 : waste + 1].any():
        return False
    small = set(fill) | {a + b for i, a in enumerate(fill) for b in fill[i + 1 :]}
    return not any(left[x + 1 if x in fill else x : x + waste + 1].any() for x in small if x < len(left))


def best_fit(have: np.ndarray, capacity: int) -> list[Fill]:
    """Best fit decreasing: each piece, longest first, into the open bin with the least room for it. Bins of equal room
    are filled together."""
    by_gap: dict[int, list[Fill]] = {}
    for x in np.flatnonzero(have)[::-1].tolist():
        left = int(have[x])
        while left:
            gap = min((g for g in by_gap if g >= x), default=None)
            if gap is None:
                gap, (lengths, n) = capacity, ((), left)
            else:
                lengths, n = by_gap[gap].pop()
            each = min(gap // x, left)
            used = min(n, left // each)
            if lengths and used < n:
                by_gap[gap].append((lengths, n - used))
            elif gap in by_gap and not by_gap[gap]:
                del by_gap[gap]
            by_gap.setdefault(gap - each * x, []).append((lengths + (x,) * each, used))
            left -= each * used
    return [f for fills in by_gap.values() for f in fills]


@functools.cache
def _weights(capacity: int) -> np.ndarray:
    """Dual feasible functions of Fekete and Schepers, k from 2 to 32: a piece that is no whole (k + 1)-th of a bin weighs
    its k-ths rounded down; in units of 1 / (k * capacity)."""
    sizes = np.arange(capacity + 1)
    out = []
    for k in range(2, 33):
        parts, rest = np.divmod((k + 1) * sizes, capacity)
        out.append(np.where(rest == 0, k * sizes, parts * capacity))
    return np.stack(out)


def lower_bound(have: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2 (bins that pieces over half a bin open, and what the rest needs beyond their gaps), or a
    bound by dual feasible functions if that is higher."""
    sizes = np.arange(len(have))
    n, w = np.cumsum(have[::-1])[::-1], np.cumsum((have * sizes)[::-1])[::-1]
    n, w = np.append(n, 0), np.append(w, 0)
    best = -(-int(w[0]) // capacity)
    half = capacity // 2
    k = np.arange(half + 1)
    top = capacity - k + 1
    over = n[top]
    mid_n, mid_w = n[half + 1] - over, w[half + 1] - w[top]
    small = w[k] - w[half + 1]
    best = max(best, int((over + mid_n + np.maximum(0, -(-(small - (mid_n * capacity - mid_w)) // capacity))).max()))
    dual = _weights(capacity) @ have
    return max(best, int((-(-dual // (np.arange(2, 33) * capacity))).max()))


def fullest(have: np.ndarray, room: int, wide: int = 48) -> list[tuple[int, ...]]:
    """A few good fillings of ``room`` by pieces of ``have``, for the dives: one piece, a pair or a triple with the longest
    possible partners, each filled up with the longest piece that fits, again and again. The fullest come first, then
    those of the fewest pieces, which leave the short ones for later. One empty filling if nothing fits."""
    sizes = np.flatnonzero(have[: room + 1])
    if not len(sizes):
        return [()]
    fits = np.zeros(room + 1, np.int64)
    fits[sizes] = sizes
    fits = np.maximum.accumulate(fits)
    found = [(int(sizes[-1]),)]

    def partner(a: np.ndarray, gap: np.ndarray) -> np.ndarray:
        b = fits[gap]
        again = (b == a) & (have[a] < 2)
        return np.where(again, np.where(a > 0, fits[np.minimum(gap, np.maximum(a - 1, 0))], 0), b)

    if found[0][0] < room:
        b = partner(sizes, room - sizes)
        total = sizes + b
        top = np.flatnonzero((total == total.max()) & (b > 0))
        pairs = [(int(max(sizes[i], b[i])), int(min(sizes[i], b[i]))) for i in top[::-1][:3]]
        found += pairs
        if not pairs or sum(pairs[0]) < room:
            first = sizes[-wide:]
            gap = room - first[:, None] - sizes[None, :]
            a, c = np.broadcast_to(first[:, None], gap.shape), np.broadcast_to(sizes[None, :], gap.shape)
            ok = (gap >= 0) & ((a != c) | (have[a] >= 2))
            third = np.where(ok, fits[np.maximum(gap, 0)], 0)
            need = 1 + (third == a) + (a == c)
            ok &= (third == 0) | (((third != a) | (have[a] >= need)) & ((third != c) | (have[c] >= 1 + (third == c) + (a == c))))
            total = np.where(ok, a + c + third, 0)
            for i in np.argsort(total, axis=None)[::-1][:3]:
                x, y = np.unravel_index(i, total.shape)
                if total[x, y]:
                    found.append(tuple(sorted((int(v) for v in (a[x, y], c[x, y], third[x, y]) if v), reverse=True)))
    full = []
    for f in dict.fromkeys(found):
        rest, gap = have[: room + 1].copy(), room - sum(f)
        np.subtract.at(rest, list(f), 1)
        if rest.min() < 0:
            continue
        more = list(f)
        while gap and len(low := np.flatnonzero(rest[: gap + 1])):
            big = int(low[-1])
            n = min(int(rest[big]), gap // big)
            more += [big] * n
            rest[big] -= n
            gap -= n * big
        full.append(tuple(sorted(more, reverse=True)))
    return sorted(dict.fromkeys(full), key=lambda f: (-sum(f), len(f), [-x for x in f]))


def slots(fills: list[Fill]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first bin, offset) for each place of each filling. Ranks of a length count from 0."""
    given: dict[int, int] = {}
    out, base = [], 0
    for lengths, times in fills:
        offset = 0
        for size in lengths:
            out.append((size, given.get(size, 0), times, base, offset))
            given[size] = given.get(size, 0) + times
            offset += size
        base += times
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: every row a place of its own, gapless from offset 0; and, the same in
    all rows, ``sequences``, how many there are, and ``at_least``, how many are needed at least as far as is proved.

    ``pieces`` is read several times; give a materialized table. Lengths must lie in 1..capacity. Rows that tie in
    ``order`` and ``length`` share out their places arbitrarily.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most ``capacity`` rows
    search = Search(capacity)
    fills = search.run(counts)
    plan = spark.createDataFrame(slots(fills) or [(0, 0, 0, 0, 0)], f"{length} long, first long, ranks long, base long, offset long")
    salts = spark.createDataFrame([(k, 1 + n // SALTED_ROWS) for k, n in counts.items()] or [(0, 1)], f"{length} long, salts long")
    salted = pieces.join(F.broadcast(salts), length).withColumn("salt", F.pmod(F.xxhash64(*order), "salts")).drop("salts")
    before = Window.partitionBy(length).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead = salted.groupBy(length, "salt").count().select(length, "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy(length, "salt").orderBy(*order)) - 1)
    ranked = ranked.join(ahead, [length, "salt"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    # The plan has a few places for each of at most ``capacity`` lengths: bounded whatever the input, so it is broadcast.
    per_length = plan.groupBy(length).agg(F.sort_array(F.collect_list(F.struct("first", "ranks", "base", "offset"))).alias("places"))
    found = ranked.join(F.broadcast(per_length), length)
    spot = F.explode(F.filter("places", lambda p: (p["first"] <= F.col("rank")) & (F.col("rank") < p["first"] + p["ranks"])))
    found = found.withColumn("spot", spot)
    place_ = (F.col("spot.base") + F.col("rank") - F.col("spot.first")).alias("sequence_id"), F.col("spot.offset").alias("offset")
    return found.select(*pieces.columns, *place_, F.lit(search.bins).cast("long").alias("sequences"), F.lit(search.bound).cast("long").alias("at_least"))


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack whole documents: the columns of ``tokenize_pieces`` and those of ``place``.

    An empty table gives an empty one.
    """
    pieces = materialize(tokenize_pieces(docs, tokenizer, key, text, capacity, end_id, with_ids), "pieces", TEXT_ROWS)
    return place(pieces, capacity, order=(key, "piece"))


def op3_query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
