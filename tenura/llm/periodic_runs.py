"""Stretches of words that repeat with a period, found by longest common extensions over a difference cover."""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 6  # words of a run
TIMES = 4  # periods of a run
COVER_ROOT = 8  # the cover is of residues modulo its square
BATCH_WORDS = 200_000  # words of several documents handled together; a longer document is on its own
PAIRS = 400_000  # grid pairs compared at a time


class CommonExtensions:
    """How many words two places of a sequence have in common from there on.

    Only suffixes at places whose residue is in a difference cover are sorted.
    For any two places there is an offset below the cover's modulus at which
    both are sampled: the words before it are compared one by one, the rest is
    a range minimum over the sampled suffixes' common prefixes.
    """

    def __init__(self, words: np.ndarray, root: int = COVER_ROOT):
        self.v = v = root * root
        # every d is k * root - j with j < root, so two of these residues differ by it
        self.cover = np.unique(np.concatenate([np.arange(root), np.arange(root) * root]))
        inside = np.full(v, -1)
        inside[self.cover] = np.arange(len(self.cover))
        self.nth = inside
        self.first = np.array([next(x for x in self.cover if inside[(x + d) % v] >= 0) for d in range(v)])
        top = int(words.max(initial=0)) + 1
        pad = 2 * v - len(words) % v  # numbers that occur once each
        self.words = np.concatenate([words, top + np.arange(pad)]).astype(np.int64)
        self._sort(len(self.words) - v)
        self._minima()

    def _index(self, places: np.ndarray) -> np.ndarray:
        return places // self.v * len(self.cover) + self.nth[places % self.v]

    def _sort(self, end: int) -> None:
        """Ranks of the sampled suffixes; ``levels`` has those by their first v, 2v, 4v ... words."""
        v = self.v
        self.places = (np.arange(0, end, v)[:, None] + self.cover).reshape(-1)
        rank = np.zeros(len(self.places), np.int64)  # of equal ones: how many are less
        tied = np.arange(len(self.places))

        def refine(keys: np.ndarray, tied: np.ndarray) -> np.ndarray:
            order = np.lexsort((keys, rank[tied]))
            tied, keys, group = tied[order], keys[order], rank[tied[order]]
            new_group = np.diff(group, prepend=-1) != 0
            new = new_group | (np.diff(keys, prepend=0) != 0)
            at = np.arange(len(tied))
            group_start = np.maximum.accumulate(np.where(new_group, at, 0))
            start = np.maximum.accumulate(np.where(new, at, 0))
            rank[tied] = group + start - group_start
            size = np.diff(np.append(np.flatnonzero(new), len(tied)))
            return tied[np.repeat(size, size) > 1]

        shift = int(self.words.max()).bit_length()
        step = max(1, min(62 // shift, v))
        for t in range(0, v, step):
            if not len(tied):
                break
            keys = np.zeros(len(tied), np.int64)
            for k in range(t, min(t + step, v)):
                keys = keys << shift | self.words[self.places[tied] + k]
            tied = refine(keys, tied)
        self.levels, far = [rank.copy()], v
        while len(tied):
            later = self.places[tied] + far
            keys = np.where(later < end, self.levels[-1][self._index(np.where(later < end, later, 0))], -1)
            tied = refine(keys, tied)
            self.levels.append(rank.copy())
            far *= 2
        self.rank, self.end = rank, end

    def _minima(self) -> None:
        """Common prefixes of neighbours in the order, and their minima over 1, 2, 4 ... of them."""
        order = np.argsort(self.rank)
        a, b = self.places[order[:-1]].copy(), self.places[order[1:]].copy()
        common = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            far = self.v << k
            here = np.flatnonzero(np.maximum(a, b) < self.end)
            same = here[self.levels[k][self._index(a[here])] == self.levels[k][self._index(b[here])]]
            common[same] += far
            a[same] += far
            b[same] += far
        common += self._compared(a, b, np.full(len(a), self.v))
        self.minima = [common.astype(np.int32)]
        while len(self.minima[-1]) > 1 << (len(self.minima) - 1):
            half = 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(self.minima[-1][:-half], self.minima[-1][half:]))

    def _compared(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The words in common from i and j on, up to ``limit``, one after the other."""
        found = np.zeros(len(i), np.int64)
        alive = np.flatnonzero(limit > 0)
        t, last = 0, len(self.words) - 1
        while len(alive):
            same = self.words[np.minimum(i[alive] + t, last)] == self.words[np.minimum(j[alive] + t, last)]
            alive = alive[same & (np.maximum(i[alive], j[alive]) + t <= last)]
            t += 1
            found[alive] = t
            alive = alive[limit[alive] > t]
        return found

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For arrays of different places i and j."""
        ahead = (self.first[(j - i) % self.v] - i) % self.v
        found = self._compared(i, j, ahead)
        on = np.flatnonzero((found == ahead) & (np.maximum(i, j) + ahead < self.end))
        one, two = (self.rank[self._index(x[on] + ahead[on])] for x in (i, j))
        low, high = np.minimum(one, two), np.maximum(one, two)
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        for level in np.unique(k).tolist():
            own = k == level
            table = self.minima[level]
            found[on[own]] += np.minimum(table[low[own]], table[high[own] - (1 << level)])
        return found


def _grid(starts: np.ndarray, sizes: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i and periods q, periods ascending, such that any run of ``times`` periods q has one of its pairs (i, i + q).

    The words that equal the one q later in such a run are at least
    (times - 1) * q in a row, so every (times - 1) * q-th place is enough:
    over all periods that is a harmonic sum.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    q = 1
    while len(sizes):
        n = np.searchsorted(-sizes, -times * q, side="right")
        starts, sizes = starts[:n], sizes[:n]
        if not n:
            return
        many = max(n, int(sizes.sum()) // ((times - 1) * q))
        periods = np.arange(q, q + max(1, PAIRS // many))
        q = int(periods[-1]) + 1
        period = np.repeat(periods, n)
        start, size = np.tile(starts, len(periods)), np.tile(sizes, len(periods))
        fits = size >= times * period
        period, start, size = period[fits], start[fits], size[fits]
        step = (times - 1) * period
        counts = -(-(size - period) // step)
        ends = np.cumsum(counts)
        nth = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
        yield np.repeat(start, counts) + nth * np.repeat(step, counts), np.repeat(period, counts)


def _promising(words: np.ndarray, i: np.ndarray, q: np.ndarray, few: int) -> np.ndarray:
    """Which pairs have at least ``few`` words in common around them; there are that many words on either side."""
    kept = np.flatnonzero(words[i] == words[i + q])
    a, b = i[kept], q[kept]
    around = np.ones(len(kept), np.int64)
    for direction in (1, -1):
        on = np.ones(len(kept), bool)
        for t in range(1, few):
            at = a + direction * t
            on &= words[at] == words[at + b]
            around += on
    return kept[around >= few]


def runs_of(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES):
    """start, end, period of the maximal runs of sequences that lie in ``words``, in order of (start, period).

    Numbers between sequences occur once each; at least one stands before the
    first and behind the last. A run has a smallest period q and at least
    max(least, times * q) words; ``times`` is 2 at least.
    """
    few = max(1, min(least - 1, (times - 1) * max(1, -(-least // times))))
    edge = np.int64(words.max(initial=0)) + 1 + np.arange(2 * few)
    padded = np.concatenate([edge[:few], words, edge[few:]])  # so that a few words to either side exist

    hits = np.zeros(len(starts), bool)
    order = np.argsort(starts)
    for i, q in _grid(starts, sizes, times):
        near = _promising(padded, i + few, q, few)
        hits[order[np.searchsorted(starts[order], i[near], side="right") - 1]] = True
    own = np.flatnonzero(hits)
    none = np.zeros(0, np.int64)
    if not len(own):
        return none, none, none

    # the sequences with any promising pair on their own, with the numbers around them
    size = sizes[own]
    at = np.cumsum(size + 1) - size
    part = np.zeros(int(size.sum()) + len(own) + 1, np.int64)
    top = int(words.max()) + 1
    part[np.concatenate([[0], at + size])] = top + np.arange(len(own) + 1)
    inside = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    source = np.repeat(starts[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    part[inside] = words[source]
    _, part = np.unique(part, return_inverse=True)  # few bits for each
    part = part.reshape(-1).astype(np.int64)
    edge = len(part) + np.arange(2 * few)
    padded = np.concatenate([edge[:few], part, edge[few:]])
    ahead, back = CommonExtensions(part), CommonExtensions(part[::-1])

    found = [none], [none], [none]
    for i, q in _grid(at, size, times):
        near = _promising(padded, i + few, q, few)
        i, q = i[near], q[near]
        begin = i - back(len(part) - i, len(part) - i - q)
        end = i + q + ahead(i, i + q)
        kept = end - begin >= np.maximum(least, times * q)
        # pairs of one run, and multiples of its period, give the same words: the smallest period counts
        begin, end, q = begin[kept], end[kept], q[kept]
        order = np.lexsort((q, end, begin))
        new = (np.diff(begin[order], prepend=-1) != 0) | (np.diff(end[order], prepend=-1) != 0)
        for list_, values in zip(found, (begin, end, q), strict=True):
            list_.append(values[order[new]])
    begin, end, q = (np.concatenate(x) for x in found)
    order = np.lexsort((q, end, begin))
    new = (np.diff(begin[order], prepend=-1) != 0) | (np.diff(end[order], prepend=-1) != 0)
    begin, end, q = begin[order[new]], end[order[new]], q[order[new]]
    move = (starts[own] - at)[np.searchsorted(at, begin, side="right") - 1]
    begin, end = begin + move, end + move
    order = np.lexsort((q, begin))
    return begin[order], end[order], q[order]


def _batch(doc_ids: pa.Array, documents: list[list[bytes]], least: int, times: int) -> pa.RecordBatch:
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    sizes = np.array([len(x) for x in documents], np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    words = np.zeros(int(sizes.sum()) + len(sizes) + 1, np.int64)
    for start, size, own in zip(starts.tolist(), sizes.tolist(), documents, strict=True):
        words[start : start + size] = [numbers[w] for w in own]
    words[np.concatenate([[0], starts + sizes])] = len(numbers) + np.arange(len(sizes) + 1)
    begin, end, period = runs_of(words, starts, sizes, least, times)
    of = np.searchsorted(starts, begin, side="right") - 1
    # a word goes if it lies in any run behind that run's first period
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, begin + period, 1)
    np.add.at(steps, end, -1)
    kept = np.cumsum(steps) == 0
    collapsed = []
    counts = np.bincount(of, minlength=len(sizes))
    for start, own, n in zip(starts.tolist(), documents, counts.tolist(), strict=True):
        if n:
            own = [w for w, keep in zip(own, kept[start : start + len(own)].tolist(), strict=True) if keep]
        collapsed.append(b" ".join(own))
    fields = [pa.array(x) for x in (begin - starts[of], end - begin, period)]
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            doc_ids,
            pa.array(sizes),
            pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "length", "period"])),
            pa.array(collapsed, pa.binary()).cast(pa.string()),
        ],
        ["doc_id", "n_words", "runs", "collapsed"],
    )


def find_runs(
    docs: DataFrame, least: int = LEAST, times: int = TIMES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_words, runs, collapsed of every row's whole text; nothing is shuffled.

    Words are what blanks, tabs and line ends (ASCII 9 to 13) separate. ``runs``
    has start (word number), length and period of every maximal stretch with
    smallest period q and at least max(least, times * q) words, by start, then
    period. ``collapsed`` is the text without the words that a run contains
    behind its first period, the others joined by single blanks. A null or
    empty text has no words. Rows are handled on their own: missing or repeated
    ids and repeated rows change nothing, a very long text takes memory in
    proportion to its words.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has at least two words and two periods")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, total, first = [], 0, 0
            for i in range(batch.num_rows):
                held.append((batch.column(1)[i].as_py() or b"").split())
                total += len(held[-1])
                if total >= BATCH_WORDS:
                    yield _batch(batch.column(0).slice(first, len(held)), held, least, times)
                    held, total, first = [], 0, i + 1
            if held:
                yield _batch(batch.column(0).slice(first, len(held)), held, least, times)

    return rows.mapInArrow(
        run,
        f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string",
    )
