"""Training of a byte-level BPE in rounds: words stay on the executors, and the driver only sees pairs that can be next.

A round asks for the counts of some candidate pairs and of their neighbours. With these the driver can tell what a merge
does to all other counts: exactly, or at most. It goes on merging while the most frequent pair is certain, that is, its count
is known and above all that is only bounded, so a round takes many merges and their order is the one that merging one by one
would give.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.constants import FIRST_BYTE
from corpusmill.scratch import Table

Pair = tuple[int, int]
CANDIDATES = 128  # pairs that a round learns about
KNOWN = 8192  # pairs whose counts the driver holds from the start of a stretch of rounds
PENDING = 256  # merges that tasks apply anew before the words are written with them


class Lazy:
    """A dictionary of counts that knows its greatest one; of equal ones, that of the smallest pair."""

    def __init__(self, counts: dict[Pair, int]):
        self.counts = counts
        self.heap = [(-n, p) for p, n in counts.items()]
        heapq.heapify(self.heap)

    def set(self, p: Pair, n: int) -> None:
        self.counts[p] = n
        heapq.heappush(self.heap, (-n, p))

    def top(self) -> tuple[int, Pair] | None:
        while self.heap and self.counts.get(self.heap[0][1]) != -self.heap[0][0]:
            heapq.heappop(self.heap)
        return self.heap[0] if self.heap else None


class Counts:
    """What the driver knows about pair counts; any pair that isn't here comes behind ``last``, a pair and its count."""

    def __init__(self, known: dict[Pair, int], last: tuple[int, Pair]):
        self.last, self.rest = last, -last[0]
        self.exact = Lazy(known)
        self.most = Lazy({})  # bounds of pairs whose count isn't known
        self.left: dict[Pair, dict[int, int]] = {}  # candidate: neighbour: count, or a bound where it is loose
        self.right: dict[Pair, dict[int, int]] = {}
        self.loose: dict[Pair, set[tuple[str, int]]] = {}

    def learn(self, found: dict[Pair, tuple[int, dict[int, int], dict[int, int]]]) -> None:
        """Exact counts of this round's candidates, with their neighbours; older neighbours are no longer of use."""
        self.left, self.right = {p: f[1] for p, f in found.items()}, {p: f[2] for p, f in found.items()}
        self.loose = {p: set() for p in found}
        for p, (n, _, _) in found.items():
            self._exact(p, n)

    def _exact(self, p: Pair, n: int) -> None:
        self.most.counts.pop(p, None)
        self.exact.set(p, n)

    def _bound(self, p: Pair, n: int) -> None:
        if n > 0:
            self.exact.counts.pop(p, None)
            self.most.set(p, n)
        else:
            self._exact(p, 0)

    def _less(self, p: Pair, n: int, sure: bool) -> None:
        """A pair lost n occurrences, or up to n."""
        if p in self.exact.counts:
            if sure:
                self._exact(p, self.exact.counts[p] - n)
            elif n:
                self._bound(p, self.exact.counts[p])
        elif p in self.most.counts and sure:
            self._bound(p, self.most.counts[p] - n)

    def _more(self, p: Pair, n: int, sure: bool, new: bool) -> None:
        """A pair got n occurrences, or up to n; a ``new`` one had none before."""
        if not n:
            return
        if p in self.most.counts:
            self._bound(p, self.most.counts[p] + n)
        elif p in self.exact.counts or new:
            total = self.exact.counts.get(p, 0) + n
            self._exact(p, total) if sure else self._bound(p, total)
        else:
            self._bound(p, self.rest + n)

    def candidates(self, k: int) -> list[Pair]:
        """The pairs that may be most frequent next: the highest counts and bounds."""
        every = [(-n, p) for held in (self.exact, self.most) for p, n in held.counts.items() if n > 0]
        return [p for _, p in heapq.nsmallest(k, every)]

    def next(self) -> tuple[int, Pair] | None:
        """The most frequent pair, of several the one of smaller ids, if that is certain: minus its count, and the pair."""
        top, bound = self.exact.top(), self.most.top()
        return top if top and (bound is None or top < bound) and top <= self.last else None

    def merge(self, p: Pair, new: int, fresh: bool) -> None:
        """Every p is ``new`` from now on; ``fresh`` says that no other symbol is."""
        (a, b), left, right, loose = p, self.left.pop(p), self.right.pop(p), self.loose.pop(p)
        self._exact(p, 0)
        for side, table in (("L", left), ("R", right)):
            for x, n in table.items():
                # A neighbour that is itself the end of another p becomes part of that, and runs of one symbol overlap themselves.
                sure = (side, x) not in loose and x != (b if side == "L" else a) and a != b
                self._less((x, a) if side == "L" else (b, x), n, sure)
                self._more((x, new) if side == "L" else (new, x), n, sure, fresh)
        self._more((new, new), min(left.get(b, 0), right.get(a, 0)), False, fresh)
        # Other candidates: a neighbour may have become part of the new symbol, and what overlapped p is gone.
        for q in self.left:
            c, d = q
            for side, table, x in (("L", self.left[q], b), ("R", self.right[q], a)):
                if n := table.get(x):
                    self.loose[q] |= {(side, x), (side, new)}
                    table[new] = table.get(new, 0) + n
            if c == b:  # a p before it took its first symbol
                self.left[q].pop(a, None)
                self.loose[q].discard(("L", a))
                if right.get(d):
                    self.loose[q] |= {("R", x) for x in self.right[q]}
            if d == a:
                self.right[q].pop(b, None)
                self.loose[q].discard(("R", b))
                if left.get(c):
                    self.loose[q] |= {("L", x) for x in self.left[q]}


def learned(top: Callable, facts: Callable, apply: Callable, names: list[str], vocab: int, least: int) -> list[tuple[str, str]]:
    """The merges, in order; ``names`` grows by the new symbols.

    ``top(k)`` gives the counts of the k most frequent pairs, and the last of them (with no more than these, any pair comes
    before it); ``facts(pairs)`` counts and neighbours of each pair; ``apply`` takes the merges of a round.
    """
    number = {s: i for i, s in enumerate(names)}
    merges: list[tuple[str, str]] = []
    counts = None
    while len(names) < vocab:
        anew = counts is None
        if anew:
            counts = Counts(*top(KNOWN))
        counts.learn(facts(counts.candidates(CANDIDATES)))
        done: list[tuple[int, int, int]] = []
        while len(names) < vocab and (found := counts.next()) and -found[0] >= least and found[1] in counts.left:
            a, b = found[1]
            joined = names[a] + names[b]
            merges.append((names[a], names[b]))
            fresh = joined not in number
            if fresh:
                number[joined] = len(names)
                names.append(joined)
            done.append((a, b, number[joined]))
            counts.merge((a, b), number[joined], fresh)
        if done:
            apply(done)
        elif anew:  # even the first pair is too rare, or there is none
            break
        else:  # what was left out at the start of this stretch may come first by now
            counts = None
    return merges


def merged(v: np.ndarray, end: np.ndarray, weight: np.ndarray, merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of words end to end (``end`` marks the last of each) after some merges, one after another."""
    for a, b, new in merges:
        at = np.flatnonzero((v[:-1] == a) & (v[1:] == b) & ~end[:-1])
        if a == b and len(at):  # of a run, every second place
            first = np.concatenate(([True], np.diff(at) != 1))
            at = at[(at - np.maximum.accumulate(np.where(first, at, -1))) % 2 == 0]
        if len(at):
            v[at] = new
            end[at] = end[at + 1]
            keep = np.ones(len(v), bool)
            keep[at + 1] = False
            v, end, weight = v[keep], end[keep], weight[keep]
    return v, end, weight


def _flat(batch: pa.RecordBatch, merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column(0)
    v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    end = np.zeros(len(v), bool)
    end[np.cumsum(sizes) - 1] = True
    return merged(v, end, np.repeat(batch.column(1).to_numpy(), sizes), merges)


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return key[starts], np.add.reduceat(n, starts) if len(starts) else n


WIDE = 32  # bits for a symbol in a pair's code


class Words:
    """The distinct words as arrays of symbols, with counts, in a written table; merges since then are applied by each task."""

    def __init__(self, counts: DataFrame):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = batch.column(0)
                offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
                data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.int32) + FIRST_BYTE
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(data)), batch.column(1)], names=["v", "n"])

        words = counts.where(F.octet_length("word") > 1).select(F.col("word").cast("binary").alias("word"), F.col("n").cast("long").alias("n"))
        self.spark = counts.sparkSession
        self.table = Table(words.mapInArrow(run, "v array<int>, n long"))
        self.pending: list[tuple[int, int, int]] = []

    def _job(self, fn, schema: str) -> DataFrame:
        merges = self.pending

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield from fn(*_flat(batch, merges))

        return self.table.df.mapInArrow(run, schema)

    def apply(self, merges: list[tuple[int, int, int]]) -> None:
        self.pending = self.pending + merges
        if len(self.pending) >= PENDING:

            def rows(v, end, weight):
                stops = np.flatnonzero(end) + 1
                sizes = np.diff(stops, prepend=0)
                more = np.repeat(sizes > 1, sizes)  # a word of one symbol has no pairs any more
                offsets = np.concatenate(([0], np.cumsum(sizes[sizes > 1]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(v[more].astype(np.int32))), pa.array(weight[stops - 1][sizes > 1])], names=["v", "n"])

            after = Table(self._job(rows, "v array<int>, n long"))
            self.table.drop()
            self.table, self.pending = after, []

    def top(self, k: int) -> tuple[dict[Pair, int], tuple[int, Pair]]:
        def rows(v, end, weight):
            inside = ~end[:-1]
            code, n = _sums((v[:-1] << WIDE | v[1:])[inside], weight[:-1][inside])
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

        sums = self._job(rows, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        found = [((r.code >> WIDE, r.code & (1 << WIDE) - 1), r.n) for r in sums.orderBy(F.desc("n"), "code").limit(k).collect()]
        last = (-found[-1][1], found[-1][0]) if len(found) == k else (1, (0, 0))
        return dict(found), last

    def facts(self, pairs: list[Pair]) -> dict[Pair, tuple[int, dict[int, int], dict[int, int]]]:
        """Counts and neighbours: at most a row for each pair and symbol of the vocabulary on either side."""
        codes = np.array([a << WIDE | b for a, b in pairs], np.int64)
        order = np.argsort(codes)
        ranked = codes[order]

        def rows(v, end, weight):
            if not len(ranked):
                return
            code = v[:-1] << WIDE | v[1:]
            k = np.minimum(np.searchsorted(ranked, code), len(ranked) - 1)
            at = np.flatnonzero((ranked[k] == code) & ~end[:-1])
            k = k[at]
            before, behind = (at > 0) & ~end[at - 1], ~end[at + 1]
            # A pair's number, then the kind of row, then the neighbour.
            keys = [k * 3 << WIDE, (k[before] * 3 + 1 << WIDE) | v[at[before] - 1], (k[behind] * 3 + 2 << WIDE) | v[at[behind] + 2]]
            key, n = _sums(np.concatenate(keys), np.concatenate([weight[at], weight[at[before]], weight[at[behind]]]))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

        out: dict[Pair, tuple[int, dict[int, int], dict[int, int]]] = {}
        tables: list[list[dict[int, int]]] = [[{}, {}, {}] for _ in pairs]
        sums = self._job(rows, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        for key, n in zip(sums["key"].to_pylist(), sums["n"].to_pylist(), strict=True):
            kind = key >> WIDE
            tables[int(order[kind // 3])][kind % 3][key & (1 << WIDE) - 1] = n
        for p, (total, left, right) in zip(pairs, tables, strict=True):
            out[p] = (total.get(0, 0), left, right)
        return out
