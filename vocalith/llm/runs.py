"""Maximal periodic runs of words, by block convolution with an exact integer NTT.

A run is a stretch of consecutive words with smallest period q and at least ``MIN_REPEATS`` q
words (and ``MIN_LENGTH``) that no neighbouring word extends keeping period q.  Periods from B
on and below 2B are sought at scale B, for B = 1, 2, 4 and so on.  The words are numbers, and blocks
of B words stand at every multiple of 2B: the first 3B words of a run of four periods hold one
wholly, and the run holds the block's next occurrence too, at the distance of its period.  The
sum of the squared differences of a block and the words at distance d is zero exactly if the block occurs there.
These sums, for all d of the scale at once, are a constant, a prefix sum and a correlation, which is
taken as a cyclic convolution of size 2B by number-theoretic transforms modulo two primes,
so exactly for sums below their product of 4.6e18.

Each zero gives a distance as a seed, which is extended to both sides by comparing words.  Blocks are
transformed only if each of their words occurs again within less than 2B, without which no sum
can be zero, and if they don't lie in a run already found with all they are compared with: there
only multiples of its period would be found.  For the same reason seeds inside a run are let go, so
that what is extended has no smaller period.

The texts of a batch are worked on together, ``CHUNK`` words or so at a time, with a word that is nowhere else after
each; a text is read whole however long, and there is no shuffle.

Defined cases: words are what white space of ASCII separates; a null text has none; texts of
fewer than six words have no run; the collapsed text of no words is empty; repeated rows
and ties stay as they are; an empty table gives an empty result; columns named ``runs`` and ``collapsed`` are
replaced, other columns are kept and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MIN_REPEATS = 4
MIN_LENGTH = 6
#: Words worked on together.
CHUNK = 1 << 19
#: Numbers in a block of transforms.
CELLS = 1 << 19
#: Primes under 2^32 with roots of unity of order 2^27, and a primitive root of each.
PRIMES = ((2013265921, 31), (2281701377, 3))
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _powers(p: int, root: int, n: int) -> np.ndarray:
    """The powers 0 to n/2 - 1 of an n-th root of unity modulo ``p``."""
    w, out = pow(root, (p - 1) // n, p), np.ones(1, np.uint64)
    while 2 * len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(w, len(out), p)) % np.uint64(p)])
    return out


class Transform:
    """NTT of the columns of arrays with ``n`` rows, and back; in between the order of rows is that of reversed bits."""

    def __init__(self, prime: tuple[int, int], n: int, columns: int):
        (self.p, g), self.n, self.columns = prime, n, columns
        spread = lambda w: np.repeat(w, columns).reshape(-1, columns)
        powers = _powers(self.p, g, n) if n > 1 else np.ones(1, np.uint64)
        back = _powers(self.p, pow(g, -1, self.p), n) if n > 1 else powers
        sizes = [n >> k for k in range(n.bit_length() - 1)]
        self.ahead = [(s // 2, spread(powers[:: n // s])) for s in sizes]
        self.back = [(s // 2, spread(back[:: n // s])) for s in reversed(sizes)]

    def _less(self, a: np.ndarray) -> np.ndarray:
        """``a`` < 2p modulo p: taking p from less wraps to a greater number."""
        return np.minimum(a, a - np.uint64(self.p))

    def forward(self, a: np.ndarray) -> np.ndarray:
        p = np.uint64(self.p)
        for half, w in self.ahead:
            v = a.reshape(-1, 2, half, self.columns)
            x, y = v[:, 0], v[:, 1]
            a = np.stack([self._less(x + y), (x + (p - y)) * w % p], axis=1)
        return a.reshape(self.n, self.columns)

    def inverse(self, a: np.ndarray) -> np.ndarray:
        p = np.uint64(self.p)
        for half, w in self.back:
            v = a.reshape(-1, 2, half, self.columns)
            x, y = v[:, 0], v[:, 1] * w % p
            a = np.stack([self._less(x + y), self._less(x + (p - y))], axis=1)
        return a.reshape(self.n, self.columns) * np.uint64(pow(self.n, -1, self.p)) % p


def occurrences(x: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and distance of each block's zero-mismatch occurrences at distances from ``block`` on and below twice it.

    ``x`` are words as numbers, and goes on for ``3 * block`` words from each of ``starts``.
    """
    n, found = 2 * block, []
    step = max(1, CELLS // n)
    for i in range(0, len(starts), step):
        some = starts[i : i + step]
        words = x[some + np.arange(3 * block)[:, None]]  # a column for each block
        zero = np.ones((block, len(some)), bool)
        for prime in PRIMES:
            p, t = np.uint64(prime[0]), Transform(prime, n, len(some))
            # The block backwards, so that the product at block - 1 + k compares it with the words at distance block + k.
            a = np.zeros((n, len(some)), np.uint64)
            a[:block] = words[:block][::-1]
            product = t.inverse(t.forward(a) * t.forward(words[block:]) % p)
            both = product[(block - 1 + np.arange(block)) % n]
            squares = words * words % p
            sums = np.concatenate([np.zeros((1, len(some)), np.uint64), np.cumsum(squares, axis=0, dtype=np.uint64)])
            at = np.arange(block)
            total = sums[block] + sums[2 * block + at] - sums[block + at]
            zero &= (total + (p - both) + (p - both)) % p == 0
        k, c = np.nonzero(zero)
        found.append((some[c], k + block))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _gallop(x: np.ndarray, y: np.ndarray) -> int:
    """How many of the first numbers of two sequences are equal."""
    at, step, n = 0, 64, min(len(x), len(y))
    while at < n:
        differ = x[at : min(at + step, n)] != y[at : min(at + step, n)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, 2 * step
    return n


class Found:
    """The runs found so far, as start, end and period."""

    def __init__(self):
        self.start, self.end, self.period = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.furthest = self.end

    def add(self, more: list[tuple[int, int, int]]) -> None:
        if more:
            s, e, q = (np.concatenate([old, new]) for old, new in zip((self.start, self.end, self.period), np.array(more, np.int64).T, strict=True))
            order = np.lexsort((q, s))
            self.start, self.end, self.period = s[order], e[order], q[order]
            self.furthest = np.maximum.accumulate(self.end)

    def cover(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether one run holds all from ``start`` to ``end``."""
        at = np.searchsorted(self.start, start, "right") - 1
        if not len(self.start):
            return np.zeros(len(start), bool)
        return (at >= 0) & (self.furthest[at] >= end)


def find(x: np.ndarray, longest: int) -> Found:
    """The runs of ``x``, words as numbers, of which at most ``longest`` follow each other without a number that is nowhere else."""
    n, found, block = len(x), Found(), 1
    order = np.argsort(x.astype(np.uint16) if n and x.max() < 1 << 16 else x, kind="stable")
    gap = np.full(n, np.iinfo(np.int64).max)
    again = x[order[1:]] == x[order[:-1]]
    gap[order[:-1][again]] = np.diff(order)[again]
    x = np.concatenate([x, x.max(initial=0) + 1 + np.arange(longest)])  # what blocks at the end are compared with
    while MIN_REPEATS * block <= longest:
        starts = np.arange(0, n - block + 1, 2 * block)
        before = np.concatenate([[0], np.cumsum(gap < 2 * block)])
        starts = starts[before[starts + block] - before[starts] == block]
        starts = starts[~found.cover(starts, starts + 3 * block)]
        at, distance = occurrences(x.view(np.uint64), starts, block)
        seeds = ~found.cover(at, at + block + distance)
        at, distance = at[seeds], distance[seeds]
        order = np.lexsort((at, distance))
        more, last, done = [], 0, 0
        for a, d in zip(at[order].tolist(), distance[order].tolist(), strict=True):
            if d == last and a < done:
                continue
            s = a - _gallop(x[:a][::-1], x[: a + d][::-1][: a])
            e = a + d + _gallop(x[a:], x[a + d :])
            last, done = d, e - d
            if e - s >= max(MIN_LENGTH, MIN_REPEATS * d):
                more.append((s, e, d))
        found.add(more)
        block *= 2
    return found


def _worked(texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """The runs (start, length, period) of each text, and its kept words joined by a space."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    offsets = np.cumsum(sizes + 1) - sizes - 1
    inside = np.ones(len(flat) + len(texts), bool)
    inside[offsets + sizes] = False
    x = np.empty(len(inside), np.int64)
    x[inside] = flat.indices.to_numpy(zero_copy_only=False)
    x[~inside] = len(flat.dictionary) + np.arange(len(texts))
    found = find(x, int(sizes.max(initial=0)))
    of = np.searchsorted(offsets, found.start, "right") - 1
    gone = np.zeros(len(x) + 1, np.int32)
    np.add.at(gone, found.start + found.period, 1)
    np.add.at(gone, found.end, -1)
    keep = np.cumsum(gone)[:-1] == 0
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for d, s, e, q in zip(of.tolist(), found.start.tolist(), found.end.tolist(), found.period.tolist(), strict=True):
        runs[d].append((s - int(offsets[d]), e - s, q))
    return [(r, b" ".join(compress(t, keep[o : o + len(t)].tolist()) if r else t)) for t, r, o in zip(texts, runs, offsets.tolist(), strict=True)]


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with ``runs`` (start, length and period, by start and period) of each text and ``collapsed``, its words but those a run repeats."""
    names = [c for c in docs.columns if c not in ("runs", "collapsed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, some, size = [], [], 0
            for text in batch.column("text"):
                some.append((text.as_py() or "").encode().split())
                size += len(some[-1])
                if size >= CHUNK:
                    made, some, size = made + _worked(some), [], 0
            made += _worked(some)
            runs = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r, _ in made], RUNS)
            collapsed = pa.array([c.decode() for _, c in made], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), runs, collapsed], [*names, "runs", "collapsed"])

    read = docs.withColumn("text", F.col("text").cast("string")).select(*[F.col(f"`{n}`") for n in names])
    made = StructType.fromDDL("runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return read.mapInArrow(run, StructType([*(read.schema[n] for n in names), *made]))


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length per period; ties go to the smallest start, then period; null if there is none."""

    def before(a: Column, b: Column) -> Column:
        x, y = a.length * b.period, b.length * a.period
        tie = F.when(a.start != b.start, F.signum(a.start - b.start)).otherwise(F.signum(a.period - b.period))
        return F.when(x > y, -1).when(x < y, 1).otherwise(tie).cast("int")

    return F.get(F.array_sort(runs, before), F.lit(0))
