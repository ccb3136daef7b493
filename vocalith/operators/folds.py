"""State carried over the ordered rows of a key.

``fold`` brings a key's rows to one task in order and streams them through, a stretch of a batch at
a time, with the key's state; only the state is held, so a key may have any number of rows.
A stretch is worked out in whole arrays.  Other keys of the task follow one after the
other; null is a key like any other.

``scan`` gives the same without bringing a key's rows to one task: all rows are sorted over the
partitions, so a key of very many rows has many of them.  What each partition does to the state of a key that
goes on from one to the next is summed up in a small row, the rows of a key are composed in order, and each
partition then starts from the state that it is left.  Smoothing is summed up as a scaling and a shift of
the held values; a limiter as a step function from the end of the window it is entered with to the one it is left with,
which has as many steps as there are different windows to leave with.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from vocalith.operators.shared import settle

ALPHA, WARM, LEAST = 0.3, 6.25, 7
BLOCK = 64


def stretches(df: DataFrame, key: str, order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` sorted by key and order over all partitions, or ``parts`` of them, settled, with the number ``_stretch`` of each row's partition."""
    placed = (df.repartitionByRange(parts, key, *order) if parts else df.repartitionByRange(key, *order)).sortWithinPartitions(key, *order)
    return settle(placed.withColumn("_stretch", F.spark_partition_id()))


def _spans(rows: DataFrame, key: str) -> DataFrame:
    """_key, _at and _base of each stretch of the keys that have several: how many rows of the key come before it.

    A stretch has at most two such keys, so these are few rows.
    """
    counts = rows.groupBy(F.col(key).alias("_key"), F.col("_stretch").alias("_at")).agg(F.count("*").alias("_n"))
    by = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_base": F.coalesce(F.sum("_n").over(by), F.lit(0)), "_of": F.count("*").over(Window.partitionBy("_key"))})
    return counts.where("_of > 1").select("_key", "_at", "_base")


def _segments(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[object, pa.RecordBatch]]:
    """The rows of each key, in pieces of a batch at most, with the key."""
    for batch in batches:
        if batch.num_rows:
            codes = batch.column(at).dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield batch.column(at)[int(a)].as_py(), batch.slice(int(a), int(b - a))


def scan(df: DataFrame, key: str, order: list[str], needs: str, step: Callable, summary: Callable, compose: Callable, outputs: str, parts: int | None = None) -> DataFrame:
    """``fold`` with a key's rows in many tasks; wide rows want ``parts`` so many that one is held at once.

    ``summary(pieces, base)`` sums up the pieces of ``needs`` of a key in one stretch, before which the key has ``base`` rows;
    ``compose(state, summary)`` is the state after it.
    """
    rows = stretches(df, key, order, parts)
    spans = _spans(rows, key)
    here = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_stretch") == F.col("_at"))

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pieces, base = object(), [], None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last], made_schema.field("_key").type), pa.array([base[1]], pa.int32()), pa.array([pickle.dumps(summary(pieces, base[0]))], pa.binary())], ["_key", "_at", "_sum"])

        made_schema = None
        for now, piece in _segments(batches, 0):
            made_schema = made_schema or pa.schema([("_key", piece.schema.field(0).type)])
            if pieces and not _same(now, last):
                yield out()
                pieces = []
            last, base = now, (piece.column(2)[0].as_py(), piece.column(3)[0].as_py())
            pieces.append(piece.column(1))
        if pieces:
            yield out()

    fields = StructType([StructField("_key", df.schema[key].dataType), *StructType.fromDDL("_at int, _sum binary")])
    sums = rows.join(F.broadcast(spans), here).select("_key", needs, "_base", "_at").mapInArrow(sum_up, fields)

    def carry(group: pd.DataFrame) -> pd.DataFrame:
        group, state, states = group.sort_values("_at"), None, []
        for s in group["_sum"]:
            states.append(pickle.dumps(state))
            state = compose(state, pickle.loads(s))  # noqa: S301
        return pd.DataFrame({"_key": group["_key"], "_at": group["_at"], "_state": states})

    states = sums.groupBy("_key").applyInPandas(carry, StructType([fields[0], *StructType.fromDDL("_at int, _state binary")]))
    cols, names = df.columns, [x.split()[0] for x in outputs.split(", ")]
    at, of = cols.index(key), cols.index(needs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for now, piece in _segments(batches, at):
            if not _same(now, last):
                start = piece.column(len(cols))[0].as_py()
                last, state = now, pickle.loads(start) if start else None  # noqa: S301
            arrays, state = step(piece.column(of), state)
            yield pa.RecordBatch.from_arrays([*piece.columns[: len(cols)], *arrays], [*cols, *names])

    placed = rows.join(F.broadcast(states), here, "left").select(*[F.col(f"`{c}`") for c in cols], "_state")
    return placed.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(outputs).fields]))


def _same(a: object, b: object) -> bool:
    """Equality in which null equals null and NaN equals NaN."""
    return a == b or (a is None and b is None) or (a != a and b != b)


def fold(df: DataFrame, key: str, order: list[str], needs: str, step: Callable, outputs: str) -> DataFrame:
    """``df`` with the columns ``outputs``: step(values of ``needs`` or None, state or None) gives (arrays, state)."""
    cols, names = df.columns, [x.split()[0] for x in outputs.split(", ")]
    at, of = cols.index(key), cols.index(needs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(at).dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1), batch.num_rows]
            made = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                now = batch.column(at)[int(a)].as_py()
                if not _same(now, last):
                    last, state = now, None
                arrays, state = step(batch.column(of).slice(int(a), int(b - a)), state)
                made.append(arrays)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.concat_arrays(x) for x in zip(*made, strict=True))], [*cols, *names])

    placed = df.repartition(key).sortWithinPartitions(key, *order)
    return placed.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(outputs).fields]))


def counted(t: np.ndarray, state: tuple[int, int] | None, window: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """The number in its window, and the end of that window, of each of the rising times ``t``; a window opens with its first request."""
    count, reset = state or (0, None)
    number, ends, i = np.empty(len(t), np.int64), np.empty(len(t), np.int64), 0
    while i < len(t):
        if reset is None or t[i] >= reset:
            count, reset = 0, int(t[i]) + window
        j = int(np.searchsorted(t, reset))
        number[i:j], ends[i:j] = count + np.arange(1, j - i + 1), reset
        count, i = count + j - i, j
    return number, ends, (count, reset)


def limiter(limit: int, window: int) -> Callable:
    """ok, remaining and reset_at of each request at ``t``, which is not null."""

    def step(t: pa.Array, state: tuple | None) -> tuple:
        number, ends, state = counted(t.to_numpy(), state, window)
        return [pa.array(number <= limit), pa.array(np.maximum(0, limit - number)), pa.array(ends)], state

    return step


def windows_left(t: np.ndarray, window: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """What the rising times ``t`` do to a limiter: their number, the last one, and a step function.

    A limiter whose window ends at a time up to ``upto[i]`` opens its next window in ``t``, and leaves with a window
    that ends at ``ends[i]`` and holds ``counts[i]`` of them.
    """
    after = np.searchsorted(t, t + window)  # where the next window opens
    last = np.arange(len(t))
    while True:  # windows follow windows; each round doubles how many are passed
        inside = after < len(t)
        if not inside.any():
            break
        last = np.where(inside, last[np.where(inside, after, 0)], last)
        after = np.where(inside, after[np.where(inside, after, 0)], after)
    ends = t[last] + window
    turn = np.flatnonzero(np.diff(ends, append=ends[-1] + 1))
    return len(t), int(t[-1]), t[turn], ends[turn], len(t) - np.searchsorted(t, ends[turn] - window)


def entered(state: tuple[int, int] | None, left: tuple) -> tuple[int, int]:
    """The state (count, end of window) after the times summed up by ``windows_left``."""
    n, last, upto, ends, counts = left
    if state is not None and state[1] > last:
        return state[0] + n, state[1]
    i = 0 if state is None else int(np.searchsorted(upto, state[1]))
    return int(counts[i]), int(ends[i])


def rate_limit(requests: DataFrame, key: str, order: list[str], limit: int, window: int) -> DataFrame:
    return rate_limits(requests, key, order, [(limit, window)], ["ok boolean, remaining long, reset_at long"])


def rate_limits(requests: DataFrame, key: str, order: list[str], limits: list[tuple[int, int]], outputs: list[str]) -> DataFrame:
    """Several limiters over the same requests, the outputs of each under names of their own."""
    steps = [limiter(*x) for x in limits]

    def step(t: pa.Array, state: list | None) -> tuple:
        each = [s(t, old) for s, old in zip(steps, state or [None] * len(steps), strict=True)]
        return [a for arrays, _ in each for a in arrays], [new for _, new in each]

    def summary(pieces: list[pa.Array], base: int) -> list[tuple]:
        t = np.concatenate([p.to_numpy() for p in pieces])
        return [windows_left(t, window) for _, window in limits]

    def compose(state: list | None, left: list[tuple]) -> list[tuple]:
        return [entered(old, x) for old, x in zip(state or [None] * len(left), left, strict=True)]

    return scan(requests, key, order, "t", step, summary, compose, ", ".join(outputs))


def smoothed(p: np.ndarray, state: tuple | None, alpha: float = ALPHA, warm: float = WARM, least: int = LEAST) -> tuple[np.ndarray, tuple]:
    """Exponential smoothing of the rows of ``p`` with a warm-up; raw until ``least`` observations, then renormalized."""
    seen, held = state or (0, np.zeros(p.shape[1]))
    out = np.empty_like(p)
    for at in range(0, len(p), BLOCK):
        part = p[at : at + BLOCK]
        k = seen + np.arange(1, len(part) + 1)
        a = np.minimum(k / warm, 1.0) * alpha
        decay = np.cumprod(1 - a)
        weights = np.tril(decay[:, None] / decay[None]) * a
        s = weights @ part + decay[:, None] * held
        total = s.sum(1, keepdims=True)
        out[at : at + BLOCK] = np.where((k >= least)[:, None], s / np.where(total == 0, 1.0, total), part)
        seen, held = int(k[-1]), s[-1]
    return out, (seen, held)


def _smoother(probs: pa.Array, state: tuple | None) -> tuple:
    out, state = smoothed(probs.flatten().to_numpy().reshape(len(probs), -1), state)
    ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
    return [pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], state


def _shifted(pieces: list[pa.Array], base: int) -> tuple[int, float, np.ndarray]:
    """How many rows there are, and what they do to the held values: a scaling and a shift."""
    n, scale, shift = base, 1.0, None
    for piece in pieces:
        p = piece.flatten().to_numpy().reshape(len(piece), -1)
        a = np.minimum((n + np.arange(1, len(p) + 1)) / WARM, 1.0) * ALPHA
        decay = np.cumprod((1 - a)[::-1])[::-1]
        weights = a * np.append(decay[1:], 1.0)
        shift = weights @ p + (decay[0] * shift if shift is not None else 0)
        n, scale = n + len(p), scale * decay[0]
    return n - base, scale, shift


def _moved(state: tuple | None, left: tuple[int, float, np.ndarray]) -> tuple:
    n, scale, shift = left
    seen, held = state or (0, np.zeros_like(shift))
    return seen + n, scale * held + shift


def ema(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Smooths ``probs``, which has as many numbers in every row."""
    return scan(rows, key, order, "probs", _smoother, _shifted, _moved, "smoothed array<double>")


def micro_batches(rows: DataFrame, key: str, order: list[str], size: int = 50) -> DataFrame:
    """Rows of a key in batches of ``size`` in order."""

    def step(x: pa.Array, seen: int | None) -> tuple:
        at = (seen or 0) + np.arange(len(x))
        return [pa.array(at // size)], (seen or 0) + len(x)

    return scan(rows, key, order, key, step, lambda pieces, base: sum(map(len, pieces)), lambda seen, n: (seen or 0) + n, "batch long")


def read_through(lookups: DataFrame, key: str, order: list[str], version: str) -> DataFrame:
    """``lookups`` with hit: whether the artifact ``key`` was last looked up in the same version, and so is held in it."""

    def step(v: pa.Array, held: list | None) -> tuple:
        values = v.to_pylist()
        before = [held[0] if held else _NOTHING, *values[:-1]]
        return [pa.array([a == b for a, b in zip(values, before, strict=True)], pa.bool_())], values[-1:]

    return scan(lookups, key, order, version, step, lambda pieces, base: pieces[-1][-1].as_py(), lambda held, last: [last], "hit boolean")


_NOTHING = object()


def closed(t: np.ndarray, state: tuple[int, int, int] | None, size: int, wait: int) -> tuple[np.ndarray, tuple[int, int, int]]:
    """The batch of each of the rising times ``t``: one closes with ``size`` of them, or ``wait`` after its first one."""
    batch, first, n = state or (-1, 0, size)
    out, i = np.empty(len(t), np.int64), 0
    while i < len(t):
        if n == size or t[i] >= first + wait:
            batch, first, n = batch + 1, int(t[i]), 0
        j = min(int(np.searchsorted(t, first + wait)), i + size - n)
        out[i:j] = batch
        n, i = n + j - i, j
    return out, (batch, first, n)


def timed_batches(rows: DataFrame, key: str, order: list[str], size: int = 50, wait: int = 5_000) -> DataFrame:
    """Rows of a key (``t`` in milliseconds) in batches that close at ``size`` or ``wait`` milliseconds after their first row."""

    def step(t: pa.Array, state: tuple | None) -> tuple:
        batch, state = closed(t.to_numpy(), state, size, wait)
        return [pa.array(batch)], state

    return fold(rows, key, order, "t", step, "batch long")
