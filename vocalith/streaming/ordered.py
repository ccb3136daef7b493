"""Event-time order inside keyed state: rows wait until the watermark has passed them, then they are folded in order.

Keys are dealt by hash to ``GROUPS`` groups, since each call of a processor and each access to its state costs far more than
the rows of a key.  A group's rows wait packed, beside the states of its keys, in one value that a micro-batch reads and writes
once.  Beyond ``FEW`` rows they move to slabs of ``SLAB`` buckets of event time, of which a micro-batch reads and writes only
those it has rows for, so that no more than ``FEW`` rows, a batch and a slab are held at once, however many rows a key has.  A
timer wakes the group when the watermark reaches the end of its first bucket, or the time at which one of its states has
something to do or ends.  Files may so come in any order and in any number within the delay: the outcome is
that of a fold over the rows in order.  A group's states are read and written whole, so many millions of keys want more groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Numbers that a step gives out, by column, the state it leaves (None: none), and when that has to be woken.
Outcome = tuple[dict[str, np.ndarray], tuple[int, ...] | None, int | None]
GROUPS = 1024
#: Waiting rows of a group, 24 bytes each, that stay in its value; and how many buckets are kept as one beyond them.
FEW = 1 << 14
SLAB = 16
#: The groups of rows that only move the watermark, and of those whose key is null.
NO_ROWS, NULL_KEY = -1, -2
NEVER = -(1 << 63)


class InOrder(StatefulProcessor):
    """Folds the rows (t in milliseconds, event_id) of each key in order of both.

    ``step(t, ids, state)`` gets the next rows of a key, and sees to what falls due between them; ``wake(state)`` is asked once
    the time that the last step named has passed, with all rows before it folded.
    """

    def __init__(self, step: Callable[..., Outcome], wake: Callable[[tuple[int, ...]], Outcome], held: str, bucket: int, columns: list[str], few: int = FEW):
        self.step, self.wake, self.fields, self.bucket, self.columns, self.few = step, wake, len(held.split(", ")), bucket, columns, few

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slabs = handle.getMapState("slabs", "slab long", "rows binary")
        # ``at``: the timer; ``spilled``: whether there are slabs; ``rows``: those that wait outside of them; ``states``: key, wake and state of each key that has one.
        self.value = handle.getValueState("value", "at long, spilled boolean, rows binary, states binary")

    def _save(self, before: int | None, at: int | None, spilled: bool, rows: np.ndarray, states: bytes) -> None:
        """Keep all, with the timer moved from ``before`` to ``at``."""
        if at != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if at is not None:
                self.handle.registerTimer(at)
        if at is None and not states:  # then no rows wait
            self.value.clear()
        else:
            self.value.update((at, spilled, rows.astype("<i8").tobytes(), states))

    def _by_slab(self, rows: np.ndarray) -> dict[int, np.ndarray]:
        of = rows[:, 1] // (self.bucket * SLAB)
        return {s: rows[of == s] for s in np.unique(of).tolist()}

    def _slab(self, s: int) -> np.ndarray:
        return _rows(self.slabs.getValue((s,))[0] if self.slabs.containsKey((s,)) else b"")

    def _after(self, t: int) -> int:
        """The end of the bucket of ``t``."""
        return (int(t) // self.bucket + 1) * self.bucket

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if key[0] == NO_ROWS:
            return iter(())
        before, spilled, waiting, states = self.value.get() or (None, False, b"", b"")
        waiting, at = _rows(waiting), before
        for part in rows:
            waiting = np.concatenate([waiting, part[["of", "t", "event_id"]].to_numpy(np.int64)])
            end = self._after(part.t.min())
            at = end if at is None else min(at, end)
            if len(waiting) > self.few:
                for s, more in self._by_slab(waiting).items():
                    self.slabs.updateValue((s,), (np.concatenate([self._slab(s), more]).astype("<i8").tobytes(),))
                waiting, spilled = waiting[:0], True
        self._save(before, at, spilled, waiting, bytes(states))
        return iter(())

    def _fold(self, rows: np.ndarray, states: dict[int, tuple], made: list[dict[str, np.ndarray]]) -> None:
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        cuts = [0, *(np.flatnonzero(np.diff(rows[:, 0])) + 1).tolist(), len(rows)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = int(rows[a, 0])
            out, state, wake = self.step(rows[a:b, 1], rows[a:b, 2], states.pop(key, (None, None))[0])
            made.append(out)
            if state is not None:
                states[key] = state, wake

    def _table(self, made: list[dict[str, np.ndarray]]) -> Iterator[pd.DataFrame]:
        made = [out for out in made if out and len(out[self.columns[0]])]
        if made:
            yield pd.DataFrame({c: np.concatenate([out[c] for out in made]) for c in self.columns})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // self.bucket * self.bucket
        _, spilled, waiting, packed = self.value.get()
        waiting = _rows(waiting)
        states = {k: (tuple(state), None if wake == NEVER else wake) for k, wake, *state in np.frombuffer(bytes(packed), "<i8").reshape(-1, 2 + self.fields).tolist()}
        ready, waiting = waiting[waiting[:, 1] < now], waiting[waiting[:, 1] >= now]
        ends = [self._after(waiting[:, 1].min())] if len(waiting) else []
        slabs, left = sorted(k[0] for k in self.slabs.keys()) if spilled else [], 0
        own = self._by_slab(ready) if slabs else {None: ready} if len(ready) else {}
        begun = [s for s in slabs if s * self.bucket * SLAB < now]
        for s in sorted({*begun, *own}) if slabs else own:
            rows, made = own.get(s, ready[:0]), []
            if s in begun:
                old = self._slab(s)
                rows, rest = np.concatenate([rows, old[old[:, 1] < now]]), old[old[:, 1] >= now]
                if len(rest):
                    left += 1
                    ends.append(self._after(rest[:, 1].min()))
                    if len(rest) < len(old):
                        self.slabs.updateValue((s,), (rest.tobytes(),))
                else:
                    self.slabs.removeKey((s,))
            if len(rows):
                self._fold(rows, states, made)
            yield from self._table(made)
        later = slabs[len(begun) :]
        if later:  # its first bucket, or one before it
            ends.append(later[0] * self.bucket * SLAB + self.bucket)
        made = []
        for k, (state, wake) in list(states.items()):
            while state is not None and wake is not None and wake <= now:
                out, state, wake = self.wake(state)
                made.append(out)
                states[k] = state, wake
            if state is None:
                del states[k]
            elif wake is not None:
                ends.append(-(-wake // self.bucket) * self.bucket)
        packed = np.array([(k, NEVER if wake is None else wake, *state) for k, (state, wake) in states.items()], "<i8").tobytes()
        # The timer that woke the group is gone.
        self._save(None, min(ends, default=None), bool(left or later), waiting, packed)
        yield from self._table(made)

    def close(self) -> None:
        pass


def _rows(packed: bytes) -> np.ndarray:
    return np.frombuffer(bytes(packed), "<i8").reshape(-1, 3)


def in_order(rows: DataFrame, key: str, latest: str, fold: InOrder, outputs: str, groups: int = GROUPS) -> DataFrame:
    """``outputs`` of the stream ``rows`` (``key``, event_id, t in milliseconds, ts), folded in order; rows later than ``latest`` are let go.

    The key is a long; null is a key like any other.  Rows without an id only move the watermark.
    """
    group = F.when(F.col("event_id").isNull(), NO_ROWS).when(F.col(key).isNull(), NULL_KEY).otherwise(F.pmod(F.xxhash64(key), F.lit(groups)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    dealt = rows.withWatermark("ts", latest).select(group.cast("int").alias("dealt"), zero(key).alias("of"), zero("event_id").alias("event_id"), "t", "ts")
    return dealt.groupBy("dealt").transformWithStateInPandas(fold, outputs, "append", "eventTime")
