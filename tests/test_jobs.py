"""Streams over files in any order, the delta store, observed metrics."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vocalith.streaming import deltas, jobs, metrics, ordered
from tests.test_scans import batches_of

START = 1_704_067_200_000


def written(spark, rows, folder, files, seed):
    """The rows (event_id, user_id, milliseconds) in ``files`` files of ranges of time, their names in a shuffled order."""
    names = list(range(files))
    random.Random(seed).shuffle(names)
    step = -(-len(rows) // files)
    for i, name in enumerate(names):
        df = spark.createDataFrame(rows[i * step : (i + 1) * step], "event_id long, user_id long, ms long").select("event_id", "user_id", F.timestamp_millis("ms").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/{name:03d}")
    import shutil
    from pathlib import Path

    out = Path(folder) / "events.parquet"
    out.mkdir()
    for name in sorted(names):
        for part in (Path(folder) / f"{name:03d}").glob("part-*.parquet"):
            shutil.move(part, out / f"{name:03d}-{part.name}")
    for n, part in enumerate(sorted(out.glob("*.parquet"))):  # files are read by their time
        import os

        os.utime(part, (1_700_000_000 + n, 1_700_000_000 + n))
    return folder


@pytest.mark.parametrize("files,minutes", [(1, 10), (6, 10), (20, 10), (8, 3)])
def test_limiter_on_files_in_any_order(spark, tmp_path, files, minutes):
    rows = [(i, i % 3, START + i * minutes * 60_000 + (i % 2) * 17) for i in range(120)]
    folder = written(spark, rows, str(tmp_path / "in"), files, files)
    got = {r.event_id: (r.ok, r.remaining, r.reset_at) for r in jobs.rate_limits(spark, folder, 2, 7_200_000).collect()}
    want = {}
    for user in range(3):
        count, end = 0, None
        for i, _, t in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0])):
            if end is None or t >= end:
                count, end = 0, t + 7_200_000
            count += 1
            want[i] = (count <= 2, max(0, 2 - count), end)
    assert got == want


def test_batches_close_by_count_and_by_timer(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice([1, 1, 2]), START + t) for i, t in enumerate(sorted(rng.randrange(200_000) for _ in range(300)))]
    folder = written(spark, rows, str(tmp_path / "in"), 5, 2)
    events = jobs.source(spark, folder).select("user_id", "event_id", F.unix_millis("ts").alias("t"), "ts")
    made = jobs.to_the_end(spark, events, lambda e: jobs.batched(e, size=7, wait=5_000, latest="10 minutes"), str(tmp_path / "job"))
    got = sorted((r.first_t, r.first_id, r.n, r.ids, r.full) for r in made.collect())
    want = []
    for user in (1, 2):
        mine = sorted((t, i) for i, u, t in rows if u == user)
        parts = {}
        for (t, i), b in zip(mine, batches_of([t for t, _ in mine], 7, 5_000), strict=True):
            parts.setdefault(b, []).append((t, i))
        want += [(p[0][0], p[0][1], len(p), sum(i for _, i in p), int(len(p) == 7)) for p in parts.values()]
    assert got == sorted(want) and {w[4] for w in want} == {0, 1}


@pytest.mark.parametrize("few", [1, 40, 1 << 14])
def test_ordered_state_costs_few_accesses(few):
    """Rows of many keys over many buckets, within one value of a group or in slabs: a plain fold's outcome with few accesses to state."""
    rng = random.Random(few)
    rows = sorted({(START + rng.randrange(4_000_000), i) for i in range(400)})
    keys = {i: rng.randrange(20) - 5 for _, i in rows}
    step, wake = jobs._batch_steps(3, 20_000)
    fold = ordered.InOrder(step, wake, "batch long, first_t long, first_id long, n long, ids long", 1_000, ["first_t", "first_id", "n", "ids"], few)
    handle = Handle()
    fold.init(handle)
    got = []
    for a in range(0, 400, 100):
        part = rows[a : a + 100]
        rng.shuffle(part)
        frame = pd.DataFrame([(keys[i], t, i) for t, i in part], columns=["of", "t", "event_id"])
        list(fold.handleInputRows((7,), iter([frame[:60], frame[60:]]), None))
        got += handle.fire(fold, max(t for t, _ in part) - 30_000)
    got += handle.fire(fold, START + 10_000_000)
    want = []
    for key in set(keys.values()):
        mine = [(t, i) for t, i in rows if keys[i] == key]
        parts = {}
        for (t, i), b in zip(mine, batches_of([t for t, _ in mine], 3, 20_000), strict=True):
            parts.setdefault(b, []).append((t, i))
        want += [(*p[0], len(p), sum(i for _, i in p)) for p in parts.values()]
    assert sorted(got) == sorted(want) and not handle.timers and not handle.slabs
    if few > 400:
        assert handle.accesses <= 4 * 10


class Handle:
    """A group's state, which counts how often it is accessed."""

    def __init__(self):
        self.slabs, self.held, self.timers, self.accesses = {}, None, set(), 0

    def _count(self, f):
        def run(*args):
            self.accesses += 1
            return f(*args)

        return run

    def getMapState(self, *_):
        of = {"getValue": lambda k: (self.slabs[k],), "containsKey": lambda k: k in self.slabs, "updateValue": lambda k, v: self.slabs.__setitem__(k, v[0]), "removeKey": lambda k: self.slabs.pop(k), "keys": lambda: iter(list(self.slabs))}
        return SimpleNamespace(**{n: self._count(f) for n, f in of.items()})

    def getValueState(self, *_):
        of = {"get": lambda: self.held, "update": lambda v: setattr(self, "held", v), "clear": lambda: setattr(self, "held", None)}
        return SimpleNamespace(**{n: self._count(f) for n, f in of.items()})

    def registerTimer(self, at):
        self.accesses += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.accesses += 1
        self.timers.remove(at)

    def fire(self, fold, watermark):
        due = sorted(t for t in self.timers if t <= watermark)
        made = []
        for at in due:
            self.timers.discard(at)
            for df in fold.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), None):
                made += list(df.itertuples(index=False, name=None))
        return made


def test_delta_store(spark, tmp_path):
    folder = str(tmp_path / "store")
    store = deltas.DeltaStore(spark, folder, "k long, v string", ["k"], every=3)
    assert store.read().collect() == []
    want = {}
    for n in range(8):
        rows = [(k, f"{n}") for k in range(n, n + 3)]
        want |= dict(rows)
        for _ in range(2 if n in (1, 4, 5) else 1):  # a batch that runs again changes nothing
            store.write(spark.createDataFrame(rows, "k long, v string"), n)
        assert dict(map(tuple, store.read().collect())) == want
        assert store._numbers("base") == ([] if n < 2 else [n - (n + 1) % 3])
        assert all(d > max(store._numbers("base"), default=-1) for d in store._numbers("delta"))
    # A writer lost while it compacts leaves a base that is not whole, or old parts beside a whole one.
    (tmp_path / "store/base-7").mkdir()
    assert dict(map(tuple, store.read().collect())) == want
    store._merged(6).write.mode("overwrite").parquet(f"{folder}/base-6")
    assert dict(map(tuple, store.read().collect())) == want


def test_what_is_written_grows_with_the_updates(spark, tmp_path):
    store = deltas.DeltaStore(spark, str(tmp_path / "store"), "k long, v string", ["k"], every=100)
    store.write(spark.range(20_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")), 0)
    store.write(spark.createDataFrame([(5, "x")], "k long, v string"), 1)
    size = lambda n: sum(p.stat().st_size for p in (tmp_path / f"store/delta-{n}").glob("*.parquet"))
    assert size(1) * 100 < size(0) and store.read().where("k = 5").first().v == "x"


def test_metrics_equal_the_query(spark, tmp_path):
    rows = [(i, i % 3, START + i) for i in range(100)]
    folder = written(spark, rows, str(tmp_path / "in"), 9, 1)
    seen = []
    got = metrics.observed(jobs.source(spark, folder), "watched", [F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")], str(tmp_path / "job"), lambda df, n: seen.append(df.count()))
    assert sum(v for *_, m, v in got if m == "n") == sum(seen) == 100 and sum(v for *_, m, v in got if m == "ids") == sum(range(100))
    assert len({b for _, b, *_ in got}) == len(seen) == 3 and '"metric": "n"' in "".join(metrics.as_lines(got))
