"""Scans over keys with rows in many tasks, against plain loops; batches, blocks of samples, eviction."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalith.functions import signals as G
from vocalith.operators import blocks, folds, keyed, segments, sequences
from vocalith.sources import audio


@pytest.fixture
def many_stretches(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def limited(times, limit, window):
    count, end, out = 0, None, []
    for t in times:
        if end is None or t >= end:
            count, end = 0, t + window
        count += 1
        out.append((count <= limit, max(0, limit - count), end))
    return out


@pytest.mark.parametrize("window", [1, 7, 60, 5000])
def test_limiter_of_a_hot_key(many_stretches, window):
    spark, rng = many_stretches, random.Random(window)
    rows = [(k, t, i) for i, (k, t) in enumerate([("hot", rng.randrange(2000)) for _ in range(900)] + [(None, rng.randrange(50)) for _ in range(80)] + [(f"k{i % 9}", rng.randrange(300)) for i in range(90)])]
    df = spark.createDataFrame(rows, "k string, t long, i long")
    assert folds.stretches(df, "k", ["t", "i"]).where("k = 'hot'").select("_stretch").distinct().count() > 3
    got = {r.i: (r.ok, r.remaining, r.reset_at) for r in folds.rate_limit(df, "k", ["t", "i"], 3, window).collect()}
    for key in {k for k, _, _ in rows}:
        mine = sorted((t, i) for k, t, i in rows if k == key)
        assert [got[i] for _, i in mine] == limited([t for t, _ in mine], 3, window)
    assert len(got) == len(rows)


def test_smoothing_of_a_hot_key(many_stretches):
    spark, rng = many_stretches, np.random.default_rng(4)
    rows = [(k, i, rng.random(2).tolist()) for i, k in enumerate([1.0] * 700 + [float("nan")] * 60 + [None] * 5)]
    got = {r.i: r.smoothed for r in folds.ema(spark.createDataFrame(rows, "k double, i long, probs array<double>"), "k", ["i"]).collect()}
    for lo, hi in ((0, 700), (700, 760), (760, 765)):
        held = np.zeros(2)
        for n, (_, i, p) in enumerate(rows[lo:hi], 1):
            a = min(n / 6.25, 1) * 0.3
            held = a * np.array(p) + (1 - a) * held
            assert np.allclose(got[i], held / held.sum() if n >= 7 else p), i


def test_scans_of_nothing_and_one_row(spark):
    empty = spark.createDataFrame([], "k string, t long")
    assert folds.rate_limit(empty, "k", ["t"], 1, 1).collect() == []
    one = spark.createDataFrame([("a", 5)], "k string, t long")
    assert [tuple(r) for r in folds.rate_limit(one, "k", ["t"], 1, 10).collect()] == [("a", 5, True, 0, 15)]


def batches_of(times, size, wait):
    out, first, n, batch = [], None, 0, -1
    for t in times:
        if first is None or n == size or t >= first + wait:
            first, n, batch = t, 0, batch + 1
        n += 1
        out.append(batch)
    return out


def test_batches(many_stretches):
    spark, rng = many_stretches, random.Random(5)
    rows = [("a", rng.randrange(60_000), i) for i in range(600)] + [("b", t, 1000 + t) for t in (0, 4999, 5000, 9999, 10_001)]
    df = spark.createDataFrame(rows, "k string, t long, i long")
    timed = {r.i: r.batch for r in folds.timed_batches(df, "k", ["t", "i"], 20).collect()}
    by_count = {r.i: r.batch for r in folds.micro_batches(df, "k", ["t", "i"]).collect()}
    for key in "ab":
        mine = sorted((t, i) for k, t, i in rows if k == key)
        assert [timed[i] for _, i in mine] == batches_of([t for t, _ in mine], 20, 5_000)
        assert [by_count[i] for _, i in mine] == [n // 50 for n in range(len(mine))]


@pytest.mark.parametrize("length", [100, 256, 300, 5000, 40_000])
def test_blocks_of_any_length_give_the_same_segments(spark, length):
    rng = np.random.default_rng(6)
    x = rng.standard_normal(60_000) * 0.001
    for s, e in ((9000, 15_000), (30_000, 36_000), (50_500, 60_000)):
        x[s:e] += 0.4 * np.sin(2 * np.pi * 500 * np.arange(e - s) / 16_000)
    rows = [("a", i, x[i : i + length].tolist()) for i in range(0, len(x), length)] + [("b", 0, [0.0] * 600), ("b", 1, None), ("b", 2, []), ("c", 0, [0.5] * 10)]
    df = spark.createDataFrame(rows, "clip string, at long, samples array<double>").repartition(5)
    frames, clips = blocks.levels(blocks.cells(blocks.placed(df, "clip", ["at"], "samples")))
    got = sorted((r.start, r.end) for r in segments.segments(frames, clips).where("clip = 'a'").collect())
    assert got == audio.found(x * (G.PEAK / np.abs(x).max())) and len(got) == 3
    assert {r.clip: r.n for r in clips.collect()} == {"a": 60_000, "b": 600, "c": 10}
    assert frames.where("clip = 'c'").count() == 0


def test_eviction_keeps_nulls_and_any_spread_of_ids(many_stretches):
    spark, rng = many_stretches, random.Random(7)
    for ids in ([None, None, 3, 4, 10**15, None], [5] * 6, list(range(6)), [-(10**12), 0, 1, 2, 3, 4]):
        rows = [(i, n, rng.choice([None, 10, 20])) for n, i in enumerate(ids)]
        df = spark.createDataFrame(rows, "id long, n long, size long")
        total = sum(s or 0 for _, _, s in rows)
        got = {r.n: r.evict for r in keyed.evicted(df, "size", ["id", "n"], 50.0).collect()}
        held, want = total, {}
        for _, n, s in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
            want[n] = total >= 50 and held > 35
            held -= s or 0
        assert got == want


def test_sequences(many_stretches):
    spark = many_stretches
    a = spark.createDataFrame([(i, i * 7 % 50) for i in range(50)], "k long, v long")
    x, y = sequences.numbered(a, ["k"]), sequences.numbered(a, ["v"])
    assert sorted(r.place for r in x.collect()) == list(range(50)) and all(r.place == r.k for r in x.collect())
    assert tuple(sequences.same_sequence(x, x, "k").first()) == (True, None)
    assert tuple(sequences.same_sequence(x, y, "k").first()) == (False, 1)
    assert tuple(sequences.same_sequence(x, x.where("place < 49"), "k").first()) == (False, 49)
    twice = a.union(a.limit(1)).union(spark.createDataFrame([(None, 1), (None, 1)], "k long, v long"))
    assert tuple(sequences.duplicates(twice, F.col("k")).first()) == (53, 51, False)
    assert tuple(sequences.duplicates(a, F.col("k")).first()) == (50, 50, True) and tuple(sequences.duplicates(a.limit(0), F.col("k")).first()) == (0, 0, True)
