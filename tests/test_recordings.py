"""Generators, lookups, quantized models and shown values."""

import math

import numpy as np
import pyarrow.fs as fs
import pytest
from pyspark.sql import functions as F

from vocalith.functions import calls, engines, quantized
from vocalith.functions import generators as N
from vocalith.functions import scoring as S
from vocalith.functions import signals as G
from vocalith.functions import text as T
from vocalith.operators import blocks, layout, priors, shared
from vocalith.plans import analysis, signal
from vocalith.sources import audio


def plain_draws(seed, n):
    state, out = seed % 2**32, []
    for _ in range(n):
        state = (state + 0x6D2B79F5) % 2**32
        t = (state ^ state >> 15) * (state | 1) % 2**32
        t ^= (t + (t ^ t >> 7) * (t | 61)) % 2**32
        out.append((t ^ t >> 14) / 2**32)
    return out


def test_draws_with_skips(spark):
    for seed in (0, 1, 7, 2**31, 2**32 - 1, 2**40 + 5, -3):
        got = [r.u for r in spark.range(50).orderBy("id").select(N.draw(F.lit(seed), F.col("id")).alias("u")).collect()]
        assert got == plain_draws(seed, 50)
    far = spark.range(1).select(N.draw(F.lit(9), F.lit(99_999)).alias("u")).first().u
    assert far == plain_draws(9, 100_000)[-1]


def test_signals(spark):
    n = 300
    rows = spark.range(n).crossJoin(spark.createDataFrame([(k,) for k in N.KINDS], "kind string"))
    got = {(r.kind, r.id): r.x for r in rows.select("kind", "id", N.sample(F.col("kind"), F.col("id"), F.lit(n), F.lit(7)).alias("x")).collect()}
    phase, noise = 0.0, plain_draws(7, n)
    for i in range(n):
        phase += 300 + 900 * i / (n - 1)
        want = {"tone_440": 0.8 * math.sin(2 * math.pi * 440 * i / 16_000), "tone_900": 0.6 * math.sin(2 * math.pi * 900 * i / 16_000), "chirp": 0.7 * math.sin(2 * math.pi * phase / 16_000), "noise": (noise[i] * 2 - 1) * 0.5}
        for kind, x in want.items():
            assert got[kind, i] == pytest.approx(np.float32(x), abs=1e-6)


def test_lookups_read_few_rows(spark, tmp_path):
    folder, n = str(tmp_path / "store"), 80_000
    rows = spark.range(n).select(F.col("id").alias("k"), (F.xxhash64("id") % 5000).alias("c"), F.sha2(F.col("id").cast("string"), 512).alias("v"))
    layout.cluster(rows, folder, "k", "c", files=4, group_bytes=200_000, distinct=4000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    one = layout.lookup(spark, folder, "k", 41_234)
    assert [r.k for r in one.collect()] == [41_234] and layout.rows_read(one) < n / 10
    c = rows.where("k = 77").first().c
    some = layout.lookup(spark, folder, "c", c)
    assert sorted(r.k for r in some.collect()) == sorted(r.k for r in rows.where(F.col("c") == c).collect())
    assert layout.rows_read(some) < n
    none = layout.lookup(spark, folder, "c", 4_999_999)
    assert none.collect() == [] and layout.rows_read(none) < n / 5
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,41234)]" in one._jdf.queryExecution().toString()
    assert layout.lookup(spark, folder, "k", None).collect() == []


def test_quantized_models(spark, tmp_path):
    rng = np.random.default_rng(9)
    weights = [(rng.standard_normal((16, 8)), rng.standard_normal(8)), (rng.standard_normal((8, 6)), rng.standard_normal(6)), (rng.standard_normal((12, 5)), rng.standard_normal(5))]
    layers = [quantized.quantized(w, b) for w, b in weights]
    quantized.save(spark, layers, str(tmp_path / "m"))
    loaded = quantized.load(spark, str(tmp_path / "m"))
    x = rng.standard_normal((9, 40))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [1.0] * 3)]
    got = {r.k: r.p for r in quantized.score(spark.createDataFrame(rows, "k long, x array<double>"), "k", "x", loaded, 8, chunk=4).collect()}
    assert got[100] is None and got[101] is None
    for i, v in enumerate(x):
        pooled = []
        for s in range(0, 40 - 15, 8):
            h = v[s : s + 16]
            for w, scale, b in layers[:-1]:
                h = np.array([max(0.0, sum(h[a] * int(w[a, c]) * scale[c] for a in range(len(h))) + b[c]) for c in range(w.shape[1])])
            pooled.append(h)
        h = np.array(pooled)
        w, scale, b = layers[-1]
        z = np.concatenate([h.mean(0), np.sqrt(h.var(0) + 1e-8)]) @ (w * scale) + b
        e = np.exp(z - z.max())
        assert np.allclose(got[i], e / e.sum())
    assert all(np.abs(w - q * s).max() <= s.max() / 2 + 1e-12 for (w, _), (q, s, _) in zip(weights, layers, strict=True))
    quantized.save(spark, layers[:1] + layers[2:], str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        quantized.load(spark, str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        quantized.save(spark, [], str(tmp_path / "none")) or quantized.load(spark, str(tmp_path / "none"))


def test_two_decimals_are_those_of_the_exact_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    values = [0.0, 0.005, 0.015, 1.005, 2.675, 0.125, 0.375, 8.345, 1.255, 0.63, 20.0, 1e-9, 123456.785, -1.005, -0.125, 10.235, 1.45, 0.285] + [k / 16_000 for k in range(0, 320_000, 997)]
    got = [r.s for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(T.fixed2(F.col("v")).alias("s")).collect()]
    assert got == [str(Decimal(v).quantize(Decimal("0.01"), ROUND_HALF_UP)) for v in values]


def test_disallowed_paths(spark):
    paths = {"/api/x": True, "/api": False, "/es/cats": True, "/cats": False, "/es/catsitter": True, "/a/b/admin": True, "/es/sounds": False, "//history": True, "": False}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", T.disallowed(F.col("p")).alias("d")).collect()
    assert {r.p: r.d for r in rows} == paths


def test_folders_are_given_in_full(spark):
    assert shared.job_dir(spark, "x").startswith("file:/") and shared.qualified(spark, "/a/b").startswith("file:/")


def plain_call(seed):
    """A call for attention, draw by draw and sample by sample."""
    draws = iter(plain_draws(seed, 60_000))
    uni = lambda lo, hi: lo + (hi - lo) * next(draws)

    def normal():
        u, v = max(next(draws), 1e-12), next(draws)
        return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)

    n, f0, rise = int(uni(0.3, 1.2) * 16_000), uni(350, 700), uni(0.05, 0.25)
    phases, turn, x = [uni(0, 2 * math.pi) for _ in range(3)], 0.0, []
    for i in range(n):
        turn += 2 * math.pi * f0 * (1 + rise * i / (n - 1)) / 16_000
        x.append(sum(a * math.sin((k + 1) * turn + p) for k, (a, p) in enumerate(zip((1.0, 0.5, 0.25), phases, strict=True))))
    attack, decay = int(n * uni(0.05, 0.15)), int(n * uni(0.1, 0.3))
    for i in range(attack):
        x[i] *= i / attack
    for i in range(decay):
        x[n - 1 - i] *= i / decay
    room = calls.WINDOW - n
    start = int(uni(0.2, 0.8) * room)
    whole = [0.0] * start + x + [0.0] * (room - start)
    top = max(map(abs, whole))
    return [v * 0.7 / top + 0.005 * normal() for v in whole]


def test_calls_are_those_of_single_draws():
    for seed in (5, 2**32 - 3):
        assert np.allclose(calls.call("atencion", seed), plain_call(seed), atol=1e-5)
    draws = calls.Draws(11)
    assert np.concatenate([draws.take(3), draws.take(0), draws.take(40)]).tolist() == plain_draws(11, 43)


def test_rules_do_better_than_chance_on_calls(spark):
    """Calls of all classes through segments, features and rules; by chance the mean F1 would be 0.1."""
    rows = []
    for cls, seed, x in calls.evaluation(range(4)):
        x = x.astype(float) * (G.PEAK / np.abs(x).max())
        s, e = max(audio.found(x), key=lambda p: float(x[p[0] : p[1]] @ x[p[0] : p[1]]))
        f = G.record(x[s:e])
        rows.append((cls, *[None if f[name] is None else float(f[name]) for name in engines.SHORT.values()]))
    table = spark.createDataFrame(rows, "truth string, " + ", ".join(f"{k} double" for k in engines.SHORT))
    best = table.select("truth", S.ranked(F.slice(S.distribution(S.rule_scores()), 1, len(S.CLASSES)))[0]["cls"].alias("predicted"))
    macro = priors.f1_by_class(best).first().macro_f1
    assert macro >= 0.2, macro


def test_clips_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    """A file of few bytes is read by one task, but its clips are made by many, few at a time."""
    spark.range(40).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(signal, "TASK_CLIPS", 4)
    rows = signal.labels(spark, str(tmp_path)).select("label", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.label for r in rows) == list(range(40))
    per = [sum(r.task == t for r in rows) for t in {r.task for r in rows}]
    assert len(per) >= 10 and max(per) <= 8


def test_blocks_are_held_a_few_at_a_time(spark, monkeypatch):
    """Partitions of placed blocks, which Python may get at once, are as many as their samples need."""
    rows = spark.range(300).select(F.lit("a").alias("clip"), F.col("id").alias("at"), F.array_repeat(F.col("id").cast("double"), 100).alias("samples"))
    monkeypatch.setattr(blocks, "PART_SAMPLES", 1000)
    got = blocks.placed(rows, "clip", ["at"], "samples").select("start", "samples", F.spark_partition_id().alias("part")).collect()
    assert sorted((r.start, r.samples[0]) for r in got) == [(100 * i, float(i)) for i in range(300)]
    per = [sum(r.part == p for r in got) for p in {r.part for r in got}]
    assert len(per) >= 20 and max(per) <= 40


def test_one_clip_in_ten_is_too_large(spark, tmp_path):
    """However many clips there are; a file has all the bytes that were made for it."""
    spark.range(40).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    errors = {r.path: r.error for r in analysis.analyze_audio(spark, str(tmp_path)).select("path", "error").collect()}
    assert len(errors) == 40
    assert {p for p, e in errors.items() if e == "audio/too-large"} == {f"clip-{i}.flac" for i in (9, 19, 29, 39)}
    made = [analysis.odd_clip(i) for i in (1, 5, 7, 19)] + [("silent.wav", bytes(2000))]
    assert audio.save(spark.range(5).withColumnRenamed("id", "label"), made.__getitem__, f"file://{tmp_path}/clips") == 5
    assert all((tmp_path / "clips" / path).read_bytes() == content for path, content in made)
    other = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())  # not taken to be local
    audio._write(other, "other.flac", made[3][1])
    assert (tmp_path / "other.flac").read_bytes() == made[3][1]
