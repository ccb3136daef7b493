"""Golden values and what SQL cannot show."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalith.functions import scoring as S
from vocalith.functions import signals as G
from vocalith.functions import text as T
from vocalith.operators import folds, keyed, priors, segments
from vocalith.plans import signal
from vocalith.plans.catalogue import ORACLE_SQL, QUERIES
from vocalith.sources import audio
from vocalith.streaming import jobs


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def dist(*pairs):
    return F.array(*[S.score(c, F.lit(p)) for c, p in pairs])


def test_classification_rules(spark):
    def run(*pairs):
        return one(spark, S.unknown_policy(S.classification(S.ranked(dist(*pairs)))).alias("c")).c

    a = run(("dolor", 0.7), ("trinos", 0.2), ("pelea", 0.1))
    assert (a.primary.cls, a.certainty, a.ambiguous) == ("dolor", "high", False)
    assert run(("dolor", 0.42), ("trinos", 0.40)).ambiguous
    b = run(("atencion", 0.30), ("trinos", 0.28))
    assert (b.primary.cls, b.primary.probability, b.alternatives[0].cls) == ("unknown", 0.30, "atencion")
    c = run(("dolor", 0.6), ("trinos", 0.25), ("pelea", 0.13), ("atencion", 0.02))
    assert [x.cls for x in c.alternatives] == ["trinos", "pelea"]
    empty = F.array().cast("array<struct<cls:string,probability:double>>")
    d = one(spark, S.classification(empty).alias("c")).c
    assert (d.primary.cls, d.primary.probability) == ("unknown", 1.0)


def test_ranks_as_sql_has_them(spark):
    """A score that overflows gives NaN, which is greatest, as in SQL; what differs in the last digits only is a tie."""
    high = F.array(F.lit(0.1), F.lit(500.0), *[F.lit(0.2)] * 8)
    c = one(spark, S.unknown_policy(S.classification(S.ranked(S.distribution(high)))).alias("c")).c
    assert (c.primary.cls, c.certainty, c.ambiguous, c.alternatives) == ("trinos", "high", False, []) and c.primary.probability != c.primary.probability
    near = one(spark, S.ranked(dist(("trinos", 0.3), ("dolor", 0.1 + 0.2), ("pelea", 0.4), ("atencion", None))).alias("r")).r
    assert [x.cls for x in near] == ["pelea", "trinos", "dolor", "atencion"]
    # The first is half of a last digit, to the last bit; SQL rounds it away from zero.
    half = one(spark, S.ranked(dist(("feliz_contento", 0.249018922692805), ("pelea", 0.24901892269280523))).alias("r")).r
    assert [x.cls for x in half] == ["feliz_contento", "pelea"]


@pytest.mark.parametrize("n,mine,others", [(0, 1, 1), (1, 1 + 0.5 * (20 / 11 - 1), 1 + 0.5 * (10 / 11 - 1)), (8, 2, 1 + 0.5 * (10 / 18 - 1)), (200, 2, 1 + 0.5 * (10 / 210 - 1))])
def test_prior_factors(spark, n, mine, others):
    even = F.array(*[S.score(c, F.lit(1 / 11)) for c in (*S.CLASSES, S.UNKNOWN)])
    alphas = F.array(F.lit(1.0 + n), *[F.lit(1.0)] * 9)
    p = [x.probability for x in one(spark, S.blend(even, alphas).alias("b")).b]
    assert p[0] / p[10] == pytest.approx(mine) and p[1] / p[10] == pytest.approx(others) and sum(p) == pytest.approx(1)


def test_segments_golden(spark):
    levels = [1.0 if 5 <= i <= 10 or i == 30 else 0.0 for i in range(45)]
    frames = spark.createDataFrame([(1, i, v) for i, v in enumerate(levels)], "clip int, frame long, rms double")
    samples = spark.createDataFrame([(1, 12_000)], "clip int, n long")
    assert [tuple(r) for r in segments.segments(frames, samples).collect()] == [(1, 0, 12_000)]
    assert one(spark, segments.quantile(F.array(*[F.lit(i) for i in range(1, 11)]), 0.1).alias("q")).q == 2


def test_limiter_and_smoothing(spark):
    rows = spark.createDataFrame([("k", t) for t in (0, 1, 2, 9, 10, 11)] + [("j", 3), ("j", 12), ("j", 13)], "key string, t long")
    got = {(r.key, r.t): (r.ok, r.remaining, r.reset_at) for r in folds.rate_limit(rows, "key", ["t"], 2, 10).collect()}
    want = [(True, 1, 10), (True, 0, 10), (False, 0, 10), (False, 0, 10), (True, 1, 20), (True, 0, 20)]
    assert [got["k", t] for t in (0, 1, 2, 9, 10, 11)] == want
    assert [got["j", t][2] for t in (3, 12, 13)] == [13, 13, 23]
    _, state = folds.smoothed(np.array([[1.0], [2.0], [3.0]]), None)
    assert state[1][0] == pytest.approx(0.633495552)


def test_folds_against_plain_loops(spark):
    """Null and NaN keys, keys over many batches, and long stretches."""
    rng = np.random.default_rng(2)
    p = rng.random((500, 3))
    seen, held, want = 0, np.zeros(3), []
    for row in p:
        seen += 1
        a = min(seen / 6.25, 1) * 0.3
        held = a * row + (1 - a) * held
        want.append(held / held.sum() if seen >= 7 else row)
    for cut in (0, 1, 6, 64, 65, 130, 499):
        first, state = folds.smoothed(p[:cut], None) if cut else (p[:0], None)
        assert np.allclose(np.concatenate([first, folds.smoothed(p[cut:], state)[0]]), want)
    rows = [(k, int(t)) for k in (None, 1.0, float("nan"), 2.5) for t in np.sort(rng.integers(0, 900, 300))]
    table = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "key double, t long, i long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r.i: (r.ok, r.remaining, r.reset_at) for r in folds.rate_limit(table, "key", ["t", "i"], 3, 10).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    state = {}
    for i, (k, t) in enumerate(rows):
        n, end = state.get(str(k), (0, -1))
        n, end = (n + 1, end) if t < end else (1, t + 10)
        state[str(k)] = n, end
        assert got[i] == (n <= 3, max(0, 3 - n), end)


def test_eviction_and_partial_update(spark):
    blobs = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "id long, size long")
    got = lambda quota: [r.evict for r in keyed.evicted(blobs, "size", ["id"], quota).orderBy("id").collect()]
    # usage 100 before each row: 100, 90, 70, 40
    assert got(100.0) == [True, True, False, False] and got(101.0) == [False] * 4
    assert keyed.evicted(blobs.limit(0), "size", ["id"], 1.0).collect() == []


def test_scalars(spark):
    day = lambda d: F.to_date(F.lit(d))
    signs = {"2020-03-21": "aries", "2020-04-19": "aries", "2020-04-20": "taurus", "2020-07-23": "leo", "2020-02-19": "pisces", "2020-12-25": "capricorn", "2020-01-10": "capricorn", "2020-01-20": "aquarius"}
    got = one(spark, *[T.zodiac(day(d)).alias(d) for d in signs])
    assert got.asDict() == signs
    r = one(spark, T.percent(F.lit(0.847)).alias("p"), T.hertz(F.lit(500.0)).alias("h"), T.hertz(F.lit(None).cast("double")).alias("n"), T.age_years(day("2021-06-15"), F.lit(None).cast("int"), day("2024-06-15")).alias("a"), T.uri_component(F.lit("a b(c)!")).alias("u"))
    assert tuple(r) == ("85%", "500 Hz", "—", 3, "a%20b(c)!")
    codes = spark.createDataFrame([("!!",), ("bm90IGpzb24",), ("eyJuIjoiICJ9",)], "c string")
    assert [x.b for x in codes.select(T.read_share_code(F.col("c"), ("classic",)).alias("b")).collect()] == [None] * 3
    card = T.read_share_code(T.share_code(F.lit("Ñandú"), F.lit(None).cast("string"), F.repeat(F.lit("x"), F.lit(400)), F.lit("odd"), F.lit(True)), ("classic",))
    b = one(spark, card.alias("b")).b
    assert (b.name, b.birth_date, len(b.bio), b.template, b.horoscope) == ("Ñandú", None, 280, "classic", True)


def test_signal_kernels():
    x = np.array([0.2, -0.5, 0.7, 0.1, -0.3, 0.9, -0.1, 0.4])
    k = np.arange(5)[:, None] * np.arange(8)[None]
    assert np.allclose(G.power(x), np.abs((x * np.hanning(8)) @ np.exp(-2j * np.pi * k / 8).T) ** 2)
    with pytest.raises(ValueError):
        G.power(np.zeros(6))
    t = np.arange(16_000) / 16_000
    r = G.record(0.5 * np.sin(2 * np.pi * 440 * t))
    assert 420 < r["f0Hz"] < 460 and r["voicedRatio"] > 0.9
    noise = G.record(np.random.default_rng(1).standard_normal(16_000) * 0.1)
    assert noise["spectralFlatness"] > 0.2 and noise["voicedRatio"] < 0.5
    am = G.record(np.sin(2 * np.pi * 440 * t) * (0.5 + 0.5 * np.sin(2 * np.pi * 28 * t)))
    assert 20 < am["amRateHz"] < 36
    assert G.record(np.zeros(100))["f0Hz"] is None and G.log_mel(t).shape == (96, 64)


def test_wav_queries(spark, sf):
    rows = QUERIES["wav_segments"](spark, sf).collect()
    by = {}
    for r in rows:
        by.setdefault(int(r.path[5:-4]), []).append(r)
    for i, rs in by.items():
        if i % 3 == 0:
            assert [r.error for r in rs] == ["analysis/no-vocalization"]
        else:
            assert len(rs) == i % 3 and all(r.error is None for r in rs)
            assert all(abs(r.f0hz / (300 + 20 * (i % 20)) - 1) < 0.05 for r in rs)
    assert QUERIES["log_mel"](spark, sf).count() == 64 * len(by)
    assert signal.tone_clip(3) == signal.tone_clip(3)


def test_f1_of_nothing(spark):
    rows = priors.f1_by_class(spark.createDataFrame([("dolor", "dolor"), ("pelea", "dolor")], "truth string, predicted string")).collect()
    assert {r.cls: r.f1 for r in rows}["dolor"] == pytest.approx(2 / 3, abs=1e-6) and rows[0].macro_f1 == pytest.approx(2 / 30, abs=1e-6)


def test_every_query_has_a_twin_or_a_test():
    assert set(QUERIES) - set(ORACLE_SQL) == {"wav_segments", "log_mel", "feature_record", "analyze_audio"}


# Profiles of each class (d, f, f_start, f_end, g, v, c, s, am_rate, am), the class that scores best and its share.
PROFILES = {
    "feliz_contento": ((1.5, 350, 350, 350, 20, 0.85, 1200, 0.04, None, 0.05), "feliz_contento", 0.627649),
    "trinos": ((0.35, 600, 450, 750, 300, 0.8, 2000, 0.04, None, 0), "trinos", 0.353885),
    "enfadado": ((1.5, 150, 140, 160, 40, 0.8, 1100, 0.06, None, 0), "enfadado", 0.513717),
    "pelea": ((0.8, 500, 300, 800, 500, 0.55, 3500, 0.25, None, 0), "pelea", 0.550501),
    "llamada_madre": ((1.0, 500, 650, 400, 250, 0.85, 1800, 0.04, None, 0), None, 0.408437),
    "llamada_apareamiento": ((3.0, 500, 300, 700, 400, 0.75, 2500, 0.1, None, 0), "atencion", 0.471399),
    "dolor": ((0.8, 750, 600, 900, 300, 0.85, 3200, 0.08, None, 0), "dolor", 0.534070),
    "descansando": ((4.0, 80, 78, 82, 10, 0.5, 500, 0.03, 26, 0.8), "descansando", 0.523138),
    "advertencia": ((0.7, None, None, None, 100, 0.08, 5000, 0.75, None, 0), "advertencia", 0.691187),
    "atencion": ((0.8, 500, 420, 580, 160, 0.85, 1800, 0.04, None, 0), "atencion", 0.588213),
}
RAW = {
    "feliz_contento": (1.0000, 0.2067, 0.5017, 0.1308, 0.6000, 0.0900, 0.2900, 0.0735, 0.1225, 0.6000),
    "descansando": (0.1458, 0.1400, 0.5000, 0.1027, 0.1756, 0.0645, 0.3650, 0.7820, 0.0750, 0.2520),
    "advertencia": (0.0720, 0.3600, 0.2000, 0.1900, 0.1000, 0.0400, 0.3500, 0.0600, 0.8800, 0.1000),
    "atencion": (0.3000, 0.5600, 0.3250, 0.1596, 0.2400, 0.2236, 0.4250, 0.0473, 0.1825, 0.9000),
}


def test_rule_scores_golden(spark):
    rows = [(name, *[None if v is None else float(v) for v in profile]) for name, (profile, _, _) in PROFILES.items()]
    df = spark.createDataFrame(rows, "name string, " + ", ".join(f"{x} double" for x in S.FEATURES))
    scored = df.select("name", S.rule_scores().alias("s"))
    for r in scored.select("name", "s", S.ranked(S.distribution(F.col("s"))).alias("r")).collect():
        _, best, share = PROFILES[r.name]
        assert r.r[0].probability == pytest.approx(share, abs=1e-6)
        assert r.r[0].cls == best if best else {r.r[0].cls, r.r[1].cls} == {"llamada_madre", "feliz_contento"}
        if r.name in RAW:
            assert r.s == pytest.approx(RAW[r.name], abs=6e-5)


def plain_features(x):
    """All twelve features by plain sums and loops over lags."""
    n, rate = len(x), 16_000
    lag_of = lambda w, lo, hi: max(((float(w[k:] @ w[: len(w) - k]) / (float(w @ w) + 1e-12), -k) for k in range(lo, min(hi, len(w) - 1) + 1)), default=(0, 0))
    f0 = []
    for s in range(0, n - 1023, 512):
        c, k = lag_of(x[s : s + 1024], 13, 320) if x[s : s + 1024] @ x[s : s + 1024] >= 1e-6 else (0, -1)
        f0.append(rate / -k if c >= 0.45 else None)
    voiced = sorted(v for v in f0 if v)
    env = np.array([np.sqrt((x[s : s + 64] ** 2).mean()) for s in range(0, n - 63, 32)])
    env = env - env.mean()
    c, k = lag_of(env, 11, 34) if len(env) >= 64 and env @ env >= 1e-12 else (0, 0)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(512) / 511)
    basis = np.exp(-2j * np.pi * np.outer(np.arange(3, 257), np.arange(512)) / 512)
    power = np.mean([np.abs(basis @ (x[s : s + 512] * hann)) ** 2 for s in range(0, n - 511, 256)], 0) + 1e-12
    hz, in_order = np.arange(3, 257) * rate / 512, [v for v in f0 if v]
    return {
        "durations": n / rate, "rms": float(np.sqrt((x**2).mean())), "f0hz": (voiced[(len(voiced) - 1) // 2] + voiced[len(voiced) // 2]) / 2 if voiced else None,
        "f0starthz": in_order[0] if voiced else None, "f0endhz": in_order[-1] if voiced else None, "f0rangehz": voiced[-1] - voiced[0] if voiced else 0, "voicedratio": len(voiced) / len(f0),
        "spectralcentroidhz": float(hz @ power / power.sum()), "spectralflatness": min(1, float(np.exp(np.log(power).mean()) / power.mean())),
        "zerocrossingrate": sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:], strict=False)) * rate / n, "amratehz": 500 / -k if c >= 0.2 else None, "amstrength": min(1, max(0, c)),
    }


def test_feature_records_against_plain_loops(spark, sf):
    rows = QUERIES["feature_record"](spark, sf).collect()
    assert rows
    for r in rows:
        x, error = audio.decode(signal.tone_clip(int(r.path[5:-4])))
        assert error is None
        x = x * (0.891 / np.abs(x).max())
        parts = sorted(((-float(x[s:e] @ x[s:e]), s, e) for s, e in audio.found(x)))
        _, s, e = parts[r.place]
        for name, want in plain_features(x[s:e]).items():
            assert r[name] == (None if want is None else pytest.approx(want, rel=1e-3, abs=2e-4)), (r.path, name)


def test_wav_kinds():
    t = np.arange(8000) / 8000
    x = 0.5 * np.sin(2 * np.pi * 200 * t)

    def wav(kind, bits, raw, channels=1, extensible=False):
        head = (0xFFFE if extensible else kind, channels, 8000, 8000 * channels * bits // 8, channels * bits // 8, bits)
        fmt = struct.pack("<HHIIHH", *head) + (struct.pack("<HHIH", 22, bits, 0, kind) + bytes(14) if extensible else b"")
        body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(raw)) + raw
        return b"RIFF" + struct.pack("<I", len(body)) + body

    made = {
        8: wav(1, 8, (x * 127 + 128).round().astype(np.uint8).tobytes()), 16: wav(1, 16, (x * 32767).astype("<i2").tobytes(), extensible=True),
        24: wav(1, 24, b"".join(int(v * (2**23 - 1)).to_bytes(3, "little", signed=True) for v in x)), 32: wav(1, 32, (x * (2**31 - 1)).astype("<i4").tobytes()),
        -32: wav(3, 32, x.astype("<f4").tobytes()), -64: wav(3, 64, np.repeat(x, 2).tobytes(), channels=2),
    }
    for bits, data in made.items():
        got, rate = audio.samples(data)
        assert rate == 8000 and np.allclose(got, x, atol=0.02 if bits == 8 else 1e-4), bits
        whole, error = audio.decode(data)
        assert error is None and len(whole) == 16_000
    assert np.allclose(audio.resampled(x, 8000), 0.5 * np.sin(2 * np.pi * 200 * np.arange(16_000) / 16_000), atol=1e-6)
    high = np.sin(2 * np.pi * 11_000 * np.arange(48_000) / 48_000)
    assert np.abs(audio.resampled(high, 48_000)).max() < 1e-6  # not folded back to 5 kHz
    assert audio.decode(None)[1] == audio.decode(wav(2, 4, b"xx"))[1] == audio.decode(wav(3, 32, b"\xff" * 80_000))[1] == "audio/decode-failed"


def test_clips_become_sessions(spark, sf):
    rows = {int(r.path.split("-")[1].split(".")[0]): r for r in QUERIES["analyze_audio"](spark, sf).collect()}
    n = spark.read.parquet(f"{sf}/supplier.parquet").count()
    assert sorted(rows) == list(range(n))
    errors = {1: "audio/too-short", 3: "audio/too-long", 5: "audio/decode-failed", 7: "audio/decode-failed"}
    for i, r in rows.items():
        want = "audio/too-large" if i == 9 else errors.get(i % 10, None if i % 3 else "analysis/no-vocalization")
        assert r.error == want, i
        if want:
            assert r.message and r.cls is None and r.id is None and not r.stored and r.audio_key is None
            continue
        x = audio.decode(signal.tone_clip(i))[0]
        x = x * (0.891 / np.abs(x).max())
        s, e = max(audio.found(x), key=lambda p: float(x[p[0] : p[1]] @ x[p[0] : p[1]]))
        f = plain_features(x[s:e])
        one_row = spark.createDataFrame([tuple(None if f[k] is None else float(f[k]) for k in ("durations", "f0hz", "f0starthz", "f0endhz", "f0rangehz", "voicedratio", "spectralcentroidhz", "spectralflatness", "amratehz", "amstrength"))], ", ".join(f"{k} double" for k in S.FEATURES))
        c = one_row.select(S.unknown_policy(S.classification(S.ranked(S.distribution(S.rule_scores())))).alias("c")).first().c
        assert (r.cls, r.certainty, r.ambiguous) == (c.primary.cls, c.certainty, c.ambiguous) and r.probability == pytest.approx(c.primary.probability, abs=1e-4)
        assert (r.start, r.end) == (pytest.approx(s / 16_000, abs=1e-4), pytest.approx(e / 16_000, abs=1e-4))
        assert r.stored == (i % 4 != 0) and (r.audio_key is not None) == (i % 4 != 0 and i % 3 == 0)


def test_late_state_ends_and_order_does_not_matter(spark, tmp_path):
    """Files in any order of time within the delay give what one file gives."""
    rows = [(i, i % 3, 1_704_067_200_000 + i * 600_000) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ms long").select("event_id", "user_id", F.timestamp_millis("ms").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "one/events.parquet"))
    df.orderBy("event_id").repartitionByRange(6, "event_id").sortWithinPartitions(F.desc("event_id")).write.parquet(str(tmp_path / "many/events.parquet"))
    got = [sorted(map(tuple, jobs.rate_limits(spark, str(tmp_path / d), 2, 7_200_000).collect())) for d in ("one", "many")]
    assert len(got[0]) == 120 and [g[0] for g in got[0]] == list(range(120))
    assert len(got[1]) == 120
