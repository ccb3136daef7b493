"""Queries of array signals; an embedding stands in for a frame of 64 samples."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.functions import signals as G
from vocalith.sources import audio


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


def _long(df: DataFrame, x: str, value: str) -> DataFrame:
    rows = df.select("vec_id", F.posexplode(x).alias("i", "v"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias(value))


def frame_peak_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _frames(spark, sf_dir).withColumn("top", G.peak(F.col("x")))
    return _long(df.select("vec_id", G.normalized(F.col("x"), F.col("top")).alias("y")), "y", "sample")


def frame_rms_zcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _frames(spark, sf_dir).select("vec_id", F.round(G.rms(x), 6).alias("rms"), F.round(G.crossings(x), 6).alias("zcr"), F.round(G.peak(x), 6).alias("level"))


def framed_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _frames(spark, sf_dir).select("vec_id", F.transform(G.framed(F.col("x"), 16, 8), G.rms).alias("r"))
    return _long(df, "r", "rms")


def _kernel(df: DataFrame, make: object, spec: str) -> DataFrame:
    """``make`` of a matrix of frames, a batch at a time, gives a list of columns."""
    names = [c.split()[0] for c in spec.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame(dict(zip(names, (b.vec_id, *make(np.stack(b.x.to_numpy()))), strict=True)))

    return df.mapInPandas(run, spec)


def power_spectrum_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_kernel(_frames(spark, sf_dir), lambda x: [list(G.power(x))], "vec_id long, p array<double>"), "p", "power")


def spectral_centroid_flatness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over bins 3 to 32 of one 64-sample frame."""

    def make(x: np.ndarray) -> list:
        p = G.power(x)[:, 3:] + 1e-12
        hz = np.arange(3, 33) * G.RATE / 64
        return [(p @ hz / p.sum(1)).round(4), np.minimum(1, np.exp(np.log(p).mean(1)) / (p.mean(1) + 1e-12)).round(6)]

    return _kernel(_frames(spark, sf_dir), make, "vec_id long, centroid double, flatness double")


def autocorr_best_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(x: np.ndarray) -> list:
        both = [G.best_lag(row, (2, 20)) for row in x]
        return [[b[0] for b in both], np.round([b[1] for b in both], 6)]

    return _kernel(_frames(spark, sf_dir), make, "vec_id long, lag long, corr double")


def _wav(x: np.ndarray, rate: int = G.RATE, channels: int = 1) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.repeat(np.clip(x, -1, 1), channels) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def tone_clip(i: int) -> bytes:
    """A clip of silence, one burst or two, at a pitch that grows with ``i``, with a little seeded noise
    around the bursts."""
    rate, channels = (G.RATE, 1) if i % 2 else (8_000, 2)
    t = np.arange(int(rate * 2.4)) / rate
    on = sum(((t >= s) & (t < s + 0.5)).astype(float) for s in (0.5, 1.6)[: i % 3])
    x = 0.5 * np.sin(2 * np.pi * (300 + 20 * (i % 20)) * t) * on + (0.001 if i % 3 else 0.0) * np.random.default_rng(i).standard_normal(len(t))
    return _wav(x, rate, channels)


#: Clips of a task, and of a batch that a task makes at once; a clip has up to some 0.7 MB.
TASK_CLIPS, BATCH_CLIPS = 256, 32


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip's ``label`` for each supplier, dealt to tasks by number: a file of few bytes makes very many clips, which would all fall to the task that reads it."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("label"))
    return s.repartition(max(spark.sparkContext.defaultParallelism, -(-s.count() // TASK_CLIPS)))


def clips_of(rows: DataFrame, make: Callable[[int], tuple[str, bytes]]) -> DataFrame:
    """path and content that ``make`` gives for each ``label``, a few at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), BATCH_CLIPS):
                yield pd.DataFrame([make(int(i)) for i in b.label[at : at + BATCH_CLIPS]], columns=["path", "content"])

    return rows.mapInPandas(run, "path string, content binary")


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips_of(labels(spark, sf_dir), lambda i: (f"clip-{i}.wav", tone_clip(i)))


def wav_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = audio.analyze(_clips(spark, sf_dir)).select("path", "error", "duration", F.posexplode_outer("segments").alias("place", "s"))
    return df.select("path", "error", F.round("duration", 4).alias("duration"), "place", *[F.round(F.col(f"s.{c}"), 4).alias(c) for c in ("start", "end")], *[F.round(f"s.features.{c}", 4).alias(c.lower()) for c in ("f0Hz", "voicedRatio", "spectralCentroidHz")])


def feature_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve features of each segment of each clip, best segment first."""
    df = audio.analyze(_clips(spark, sf_dir)).select("path", F.posexplode("segments").alias("place", "s"))
    names = [f.name for f in df.schema["s"].dataType["features"].dataType.fields]
    return df.select("path", "place", *[F.round(f"s.features.{c}", 4).alias(c.lower()) for c in names])


def log_mel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each band of each clip's standardized log-mel picture."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b.path, "bands": [G.log_mel(audio.decode(c)[0]).mean(0).round(6).tolist() for c in b.content]})

    rows = _clips(spark, sf_dir).mapInPandas(run, "path string, bands array<double>")
    return rows.select("path", F.posexplode("bands").alias("band", "mean"))


QUERIES = {f.__name__: f for f in (frame_peak_normalize, frame_rms_zcr, framed_rms, power_spectrum_64, spectral_centroid_flatness, autocorr_best_lag, wav_segments, feature_record, log_mel)}

_X = "x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_HANN = "(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 63))"
_POWER = f"""{_X}, p AS (
    SELECT vec_id, k AS i, pow(sum(v * {_HANN} * cos(2 * pi() * k * i / 64)), 2) + pow(sum(v * {_HANN} * sin(2 * pi() * k * i / 64)), 2) AS p
    FROM x, range(33) t(k) GROUP BY vec_id, k)"""

ORACLE_SQL = {
    "frame_peak_normalize": f"WITH {_X} SELECT vec_id, i, round(CASE WHEN top < 0.000001 THEN v ELSE v * 0.891::DOUBLE / top END, 6) AS sample FROM (SELECT *, max(abs(v)) OVER (PARTITION BY vec_id) AS top FROM x)",
    "frame_rms_zcr": f"""WITH {_X}, l AS (SELECT *, lag(v) OVER (PARTITION BY vec_id ORDER BY i) AS u FROM x)
        SELECT vec_id, round(sqrt(avg(v * v)), 6) AS rms, round(count(*) FILTER (i > 0 AND (v >= 0) <> (u >= 0)) / (64 / 16000::DOUBLE), 6) AS zcr, round(max(abs(v)), 6) AS level FROM l GROUP BY vec_id""",
    "framed_rms": f"WITH {_X} SELECT vec_id, f AS i, round(sqrt(sum(v * v) / 16), 6) AS rms FROM x, range(7) t(f) WHERE i >= f * 8 AND i < f * 8 + 16 GROUP BY vec_id, f",
    "power_spectrum_64": f"WITH {_POWER} SELECT vec_id, i, round(p, 6) AS power FROM p",
    "spectral_centroid_flatness": f"""WITH {_POWER}, q AS (SELECT vec_id, i, p + 1e-12 AS p FROM p WHERE i >= 3)
        SELECT vec_id, round(sum(i * 250 * p) / sum(p), 4) AS centroid, round(least(1, exp(avg(ln(p))) / (avg(p) + 1e-12)), 6) AS flatness FROM q GROUP BY vec_id""",
    "autocorr_best_lag": f"""WITH {_X}, e AS (SELECT vec_id, sum(v * v) + 1e-12 AS e FROM x GROUP BY vec_id),
        c AS (SELECT a.vec_id, k, sum(a.v * b.v) AS c FROM x a JOIN range(2, 21) t(k) ON true JOIN x b ON b.vec_id = a.vec_id AND b.i = a.i + k GROUP BY a.vec_id, k),
        m AS (SELECT vec_id, k, c / e AS c FROM c JOIN e USING (vec_id))
        SELECT vec_id, CASE WHEN max(c) > 0 THEN arg_max(k, struct_pack(c := round(c, 12), k := -k)) ELSE 0 END AS lag, round(greatest(max(c), 0), 6) AS corr FROM m GROUP BY vec_id""",
}
