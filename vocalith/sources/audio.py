"""Audio clips: reading, decoding, segmentation and features, a clip to a row.

All of the usual containers are accepted; WAV (PCM of 8 to 32 bits and floats) and FLAC are
decoded, and other codecs, for which the library has no decoder, end as decode-failed.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.functions import signals as G
from vocalith.operators import segments as V
from vocalith.sources import flac

# What is accepted.
EXTENSIONS = ("wav", "mp3", "m4a", "aac", "ogg", "oga", "opus", "webm", "flac")
MOST_BYTES = 12 * 1024 * 1024
SHORTEST_S, LONGEST_S = 0.5, 20.0
FEATURES = "durationS double, rms double, f0Hz double, f0StartHz double, f0EndHz double, f0RangeHz double, voicedRatio double, spectralCentroidHz double, spectralFlatness double, zeroCrossingRate double, amRateHz double, amStrength double"
CLIP = f"path string, error string, duration double, segments array<struct<start:double,end:double,energy:double,features:struct<{FEATURES.replace(' ', ':').replace(',:', ',')}>>>"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content and error of the accepted files; those that are too large are not read and have an error instead."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    df = df.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*EXTENSIONS))
    none = F.lit(None)
    large = df.where(F.col("length") > MOST_BYTES).select("path", none.cast("binary").alias("content"), F.lit("audio/too-large").alias("error"))
    return df.where(F.col("length") <= MOST_BYTES).select("path", "content", none.cast("string").alias("error")).union(large)


def _write(fs: pafs.FileSystem, path: str, content: bytes) -> None:
    """Write a file; zeros at the end of a local one are left as a hole, which reads the same and takes no room on the disk."""
    if not isinstance(fs, pafs.LocalFileSystem):
        with fs.open_output_stream(path, compression=None) as out:
            out.write(content)
        return
    with open(path, "wb") as out:
        out.write(content.rstrip(b"\0"))
        out.truncate(len(content))


def save(rows: DataFrame, make: Callable[[int], tuple[str, bytes]], folder: str) -> int:
    """Write the clip (a file name and its bytes) that ``make`` gives for each ``label`` to ``folder``, one at a time, and return their number."""
    df = rows.select("label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for label in batch.column(0).to_pylist():
                path, content = make(label)
                _write(fs, f"{base}/{path}", content)
            yield batch

    return df.mapInArrow(run, df.schema).count()


def _chunks(data: bytes) -> dict[bytes, bytes]:
    out, at = {}, 12
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        out.setdefault(name, data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return out


def samples(data: bytes) -> tuple[np.ndarray, int]:
    """The mono samples of a WAV or FLAC file, between -1 and 1, and their rate."""
    if data[:4] == b"fLaC":
        x, rate, bits = flac.samples(data, LONGEST_S)
        return x.mean(1) / float(1 << (bits - 1)), rate
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    parts = _chunks(data)
    kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", parts[b"fmt "])
    if kind == 0xFFFE:  # the kind stands at the head of the extension's identifier
        kind = struct.unpack_from("<H", parts[b"fmt "], 24)[0]
    raw, width = parts[b"data"], bits // 8
    if not channels or not rate or (kind, bits) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)}:
        raise ValueError("not a kind of samples that is known")
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if kind == 3:
        x = np.frombuffer(raw, f"<f{width}").astype(np.float64)
    elif bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif bits == 24:
        x = (np.pad(np.frombuffer(raw, np.uint8).reshape(-1, 3), ((0, 0), (1, 0))).copy().view("<i4").ravel() >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}") / float(1 << (bits - 1))
    return x.reshape(-1, channels).mean(1), rate


def resampled(x: np.ndarray, rate: int, to: int = G.RATE) -> np.ndarray:
    """``x`` at another rate, by its spectrum, so that nothing above half of the new rate is folded back."""
    if rate == to or not len(x):
        return x
    n = int(np.ceil(len(x) * to / rate))
    spectrum, keep = np.fft.rfft(x), min(len(x), n) // 2 + 1
    made = np.zeros(n // 2 + 1, complex)
    made[:keep] = spectrum[:keep]
    return np.fft.irfft(made, n) * (n / len(x))


def decode(data: bytes | None) -> tuple[np.ndarray, str | None]:
    """Mono samples at 16 kHz, or the reason why there are none."""
    try:
        x, rate = samples(data or b"")
    except (ValueError, KeyError, struct.error):
        return np.zeros(0), "audio/decode-failed"
    if not np.isfinite(x).all():
        return np.zeros(0), "audio/decode-failed"
    if len(x) / rate < SHORTEST_S:
        return np.zeros(0), "audio/too-short"
    if len(x) / rate > LONGEST_S:
        return np.zeros(0), "audio/too-long"
    return resampled(x, rate), None


def found(x: np.ndarray) -> list[tuple[int, int]]:
    """The segments of one clip, by the rules of ``operators.segments``."""
    level = np.sqrt((G.windows(x, G.SIZE, G.HOP) ** 2).mean(1)) if len(x) >= G.SIZE else np.zeros(0)
    if not len(level):
        return []
    ordered = np.sort(level)
    q = lambda p: ordered[min(len(level) - 1, int(p * len(level)))]
    hit = level >= max(q(0.1) + 0.25 * (q(0.95) - q(0.1)), V.FLOOR)
    on = np.convolve(hit, np.ones(V.HANGOVER + 1))[: len(hit)] > 0
    edges = np.flatnonzero(np.diff(np.r_[0, on.astype(int), 0]))
    runs: list[list[int]] = []
    for s, e in zip(edges[::2], edges[1::2], strict=True):
        if runs and s - runs[-1][1] <= V.GAP:
            runs[-1][1] = int(e)
        else:
            runs.append([int(s), int(e)])
    out = []
    for s, e in runs:
        if e - s >= V.SHORTEST:
            start = max(0, s * V.HOP - V.PAD)
            out.append((start, min(min(len(x), e * V.HOP + V.SIZE + V.PAD), start + V.LONGEST)))
    return out


def analyze(clips: DataFrame) -> DataFrame:
    """path, error, duration and segments (the one of most energy first, with features) of clips (path, content and maybe an error)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data, known in zip(batch.path, batch.content, batch.error, strict=True):
                x, error = (np.zeros(0), known) if known else decode(data)
                parts = []
                if error is None:
                    top = np.abs(x).max(initial=0.0)
                    x = x * (G.PEAK / top) if top >= 1e-6 else x
                    parts = sorted(((float(x[s:e] @ x[s:e]), s, e) for s, e in found(x)), key=lambda p: (-p[0], p[1]))
                    error = None if parts else "analysis/no-vocalization"
                made = [{"start": s / G.RATE, "end": e / G.RATE, "energy": n, "features": G.record(x[s:e])} for n, s, e in parts]
                rows.append((path, error, len(x) / G.RATE, made))
            yield pd.DataFrame(rows, columns=["path", "error", "duration", "segments"])

    error = F.col("error") if "error" in clips.columns else F.lit(None).cast("string").alias("error")
    return clips.select("path", "content", error).mapInPandas(run, CLIP)
