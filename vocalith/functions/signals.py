"""Array signal functions: Column forms for short frames, numpy kernels for whole clips."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the signal path.
RATE, SIZE, HOP, PEAK = 16_000, 512, 256, 0.891
F0_FRAME, F0_HOP, F0_LAGS, VOICED = 1024, 512, (13, 320), 0.45
AM_FRAME, AM_HOP, AM_LAGS, AM_LEAST = 64, 32, (11, 34), 0.2


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def normalized(x: Column, top: Column) -> Column:
    """``x`` scaled so that its peak ``top`` becomes ``PEAK``; silence stays as it is."""
    return F.when(top < 1e-6, x).otherwise(F.transform(x, lambda v: v * PEAK / top))


def rms(x: Column) -> Column:
    return F.sqrt(total(F.transform(x, lambda v: v * v)) / F.greatest(F.size(x), F.lit(1)))


def crossings(x: Column, rate: int = RATE) -> Column:
    """Zero crossings a second."""
    flips = F.filter(F.zip_with(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), x, lambda b, a: (b >= 0) != (a >= 0)), lambda v: F.coalesce(v, F.lit(False)))
    return F.when(F.size(x) < 2, 0.0).otherwise(F.size(flips) / (F.size(x) / rate))


def framed(x: Column, size: int, hop: int) -> Column:
    n = F.floor((F.size(x) - size) / hop).cast("int")
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda f: F.slice(x, f * hop + 1, size))).otherwise(F.array().cast("array<array<double>>"))


def power(frames: np.ndarray) -> np.ndarray:
    """Power spectra of Hann-windowed rows, whose length is a power of two."""
    n = frames.shape[-1]
    if n & (n - 1):
        raise ValueError("the frame length must be a power of two")
    return np.abs(np.fft.rfft(frames * np.hanning(n), axis=-1)) ** 2


def windows(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    if len(x) < size:
        return np.zeros((0, size))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def best_lag(x: np.ndarray, lags: tuple[int, int]) -> tuple[int, float]:
    """The first lag of the greatest autocorrelation against the lag-0 energy, 0 if none is positive."""
    n = len(x)
    f = np.fft.rfft(x, 1 << (2 * n - 1).bit_length())
    c = np.fft.irfft(f * np.conj(f))[: n]
    part = c[lags[0] : min(lags[1] + 1, n)] / (float(x @ x) + 1e-12)
    at = int(part.argmax()) if len(part) else 0
    return (lags[0] + at, float(part[at])) if len(part) and part[at] > 0 else (0, 0.0)


def pitch(x: np.ndarray) -> list[float | None]:
    out: list[float | None] = []
    for w in windows(x, F0_FRAME, F0_HOP):
        lag, c = best_lag(w, F0_LAGS) if w @ w >= 1e-6 else (0, 0.0)
        out.append(RATE / lag if lag and c >= VOICED else None)
    return out


def modulation(x: np.ndarray) -> tuple[float | None, float]:
    env = np.sqrt((windows(x, AM_FRAME, AM_HOP) ** 2).mean(1)) if len(x) >= AM_FRAME else np.zeros(0)
    centred = env - env.mean() if len(env) else env
    if len(env) < 64 or centred @ centred < 1e-12:
        return None, 0.0
    lag, c = best_lag(centred, AM_LAGS)
    return (None, max(0.0, c)) if not lag or c < AM_LEAST else (RATE / AM_HOP / lag, min(1.0, c))


def shape(x: np.ndarray) -> tuple[float, float]:
    """Spectral centroid and flatness over bins 3 to 256 of the mean spectrum."""
    w = windows(x, SIZE, HOP)
    if not len(w):
        return 0.0, 1.0
    p = power(w).mean(0)[3:257] + 1e-12
    hz = np.arange(3, 257) * RATE / SIZE
    return float(hz @ p / p.sum()), min(1.0, float(np.exp(np.log(p).mean()) / (p.mean() + 1e-12)))


def record(x: np.ndarray) -> dict:
    """The twelve features of a segment."""
    f0 = pitch(x)
    voiced = [v for v in f0 if v is not None]
    rate, strength = modulation(x)
    centroid, flatness = shape(x)
    return {
        "durationS": len(x) / RATE, "rms": float(np.sqrt((x @ x) / max(1, len(x)))), "f0Hz": float(np.median(voiced)) if voiced else None,
        "f0StartHz": voiced[0] if voiced else None, "f0EndHz": voiced[-1] if voiced else None, "f0RangeHz": max(voiced) - min(voiced) if voiced else 0.0,
        "voicedRatio": len(voiced) / len(f0) if f0 else 0.0, "spectralCentroidHz": centroid, "spectralFlatness": flatness,
        "zeroCrossingRate": float(((x[1:] >= 0) != (x[:-1] >= 0)).sum() / (len(x) / RATE)) if len(x) > 1 else 0.0, "amRateHz": rate, "amStrength": strength,
    }


def mel_filters(bands: int, low: float = 50.0, high: float = 8000.0) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, over the bins of a frame's spectrum."""
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(mel(low), mel(high), bands + 2) / 2595) - 1) * SIZE / RATE
    k = np.arange(SIZE // 2 + 1)[None]
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((k - lo) / (mid - lo), (hi - k) / (hi - mid)))


def log_mel(x: np.ndarray, bands: int = 64, frames: int = 96) -> np.ndarray:
    """Standardized log energies, cut in the middle if long and padded at the end if short."""
    need = (frames - 1) * HOP + SIZE
    start = max(0, (len(x) - need) // 2)
    x = np.pad(x[start : start + need], (0, max(0, need - len(x))))
    m = np.log(power(windows(x, SIZE, HOP)) @ mel_filters(bands).T + 1e-6)
    return (m - m.mean()) / (m.std() + 1e-6)
