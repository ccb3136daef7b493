"""Calls of a parametric family for each class, from the draws of ``generators`` in whole arrays.

A call is a duration, a course of its frequency, harmonics and an envelope, all drawn; it is put into a
window of silence and noise is added.  Since any draw can be had by its number, those of a call are
taken in blocks and never one by one.
"""

from __future__ import annotations

import numpy as np

from vocalith.functions.generators import RATE, STEP
from vocalith.functions.scoring import CLASSES

# A window, and of each class the seconds, whether they are cut to the window, the base frequency and the harmonics.
WINDOW = 95 * 256 + 512
LEVEL, NOISE = 0.7, 0.005
FAMILY = {
    "feliz_contento": ((0.8, 2.5), True, (250, 650), (1.0, 0.4, 0.15)),
    "trinos": ((0.2, 0.9), False, (450, 800), (1.0, 0.4)),
    "enfadado": ((0.8, 1.5), True, (70, 180), (1.0, 0.8, 0.6, 0.45, 0.3)),
    "pelea": ((0.5, 2.0), False, (300, 800), (1.0, 0.6, 0.3)),
    "llamada_madre": ((0.3, 1.5), False, (500, 700), (1.0, 0.3)),
    "llamada_apareamiento": ((1.2, 2.5), True, (250, 450), (1.0, 0.5)),
    "dolor": ((0.3, 1.5), False, (500, 1000), (1.0, 0.3, 0.15)),
    "descansando": ((1.5, 3.0), True, (60, 140), (1.0, 0.4)),
    "advertencia": ((0.3, 1.0), False, (0.5, 0.8), ()),
    "atencion": ((0.3, 1.2), False, (350, 700), (1.0, 0.5, 0.25)),
}


class Draws:
    """The draws of a seed, taken in order."""

    def __init__(self, seed: int):
        self.seed, self.at = seed, 0

    def take(self, n: int) -> np.ndarray:
        i = np.arange(self.at + 1, self.at + n + 1, dtype=np.uint64)
        self.at += n
        low = np.uint64(0xFFFFFFFF)
        s = (np.uint64(self.seed % (1 << 32)) + i * np.uint64(STEP)) & low
        s = (s ^ s >> np.uint64(15)) * (s | np.uint64(1)) & low
        s ^= (s + (s ^ s >> np.uint64(7)) * (s | np.uint64(61))) & low
        return (s ^ s >> np.uint64(14)) / float(1 << 32)

    def between(self, low: float, high: float) -> float:
        return low + (high - low) * float(self.take(1)[0])

    def normal(self, n: int) -> np.ndarray:
        u, v = self.take(2 * n).reshape(-1, 2).T
        return np.sqrt(-2 * np.log(np.maximum(u, 1e-12))) * np.cos(2 * np.pi * v)


def _wobble(d: Draws, base: float, n: int, depth: tuple[float, float], speed: tuple[float, float]) -> np.ndarray:
    """A frequency that is drawn anew for each sample."""
    u, v = d.take(2 * n).reshape(-1, 2).T
    swing, rate = depth[0] + (depth[1] - depth[0]) * u, speed[0] + (speed[1] - speed[0]) * v
    return base + swing * np.sin(2 * np.pi * rate * np.arange(n) / RATE)


def _course(cls: str, d: Draws, base: float, n: int) -> np.ndarray:
    """The frequency of each sample."""
    i, part = np.arange(n), np.arange(n) / max(1, n - 1)
    if cls == "trinos":
        depth, speed = d.between(80, 200), d.between(15, 30)
        return base + depth * np.sin(2 * np.pi * speed * i / RATE)
    if cls == "enfadado":
        return np.clip(base * (1 + np.cumsum(0.02 * d.normal(n)) / np.sqrt(i + 1)), 50, 300)
    if cls == "pelea":
        return _wobble(d, base, n, (-200, 300), (3, 8))
    if cls == "dolor":
        return _wobble(d, base, n, (-100, 200), (4, 10))
    if cls == "llamada_madre":
        return base + (d.between(250, 450) - base) * part
    if cls == "llamada_apareamiento":
        top, end = d.between(600, 900), d.between(300, 500)
        return base + (top - base) * np.sin(np.pi * part) + (end - base) * part
    if cls == "atencion":
        return base * (1 + d.between(0.05, 0.25) * part)
    return np.full(n, base)


def call(cls: str, seed: int) -> np.ndarray:
    """A window of samples, as floats of 32 bits, with a call of class ``cls``."""
    seconds, cut, first, harmonics = FAMILY[cls]
    d = Draws(seed)
    n = int(d.between(*seconds) * RATE)
    n = min(n, WINDOW) if cut else n
    base = d.between(*first)
    if harmonics:
        turn = 2 * np.pi * np.cumsum(_course(cls, d, base, n)) / RATE
        phases = 2 * np.pi * d.take(len(harmonics))
        x = sum(a * np.sin((k + 1) * turn + p) for k, (a, p) in enumerate(zip(harmonics, phases, strict=True)))
    else:  # a hiss
        white = d.normal(n)
        x = white - base * np.concatenate([[0.0], white[:-1]])
    if cls == "descansando":
        speed, phase = d.between(20, 35), d.between(0, 2 * np.pi)
        x = x * 0.7 * 0.5 * (1 + np.sin(2 * np.pi * speed * np.arange(n) / RATE + phase))
    rise, fall = (max(1, int(n * d.between(*part))) for part in ((0.05, 0.15), (0.1, 0.3)))
    shape = np.ones(n)
    shape[:rise] = np.arange(rise) / rise
    shape[n - fall :] *= np.arange(fall)[::-1] / fall
    out, room = np.zeros(WINDOW), WINDOW - n
    start = int(d.between(0.2, 0.8) * room) if room > 0 else 0
    out[start : start + n] = (x * shape)[: WINDOW - start]
    top = np.abs(out).max()
    return (out * (LEVEL / top if top > 1e-9 else 0) + NOISE * d.normal(WINDOW)).astype(np.float32)


def evaluation(seeds: range) -> list[tuple[str, int, np.ndarray]]:
    """A call of each class for each seed."""
    return [(cls, seed, call(cls, seed * len(CLASSES) + i)) for seed in seeds for i, cls in enumerate(FAMILY)]
